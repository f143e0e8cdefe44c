"""Formats of date texts, found from the texts: one aggregate judges all formats of all columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.expressions import quoted

_TIME = "[ H:mm[:ss]]"
#: Formats that read a text in one way only.
PLAIN = (
    f"yyyy-M-d{_TIME}", "yyyy-M-d'T'H:mm[:ss][X]", f"yyyy/M/d{_TIME}", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy",
)
#: (month first, day first): texts such as 3/4/2024 can be read by both.
TWOFOLD = tuple((f"M{s}d{s}yyyy{_TIME}", f"d{s}M{s}yyyy{_TIME}") for s in "/-.")


@dataclass(frozen=True)
class DateFormats:
    """How the texts of a column are read: the formats in the order in which they are tried."""

    formats: tuple[str, ...]
    texts: int  # texts in the column
    unread: int  # texts that no format reads
    undecided: int  # texts that both orders of day and month read, where no other text decides
    conflicting: int  # texts that only the other order of day and month reads


def _may_read(text: Column, fmt: str) -> Column:
    """False only for texts that lack what the format cannot do without: parsing one in vain costs far more."""
    if fmt == "yyyyMMdd":
        return ~F.contains(text, F.lit("/")) & ~F.contains(text, F.lit(" ")) & ~F.contains(text, F.lit("."))
    return F.contains(text, F.lit(next(mark for mark in ",-/. " if mark in fmt.removesuffix(_TIME))))


def _read(column: Column, fmt: str) -> Column:
    text = F.trim(column)
    return F.when(_may_read(text, fmt), F.try_to_timestamp(text, F.lit(fmt)))


def infer_date_formats(
    df: DataFrame, columns: Sequence[str], day_first: bool = False, least_share: float = 0.0
) -> dict[str, DateFormats]:
    """Formats per text column, those that read most texts first.

    Of the two orders of day and month, the one that alone reads more texts is tried first; texts
    that both read follow it. Where nothing decides, ``day_first`` does, and texts with dots put
    the day first. A format that reads no text, or no more than ``least_share`` of them, is not used.
    """
    judged = []
    for i, name in enumerate(columns):
        text = F.col(f"text{i}")
        reads = [F.col(f"reads{i}")[j] for j in range(len(PLAIN))]
        pairs = [(F.col(f"reads{i}")[len(PLAIN) + 2 * j], F.col(f"reads{i}")[len(PLAIN) + 2 * j + 1]) for j in range(len(TWOFOLD))]
        any_read = F.exists(f"reads{i}", lambda found: found)
        judged += [F.count(text).alias(f"texts{i}"), F.count_if(text.isNotNull() & ~any_read).alias(f"unread{i}")]
        judged += [F.count_if(found).alias(f"plain{i}_{j}") for j, found in enumerate(reads)]
        for j, (month, day) in enumerate(pairs):
            judged += [
                F.count_if(month & ~day).alias(f"month{i}_{j}"),
                F.count_if(day & ~month).alias(f"day{i}_{j}"),
                F.count_if(day & month).alias(f"both{i}_{j}"),
            ]
    if not judged:
        return {}
    # every text is parsed once by each format, whatever counts it
    tried = [F.array(*[_read(quoted(name), f).isNotNull() for f in (*PLAIN, *[f for pair in TWOFOLD for f in pair])]) for name in columns]
    texts = [quoted(name).alias(f"text{i}") for i, name in enumerate(columns)]
    row = df.select(*texts, *[found.alias(f"reads{i}") for i, found in enumerate(tried)]).agg(*judged).first()
    result = {}
    for i, name in enumerate(columns):
        ranked = [(row[f"plain{i}_{j}"], 0, f) for j, f in enumerate(PLAIN)]
        undecided = conflicting = 0
        for j, (month_first, day_first_format) in enumerate(TWOFOLD):
            month, day, both = row[f"month{i}_{j}"], row[f"day{i}_{j}"], row[f"both{i}_{j}"]
            day_wins = day > month or (day == month and (day_first or "." in day_first_format))
            chosen, other = (day_first_format, month_first) if day_wins else (month_first, day_first_format)
            ranked += [(max(month, day) + both, 0, chosen), (min(month, day), 1, other)]
            undecided += both if month == day else 0
            conflicting += min(month, day)
        texts = row[f"texts{i}"]
        used = sorted((r for r in ranked if r[0] > least_share * texts), key=lambda r: (r[1], -r[0], r[2]))
        result[name] = DateFormats(tuple(f for *_, f in used), texts, row[f"unread{i}"], undecided, conflicting)
    return result


def parse_mixed(column: Column, formats: Sequence[str]) -> Column:
    """Timestamp of a text by the first format that reads it; NULL where none does."""
    return F.coalesce(*[_read(column, f) for f in formats]) if formats else F.lit(None).cast("timestamp")


def with_parsed_dates(df: DataFrame, found: Mapping[str, DateFormats]) -> DataFrame:
    """Text columns replaced by their timestamps."""
    return df.withColumns({name: parse_mixed(quoted(name), how.formats) for name, how in found.items()})

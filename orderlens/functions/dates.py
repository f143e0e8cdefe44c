"""Date parsing and date column detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of a column name that hint at a time axis.
DATE_WORDS = ["date", "time", "day", "month", "year"]


def parse_timestamp(column: Column, fmt: str | None = None) -> Column:
    """Timestamp of a text, NULL where it cannot be read."""
    return F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)


def date_candidates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(word in c.lower() for word in DATE_WORDS)]


def date_columns(df: DataFrame, share: float = 0.95) -> list[str]:
    """Candidates by name that are dates by type, or texts of which ``share`` can be read.

    All text candidates are judged in one aggregate.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    names = date_candidates(df)
    typed = [c for c in names if isinstance(kinds[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    texts = [c for c in names if isinstance(kinds[c], T.StringType)]
    readable: list[str] = []
    if texts:
        shares = df.agg(
            *[
                F.try_divide(F.count(parse_timestamp(F.col(f"`{c}`"))), F.count(F.col(f"`{c}`"))).alias(str(i))
                for i, c in enumerate(texts)
            ]
        ).first()
        readable = [c for i, c in enumerate(texts) if (shares[i] or 0.0) >= share]
    return [c for c in names if c in typed or c in readable]

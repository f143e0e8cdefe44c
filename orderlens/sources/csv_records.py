"""CSV files with line breaks inside quotes, read by many tasks.

A line break ends a record only where an even number of quotes precedes it in the file. One scan
counts, for every byte range that Spark reads as a unit, the lines with an odd number of quotes.
Their running sum over the ranges of a file tells each range whether it begins inside a quoted text.
A second scan then puts the lines of each range together into records. Only the pieces of a record that
crosses a range boundary are shuffled, two per boundary; they meet by the range in which it began.

What grows with the data on the driver's side is one row per byte range (``spark.sql.files.maxPartitionBytes``,
128 MB by default: 8,000 rows a TB). It is broadcast; no text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.session import cut_lineage

#: Encodings in which quotes, commas and line ends are single bytes, and that Spark decodes.
BYTEWISE = ("UTF-8", "ISO-8859-1", "US-ASCII")
_PIECES = ["record", "file", "start", "origin", "heads"]


@dataclass(frozen=True)
class Survey:
    """What one scan over the lines tells of a CSV path."""

    ranges: DataFrame  # file, start, odd: lines with an odd number of quotes
    valid_utf8: bool
    quoted_breaks: bool  # some text in quotes goes on in the next line
    lone_returns: bool  # some carriage return stands inside a line


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines by line feed, as raw bytes, each with its file and byte range, in the order of the range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def _odd(value: Column) -> Column:
    quotes = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    return quotes % 2 == 1


def survey(spark: SparkSession, path: str) -> Survey:
    """Count odd lines by byte range and look at the bytes, in one scan."""
    value = F.col("value")
    inner_return = F.instr(F.rtrim(value, F.lit("\r")), "\r") > 0
    found = _lines(spark, path).groupBy("file", "start").agg(
        F.count_if(_odd(value)).alias("odd"),
        F.count_if(~F.is_valid_utf8(value)).alias("bad"),
        F.count_if(inner_return).alias("returns"),
    )
    kept = cut_lineage(found)  # a row per range; later steps must see the very same ranges
    about = kept.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"),
        F.coalesce(F.sum("returns"), F.lit(0)).alias("returns"),
    ).first()
    return Survey(kept.select("file", "start", "odd"), about["bad"] == 0, about["odd"] > 0, about["returns"] > 0)


def _opened(ranges: DataFrame) -> DataFrame:
    """Per range: does it begin inside quotes, and in which range did the record at its beginning begin.

    A window over the ranges of one file, not over its rows.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd_before = F.coalesce(F.sum("odd").over(before), F.lit(0))
    return ranges.select(
        "file",
        "start",
        (odd_before % 2 == 1).alias("inside"),
        F.last(F.when(F.col("odd") > 0, F.col("start")), ignorenulls=True).over(before).alias("origin"),
        (F.row_number().over(Window.partitionBy("file").orderBy("start")) == 1).alias("leads"),
    )


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the byte ranges of one task, in order; pieces of records that cross a boundary are marked.

    Holds one batch and the lines of one unfinished record. ``origin`` names the range in which a
    crossing record began, null for a whole record; only crossing ones tell their file and range.
    """
    key: tuple[str, int] | None = None
    pending: list[str] = []  # lines of the record that is not finished yet
    inside = fresh = False
    origin: int | None = None

    def crossing(text: str, origin: int, first: bool) -> pa.RecordBatch:
        columns = [pa.array([text], pa.string()), pa.array([key[0]], pa.string()), pa.array([key[1]]), pa.array([origin]), pa.array([first])]
        return pa.RecordBatch.from_arrays(columns, _PIECES)

    def whole(texts: pa.Array, first: bool) -> pa.RecordBatch:
        heads = np.zeros(len(texts), dtype=bool)
        heads[:1] = first
        n = len(texts)
        return pa.RecordBatch.from_arrays([texts, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(heads)], _PIECES)

    def left_over() -> Iterator[pa.RecordBatch]:
        if pending:  # goes on in the next range, or the quotes of the file never close
            yield crossing("\n".join(pending), key[1] if origin is None else origin, fresh and origin is None)

    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, start, odd, begins_inside, began, leads = batch.columns
        place = start.to_numpy()
        changed = (np.diff(place) != 0) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist()]
        odd = odd.to_numpy(zero_copy_only=False)
        for low, high in zip(bounds, [*bounds[1:], len(batch)]):
            if (file[low].as_py(), int(place[low])) != key:
                yield from left_over()
                key, pending = (file[low].as_py(), int(place[low])), []
                inside, fresh = begins_inside[low].as_py(), leads[low].as_py()
                origin = began[low].as_py() if inside else None
            # after each line: inside quotes or not
            state = (np.cumsum(odd[low:high]) + inside) % 2
            ends = low + np.flatnonzero(state == 0) + 1
            at = low
            if len(ends) and (pending or origin is not None):  # the record that began before
                pending.extend(value[at : ends[0]].to_pylist())
                record, pending, at, ends = "\n".join(pending), [], int(ends[0]), ends[1:]
                if origin is not None:
                    yield crossing(record, origin, False)
                    origin = None
                elif record.rstrip("\r"):
                    yield whole(pa.array([record], pa.string()), fresh)
                    fresh = False
            if len(ends):
                limits = pa.array(np.concatenate([[at], ends]), pa.int32())
                texts = pc.binary_join(pa.ListArray.from_arrays(limits, value), "\n")
                texts = texts.filter(pc.not_equal(pc.utf8_rtrim(texts, "\r"), ""))
                if len(texts):
                    yield whole(texts, fresh)
                    fresh = False
                at = int(ends[-1])
            pending.extend(value[at:high].to_pylist())
            inside = bool(state[-1])
    yield from left_over()


def records(spark: SparkSession, path: str, ranges: DataFrame, encoding: str) -> DataFrame:
    """(record, heads): the records of all files under ``path``; ``heads`` marks the first one of a file.

    ``ranges`` come from ``survey``. If Spark cuts the files otherwise than it did then, as it may
    after a change of its settings, the job stops instead of joining the wrong pieces.
    """
    value = F.col("value")
    lines = _lines(spark, path).withColumn("odd", _odd(value))
    text = F.make_valid_utf8(value) if encoding == "UTF-8" else F.decode(value.cast("binary"), encoding)
    known = F.broadcast(_opened(ranges))
    unknown = F.raise_error(F.lit("the byte ranges of the files have changed since they were surveyed"))
    lines = lines.join(known, ["file", "start"], "left").select(
        text.alias("value"),
        "file",
        "start",
        "odd",
        F.coalesce("inside", unknown.cast("boolean")).alias("inside"),
        F.coalesce("origin", F.lit(0)).alias("origin"),
        "leads",
    )
    # both kinds of pieces, and every later pass, take them from one run over the lines
    pieces = lines.mapInArrow(_assembled, "record string, file string, start long, origin long, heads boolean")
    pieces = pieces.persist(StorageLevel.MEMORY_AND_DISK)
    whole = pieces.where(F.col("origin").isNull())
    crossing = pieces.where(F.col("origin").isNotNull()).groupBy("file", "origin").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.max("heads").alias("heads"),
    )
    found = whole.select("record", "heads").unionByName(crossing.select("record", "heads"))
    return found.select(F.regexp_replace("record", "\r$", "").alias("record"), "heads").where("record <> ''")


def well_formed(record: Column, separator: str = ",") -> Column:
    """Every quoted text of a record fills its field: no quote stands inside an unquoted value."""
    # a match takes two quotes with none between, so that no quote is left only if the first is paired with the second and so on
    single = F.replace(record, F.lit('""'), F.lit(""))
    rest = F.regexp_replace(single, rf'(\A|\Q{separator}\E)"[^"]*+"(?=\Q{separator}\E|\z)', "$1")
    return ~F.contains(rest, F.lit('"'))


def parsed(records: DataFrame, names: list[str]) -> DataFrame:
    """The fields of the records as text columns, without the header of each file."""
    places = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv("record", places, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("fields")
    rows = records.where(~F.col("heads")).select(fields).select("fields.*")
    return rows.toDF(*names)

"""Loading tables from files: format, encoding, types, names, checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.columns import SPELLINGS
from orderlens.functions.expressions import nan_to_null, quoted
from orderlens.sources import csv_records

# Texts that stand for a missing value in a CSV file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

FORMATS = {".csv": "csv", ".txt": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}


def format_of(path: str) -> str:
    """File format by extension; a name without a known one is taken as CSV."""
    name = path.rstrip("/").lower()
    for packed in (".gz", ".bz2"):
        name = name.removesuffix(packed)
    if name.endswith((".xlsx", ".xls")):
        raise ValueError("Excel files are read by one process only; export the sheet as CSV or parquet first")
    return next((fmt for ending, fmt in FORMATS.items() if name.endswith(ending)), "csv")


# How a whole number and a decimal number may be written.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the file is valid UTF-8, else ISO-8859-1, which decodes any byte.

    The text reader keeps the raw bytes, so this is one scan that stops at the first bad line.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header line. Without an encoding it is detected, without a schema inferred.

    A schema is matched by the names of the header, whatever the order of the columns; a name that
    the file lacks is an error. Without ``multi_line`` one scan finds the encoding and whether quoted
    texts hold line breaks; files that have them are read by many tasks (``csv_records``). With
    ``multi_line`` Spark's own reader takes such a file in one task. It is also taken where the text
    leaves no other way: quotes inside unquoted values, carriage returns inside lines, an encoding of
    several bytes a character other than UTF-8.
    """
    found = None
    if multi_line is None and (encoding is None or encoding.upper() in csv_records.BYTEWISE):
        found = csv_records.survey(spark, path)
        encoding = encoding or ("UTF-8" if found.valid_utf8 else "ISO-8859-1")
    breaks = found.quoted_breaks if found is not None else multi_line is not False
    reader = spark.read.option("header", True).option("encoding", encoding or detect_encoding(spark, path))
    texts = reader.option("escape", '"').option("multiLine", breaks).csv(path)
    if found is not None and breaks and not found.lone_returns:
        rows = csv_records.records(spark, path, found.ranges, encoding.upper())
        if rows.where(~csv_records.well_formed(F.col("record"))).isEmpty():
            texts = csv_records.parsed(rows, texts.columns)
    if schema is None:
        return infer_types(texts)
    absent = missing_columns(texts, schema.names)
    if absent:
        raise ValueError(f"columns of the schema are missing in the file: {absent}")
    return nan_to_null(texts.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema]))


def _value(name: str) -> Column:
    """A text of a file, NULL where it stands for a missing value."""
    return F.when(~F.trim(quoted(name)).isin(MISSING_TEXTS), quoted(name))


def _typed(name: str, kind: T.DataType) -> Column:
    """A text as a value of the given type; NULL if it is not written as one."""
    if isinstance(kind, T.StringType):
        return _value(name)
    pattern = WHOLE if isinstance(kind, T.IntegralType) else DECIMAL if isinstance(kind, T.NumericType) else None
    value = _value(name) if pattern is None else F.when(_value(name).rlike(pattern), F.trim(_value(name)))
    return value.try_cast(kind)


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns by what all their values allow: bigint, else double, else text.

    Missing-value texts become NULL first. A number must be written as one: codes such as ``1D``
    stay texts. All columns are judged in one aggregate.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return nan_to_null(df)
    whole, decimal = T.LongType(), T.DoubleType()
    judged = df.agg(
        *[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count(_typed(c, whole)).alias(f"l{i}") for i, c in enumerate(names)],
        *[F.count(_typed(c, decimal)).alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    types = {}
    for i, name in enumerate(names):
        filled = judged[f"n{i}"]
        types[name] = T.StringType() if not filled else whole if judged[f"l{i}"] == filled else decimal if judged[f"d{i}"] == filled else T.StringType()
    return nan_to_null(df.select(*[_typed(c, types[c]).alias(c) if c in types else quoted(c) for c in df.columns]))


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Load a table in the format its name says, check that it has rows."""
    fmt = format_of(path)
    if fmt == "csv":
        df = read_csv(spark, path, schema)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = nan_to_null(reader.format(fmt).load(path))
    check_table(df)
    return df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_table(df: DataFrame, required: Sequence[str] = ()) -> None:
    """Raise if a required column is missing or the table is empty."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    if df.isEmpty():
        raise ValueError("the table is empty")


def canonical_columns(df: DataFrame, spellings: Mapping[str, Sequence[str]] = SPELLINGS) -> DataFrame:
    """Rename each column found under one of its spellings to its canonical name."""
    renames = {}
    for name, choices in spellings.items():
        found = next((c for c in choices if c in df.columns), None)
        if found is not None:
            renames[found] = name
    return df.withColumnsRenamed(renames)


def display_columns(df: DataFrame, spellings: Mapping[str, Sequence[str]] = SPELLINGS) -> DataFrame:
    """Rename canonical columns to their first spelling, for files meant to be read by people."""
    return df.withColumnsRenamed({name: choices[0] for name, choices in spellings.items() if name in df.columns})


def keep_for_reuse(df: DataFrame) -> DataFrame:
    """Keep a table for several actions; what does not fit in memory goes to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

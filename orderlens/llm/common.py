"""What the operators of this subpackage share: picking columns, splits, bounded samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.expressions import quoted
from orderlens.session import small_side

#: White space between words, as a Java pattern and as characters. Fixed values.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``new=old`` by exact name; all others, clashing names too, stay behind."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that a result is about to define anew."""
    taken = {name.lower() for name in names}
    return df.select(*[quoted(name) for name in df.columns if name.lower() not in taken])


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


def share(*columns: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the values of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / F.lit(float(1 << 31))


def words(text: Column) -> Column:
    """Words of a text as an array; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK, -1))


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, *key: str) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, those with the smallest hash of ``key``.

    For any number of strata. Rows far from the limit are sieved out before the ranking, by the counted
    size of their stratum, so that a ranked stratum has little more than ``per_stratum`` rows.
    """
    sizes = small_side(rows.groupBy(F.col(stratum).alias("stratum_")).agg(F.count(F.lit(1)).alias("n_")))
    known = rows.withColumn("share_", share(*[F.col(k) for k in key])).join(sizes, F.col(stratum).eqNullSafe(F.col("stratum_")))
    sieved = known.where(F.col("share_") * F.col("n_") < 1.5 * per_stratum + 50)
    order = Window.partitionBy(stratum).orderBy("share_", *key)
    ranked = sieved.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= per_stratum)
    return ranked.drop("share_", "rank_", "stratum_", "n_")


def scored(docs: DataFrame, text_col: str, result: str, function, **extra: Column) -> DataFrame:
    """``docs`` with the columns of the schema text ``result``, made by ``function`` batch by batch.

    ``function(text, *extra)`` gets Arrow arrays of the texts and of the ``extra`` columns and returns
    one array for each result column. Columns of ``docs`` with the name of a result are replaced; all
    other columns pass through untouched, so no join is needed to bring results and rows together.
    """
    added = T.StructType.fromDDL(result)
    keep = without(docs, *added.fieldNames())
    inputs = [quoted(text_col).alias("text_"), *[column.alias(f"extra{i}_") for i, column in enumerate(extra.values())]]
    source = docs.select(*inputs, *[quoted(name) for name in keep.columns if name != text_col])
    names = [text_col if name == "text_" else name for name in source.columns]
    at = [names.index(name) for name in keep.columns]
    schema = T.StructType([*keep.schema.fields, *added.fields])
    given, made = len(inputs), [f"c{i}" for i in range(len(schema.fields))]

    def run(batches):
        for batch in batches:
            new = function(*batch.columns[:given])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *new], made)

    plain = T.StructType([T.StructField(name, f.dataType, True) for name, f in zip(made, schema.fields)])
    return source.mapInArrow(run, plain).toDF(*schema.fieldNames())

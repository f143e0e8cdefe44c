"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic; a cell's size is its words. Raking scales
the cells' shares q in turn to the target shares of each source, each language and each topic, and
starts from the shares that the corpus has. A sample of the share ``budget`` of all words can take
a cell once at most, so after each sweep a share is held to cell words / (budget x all words). At
the end a cell's documents are drawn with probability p = budget x all words x q / cell words, which
is never above 1, by a hash of id and text: the sample then has the target shares, in expectation,
up to the error that ``mixture`` reports (zero unless targets and bounds contradict each other).

Targets are the corpus' own shares raised to a power and scaled to one, or given by name; values
that the corpus does not have are left out. Cells are small rows: they are counted with partial
sums, so no source, however large, meets in one task, and are raked as a distributed table. They are
broadcast to the documents only up to ``BROADCAST_CELLS`` of them.

Everything is DataFrame functions. Edge cases: a null source, language or topic is a value of its
own. Documents without words are in a cell but weigh nothing; a cell without words is drawn with
probability 1. Equal rows are drawn together. An empty table gives an empty result. Columns of the
input that have the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pick, quoted, share, without, words
from orderlens.session import cut_lineage

BUDGET = 0.5
#: Powers of the corpus' shares that the registered query aims at.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SWEEPS, TOLERANCE = 40, 1e-4
BROADCAST_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")


def topic_of(text: Column, tokens: Column) -> Column:
    """A rough topic where documents have none: what the text looks like."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike("[lL]icen[sc]e|[Cc]opyright|rights reserved"), "legal")
        .when(text.contains("@") | text.rlike(r"[0-9]{6}"), "contact")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def key_of(value: Column) -> Column:
    """A value as a text that is never null and never mistaken for the null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def described(docs: DataFrame, source_col: str, lang_col: str, topic: Column | None, text_col: str, id_col: str) -> list[Column]:
    """The keys of a document's cell, its words and its place between 0 and 1."""
    tokens = F.size(words(quoted(text_col))).cast("long")
    return [
        key_of(quoted(source_col)).alias("source"),
        key_of(quoted(lang_col)).alias("lang"),
        key_of(topic if topic is not None else topic_of(quoted(text_col), tokens)).alias("topic"),
        tokens.alias("tokens"),
        share(F.lit(8), quoted(id_col), quoted(text_col)).alias("draw_"),
    ]


def targets(cells: DataFrame, dimension: str, aim: float | Mapping[str, float]) -> DataFrame:
    """(dimension, target): shares by power, or given by value, scaled to one over the values there are."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").alias("own")).where("own > 0")
    if isinstance(aim, Mapping):
        given = cells.sparkSession.createDataFrame([("=" + k, float(v)) for k, v in aim.items()], f"{dimension} string, raw double")
        own = own.join(given, dimension)
    else:
        own = own.withColumn("raw", F.pow(F.col("own").cast("double"), F.lit(float(aim))))
    total = own.agg(F.sum("raw")).first()[0] or 1.0
    return own.select(dimension, (F.col("raw") / total).alias("target"))


def raked(cells: DataFrame, aims: Mapping[str, float | Mapping[str, float]], budget: float = BUDGET, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` (source, lang, topic, tokens) with ``q``, and the largest error of a target share."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    live = cells.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    live = live.withColumn("most", F.col("share") / F.lit(budget)).withColumn("q", F.col("share"))
    aimed = {d: cut_lineage(targets(cells, d, aims[d])) for d in DIMENSIONS}
    for dimension in DIMENSIONS:
        live = live.join(aimed[dimension].withColumnRenamed("target", f"target_{dimension}"), dimension)
    live, error, before = cut_lineage(live), 0.0, float("inf")
    for _ in range(sweeps):
        for dimension in DIMENSIONS:
            sums = live.groupBy(dimension).agg(F.sum("q").alias("sum_"))
            scaled = F.when(F.col("sum_") > 0, F.col("q") * F.col(f"target_{dimension}") / F.col("sum_")).otherwise(0.0)
            live = live.join(sums, dimension).withColumn("q", F.least(scaled, F.col("most"))).drop("sum_")
        live = cut_lineage(live)
        off = [
            live.groupBy(d).agg(F.abs(F.sum("q") - F.first(f"target_{d}")).alias("off")).agg(F.max("off").alias("off"))
            for d in DIMENSIONS
        ]
        error = max((row.off or 0.0) for row in off[0].union(off[1]).union(off[2]).collect())
        if error <= tolerance or error > 0.999 * before:  # met, or as near as targets and bounds allow
            break
        before = error
    return live, error


def mixture(cells: DataFrame, aims: Mapping, budget: float = BUDGET, **how) -> tuple[DataFrame, float]:
    """(source, lang, topic, weight, probability) of every cell, and the largest error of a target.

    ``weight`` is the cell's share in the mixture over its share in the corpus.
    """
    live, error = raked(cells, aims, budget, **how)
    fit = live.select(*DIMENSIONS, (F.col("q") / F.col("share")).alias("weight"))
    dead = cells.join(fit, list(DIMENSIONS), "left")
    weight = F.coalesce("weight", F.when(F.col("tokens") > 0, 0.0).otherwise(1.0 / budget))
    return cut_lineage(dead.select(*DIMENSIONS, weight.alias("weight"), F.least(F.lit(1.0), budget * weight).alias("probability"))), error


def counted_cells(described_rows: DataFrame) -> DataFrame:
    return cut_lineage(described_rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    small = cells.count() <= BROADCAST_CELLS
    return rows.join(F.broadcast(cells) if small else cells, list(DIMENSIONS)).withColumn("sampled", F.col("draw_") < F.col("probability"))


def mixed(docs: DataFrame, aims: Mapping | None = None, budget: float = BUDGET, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows of ``docs``, whole and with ``weight`` and ``probability``."""
    keep = without(docs, "weight", "probability")
    of = described(docs, source_col, lang_col, topic, text_col, id_col)
    names = [*DIMENSIONS, "tokens", "draw_"]
    cells, _ = mixture(counted_cells(docs.select(*of)), aims or POWERS, budget)
    packed = docs.select(F.struct(*of).alias("of_"), F.struct(*[quoted(c) for c in keep.columns]).alias("row_"))
    rows = packed.select("row_", *[F.col(f"of_.{name}").alias(name) for name in names])
    return with_probability(rows, cells).where("sampled").select("row_.*", "weight", "probability")


def op8_mixing(spark, folder: str) -> DataFrame:
    """Weight, probability and draw of all documents."""
    docs = pick(spark.read.parquet(f"{folder}/documents.parquet"), doc_id="doc_id", text="text", source="source", lang="lang")
    rows = cut_lineage(docs.select("doc_id", *described(docs, "source", "lang", None, "text", "doc_id")))
    cells, _ = mixture(counted_cells(rows), POWERS)
    return with_probability(rows, cells).select("doc_id", "tokens", "weight", "probability", "sampled")

"""Keyword questions: find a value of a column in a question and filter by it."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.columns import TARGET
from orderlens.functions.expressions import quoted, row_text, string_columns
from orderlens.operators.predicates import all_of

# Words of a question that point at a column, and the label of the filter.
TOPICS = {"market": "Market", "segment": "Segment", "shipping": "Shipping"}


@dataclass(frozen=True)
class Match:
    label: str
    column: str
    value: str


def squash(column: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")


def phrases(text: str) -> list[str]:
    """All runs of whole words of a question, written without spaces."""
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)})


def find_values(df: DataFrame, columns: Sequence[str], text: str) -> dict[str, str]:
    """Per column its value that occurs in the text as whole words: the longest, then the first by name.

    One pass for all columns; what reaches the driver is at most a spelling of each phrase of the text.
    """
    known = phrases(text)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns])
    found = df.select(F.inline(pairs)).where(squash(F.col("value")).isin(known)).distinct()
    longest = found.groupBy("column").agg(F.min(F.struct((-F.length("value")).alias("size"), "value")).alias("best"))
    return {row["column"]: row["best"]["value"] for row in longest.collect()}


def match_question(df: DataFrame, text: str, topics: Mapping[str, str] = TOPICS) -> list[Match]:
    """Per topic word in the text: the first text column named like it, and its value in the text."""
    asked = {}
    for word, label in topics.items():
        column = next((c for c in string_columns(df) if word in c.lower()), None)
        if word in text.lower() and column:
            asked[label] = column
    values = find_values(df, sorted(set(asked.values())), text) if asked else {}
    return [Match(label, column, values[column]) for label, column in asked.items() if column in values]


def match_predicate(matches: Sequence[Match]) -> Column:
    return all_of(quoted(m.column) == F.lit(m.value) for m in matches)


def ask(df: DataFrame, text: str) -> DataFrame:
    """Rows that a keyword question asks for; a question without a match asks for all rows."""
    return df.where(match_predicate(match_question(df, text)))


def query_summary(df: DataFrame, predicate: Column, target: str = TARGET) -> DataFrame:
    """Rows matched and in total, and the target's sum, mean, max and min over the matched rows."""
    value = F.when(predicate, F.col(target))
    return df.agg(
        F.count_if(predicate).alias("matched"),
        F.count("*").alias("total"),
        F.sum(value).alias("sum_sales"),
        F.avg(value).alias("mean_sales"),
        F.max(value).alias("max_sales"),
        F.min(value).alias("min_sales"),
    )


def summary_text(df: DataFrame, text: str, target: str = TARGET) -> str:
    """The filters of a keyword question and its one-row summary, a line for each column."""
    matches = match_question(df, text)
    row = query_summary(df, match_predicate(matches), target).first()
    return "\n".join([*(f"{m.column} = {m.value}" for m in matches), row_text(row.asDict())])

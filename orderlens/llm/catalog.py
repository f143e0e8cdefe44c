"""The registered queries of this subpackage: whole tables in, full results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import (
    decontaminate,
    infill,
    language,
    licenses,
    mixing,
    negatives,
    pii,
    ppm,
    quality,
    rules,
    secrets,
    simhash,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_ppm": ppm.op9_ppm,
    "op10_licenses": licenses.op10_licenses,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_secrets": secrets.op13_secrets,
}

#: DuckDB twins. The other operators learn, align, iterate or give positions of matches; none of them is
#: one SQL statement, so each is tested against a brute-force version or by held-out accuracy (``tests/llm``).
SQL: dict[str, str] = {"op11_hard_negatives": negatives.SQL, "op12_fill_in_middle": infill.SQL}

"""Odd names, odd files, odd values: one test for each."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.catalog.base import closed_form_models
from orderlens.columns import ITEM_ORDER
from orderlens.operators import evaluation, features, keywords, ordered, paging, predicates, profiling
from orderlens.plans import preparation
from orderlens.sources import files, sinks
from orderlens.sources.order_items import order_items


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text)
    return str(path)


def test_schema_goes_by_header_names(spark, tmp_path):
    path = write(tmp_path, "Segment,Market,Sales\nconsumer,ASIA,NA\nhome,,2.5\n")
    schema = T.StructType([T.StructField(n, k) for n, k in (("Market", T.StringType()), ("Segment", T.StringType()), ("Sales", T.DoubleType()))])
    rows = files.read_csv(spark, path, schema).collect()
    assert [tuple(r) for r in rows] == [("ASIA", "consumer", None), (None, "home", 2.5)]
    with pytest.raises(ValueError, match="Region"):
        files.read_csv(spark, path, T.StructType([T.StructField("Region", T.StringType())]))


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, 'id,note\n1,"line one\nline ""two"", x"\n2,plain\n')
    assert [tuple(r) for r in files.read_csv(spark, path).orderBy("id").collect()] == [(1, 'line one\nline "two", x'), (2, "plain")]
    back = str(tmp_path / "back")
    sinks.write_csv(files.read_csv(spark, path), back)
    assert files.read_csv(spark, back).orderBy("id").collect() == files.read_csv(spark, path).orderBy("id").collect()


def test_codes_are_not_numbers(spark, tmp_path):
    path = write(tmp_path, "code,hex,n,x\n1D,0x1,+1, 2.5e1\n2F,0x2,2,.5\n")
    df = files.read_csv(spark, path)
    assert dict(df.dtypes) == {"code": "string", "hex": "string", "n": "bigint", "x": "double"}
    assert [r.x for r in df.collect()] == [25.0, 0.5]


@pytest.fixture(scope="module")
def dotted(spark):
    rows = [(i, float(i % 7), float(i % 5), "a" if i % 2 else "b") for i in range(60)]
    return spark.createDataFrame(rows, "`row.id` long, `Unit.Price` double, `x``y` double, `kind.of` string")


def test_names_with_dots(dotted):
    names = ["Unit.Price", "x`y"]
    assert profiling.correlations(dotted, names).count() == 1
    assert {r.column: (r.lo, r.hi) for r in predicates.range_bounds(dotted, names).collect()}["Unit.Price"] == (0.0, 6.0)
    assert predicates.apply_filters(dotted, {"Unit.Price": (1.0, 2.0), "kind.of": ["a"]}).count() == 9
    assert features.zscores(dotted, names).count() == 60
    assert [r[0] for r in ordered.dense_index(dotted, ["row.id"], "idx").orderBy("idx").select("`row.id`").collect()] == list(range(60))
    assert evaluation.f_scores(dotted, ["Unit.Price"], "x`y").count() == 1
    assert predicates.sorted_distinct(dotted, "kind.of").count() == 2


def test_correlations_of_one_and_of_many_columns(spark, monkeypatch):
    one = spark.range(5).select(F.col("id").cast("double").alias("a"))
    assert profiling.correlations(one).collect() == []
    many = spark.range(9).select(*[(F.col("id") * (i + 1) % 5).cast("double").alias(f"c{i}") for i in range(6)])
    whole = sorted(map(tuple, profiling.correlations(many).collect()))
    monkeypatch.setattr(profiling, "PAIRS_A_PASS", 4)
    assert sorted(map(tuple, profiling.correlations(many).collect())) == whole and len(whole) == 15


def test_metrics_are_over_complete_pairs(spark):
    rows = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (100.0, None), (None, 3.0)], "y double, p double")
    assert evaluation.error_metrics(rows, "y", "p").first().r2 == pytest.approx(0.0)
    indexed = rows.withColumn("i", F.monotonically_increasing_id())
    full = indexed.where("y is not null and p is not null")
    got, want = (evaluation.resilience_of_indexed(d, "y", "p", "i").first() for d in (indexed, full))
    assert all(a == pytest.approx(b) for a, b in zip(got, want))


def test_columns_without_values_and_infinities(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, None), (math.inf, None)], "x double, n double")
    scaled = preparation.robust_scale(rows, ["n"]).collect()
    assert [r.n_scaled for r in scaled] == [None, None, None]
    stages = preparation._percentile_stages(rows, ["x"], 10)
    out = rows
    for stage in stages:
        out = stage.transform(out)
    assert [round(r.x_percentile, 3) for r in out.orderBy("x").collect()] == [0.333, 0.833, 0.833]  # one step


def test_categories_beyond_the_limit_are_refused(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(5)], "c string")
    preparation._check_categories(rows, ["c"], 5)
    with pytest.raises(ValueError, match="c"):
        preparation._check_categories(rows, ["c"], 4)


def test_group_means_do_not_move_the_order_lines(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        plan = closed_form_models(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_rows_are_picked_before_the_joins(spark, folder):
    rows = order_items(spark, folder, [*ITEM_ORDER, "market"], pick=lambda lines: paging.page(lines, ITEM_ORDER, 40, 5))
    every = order_items(spark, folder, [*ITEM_ORDER, "market"]).orderBy(*ITEM_ORDER).collect()
    assert rows.orderBy(*ITEM_ORDER).collect() == every[40:45]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("GlobalLimit")  # the limit lies below the joins


def test_one_pass_finds_the_values_of_all_topics(items):
    found = keywords.match_question(items, "sales of the building segment in the middle east market")
    assert [(m.column, m.value) for m in found] == [("market", "MIDDLE EAST"), ("customer_segment", "BUILDING")]


def test_trained_window_is_kept(spark, tmp_path, items):
    from orderlens.plans.bundle import Bundle, load_bundle, save_bundle
    from orderlens.plans.forecast import prepare

    prepared = prepare(items.limit(400))
    assert prepared.window == 20
    save_bundle(Bundle(prepared.preparation, None, prepared.window), str(tmp_path / "b"))
    assert load_bundle(spark, str(tmp_path / "b")).window == 20

import pytest
from pyspark.sql import functions as F

from orderlens.functions.dates import date_columns, parse_timestamp
from orderlens.sources import files, sinks


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_encoding_fallback(spark, tmp_path):
    latin = write(tmp_path, "latin.csv", "Market,Sales\ncafé,1.5\nx,2\n", "latin-1")
    plain = write(tmp_path, "utf.csv", "Market,Sales\ncafé,1.5\n�,2\n")
    assert files.detect_encoding(spark, latin) == "ISO-8859-1"
    assert files.detect_encoding(spark, plain) == "UTF-8"
    for path in (latin, plain):
        df = files.load_table(spark, path)
        assert df.first()["Market"] == "café"
        assert dict(df.dtypes) == {"Market": "string", "Sales": "double"}


def test_types_and_missing_texts(spark, tmp_path):
    path = write(
        tmp_path, "t.csv", 'a,b,c,d,e\n1,1.0,x,NA,"say ""hi"", you"\nNA,nan,,,b\n3,2e3,NULL,,c\n12345678901,5,z,N/A,d\n'
    )
    df = files.load_table(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string", "e": "string"}
    rows = df.collect()
    assert [r["a"] for r in rows] == [1, None, 3, 12345678901]
    assert [r["b"] for r in rows] == [1.0, None, 2000.0, 5.0]
    assert [r["c"] for r in rows] == ["x", None, None, "z"]
    assert [r["d"] for r in rows] == [None] * 4
    assert rows[0]["e"] == 'say "hi", you'


def test_formats():
    assert files.format_of("/x/a.CSV.gz") == "csv"
    assert files.format_of("s3://b/a.parquet/") == "parquet"
    assert files.format_of("/x/folder") == "csv"
    with pytest.raises(ValueError):
        files.format_of("/x/a.xlsx")


def test_checks(spark, items):
    with pytest.raises(ValueError, match="empty"):
        files.check_table(items.where("false"))
    with pytest.raises(ValueError, match="warehouse"):
        files.check_table(items, ["market", "warehouse"])


def test_aliases_take_the_first_spelling(spark):
    df = spark.createDataFrame([(1, 2)], "Order_Region int, `Shipping Mode` int")
    assert files.canonical_columns(df).columns == ["order_region", "shipping_mode"]
    assert files.display_columns(files.canonical_columns(df)).columns == ["Order Region", "Shipping Mode"]


def test_capped_export_writes_all_or_nothing(spark, items, tmp_path):
    assert not sinks.write_capped(items, str(tmp_path / "a"), limit=100)
    assert not (tmp_path / "a").exists()
    assert sinks.write_capped(items.limit(100), str(tmp_path / "b"), limit=100)
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 100


def test_date_columns(spark):
    df = spark.createDataFrame(
        [("2024-01-02", "soon", 3.0, "x"), ("2024-02-30", "2024-01-01", 4.0, "y")],
        "order_date string, ship_time string, day_count double, note string",
    )
    assert date_columns(df) == []
    assert date_columns(df, share=0.5) == ["order_date", "ship_time"]
    stamps = df.select(parse_timestamp(F.col("order_date")).alias("t")).collect()
    assert stamps[0]["t"] is not None and stamps[1]["t"] is None


def test_sample_predictions_of_few_rows(spark):
    df = spark.createDataFrame([(2, 5.0, 1.0, 0.0, 2.0), (1, 4.0, 2.0, 1.0, 3.0)], "id int, sales double, combined double, lower double, upper double")
    rows = sinks.sample_predictions(df, ["id"]).collect()
    assert [(r["Index"], r["Actual_Sales"]) for r in rows] == [(0, 4.0), (1, 5.0)]

from datetime import datetime

from orderlens.functions.date_formats import infer_date_formats, with_parsed_dates


def parsed(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `sold.on` string")
    found = infer_date_formats(df, ["sold.on"], **options)["sold.on"]
    rows = with_parsed_dates(df.toDF("i", "sold"), {"sold": found}).orderBy("i").collect()
    return found, [r["sold"] for r in rows]


def test_mixed_formats_in_one_column(spark):
    texts = ["2024-03-04", "2024/03/05 10:30", "20240306", "7 Mar 2024", "Mar 8, 2024", " 2024-03-09 01:02:03 ", "soon", "", None, "2024-02-30"]
    found, rows = parsed(spark, texts)
    days = [4, 5, 6, 7, 8, 9]
    assert [r.day for r in rows[:6]] == days and rows[1] == datetime(2024, 3, 5, 10, 30) and rows[5].second == 3
    assert rows[6:] == [None] * 4
    assert (found.texts, found.unread, found.undecided, found.conflicting) == (9, 3, 0, 0)


def test_order_of_day_and_month_is_decided_by_the_other_texts(spark):
    found, rows = parsed(spark, ["3/4/2024", "13/4/2024", "5/6/2024"])
    assert [(r.day, r.month) for r in rows] == [(3, 4), (13, 4), (5, 6)] and found.undecided == 0
    found, rows = parsed(spark, ["3/4/2024", "4/13/2024"], day_first=True)
    assert [(r.day, r.month) for r in rows] == [(4, 3), (13, 4)] and found.undecided == 0


def test_undecided_and_conflicting_orders_are_reported(spark):
    found, rows = parsed(spark, ["3/4/2024", "5-6-2024", "7.8.2024"])
    assert [(r.day, r.month) for r in rows] == [(4, 3), (6, 5), (7, 8)] and found.undecided == 3
    assert [(r.day, r.month) for r in parsed(spark, ["3/4/2024"], day_first=True)[1]] == [(3, 4)]
    found, rows = parsed(spark, ["13/4/2024", "14/4/2024", "4/15/2024", "3/4/2024"])
    assert found.conflicting == 1 and [(r.day, r.month) for r in rows] == [(13, 4), (14, 4), (15, 4), (3, 4)]


def test_no_dates(spark):
    found, rows = parsed(spark, ["a", None, "12"])
    assert found.formats == () and found.unread == 2 and rows == [None] * 3
    assert parsed(spark, [])[0].texts == 0
    assert infer_date_formats(spark.range(1), []) == {}

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.sources import csv_records, files


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that small files are cut like large ones."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def text_of(rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    return out.getvalue()


def random_rows(n, seed, length=40):
    pick = random.Random(seed)
    parts = ["a", "é", '"', ",", "\n", " ", "x,y", '""', "\n\n", "word"]
    return [[str(i), "".join(pick.choice(parts) for _ in range(pick.randrange(length))) + "z", str(pick.random())] for i in range(n)]


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_records_equal_the_python_reader(spark, tmp_path, small_ranges, ending, encoding):
    rows = random_rows(400, 5)
    path = write(tmp_path, "a.csv", text_of([["id", "note", "v"], *rows], ending), encoding)
    df = files.read_csv(spark, path)
    assert got(df.select(df.id.cast("string"), "note")) == sorted((r[0], r[1]) for r in rows)
    found = csv_records.survey(spark, path)
    assert found.quoted_breaks and found.ranges.count() > 20
    texts = csv_records.records(spark, path, found.ranges, "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
    assert texts.rdd.getNumPartitions() > 8


def test_equals_the_single_task_reader(spark, tmp_path, small_ranges):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(4):
        write(folder, f"part-{i}.csv", text_of([["id", "note", "v"], *random_rows(60 * i, i)]))
    many = files.read_csv(spark, str(folder))
    one = files.read_csv(spark, str(folder), multi_line=True)
    assert many.dtypes == one.dtypes and got(many) == got(one) and many.count() == 360


def test_records_longer_than_ranges(spark, tmp_path, small_ranges):
    rows = [["1", "\n".join(["line"] * 500), "x"], ["2", "\n" * 700, "y"], ["3", "short", "z"], ["4", 'q"' * 400 + "\n", "w"]]
    path = write(tmp_path, "long.csv", text_of([["id", "no\nte", "v"], *rows]))
    df = files.read_csv(spark, path)
    assert df.columns == ["id", "no\nte", "v"]
    kept = {r[0]: r[1] for r in df.collect()}
    assert kept[1] == rows[0][1] and kept[4] == rows[3][1] and kept[3] == "short" and set(kept) == {1, 2, 3, 4}


def test_header_across_ranges_blank_lines_and_no_last_line_end(spark, tmp_path, small_ranges):
    header = ["id", "long " + "\n" * 800 + "name"]
    path = write(tmp_path, "h.csv", "\n\n" + text_of([header]) + '\n1,"a\nb"\n\n2,c')
    df = files.read_csv(spark, path)
    assert df.columns == header and got(df) == [(1, "a\nb"), (2, "c")]


def test_quotes_inside_unquoted_values_go_the_old_way(spark, tmp_path, small_ranges):
    path = write(tmp_path, "q.csv", 'id,size\n1,5" pipe\n2,"a\nb"\n3,plain\n')
    assert got(files.read_csv(spark, path)) == [(1, '5" pipe'), (2, "a\nb"), (3, "plain")]


def test_well_formed(spark):
    cases = {
        'a,b': True, '"a",b': True, 'a,"b"': True, '"a","b"': True, '""': True, '"",""': True, '"a""b",c': True,
        'a"b,c': False, '"a"b,c': False, '"a': False, 'a,b"': False, ',"x",': True, '"a,b","c\nd"': True, 'x"y"z': False,
    }
    df = spark.createDataFrame(pd.DataFrame({"t": list(cases)}))
    found = {r["t"]: r["ok"] for r in df.select("t", csv_records.well_formed(df.t).alias("ok")).collect()}
    assert found == cases


def test_changed_ranges_stop_the_job(spark, tmp_path, small_ranges):
    path = write(tmp_path, "c.csv", text_of([["id", "note", "v"], *random_rows(200, 1)]))
    found = csv_records.survey(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "170")
    with pytest.raises(Exception, match="byte ranges"):
        csv_records.records(spark, path, found.ranges, "UTF-8").count()


def test_empty_files(spark, tmp_path):
    path = write(tmp_path, "e.csv", "id,note\n")
    assert files.read_csv(spark, path).columns == ["id", "note"]
    assert files.read_csv(spark, path).isEmpty()


def test_well_formed_records(spark):
    texts = [
        "", "a,b", '"a"', '"a","b\n,"', 'x,"a",y', '"",a', 'a,""', '"a""b",c', '"""a"""', '"a,\nb"\n', '"', 'a"', '"a"b', 'a"b"', 'x"a,"b",c',
        '"a,"b', 'a,b"c"d,e', '"a" ,b', ',"a"', '"a",', '"a","b', '"a"x"b"', '","', '",",","', 'a"",b',
    ]

    def expected(text):
        pieces = text.replace('""', "").split('"')
        last = len(pieces) - 1
        outside = [
            (i == 0 or piece.startswith(",") or i == last and not piece) and (i == last or piece.endswith(",") or i == 0 and not piece)
            for i, piece in enumerate(pieces)
            if i % 2 == 0
        ]
        return last % 2 == 0 and all(outside)

    pick = random.Random(4)
    texts += ["".join(pick.choice('a,""\n') for _ in range(pick.randrange(9))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "record string")
    found = rows.select("record", csv_records.well_formed(F.col("record")).alias("ok")).collect()
    assert [(r.record, r.ok) for r in found] == [(t, expected(t)) for t in texts]


def test_lines_are_put_together_once(spark, tmp_path, small_ranges):
    path = write(tmp_path, "a.csv", text_of([["id", "note", "v"], *random_rows(50, 7)]))
    df = files.read_csv(spark, path)
    before = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 50 and "InMemoryRelation" in before.split("MapInArrow")[0]

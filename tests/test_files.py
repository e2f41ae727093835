"""Files and tables of publications: round trips with quotes and line breaks, versions without rows, settings left as they were; ranks of several columns at once."""

import random

import pytest
from pyspark.sql import functions as F

from metroframe.operators import ranks, raster, search, trajectories
from metroframe.sources import files

TEXTS = [(1, "plain"), (2, 'a "quoted" word'), (3, "two\nlines"), (4, "comma, and \r\n more"), (5, None), (6, '"'), (7, "last")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "id int, text string")
    files.export(rows, str(tmp_path / "out"), "csv")
    got = {r["id"]: r["text"] for r in files.read_csv(spark, str(tmp_path / "out")).collect()}
    assert got == {i: t for i, t in TEXTS}
    files.export(rows.where("id < 3"), str(tmp_path / "short"), "csv")
    assert files.read_csv(spark, str(tmp_path / "short")).count() == 2


def test_json_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "id int, text string")
    files.export(rows, str(tmp_path / "out.jsonl"), "json")
    assert {(r["id"], r["text"]) for r in files.read_json(spark, str(tmp_path / "out.jsonl"), lines=True).collect()} == set(TEXTS)
    assert files.markdown(spark.createDataFrame([(1, "a|b\nc"), (2, None)], "id int, text string").coalesce(1)) == "| id | text |\n| --- | --- |\n| 1 | a\\|b c |\n| 2 |  |"


def test_foreign_encoding_leaves_the_setting(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,中文\n".encode("gbk"))
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    rows = files.read_foreign_csv(spark, str(tmp_path / "a.csv"))
    assert spark.conf.get(name, None) == before
    assert [tuple(r) for r in rows.collect()] == [("1", "中文")]


def test_publications(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(5).withColumnRenamed("id", "n")
    files.publish(rows, table, "d", "v1")
    files.publish(rows.limit(3), table, "d", "v2")
    files.publish(rows.limit(1), table, "e", "v1")
    seen = lambda: {(r["dataset_id"], r["version_id"], r["is_current"]): r["k"] for r in files.published(spark, table).groupBy("dataset_id", "version_id", "is_current").agg(F.count("*").alias("k")).collect()}
    assert seen() == {("d", "v1", False): 5, ("d", "v2", True): 3, ("e", "v1", True): 1}
    files.publish(rows.limit(0), table, "d", "v1")  # again, without rows: nothing of it stays, and it is current
    assert seen() == {("d", "v2", False): 3, ("e", "v1", True): 1}
    files.retire(spark, table, "d", "v1")
    assert seen() == {("d", "v2", True): 3, ("e", "v1", True): 1}
    assert files.clean(spark, table) == 2 and files.clean(spark, table) == 0
    assert seen() == {("d", "v2", True): 3, ("e", "v1", True): 1}


@pytest.mark.parametrize("few", [0, 10**6])
def test_percent_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    chance = random.Random(1)
    rows = [(i, chance.choice([None, 1.0, 2.0, 2.0, 3.5]), chance.randint(0, 3), 7) for i in range(60)]
    got = {r["id"]: r for r in ranks.percent_ranks(spark.createDataFrame(rows, "id int, _v double, value int, column int"), {"_v": "a", "value": "b", "column": "c"}).collect()}
    assert set(got[0].asDict()) == {"id", "_v", "value", "column", "a", "b", "c"} and len(got) == 60
    for place, name in ((1, "a"), (2, "b")):
        values = [r[place] or 0 for r in rows]
        for r in rows:
            v = r[place] or 0
            assert got[r[0]][name] == pytest.approx((sum(x < v for x in values) + (values.count(v) + 1) / 2) / 60)
    assert {r["c"] for r in got.values()} == {0.0}


def test_quantile_table(spark):
    rows = spark.createDataFrame([(1.0, None, "x"), (2.0, None, "y"), (10.0, None, "z"), (None, None, "z")], "a double, b double, c string")
    assert ranks.quantile_table(rows, ["a", "b"], [[0.0, 0.25, 1.0], [0.5]]) == [[1.0, 1.5, 10.0], [None]]
    assert ranks.quantile_table(rows.limit(0), ["a"], [[0.5]]) == [[None]]


def test_names_do_not_clash(spark):
    pixels = spark.createDataFrame([(1, 1.0, 4.0, 9, 8, 7), (2, 5.0, 5.0, 9, 8, 7)], "id int, a double, b double, length int, most int, cuts int")
    found = raster.levels(raster.change_magnitude(pixels, [("a", "b")]), "a", [0.5])
    assert {(r["id"], r["magnitude"], r["level"], r["length"], r["most"], r["cuts"]) for r in found.collect()} == {(1, 1.0, 0, 9, 8, 7), (2, 0.0, 1, 9, 8, 7)}
    places = spark.createDataFrame([(1, "c", "ab1", "mine"), (2, "c", "ab2", "mine"), (3, "d", "ab1", None)], "id int, city string, cell string, _prefix string")
    marks = spark.createDataFrame([("c", "ab1", "gate"), ("c", "ab9", "bridge")], "city string, cell string, landmark string")
    found = search.with_landmarks(places, marks, "city", "cell", 2).collect()
    assert {(r["id"], r["_prefix"], r["landmark"]) for r in found} == {(1, "mine", "gate"), (2, "mine", "bridge"), (3, None, None)}


def test_all_sources_are_kept(spark):
    rows = spark.range(1200).select(F.lit("r").alias("region"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.lit(1.0).alias("score"), F.col("id").cast("string").alias("source"), F.lit("l").alias("label"))
    found = trajectories.fused(rows, "region", "ts", "score", "source", "label", "day").first()
    assert found["f_counts"].count("=") == 1200

"""A stream in two batches gives the latest count of each window; a repeated run adds nothing."""

from datetime import datetime

from metroframe.streaming import windows


def test_updates(spark, tmp_path):
    schema = "kind string, ts timestamp"
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    source, table, state = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        windows.write_updates(windows.window_counts(stream, "kind", "ts", "1 hour", "1 day"), table, state).awaitTermination()
        return {(r["key"], r["start"].hour): r["n"] for r in windows.latest(spark, table, ["key", "start"]).collect()}

    assert run([("a", at(1, 5)), ("a", at(1, 50)), ("b", at(2, 0)), (None, at(2, 0))]) == {("a", 1): 2, ("b", 2): 1, (None, 2): 1}
    assert run([("a", at(1, 59)), ("b", at(3, 0))]) == {("a", 1): 3, ("b", 2): 1, ("b", 3): 1, (None, 2): 1}

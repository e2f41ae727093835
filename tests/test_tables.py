"""Where tables that cut lineage are written."""

from types import SimpleNamespace

import pytest

from metroframe.sources import tables


def test_shared_folder(spark):
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, *other: None if "checkpoint" in name else "file:/tmp/warehouse"), sparkContext=SimpleNamespace(master=master, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc))
    assert tables.shared_folder(unset("local[4]")) == "file:/tmp/warehouse"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            tables.shared_folder(unset(master))


def test_forget(spark):
    made = tables.cut(spark, spark.range(3))
    assert made.count() == 3
    tables.forget(made)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made._scratch)
    assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

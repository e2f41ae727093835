"""Tables by name in a folder of Parquet, and tables written to cut lineage."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, the warehouse, unless that is a folder of each machine's own on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at.getScheme() == "file" and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on each machine's own disk")
    return warehouse


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows, written and read again."""
    path = scratch(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once what is made from them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""What the operators share: tables, scratch space and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: Upper-case ASCII to lower case; every byte that is not part of a word to a space.
ASCII_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, the warehouse, if executors share that."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or shared_folder(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{scratch_root(spark)}/metroframe/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends here and survives lost executors.

    What was shuffled to make it isn't needed any more, and Spark's cleaner removes those files as soon as the driver's
    garbage collector tells it to.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that cut() wrote, once all that was made from it has been written itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables of one step, deleted together once what is made from them has been written."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(cut(df, label))
        return self.held[-1]

    def forget(self) -> None:
        for df in self.held:
            forget(df)
        self.held.clear()


def trimmed(run):
    """A function over record batches that gives what it no longer needs back to the system when it ends: workers live on, and share an executor's memory."""

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def by_bytes(batches, most: int = 4_000_000):
    """Slices of record batches with at most so many bytes of text (a longer text alone): what is made of texts before it is handed on takes several times their size."""
    import pyarrow.compute as pc

    from .token_ids import runs

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        for a, b in runs(sizes, most):
            yield batch.slice(a, b - a)


#: Bits of a sieve at most, and for each value where they are fewer.
SIEVE_BITS, SIEVE_EACH = 1 << 28, 32


def member(values: DataFrame, most: int = SIEVE_BITS):
    """A function of an array of hashes (int64) that is true for all of values' only column and, by chance, for some others.

    A join that keeps few rows of a large table need not shuffle the others. Tasks get a bit for each value, whose table has a
    bound whatever the number of values: where it is full more rows get through, which the join that follows drops.
    """
    n = min(most, 1 << max(10, (values.count() * SIEVE_EACH - 1).bit_length()))
    place = F.col(values.columns[0]).bitwiseAND(F.lit(n - 1))
    word = values.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    table = np.zeros(n // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    bits = table.view(np.uint8)

    def has(hashes: np.ndarray) -> np.ndarray:
        at = hashes & (n - 1)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    return has


def sieve(values: DataFrame, most: int = SIEVE_BITS):
    """The same, of a column of hashes (long)."""
    has = member(values, most)

    def hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(has(hashes.to_numpy()))

    return F.pandas_udf(hold, "boolean")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_offsets(parts: DataFrame, key: str, size: str, offset: str) -> DataFrame:
    """A row per partition (never more) with the sum of the sizes of those before it."""
    from pyspark.sql import Window

    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias(offset))


def read_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()

"""Rows of subjects that meet each other, packed and dealt to pairs of blocks of subjects, so that what they make together is never shuffled.

Subjects are dealt into blocks by hash. Each pair of blocks is a group that has the rows of both; rows are shuffled as often as there are blocks, in compressed parts of many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are packed at once; blocks that there are at least, unless they would have fewer rows than FEW.
PACKED, LEAST_BLOCKS, FEW = 500_000, 8, 20_000


def pack(order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with a block as rows (block, rows): in that order, with a dictionary for texts, compressed."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ["block", *order]])
        block, table = table["block"].to_numpy(), table.drop_columns("block").combine_chunks()
        table = pa.table({c: table[c].combine_chunks().dictionary_encode() if pa.types.is_string(table[c].type) else table[c] for c in table.column_names})
        bounds = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for start, end in zip(bounds, bounds[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(start, end - start).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([int(block[start])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> list[pa.Table]:
    """The rows of a group's two blocks, or of its one; nothing if a block has none."""
    wanted, tables = set(), {}
    for batch in batches:
        wanted |= {batch.column("i")[0].as_py(), batch.column("j")[0].as_py()}
        for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
            table = pa.ipc.open_stream(rows.as_buffer()).read_all()
            tables.setdefault(block, []).append(pa.table({c: pc.cast(table[c], pa.string()) if pa.types.is_dictionary(table[c].type) else table[c] for c in table.column_names}))
    return [pa.concat_tables(tables[b]) for b in sorted(tables)] if len(tables) == len(wanted) else []


def ranked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values in order, and each row's place among them."""
    values = pc.unique(column)
    values = values.take(pc.array_sort_indices(values))
    return values, pc.index_in(column, values).combine_chunks().to_numpy().astype(np.int64)


def spread(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times i, beside first[i], first[i] + 1 and so on."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) + np.repeat(first - np.cumsum(counts) + counts, counts)


def apply(rows: DataFrame, subject: str, order: list[str], size: int, f: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """What f makes of the rows of every two blocks of subjects, and of each one; a block has about size rows. Rows come in parts, each in that order."""
    n = rows.count()
    blocks = max(1, -(-n // size), min(LEAST_BLOCKS, -(-n // FEW)))
    packed = rows.select(F.pmod(F.xxhash64(subject), F.lit(blocks)).cast("int").alias("block"), *rows.columns).mapInArrow(pack(order), "block int, rows binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = packed.withColumn("other", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = unpack(batches)
        if tables:
            yield from f(tables)

    return dealt.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(run, schema)

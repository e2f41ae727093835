"""Patched frame-of-reference blocks of token ids, and files of them.

A block holds BLOCK values. Its least value is subtracted; the rest is packed, bit plane by bit plane, at the width that
the percentile of its values needs; values beyond that width stand in an exception list of positions and full values. A
file begins with its counts, then the documents (id, known or null, ids), then the start of every block, then the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .common import parallelism, running_offsets, scratch_path, trimmed

MAGIC = b"PFOR1\0\0\0"
BLOCK = 256
PERCENTILE = 0.9
#: Ids in one file, about; a longer document has its own.
FILE_IDS = 1_000_000
FILES = "part int, file int, before long, n_ids long, n_docs long, image binary"


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """ids: uint32. The start of every block and the end, and the blocks."""
    n = len(ids)
    if not n:
        return np.zeros(1, np.uint32), b""
    grid = np.resize(ids, (-(-n // BLOCK), BLOCK)) if n >= BLOCK else np.pad(ids, (0, BLOCK - n), mode="edge")[None]
    grid = grid.astype(np.uint32)
    if n % BLOCK and n > BLOCK:
        grid[-1, n % BLOCK :] = ids[-1]
    least = grid.min(axis=1)
    rest = grid - least[:, None]
    need = _bits(rest)
    width = np.partition(need, int(BLOCK * PERCENTILE) - 1, axis=1)[:, int(BLOCK * PERCENTILE) - 1]
    beyond = need > width[:, None]
    counts = beyond.sum(axis=1)
    planes = {}
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        low = rest[rows]
        planes.update(zip(rows.tolist(), np.stack([np.packbits((low >> k).astype(np.uint8) & 1, axis=1) for k in range(w)], axis=1) if w else [np.empty(0, np.uint8)] * len(rows)))
    at, values = np.nonzero(beyond)[1].astype(np.uint8), grid[beyond]
    ends = np.cumsum(counts)
    blocks = [
        struct.pack("<IBH", least[b], width[b], counts[b]) + planes[b].tobytes() + at[e - counts[b] : e].tobytes() + values[e - counts[b] : e].tobytes()
        for b, e in enumerate(ends.tolist())
    ]
    return np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.uint32), b"".join(blocks)


def unpack(starts: np.ndarray, body: bytes, n: int) -> np.ndarray:
    """The n ids of all blocks. One block alone is body[starts[b]:starts[b + 1]]."""
    if not n:
        return np.empty(0, np.uint32)
    raw, starts = np.frombuffer(body, np.uint8), starts.astype(np.int64)
    head = raw[starts[:-1, None] + np.arange(7)]
    least, width, counts = head[:, :4].copy().view("<u4")[:, 0], head[:, 4], head[:, 5:7].copy().view("<u2")[:, 0]
    grid = np.empty((len(least), BLOCK), np.uint32)
    step = BLOCK // 8
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        low = np.zeros((len(rows), BLOCK), np.uint32)
        for k in range(w):
            low |= np.unpackbits(raw[(starts[rows] + 7 + k * step)[:, None] + np.arange(step)], axis=1).astype(np.uint32) << np.uint32(k)
        grid[rows] = low + least[rows, None]
    for b in np.flatnonzero(counts):
        c, at = int(counts[b]), int(starts[b]) + 7 + int(width[b]) * step
        grid[b, raw[at : at + c]] = np.frombuffer(body, "<u4", c, at + c)
    return grid.reshape(-1)[:n]


def write_file(docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    starts, body = pack(ids)
    return MAGIC + struct.pack("<QQQ", len(docs), len(ids), len(starts)) + docs.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + sizes.astype("<u8").tobytes() + starts.astype("<u4").tobytes() + body


def read_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs, known, sizes, ids."""
    if image[:8] != MAGIC:
        raise ValueError("not a file of patched frame-of-reference blocks")
    n_docs, n_ids, n_starts = struct.unpack_from("<QQQ", image, 8)
    at = 32
    docs = np.frombuffer(image, "<i8", n_docs, at)
    known = np.frombuffer(image, np.uint8, n_docs, at := at + 8 * n_docs).astype(bool)
    sizes = np.frombuffer(image, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    starts = np.frombuffer(image, "<u4", n_starts, at := at + 8 * n_docs)
    return docs, known, sizes, unpack(starts, image[at + 4 * n_starts :], n_ids)


def write(docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end: int = 0) -> None:
    """Encode docs (doc_id, text) and write files of ids in ascending doc_id order, as rows of a Parquet table at path.

    The rows are whole files, so any store that Spark writes to will do; part and file give their order, before the
    ids before a file in its part. Texts are dealt by ranges of doc_id, so equal texts spread. Null and empty texts have
    the end id alone; null ids come first; repeated rows each have their own entry; other columns are not written.
    """

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, before, file = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush():
            nonlocal before, file, held
            docs, known, sizes, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
            held = []
            image = write_file(docs, known, sizes, ids)
            out = pa.RecordBatch.from_pydict({"part": [part], "file": [file], "before": [before], "n_ids": [len(ids)], "n_docs": [len(docs)], "image": [image]}, schema=schema)
            before, file = before + len(ids), file + 1
            return out

        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())])
        size = 0
        for batch, ids, offsets in token_ids.encode_batches(batches, tokenizer, spaced, end):
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            doc = batch["doc_id"].fill_null(0).to_numpy()
            for a, b in token_ids.runs(np.diff(offsets), FILE_IDS):
                if held and size + offsets[b] - offsets[a] > FILE_IDS:
                    yield flush()
                    size = 0
                held.append((doc[a:b], known[a:b], np.diff(offsets[a : b + 1]), ids[offsets[a] : offsets[b]]))
                size += offsets[b] - offsets[a]
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parallelism(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, FILES).write.option("compression", "none").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """Documents from the rows that write() made: doc_id, start, n_tokens and the unsigned CRC-32 of the ids."""

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                docs, known, sizes, ids = read_file(row["image"])
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=~known),
                        pa.array(np.full(len(docs), row["part"], np.int32)),
                        pa.array(row["before"] + ends - sizes),
                        pa.array(sizes),
                        pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.int64()),
                    ],
                    names=["doc_id", "part", "local", "n_tokens", "ids_crc32"],
                )

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    offsets = running_offsets(parts, "part", "n_ids", "offset")  # a row for each partition of the writer
    rows = files.select("part", "before", "image").mapInArrow(decode, "doc_id long, part int, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, spaced: bool = True, end: int = 0) -> DataFrame:
    """Write files in the shared folder and read them again."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write(docs, path, tokenizer, spaced, end)
    return read(spark.read.schema(FILES).parquet(path))

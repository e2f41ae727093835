"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of each seed document, which fill its window.

Documents are dealt into shards of bounded size by ranges of (key, doc_id): the key is made of the least of a document's tokens
in MINIMA orders, in which a rare token is the likelier to come early the rarer it is, so that lexically close documents
meet, and a group of copies of any size is dealt over as many shards as it needs. Each shard has an inverted
index over token ids with BM25 weights; document frequencies are those of the whole corpus. A seed's rarest tokens
query the index, and the unused documents that score best follow the seed until the window is full; a document that
doesn't fit is cut, and its rest is the next seed. A shard's last ids are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids
from .common import cut, trimmed

#: Rows of one shard on average, whatever the number of partitions.
SHARD_DOCS = 2048
#: Orders of the tokens in a document's key.
MINIMA = 3
#: Tokens of more than one in so many documents come last in them.
COMMON = 20
#: Of a seed's tokens, so many of the highest weight query the index.
QUERY_TOKENS = 24
K1, B = 1.2, 0.75
ENCODED = "doc_id long, n long, ids binary, frequencies array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def different(doc: np.ndarray, ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """The different ids of each document."""
    key = doc * vocabulary + ids
    if len(key) and key[-1] + vocabulary < 2**32:
        key = key.astype(np.uint32)
    key.sort()
    return key[np.append(True, key[1:] != key[:-1])[: len(key)]] % vocabulary


def encode(docs: DataFrame, tokenizer: str, vocabulary: int, spaced: bool, end: int) -> DataFrame:
    """A row per document (ids as little-endian integers of the narrowest width), and one per task with document frequencies."""
    width = "<u2" if vocabulary <= 65536 else "<u4"

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("frequencies", pa.list_(pa.int64()))])
        seen = np.zeros(vocabulary, np.int64)
        for batch, ids, offsets in token_ids.encode_batches(batches, tokenizer, spaced, end):
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            seen += np.bincount(different(doc, ids, vocabulary), minlength=vocabulary)
            raw = memoryview(ids.astype(width).tobytes())
            w = int(width[-1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(np.diff(offsets)), pa.array([raw[w * a : w * b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()), pa.nulls(len(batch), pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_pydict({"doc_id": [None], "n": [0], "ids": [None], "frequencies": [seen]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), ENCODED)


def corpus_frequencies(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Document frequencies over the corpus: a vector of the vocabulary's size, summed on the executors."""
    rows = encoded.where(F.col("frequencies").isNotNull()).select(F.posexplode("frequencies").alias("token", "seen"))
    total = np.zeros(vocabulary, np.int64)
    for token, seen in rows.groupBy("token").agg(F.sum("seen").alias("seen")).collect():  # a row per token of the vocabulary
        total[token] = seen
    return total


def orders(df: np.ndarray, n_docs: int) -> np.ndarray:
    """A token's place in each of MINIMA orders. Early places are the likelier the rarer a token is; tokens of one document alone and common ones come last."""
    weight = np.where((df > 1) & (COMMON * df <= n_docs), np.log(max(n_docs, 1) / np.maximum(df, 1)), 0)
    late = np.random.default_rng(1).exponential(size=(MINIMA, len(df))) / np.maximum(weight, 1e-9)
    return np.argsort(np.argsort(late, axis=1, kind="stable"), axis=1).astype(np.int32)


def keyed(rows: DataFrame, order: np.ndarray, width: str) -> DataFrame:
    """rows (doc_id, ids) with their key: the least places of a document's tokens, one order after the other."""
    bits = int(order.shape[1]).bit_length()
    order = order.astype(np.uint16 if order.shape[1] <= 65536 else np.int32)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), width) for x in batch["ids"]]
            key = np.zeros(len(texts), np.int64)
            if texts:
                starts = np.cumsum([0, *map(len, texts[:-1])])  # no text is without its end id
                ids = np.concatenate(texts).astype(np.intp)
                for places in order:
                    key = (key << bits) | np.minimum.reduceat(places.take(ids), starts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(key), batch["ids"]], names=["doc_id", "key", "ids"])

    return rows.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, key long, ids binary")


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Inverted:
    """An inverted index over the token ids of some documents, with BM25 weights."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray) -> None:
        n = len(texts)
        self.n, self.idf = n, idf
        self.sizes = np.fromiter(map(len, texts), np.int64, n)
        kind = np.uint32 if len(idf) * n < 2**32 else np.int64  # shorter keys are sorted and divided faster
        key, tf = np.unique(np.concatenate(texts).astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), self.sizes), return_counts=True)
        self.token, self.doc = (x.astype(np.intp) for x in np.divmod(key, kind(n)))
        self.weight = idf[self.token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.sizes[self.doc] / self.sizes.mean()))
        self.first = np.searchsorted(self.token, np.arange(len(idf) + 1))  # postings of a token
        self.by_doc = np.argsort(self.doc.astype(np.uint16) if n <= 65536 else self.doc, kind="stable")
        self.doc_first = np.searchsorted(self.doc[self.by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of each document, itself included, for the QUERY_TOKENS rarest tokens of the seed; of equally rare ones the least ids."""
        own = self.token[self.by_doc[self.doc_first[seed] : self.doc_first[seed + 1]]]
        own = own[np.argsort(-self.idf[own], kind="stable")[:QUERY_TOKENS]]
        spans = [slice(self.first[t], self.first[t + 1]) for t in own]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_shard(docs: list, texts: list[np.ndarray], idf: np.ndarray, window: int):
    """Pieces (row, start, length, sequence, offset) of one shard. texts: ids of each document."""
    index = Inverted(texts, idf)
    n, sizes = index.n, index.sizes
    free = np.ones(n, bool)
    pieces, sequence, filled, cursor = [], 0, 0, 0
    held: list[int] = []  # neighbours of the present seed, best last
    rest = None  # (document, ids before) still to be placed

    def neighbours(seed: int) -> list[int]:
        score = index.scores(seed)
        score[~free] = 0
        found = np.flatnonzero(score)
        most = min(len(found), 64)
        found = found[np.argpartition(-score[found], most - 1)[:most]] if most else found
        return found[np.argsort(score[found], kind="stable")].tolist()

    while True:
        if rest is None:
            while held and not free[held[-1]]:
                held.pop()
            if held and filled:
                rest = (held.pop(), 0)
            else:
                if filled and seed >= 0:  # its neighbours are used up: ask again from the last document placed
                    held = neighbours(last)
                    if held:
                        continue
                while cursor < n and not free[cursor]:
                    cursor += 1
                if cursor == n:
                    break
                rest = (cursor, 0)
            free[rest[0]] = False
        d, before = rest
        if not filled:
            seed, held = d, neighbours(d)
        last = d
        length = min(window - filled, int(sizes[d]) - before)
        pieces.append((d, before, length, sequence, filled))
        filled += length
        rest = (d, before + length) if before + length < sizes[d] else None
        if filled == window:
            sequence, filled, held = sequence + 1, 0, []
    if filled:  # the last window: into powers of two
        tail = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(tail) :]
        for room in _powers(filled):
            used = 0
            while used < room:
                d, before, length, _, _ = tail.pop(0)
                take = min(length, room - used)
                pieces.append((d, before, take, sequence, used))
                used += take
                if take < length:
                    tail.insert(0, (d, before + take, length - take, sequence, 0))
            sequence += 1
    return pieces


def pack(docs: DataFrame, tokenizer: str, vocabulary: int, spaced: bool = False, end: int = 2, window: int = 4096) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most window ids; a row per piece.

    Null and empty texts have the end id alone. Repeated rows and null ids are documents like others. An empty table gives
    no rows. Other columns are ignored. sequence_id is unique over all shards.
    """
    encoded = cut(encode(docs, tokenizer, vocabulary, spaced, end), "packing-ids")
    df = corpus_frequencies(encoded, vocabulary)
    rows = encoded.where(F.col("frequencies").isNull())
    n_docs = rows.count()
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))  # of the vocabulary's size
    width = "<u2" if vocabulary <= 65536 else "<u4"
    shards = max(1, -(-n_docs // SHARD_DOCS))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = PIECES.replace(" long", "").split(", ")
        token_ids.release()
        shard, part = TaskContext.get().partitionId(), 0
        docs, texts, total = [], [], 0

        def made():
            raw = [t.astype("<u4") for t in texts]
            out = [(docs[d], start, length, zlib.crc32(raw[d][start : start + length].tobytes()), len(raw[d]), (shard << 44) + (part << 24) + sequence, offset) for d, start, length, sequence, offset in pack_shard(docs, texts, idf, window)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=names)

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                docs.append(doc)
                texts.append(np.frombuffer(ids.as_buffer(), width))
                total += len(texts[-1])
                if len(docs) >= 4 * SHARD_DOCS or total > 20_000_000:  # an uneven range: another index, in the same task
                    yield made()
                    docs, texts, total, part = [], [], 0, part + 1
        if docs:
            yield made()

    # In one order, so that a task that runs again after a loss packs its shard alike.
    dealt = keyed(rows, orders(df, n_docs), width).repartitionByRange(shards, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(trimmed(run), PIECES)

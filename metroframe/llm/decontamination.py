"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of consecutive words of a benchmark item. It occurs in a document where all its words do, so one necessary
word is enough for a prefix: the one that is rarest in the whole corpus. Documents are joined to the windows on that word;
the word's place in the window bounds where the window can begin and end. A word has few different places in windows, however
many windows it stands for, so each of its occurrences gives few runs of words to look up by their hash, and what is found is
verified word by word.

The benchmark side is an index of bounded size, broadcast as sorted arrays: items are dealt into parts of at most PART_BYTES,
longer ones are cut into overlapping pieces, and each part takes one pass over the documents, however large the benchmark grows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORDS, cut, read_bytes, trimmed
from .winnow import covered, grams, mixed, powers, sums, word_units

#: Bytes of benchmark text that go to every task at once.
PART_BYTES = 8_000_000
#: Occurrences of prefix words looked up together.
STEP = 1 << 16
#: Tells windows of different sizes apart.
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def normal(raw: bytes | None) -> bytes:
    """The words of raw, lower-cased, with spaces for what lies between them."""
    return (raw or b"").translate(ASCII_WORDS)


def _slots(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the values those that are in known (sorted): their numbers, and where in known each is."""
    if not len(known) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    found = np.flatnonzero(known[at] == values)
    return found, at[found]


def _frequencies(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """How often each of one part's words (their hashes, sorted) occurs in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            for raw in read_bytes(batch["text"]):
                np.add.at(seen, _slots(known, word_units(normal(raw))[0])[1], 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.array(some, pa.int64()), "n": pa.array(seen[some], pa.int64())})

    counted = docs.select("text").mapInArrow(trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = np.zeros(len(words), np.int64)
    for r in counted.collect():  # no more rows than the part has words
        total[r["word"]] = r["n"]
    return total


class Index:
    """The windows of a part's items, in sorted arrays; equal windows are one entry with all their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, frequencies) -> None:
        """items: (id or none, normal text with words); frequencies: of sorted hashes of words in the corpus."""
        self.texts = [raw for _, raw in items]
        self.names = sorted({name for name, _ in items} - {None})
        name_of = {None: -1} | {name: i for i, name in enumerate(self.names)}
        split = [word_units(raw) for raw in self.texts]
        words = np.unique(np.concatenate([units for units, _, _ in split])) if split else np.empty(0, np.uint64)
        order = np.lexsort((words, frequencies(words)))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        keys, prefixes, sizes, places, owners, text_of, begins, ends = ([] for _ in range(8))
        for i, (units, first, last) in enumerate(split):
            size = min(window, len(units))
            n = len(units) - size + 1
            ranks = np.lib.stride_tricks.sliding_window_view(rank[np.searchsorted(words, units)], size)
            place = ranks.argmin(axis=1)
            keys.append(grams(units, size) + np.full(n, size, np.uint64) * _SIZE)
            prefixes.append(units[np.arange(n) + place])
            sizes.append(np.full(n, size))
            places.append(place)
            owners.append(np.full(n, name_of[items[i][0]]))
            text_of.append(np.full(n, i))
            begins.append(first[:n])
            ends.append(last[size - 1 :])
        key, prefix, size, place, owner, text, begin, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, prefixes, sizes, places, owners, text_of, begins, ends))
        self.keys, one, entry = np.unique(key.astype(np.uint64), return_index=True, return_inverse=True)
        self.spans = np.stack([text[one], begin[one], end[one]], axis=1)
        entry, self.owners = np.unique(np.stack([entry, owner]), axis=1)
        self.owned = np.searchsorted(entry, np.arange(len(self.keys) + 1))
        # The different (size, place) of each prefix word.
        probes = np.unique(np.stack([prefix.astype(np.uint64), size.astype(np.uint64), place.astype(np.uint64)]), axis=1)
        self.words, self.runs = np.unique(probes[0], return_index=True)
        self.runs = np.append(self.runs, probes.shape[1])
        self.sizes, self.places = probes[1].astype(np.int64), probes[2].astype(np.int64)

    def hits(self, raw: bytes) -> tuple[int, np.ndarray, list[str]]:
        """How many words the normal text has, begin and end of each run of hit words, and the items."""
        units, starts, ends = word_units(raw)
        n = len(units)
        at, word = _slots(self.words, units)
        begins, sizes, entries = [], [], []
        if len(at):
            running, inverse = sums(units), powers(n)[1]
        for low in range(0, len(at), STEP):
            w = word[low : low + STEP]
            many = self.runs[w + 1] - self.runs[w]
            probe = np.repeat(self.runs[w] - np.cumsum(many) + many, many) + np.arange(many.sum())
            begin, size = np.repeat(at[low : low + STEP], many) - self.places[probe], self.sizes[probe]
            inside = (begin >= 0) & (begin + size <= n)
            begin, size = begin[inside], size[inside]
            key = mixed((running[begin + size] - running[begin]) * inverse[begin]) + size.astype(np.uint64) * _SIZE
            found, entry = _slots(self.keys, key)
            begins.append(begin[found])
            sizes.append(size[found])
            entries.append(entry)
        if not sum(map(len, begins)):
            return n, np.empty(0, np.int64), []
        begin, size, entry = (np.concatenate(x) for x in (begins, sizes, entries))
        words: dict[int, list[bytes]] = {}
        true = np.zeros(len(begin), bool)
        for i, (b, k, e) in enumerate(zip(begin.tolist(), size.tolist(), entry.tolist())):
            if e not in words:
                text, first, last = self.spans[e]
                words[e] = self.texts[text][first:last].split()
            true[i] = raw[starts[b] : ends[b + k - 1]].split() == words[e]
        begin, size, entry = begin[true], size[true], np.unique(entry[true])
        runs = np.flatnonzero(np.diff(covered(n, begin, begin + size), prepend=False, append=False))
        items = np.unique(np.concatenate([self.owners[self.owned[e] : self.owned[e + 1]] for e in entry])) if len(entry) else []
        return n, runs, [self.names[i] for i in items if i >= 0]


def _hits(docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, window, lambda words: _frequencies(docs, words)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, spans, found = zip(*(shared.value.hits(normal(raw)) for raw in read_bytes(batch["text"]))) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "spans", "items"])

    return docs.mapInArrow(trimmed(run), "doc_id long, key long, n_words long, spans array<int>, items array<string>")


def _pieces(raw: bytes, window: int) -> list[bytes]:
    """A normal text, or overlapping pieces of a long one: each of its windows lies in one of them."""
    words = raw.split()
    if len(raw) <= PART_BYTES or len(words) <= window:
        return [raw] if words else []
    step = max(1, len(words) * PART_BYTES // len(raw))
    return [b" ".join(words[i : i + step + window - 1]) for i in range(0, len(words) - window + 1, step)]


def _parts(benchmark: DataFrame, window: int):
    """Items with words as (id or none, normal text), in parts of bounded size, read one at a time."""
    sized = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // PART_BYTES) or 1
    given = False
    for part in range(parts):
        rows = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        held, size = [], 0
        for r in sorted(rows, key=lambda r: (r["item"] is not None, r)):
            for piece in _pieces(normal(r["text"].encode()), window):
                if held and size + len(piece) > PART_BYTES:
                    yield held
                    held, size, given = [], 0, True
                held.append((r["item"], piece))
                size += len(piece)
        if held or not given:
            yield held
            given = True


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """A row per document of docs (doc_id, text), by benchmark (item_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A window is so many consecutive words of an item, or all words of a shorter one; a word of a document inside any
    occurrence of a window is hit, and a document is contaminated if at least a twentieth of its words are. Null and empty
    texts have no words and no windows. Items that repeat an id are one item; the windows of those without id hit as well, but n_items
    and items_sha256 are about ids. Repeated documents have a row each. With an empty benchmark nothing is hit. Windows are told apart by 64-bit hashes before their words are
    compared; very long texts and windows of one repeated word take time in proportion to their words.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    hits = None
    for items in _parts(benchmark, window):
        new = _hits(docs, items, window)
        if hits is None:
            hits = new
            continue
        more = new.where(F.size("spans") > 0).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("spans").alias("more"), F.col("items").alias("also")).dropDuplicates(["_doc", "_key"])
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
        hits = cut(hits.join(more, same, "left").select("doc_id", "key", "n_words", F.concat("spans", F.coalesce("more", F.array().cast("array<int>"))).alias("spans"), F.array_union("items", F.coalesce("also", F.array().cast("array<string>"))).alias("items")), "hits")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            hit = []
            for n, spans in zip(batch["n_words"].to_pylist(), batch["spans"]):
                at = spans.values.to_numpy()
                hit.append(int(covered(n, at[::2], at[1::2]).sum()) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], batch["n_words"], pa.array(hit, pa.int64()), batch["items"]], names=["doc_id", "key", "n_words", "n_hit", "items"])

    return hits.mapInArrow(count, "doc_id long, key long, n_words long, n_hit long, items array<string>").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "key",
    )

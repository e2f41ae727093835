"""What the two operators on repeated passages share.

Every window of consecutive units (words or bytes) belongs to its anchor (see winnow), so equal windows belong to equal
anchors. A passage is an anchor with all windows that it anchors in a row; only passages whose anchor occurs again can hold
a repeated window, and only these are looked at. Equal passages are collapsed with a count and their first occurrence before
they are compared, so a passage that a third of all documents share is one row, and so is one that a periodic text has at
every place. The different passages are dealt by anchor into shards of bounded size, where the operator's own index compares
them.

The passages of one anchor may be many and all different (a common sentence in ever new surroundings). They are then dealt on:
the windows that start in one half of the places before the anchor share a longer middle, and so do those of the other half.
Passages with different middles need not be compared, and what of two passages is equal within a half is one row again. Halves
that are still too large are halved in turn, down to single windows, so no task ever holds a large group, and the same index
decides on every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, forget, parallelism, read_bytes, trimmed
from .token_ids import runs as slices
from .winnow import anchors, byte_units, covered, word_units

#: Different passages in a shard, about.
SHARD_PASSAGES = 2000
#: Different passages of one anchor that are compared in one task; beyond, its windows are dealt by halves.
MOST = 1000
#: Bytes of text whose passages are made together.
TOGETHER = 4_000_000
#: An anchor's place is its first window, the number of windows after that and the way to the anchor, in one long.
PLACE_BITS = 12
PLACE_MASK = (1 << PLACE_BITS) - 1


@dataclass(frozen=True)
class Kind:
    """window, k: in units. first: whether the first occurrence stays."""

    words: bool
    window: int
    k: int
    first: bool
    #: Of a shard's rows (h, passage, lead, n), first occurrences in order: units of each row's first occurrence to remove.
    index: Callable[[list[tuple[int, bytes, int, int]], "Kind"], list[list[int]]]

    def __post_init__(self):
        if not 0 < self.k <= self.window <= PLACE_MASK:
            raise ValueError(f"a window has 1 to {PLACE_MASK} units")

    def units(self, raw: bytes) -> np.ndarray:
        return word_units(raw)[0] if self.words else byte_units(raw)

    def digest(self, raw: bytes) -> str:
        return hashlib.sha256(b" ".join(raw.split()) if self.words else raw).hexdigest()

    def slice(self, units, begin: int, end: int) -> bytes:
        return b" ".join(units[begin:end]) if self.words else units[begin:end]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def spans_of_windows(starts, window: int, size: int) -> list[int]:
    """The maximal runs of units in the windows that start there: begin, end, begin, end ..."""
    if not len(starts):
        return []
    starts = np.asarray(starts)
    begin, end = runs(covered(size, starts, starts + window))
    return np.stack([begin, end], axis=1).reshape(-1).tolist()


def _base(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            groups, per_doc, places, per_group, sizes, digests = [], [], [], [], [], []
            for raw in read_bytes(batch["text"]):
                units = kind.units(raw or b"")
                sizes.append(len(units))
                digests.append(kind.digest(raw or b""))
                h, at, first, last = anchors(units, kind.window, kind.k)
                order = np.argsort(h, kind="stable")
                own, n = np.unique(h, return_counts=True)
                groups.append(own)
                per_doc.append(len(own))
                per_group.append(n)
                places.append((first << 2 * PLACE_BITS | last - first << PLACE_BITS | at - first)[order])
            if not sizes:
                continue
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            at = pa.ListArray.from_arrays(offsets(np.concatenate(per_group)), pa.array(np.concatenate(places)))
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(groups).view(np.int64)), at], names=["h", "places"])
            lists = pa.ListArray.from_arrays(offsets(per_doc), found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), lists], names=["doc_id", "key", "n_units", "digest", "anchors"])

    return docs.mapInArrow(trimmed(run), "doc_id long, key long, n_units long, digest string, anchors array<struct<h:long,places:array<long>>>")


def _passages(found: DataFrame, kind: Kind) -> DataFrame:
    """A row for each different passage of a document: h, passage, lead (units before the anchor), doc_id, key, firsts (its places), size, q."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = read_bytes(batch["text"])
            for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), TOGETHER):
                h, passage, lead, row, firsts, size = [], [], [], [], [], []
                for i, (raw, found) in enumerate(zip(texts[a:b], batch["anchors"].slice(a, b - a).to_pylist()), a):
                    units = raw.split() if kind.words else raw
                    for group in found:
                        own: dict[bytes, list[int]] = {}
                        for place in sorted(group["places"]):
                            begin, n = place >> 2 * PLACE_BITS, kind.window + (place >> PLACE_BITS & PLACE_MASK)
                            text = kind.slice(units, begin, begin + n)
                            if text in own:
                                own[text].append(begin)
                                continue
                            own[text] = [begin]
                            h.append(group["h"])
                            passage.append(text)
                            lead.append(place & PLACE_MASK)
                            firsts.append(own[text])
                            size.append(n)
                            row.append(i)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(passage, pa.binary()), pa.array(lead, pa.int32()), batch["doc_id"].take(at), batch["key"].take(at), pa.array(firsts, pa.list_(pa.int32())), pa.array(size, pa.int32())],
                    names=["h", "passage", "lead", "doc_id", "key", "firsts", "size"],
                )

    return found.mapInArrow(trimmed(run), "h long, passage binary, lead int, doc_id long, key long, firsts array<int>, size int").withColumn("q", F.xxhash64("passage"))


def _compared(different: DataFrame, kind: Kind, shards: int) -> DataFrame:
    """Spans of units to remove of each different passage's first occurrence, by the operator's index in shards of whole anchors."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "first"], kind="stable")
        rows = list(zip(pdf["h"].tolist(), pdf["passage"].tolist(), pdf["lead"].tolist(), pdf["n"].tolist()))
        spans = kind.index(rows, kind)
        out = pd.DataFrame({"h": pdf["h"], "q": pdf["q"], "spans": pd.Series(spans, index=pdf.index, dtype=object)})
        return out[out["spans"].map(bool)]

    dealt = different.select("h", "q", "passage", "lead", "n", "doc_id", "first", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, "h long, q long, spans array<int>")


def _halves(hot: DataFrame, kind: Kind) -> DataFrame:
    """Each passage's windows in two halves of the places lo to hi (their starts before the anchor), each under a key of what all of them share."""
    window = kind.window

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key, text, lead, size, at, lo, hi, row = ([] for _ in range(8))
            columns = (batch[c].to_pylist() for c in ("h", "passage", "lead", "size", "lo", "hi"))
            for i, (h, passage, before, n, low, high) in enumerate(zip(*columns)):
                units = passage.split() if kind.words else passage
                mid = (low + high) // 2
                for a, b in ((low, mid), (mid + 1, high)):
                    first, last = max(a, -before), min(b, n - window - before)
                    if first > last:
                        continue
                    core = kind.slice(units, b + before, a + window + before)
                    key.append(int.from_bytes(hashlib.blake2b(b"%d %d %d " % (h, a, b) + core, digest_size=8).digest(), "little", signed=True))
                    text.append(kind.slice(units, first + before, last + window + before))
                    for to, value in ((lead, -first), (size, last - first + window), (at, first + before), (lo, a), (hi, b), (row, i)):
                        to.append(value)
            take = pa.array(row, pa.int32())
            ints = [pa.array(x, pa.int32()) for x in (lead, size, at, lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [batch["h"].take(take), batch["q"].take(take), pa.array(key, pa.int64()), pa.array(text, pa.binary()), *ints, *(batch[c].take(take) for c in ("n", "doc_id", "first"))],
                names=["up_h", "up_q", "h", "passage", "lead", "size", "at", "lo", "hi", "n", "doc_id", "first"],
            )

    made = hot.select("h", "q", "passage", "lead", "size", "lo", "hi", "n", "doc_id", "first")
    made = made.mapInArrow(trimmed(run), "up_h long, up_q long, h long, passage binary, lead int, size int, at int, lo int, hi int, n long, doc_id long, first int")
    return made.withColumn("q", F.xxhash64("passage")).withColumn("first", F.col("first") + F.col("at"))


def _spans(different: DataFrame, kind: Kind, n_tasks: int) -> DataFrame:
    """(h, q, spans) of different passages (h, q, passage, lead, size, lo, hi, n, doc_id, first: of the first occurrence)."""
    sizes = different.groupBy("h").agg(F.count("*").alias("of"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    many = cut(sizes.where((F.col("of") > MOST) & (F.col("lo") < F.col("hi"))).select("h"), "repeats-many")
    shards = max(4 * n_tasks, -(-different.count() // SHARD_PASSAGES))
    if many.isEmpty():
        return _compared(different, kind, shards)
    hot = different.join(many, "h", "left_semi")
    parts = cut(_halves(hot, kind), "repeats-parts")
    below = _different(parts.withColumn("times", F.col("n")))
    marks = cut(_marks(below, _spans(below, kind, n_tasks)), "repeats-marks")
    found = parts.select("up_h", "up_q", "h", "q", "at", "size", "doc_id", "first").join(marks, ["h", "q"])
    found = found.select("up_h", "up_q", _taken(kind, F.col("first"), F.col("at")).alias("spans"))
    found = found.groupBy(F.col("up_h").alias("h"), F.col("up_q").alias("q")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return _compared(different.join(many, "h", "left_anti"), kind, shards).unionByName(found.where(F.size("spans") > 0))


def _different(passages: DataFrame) -> DataFrame:
    """Passages (h, q, passage, lead, size, lo, hi, times, doc_id, first) as different ones, with their count and first occurrence."""
    origin = F.min(F.struct("doc_id", "first")).alias("origin")
    found = passages.groupBy("h", "q", "passage").agg(F.sum("times").alias("n"), origin, *(F.min(c).alias(c) for c in ("lead", "size", "lo", "hi")))
    return cut(found.select("h", "q", "passage", "n", "lead", "size", "lo", "hi", "origin.*"), "repeats-passages")


def _marks(different: DataFrame, spans: DataFrame) -> DataFrame:
    marks = different.select("h", "q", "n", F.struct("doc_id", "first").alias("origin")).join(cut(spans, "repeats-spans"), ["h", "q"], "left")
    return marks.where("n > 1 or spans is not null")


def _taken(kind: Kind, first, at):
    """What goes of an occurrence that begins at first in its document: the spans found if it is the first one (or the only one), else all; moved by at."""
    own = F.struct(F.col("doc_id"), first.alias("first")) == F.col("origin") if kind.first else F.col("n") == 1
    spans = F.transform(F.coalesce("spans", F.array().cast("array<int>")), lambda x: x + at)
    return F.when(own, spans).otherwise(F.array(at, at + F.col("size")))


def find(docs: DataFrame, kind: Kind, text: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """Of docs (doc_id, text): a row for each document (doc_id, key, n_units, digest, gone: whether all of it goes as a copy),
    one for each other one that loses units (doc_id, key, n_removed, n_spans, kept_sha256, with text also kept_text), and
    whether an id stands for several rows, so that key is the hash of the text and not 0.

    Copies come first: of documents with equal units only the one of least id is compared with others.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    base = whole = cut(_base(keyed, kind), "repeats-base")
    repeated = not base.groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:  # ids tell documents apart, as they should
        keyed, base = (df.withColumn("key", F.lit(0).cast("long")) for df in (keyed, base))
    copies = base.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.count("*").alias("n_copies"))
    copies = cut(copies, "repeats-copies")
    anchored = cut(base.join(copies.select("one.*"), ["doc_id", "key"], "left_semi").select("doc_id", "key", "anchors"), "repeats-places")
    base = cut(base.drop("anchors"), "repeats-documents")
    forget(whole)
    places = anchored.select("doc_id", "key", F.explode("anchors").alias("a")).select("doc_id", "key", "a.*")
    again = cut(places.groupBy("h").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("h"), "repeats-anchors")
    mine = places.join(again, "h", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("h", "places")).alias("anchors"))
    found = cut(keyed.join(mine, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]), "repeats-texts")
    forget(anchored)
    copied = F.col("one") != F.struct("doc_id", "key") if kind.first else F.col("n_copies") > 1
    base = base.join(copies, "digest", "left").withColumn("gone", F.coalesce((F.col("n_units") >= kind.window) & F.col("doc_id").isNotNull() & copied, F.lit(False))).drop("one", "n_copies")
    passages = _passages(found, kind)
    at_all = {"times": F.size("firsts").cast("long"), "first": F.col("firsts")[0], "lo": F.lit(kind.k - kind.window), "hi": F.lit(0)}
    different = _different(passages.withColumns(at_all))
    marks = cut(_marks(different, _spans(different, kind, n)), "repeats-marks")
    hits = passages.select("h", "q", "doc_id", "key", "firsts", "size").join(marks, ["h", "q"])
    hits = hits.select("doc_id", "key", F.flatten(F.transform("firsts", lambda x: _taken(kind, x, x))).alias("spans")).where(F.size("spans") > 0)
    hits = hits.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def remove(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            out = []
            for raw, spans in zip(read_bytes(batch["text"]), batch["spans"]):
                units = raw.split() if kind.words else raw
                at = spans.values.to_numpy()
                gone = covered(len(units), at[::2], at[1::2])
                begin, end = runs(~gone)
                kept = [units[b:e] for b, e in zip(begin.tolist(), end.tolist())]
                kept = b" ".join(w for k in kept for w in k) if kind.words else b"".join(kept)
                out.append((int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if text else None))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "key", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    once = found.select("doc_id", "key", "text").join(hits, ["doc_id", "key"])
    changed = once.mapInArrow(trimmed(remove), "doc_id long, key long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return base, changed, repeated


def report(docs: DataFrame, kind: Kind) -> DataFrame:
    """A row per document: doc_id, n_units, n_removed, n_spans, kept_sha256."""
    base, changed, _ = find(docs, kind)
    gone = lambda all_, other, none: F.when(F.col("gone"), all_).otherwise(F.coalesce(other, none))
    return base.join(changed.drop("kept_text"), ["doc_id", "key"], "left").select(
        "doc_id",
        "n_units",
        gone(F.col("n_units"), "n_removed", F.lit(0)).alias("n_removed"),
        gone(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        gone(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", "digest").alias("kept_sha256"),
    )


def clean(docs: DataFrame, kind: Kind) -> DataFrame:
    """docs with all their columns, the text without what is removed; a character that loses a byte goes whole."""
    base, changed, repeated = find(docs.select("doc_id", "text"), kind, text=True)
    kept = base.where("gone").select("doc_id", "key", F.lit("").alias("kept_text")).unionByName(changed.join(base.where("gone"), ["doc_id", "key"], "left_anti").select("doc_id", "key", "kept_text"))
    kept = kept.dropDuplicates(["doc_id", "key"])
    key = F.xxhash64(docs["text"]) if repeated else F.lit(0).cast("long")
    named = kept.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("kept_text").alias("_kept"))
    joined = docs.join(named, (docs["doc_id"] == named["_doc"]) & (key == named["_key"]), "left")
    return joined.select(*(F.coalesce(named["_kept"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns))

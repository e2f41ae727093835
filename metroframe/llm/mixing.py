"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens: its words and one end. The model codes a token as a path of binary decisions (a Huffman code
over the most frequent training tokens). Each decision is predicted from several contexts, the tokens before it, hashed into
tables of counts of fixed size; a mixer adds the predictions in the logistic domain with weights that the depth of the decision
selects (gates), and learns them online, decision by decision, from the text itself. An adaptive table refines the mixed
probability. Decisions so deep that no context is kept for
them have the prediction of their own counts. Where a text follows another one of the training documents, that one predicts the next token as a whole; whether
it is right is one more decision, predicted by how often it has just been right. These contexts are looked up in a table of
all training documents, which grows with them. Tokens beyond the code take an escape and are coded by what the whole corpus has of them (a share of the rest)
together with a spelling model over their bytes.

Counts come from the training documents alone. Frequent tokens are a bounded list that goes to every task; all others meet
their counts in a join, so that nothing of the size of the vocabulary is ever in one place.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, member, parallelism, read_bytes, trimmed
from .token_ids import runs
from .winnow import _SPACE, BASE, BYTES, grams, mixed, sums

#: Tokens in the code, with the end and the escape.
CODED = 1 << 16
SLOTS = 1 << 18
ORDERS = 3
CHUNK = 1 << 16
#: Decisions that one mixer sees before it starts anew.
SEGMENT = 2048
GATES = 24
RATE = 0.02
BUCKETS = 24
#: Classes of bytes in the spelling model; class 0 ends a word, the last stands for all other bytes.
CLASSES = 40
#: Tokens before a decision are told apart up to these ranks, and decisions below these depths have no context, by order.
RANKS, DEPTHS = (2048, 64), (12, 10)
#: What a context's counts are blended with, in counts of the shorter context's prediction.
BLEND = 4.0
END, ESCAPE = 0, 1
#: Words of more bytes are hashed one by one.
LONG = 64
#: Bits of a hash by which the code's tokens are found.
PREFIX = 20
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # masks of the first bytes of eight
#: Tokens of a context that a text is followed by; one of so many contexts is looked up; tokens kept after one, at most.
CONTEXT, SPACED, AHEAD = 4, 5, 256
SPACING = 1 << SPACED


def is_training(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


class Code:
    """tokens: hashes of the coded words, most frequent first; counts: of END, ESCAPE and these."""

    def __init__(self, tokens: np.ndarray, counts: list[int]):
        order = np.argsort(tokens)
        self.tokens, self.symbols = tokens[order], order + 2
        heap = [(c, i, None, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        made = n = len(counts)
        left, right = {}, {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            left[made], right[made] = a[1], b[1]
            heapq.heappush(heap, (a[0] + b[0], made, None, None))
            made += 1
        paths: list = [None] * made
        paths[heap[0][1]] = ((), ())
        for node in range(made - 1, n - 1, -1):
            nodes, bits = paths[node]
            paths[left[node]] = (nodes + (made - 1 - node,), bits + (0,))
            paths[right[node]] = (nodes + (made - 1 - node,), bits + (1,))
            paths[node] = None
        self.length = np.array([len(p[0]) for p in paths[:n]], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.nodes = np.concatenate([np.array(p[0], np.uint32) for p in paths[:n]])
        self.bits = np.concatenate([np.array(p[1], np.uint8) for p in paths[:n]])
        self.slots = self.nodes % np.uint32(SLOTS)
        self.scatter = (self.nodes + np.uint32(1)) * np.uint32(0x27D4EB2F)
        #: Where the tokens of each beginning stand among those in order, and how many have one at most.
        prefix = (self.tokens >> np.uint64(64 - PREFIX)).astype(np.int64)
        self.first = np.searchsorted(prefix, np.arange(1 << PREFIX)).astype(np.int32)
        self.most = int(np.bincount(prefix, minlength=1).max()) if len(prefix) else 0

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), ESCAPE)
        at = self.first[(words >> np.uint64(64 - PREFIX)).astype(np.int64)]
        for step in range(self.most):
            place = np.minimum(at + step, len(self.tokens) - 1)
            found = np.flatnonzero(self.tokens[place] == words)
            out[found] = self.symbols[place[found]]
        return out

    def decisions(self, symbols: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, most: int | None = None):
        """For texts of symbols: slots by order, bits and depths of all decisions, and where each text's begin. keep: the symbols that are coded. most: of each, the first decisions alone."""
        before = np.concatenate([[END], symbols[:-1]])
        before[offsets[:-1]] = END
        earlier = np.concatenate([[END], before[:-1]])
        earlier[offsets[:-1]] = END
        if keep is not None:
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            symbols, before, earlier = symbols[keep], before[keep], earlier[keep]
        own = self.length[symbols] if most is None else np.minimum(self.length[symbols], most)
        begin = np.cumsum(own) - own
        total = int(own.sum())
        narrow = np.int32 if total + len(self.nodes) < 2**31 else np.int64
        place = np.arange(total, dtype=narrow)
        depth = (place - np.repeat(begin.astype(narrow), own)).astype(np.uint8)
        index = place + np.repeat((self.start[symbols] - begin).astype(narrow), own)
        contexts = (np.minimum(before, RANKS[0]) + 1, np.minimum(before, RANKS[1]) * (RANKS[1] + 1) + np.minimum(earlier, RANKS[1]) + 7)
        scatter = self.scatter[index]
        slots = [self.slots[index]]
        for context, deepest in zip(contexts, DEPTHS):
            slot = np.repeat(context.astype(np.uint32) * np.uint32(0x9E3779B1), own)
            slot ^= scatter
            slot *= np.uint32(0x165667B1)
            slot >>= np.uint32(14)
            slot[depth >= deepest] = SLOTS
            slots.append(slot)
        ends = np.append(begin, total)
        return slots, self.bits[index], depth, ends[offsets]


    def deep(self, first: np.ndarray) -> np.ndarray:
        """The bits (-log2 of the probability) of each symbol's decisions that no order has a context for: what first has of a slot is all that predicts them."""
        p = first[self.slots]
        place = np.arange(len(p)) - np.repeat(self.start, self.length)
        bits = np.where(place < max(DEPTHS), 0, -np.log2(np.where(self.bits > 0, p, 1 - p).astype(np.float64)))
        return np.bincount(np.repeat(np.arange(len(self.length)), self.length), bits, len(self.length))


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words b[start:end], each from its length and its bytes, eight at a time. b has eight more bytes after the last word."""
    size = ends - starts
    eight = np.ndarray((len(b) - 7,), "<u8", b, 0, (1,))
    h = mixed((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE))
    for w in np.flatnonzero(size > LONG):
        h[w] = mixed(h[w : w + 1] + sums(BYTES[b[starts[w] : ends[w]]])[-1:])[0]
    left = np.flatnonzero((size > 8) & (size <= LONG))
    for done in range(8, LONG, 8):
        left = left[size[left] > done]
        h[left] = mixed(h[left] * np.uint64(BASE) + (eight[starts[left] + done] & _FIRST[np.minimum(size[left] - done, 8)]))
    return h


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of the words of all texts with a 0 for each end, where each text begins, and the words: all bytes, their starts and ends."""
    raw = b" ".join([*((t or b"") for t in texts), b" " * 8]).lower()
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(b) and not space[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    until = np.searchsorted(starts, np.cumsum(sizes))  # words before each text's end
    offsets = np.append(0, until + np.arange(1, len(texts) + 1)).astype(np.int64)
    tokens = np.zeros(offsets[-1], np.uint64)
    word = np.ones(len(tokens), bool)
    word[offsets[1:] - 1] = False
    tokens[word] = hashes(b, starts, ends)
    return tokens, offsets, (b, starts, ends)


def squash(x):
    return 1 / (1 + np.exp(-x))


def stretches(slots: list[np.ndarray], first: np.ndarray, stretch: np.ndarray, pairs: list[np.ndarray]) -> list[np.ndarray]:
    """The predictions of each order, in the logistic domain, for decisions with these slots. first: the shortest order's probabilities by slot, and
    stretch the same in that domain; pairs: ones and zeros by slot of each other order, blended with the shorter one's prediction."""
    out = [np.empty(len(slots[0]), np.float32) for _ in slots]
    blend = np.float32(BLEND)
    for a in range(0, len(slots[0]), 1 << 15):  # what is made meanwhile stays in a processor's cache
        part = slice(a, a + (1 << 15))
        at = slots[0][part]
        p, out[0][part] = first[at], stretch[at]
        for pair, s, to in zip(pairs, slots[1:], out[1:]):
            seen = pair[s[part]]
            one, zero = seen.real + blend * p, seen.imag + blend * (1 - p)
            p = one / (one + zero)
            np.log(one / zero, out=to[part])
    return out


def mix(stretched: list[np.ndarray], bits: np.ndarray, depth: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The bits (-log2 of the probability) of each text's decisions together. Each text is mixed in segments, many side by side."""
    sizes = np.diff(begins)
    pieces = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), pieces)
    part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[:-1][text] + part * SEGMENT
    length = np.minimum(SEGMENT, begins[1:][text] - start)
    order = np.argsort(-length, kind="stable")
    text, start, length = text[order], start[order], length[order]
    lanes, steps = len(start), int(length[0]) if len(start) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # lanes that have a decision in each step
    ends = np.cumsum(active)
    # All decisions in the order in which they are taken, the lanes of a step side by side.
    order = np.empty(int(ends[-1]) if steps else 0, np.intp)
    for t, (a, e) in enumerate(zip(active.tolist(), ends.tolist())):
        np.add(start[:a], t, out=order[e - a : e])
    inputs = [s[order].astype(np.float32, copy=False) for s in stretched]
    bit = bits[order]
    gates = np.minimum(depth, GATES - 1)[order]
    weights = [np.full(GATES * lanes, w, np.float32) for w in (0.1, 0.3, 0.6)[: len(stretched)]]
    refined = np.tile(squash(np.linspace(-8, 8, BUCKETS)).astype(np.float32), lanes)
    final = np.empty(len(order), np.float32)
    lane, rows = np.arange(lanes), np.arange(lanes) * BUCKETS
    rate, slow, scale = np.float32(RATE), np.float32(1 / 64), np.float32((BUCKETS - 1) / 16)
    buffers = [np.empty(lanes, np.float32) for _ in range(4 + len(stretched))]
    where, near = np.empty(lanes, np.intp), np.empty(lanes, np.intp)
    for a, e in zip(active.tolist(), ends.tolist()):
        x = [s[e - a : e] for s in inputs]
        gate, bucket = where[:a], near[:a]
        mix_, p, change, fine, *own = (v[:a] for v in buffers)
        np.multiply(gates[e - a : e], lanes, out=gate, dtype=np.intp)
        gate += lane[:a]
        for w, o in zip(weights, own):
            w.take(gate, out=o, mode="clip")
        np.multiply(own[0], x[0], out=mix_)
        for o, y in zip(own[1:], x[1:]):
            np.multiply(o, y, out=p)
            mix_ += p
        np.maximum(mix_, np.float32(-8), out=mix_)
        np.minimum(mix_, np.float32(8), out=mix_)
        np.negative(mix_, out=p)
        np.exp(p, out=p)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        seen = bit[e - a : e]
        np.subtract(seen, p, out=change)
        change *= rate
        for w, o, y in zip(weights, own, x):
            np.multiply(change, y, out=fine)
            o += fine
            w[gate] = o
        mix_ += np.float32(8)
        mix_ *= scale
        mix_ += np.float32(0.5)
        bucket[:] = mix_
        bucket += rows[:a]
        refined.take(bucket, out=fine, mode="clip")
        p *= np.float32(0.75)
        np.multiply(fine, np.float32(0.25), out=mix_)
        np.add(p, mix_, out=final[e - a : e])
        np.subtract(seen, fine, out=change)
        change *= slow
        fine += change
        refined[bucket] = fine
    del inputs, order, gates
    np.clip(final, np.float32(1e-5), np.float32(1 - 1e-5), out=final)
    np.subtract(np.float32(1), final, out=final, where=bit == 0)
    np.log2(final, out=final)
    cost = np.zeros(lanes)
    for a, e in zip(active.tolist(), ends.tolist()):
        cost[:a] -= final[e - a : e]
    return np.bincount(text, cost, len(sizes))


def _spelled(words: tuple, which: np.ndarray, classes: np.ndarray):
    """Classes of the bytes of escaped words with the three before them, each word with an end, as numbers to base CLASSES; and the word of each."""
    raw, starts, ends = words
    begin, size = starts[which], ends[which] - starts[which] + 1
    ends = np.cumsum(size) - 1
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(ends - size + 1, size)
    flat = classes[raw[np.repeat(begin, size) + place]]
    flat[ends] = 0
    index = flat.copy()
    for back in (1, 2, 3):
        index += np.where(place >= back, np.roll(flat, back), 0) * CLASSES**back
    return index, word, len(which)


def _slices(batches, most: int = 2_000_000):
    for batch in batches:
        raw = read_bytes(batch["text"])
        for a, b in runs(np.fromiter((len(r or b"") for r in raw), np.int64, len(raw)), most):
            yield batch.slice(a, b - a), raw[a:b]


def brief(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token's hash, none of them 0."""
    return (tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _contexts(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of texts that are looked up: hash, text, where the token after it stands, and where those end that are kept after it (at the next such place)."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = grams(tokens, CONTEXT)
    at = np.flatnonzero(h % np.uint64(SPACING) == 0)
    end = offsets[doc[at] + 1]
    inside = at + CONTEXT < end
    at, end = at[inside], end[inside]
    after = at + CONTEXT
    return h[at].view(np.int64), doc[at], after, np.minimum(np.minimum(after + AHEAD, end), np.append(after[1:], len(tokens)))


def _anchors(docs: DataFrame) -> DataFrame:
    """The contexts of docs (doc_id, key, text) that are looked up: h, key, and whether the text is a training one."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in _slices(batches, 4_000_000):
            h, own, _, _ = _contexts(*tokens_of(texts)[:2])
            train = np.fromiter((is_training(d) for d in batch["doc_id"].to_pylist()), bool, len(texts))[own]
            yield pa.RecordBatch.from_arrays([pa.array(h), batch["key"].take(pa.array(own)), pa.array(train)], names=["h", "key", "train"])

    return docs.mapInArrow(trimmed(run), "h long, key long, train boolean")


def _following(docs: DataFrame, wanted) -> DataFrame:
    """Those contexts that wanted (a function of hashes without the bits that all contexts share) lets through: h, key, at (where the token after it stands), next (tokens from there on, training documents alone)."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in _slices(batches, 4_000_000):
            tokens, offsets, _ = tokens_of(texts)
            h, own, after, ends = _contexts(tokens, offsets)
            some = wanted(h >> SPACED)
            h, own, after, ends = h[some], own[some], after[some], ends[some]
            raw = memoryview(brief(tokens).tobytes())
            train = np.fromiter((is_training(d) for d in batch["doc_id"].to_pylist()), bool, len(texts))[own]
            following = [raw[4 * a : 4 * b].tobytes() if t else None for a, b, t in zip(after.tolist(), ends.tolist(), train.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h), batch["key"].take(pa.array(own)), pa.array((after - offsets[own]).astype(np.int32)), pa.array(following, pa.binary())], names=["h", "key", "at", "next"])

    return docs.mapInArrow(trimmed(run), "h long, key long, at int, next binary")


def _matches(docs: DataFrame) -> DataFrame:
    """What other training documents have after the contexts of each text: key, matches (at, next). Of a context's documents two are
    kept, so that each text has one that isn't its own. Most contexts are met once: those that are not are found first, by their
    hashes alone, and what follows is taken, written and shuffled for them."""
    met = _anchors(docs).groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("train").alias("train"))
    held = Tables()
    met = held.cut(met.where("low < high and train").select(F.shiftright("h", SPACED).alias("h")), "mixing-met")
    found = held.cut(_following(docs, member(met)), "mixing-anchors")  # and, by chance, few that are met once, which match nothing
    one = F.when(F.col("next").isNotNull(), F.struct("key", "next"))
    kept = found.groupBy("h").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    kept = held.cut(kept.where("low is not null"), "mixing-contexts")
    other = F.when(F.col("low.key") != F.col("key"), F.col("low.next")).when(F.col("high.key") != F.col("key"), F.col("high.next"))
    hits = found.select("h", "key", "at").join(kept, "h").select("key", F.struct("at", other.alias("next")).alias("match")).where("match.next is not null")
    matches = cut(hits.groupBy("key").agg(F.collect_set("match").alias("matches")), "mixing-matches")
    held.forget()
    return matches


def predicted(matches: list, offsets: np.ndarray) -> np.ndarray:
    """The (brief) token that a match predicts at each place, 0 where there is none. matches: of each text a list of (at, next); the last one that reaches a place counts."""
    out = np.zeros(offsets[-1], np.uint32)
    for begin, end, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), matches):
        for at, following in sorted((m["at"], m["next"]) for m in own or ()):
            values = np.frombuffer(following, "<u4")[: end - begin - at]
            out[begin + at : begin + at + len(values)] = values
    return out


def followed(guess: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token is as predicted, and the bits that it costs to say so (0 without a prediction): the more predictions were right in a row, the fewer."""
    place = np.arange(len(guess))
    hit = (guess != 0) & (guess == tokens)
    last = np.maximum.accumulate(np.where(hit, -1, place))  # the last place so far where none was right
    before = np.maximum(np.append(-1, last[:-1]), np.repeat(offsets[:-1] - 1, np.diff(offsets)))
    row = place - before - 1
    right = (row + 1.5) / (row + 2.0)
    return hit, np.where(guess == 0, 0.0, -np.log2(np.where(hit, right, 1 - right)))


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch, texts in _slices(batches, 8_000_000):
            texts = [t for d, t in zip(batch["doc_id"].to_pylist(), texts) if is_training(d)]
            token, n = np.unique(tokens_of(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return docs.mapInArrow(trimmed(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _tables(docs: DataFrame, code: Code, classes: np.ndarray, salts: int) -> dict[int, np.ndarray]:
    """Counts by slot and bit of each order, and of four bytes: chunks of fixed size, added up on the executors."""
    size = ORDERS * SLOTS * 2 + CLASSES**4

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        seen = np.zeros(len(code.length), np.int64)
        for batch, texts in _slices(batches):
            texts = [t for d, t in zip(batch["doc_id"].to_pylist(), texts) if is_training(d)]
            if not texts:
                continue
            tokens, offsets, words = tokens_of(texts)
            symbols = code.symbols_of(tokens)
            symbols[offsets[1:] - 1] = END
            seen += np.bincount(symbols, minlength=len(seen))
            slots, bits, _, _ = code.decisions(symbols, offsets, most=max(DEPTHS))
            for o, s in enumerate(slots[1:], 1):
                total[o * SLOTS * 2 : (o + 1) * SLOTS * 2] += np.bincount(s.astype(np.int64) * 2 + bits, minlength=SLOTS * 2 + 2)[: SLOTS * 2]
            rare = np.flatnonzero(symbols == ESCAPE)
            text = np.searchsorted(offsets, rare, "right") - 1
            total[ORDERS * SLOTS * 2 :] += np.bincount(_spelled(words, rare - text, classes)[0], minlength=CLASSES**4)
        # Decisions without context: each symbol's, as often as it has been seen.
        np.add.at(total, code.slots.astype(np.int64) * 2 + code.bits, np.repeat(seen, code.length))
        chunks = [(k, c) for k in range(0, size, CHUNK) if (c := total[k : k + CHUNK]).any()]
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k for k, _ in chunks], pa.int64()), "salt": pa.array([salt] * len(chunks), pa.int64()), "counts": pa.array([c.astype("<u4").tobytes() for _, c in chunks], pa.binary())})

    def add(pdf, kind):
        import pandas as pd

        total = sum(np.frombuffer(c, kind).astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "salt": pdf["salt"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})

    schema = "chunk long, salt long, counts binary"
    summed = docs.mapInArrow(trimmed(run), schema).groupBy("chunk", "salt").applyInPandas(lambda pdf: add(pdf, "<u4"), schema).groupBy("chunk").applyInPandas(lambda pdf: add(pdf, "<i8"), schema)
    total = np.zeros(size, np.int64)
    for row in summed.select("chunk", "counts").collect():  # size / CHUNK chunks
        part = np.frombuffer(bytes(row["counts"]), "<i8")
        total[row["chunk"] : row["chunk"] + len(part)] = part
    return total


def score(docs: DataFrame) -> DataFrame:
    """A row per document of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Words are parted by ASCII white space and lower-cased (A-Z). Null texts are empty and have the end alone. Documents whose
    crc32(doc_id) mod 7 is 2 are held out, all others (those without id too) train. base_score is that of add-one unigrams,
    score the model's, both log10. bits_per_byte is over the text's bytes and the end. Repeated rows have a row each. Tokens
    are told apart by 64-bit hashes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("doc_id", "text"))  # equal rows have equal scores
    counts = cut(_counts(docs), "mixing-counts")
    trained, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    once = counts.where("n = 1 and token != 0").count()  # as often, by Good and Turing, a token is new
    top = counts.where("n > 1 and token != 0").orderBy(F.desc("n"), "token").limit(CODED - 2).collect()  # a bounded list
    ends = counts.where("token = 0").select("n").first()
    ends = ends[0] if ends else 0
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    seen = np.array([r["n"] for r in top], np.int64)
    rest = int(trained - ends - seen.sum())
    trust = 1 - once / rest if rest else 0.0  # the share of escaped tokens that are not new
    code = Code(tokens, [max(1, ends), max(1, rest), *seen.tolist()])
    classes = np.full(256, CLASSES - 1, np.int64)
    for i, c in enumerate(b"etaoinshrldcumfpgwybvk.,xqzj\xc3\xa9\xa8\xaa\xa7\xb3\xad\xb1\xa4\xb6"):
        classes[c] = i + 1
    salts = max(1, math.isqrt(parallelism(spark)))
    total = _tables(docs, code, classes, salts)
    n = total[: ORDERS * SLOTS * 2].reshape(ORDERS, SLOTS, 2)
    first = (n[0, :, 1] + 0.4) / (n[0].sum(axis=1) + 0.8)
    first, stretch = first.astype(np.float32), np.log(first / (1 - first)).astype(np.float32)
    pairs = [np.append(x[:, 1] + 1j * x[:, 0], 0).astype(np.complex64) for x in n[1:]]  # ones and zeros of a slot, looked up together; no context: no counts
    fours = total[ORDERS * SLOTS * 2 :].reshape((CLASSES,) * 4).astype(np.float64)
    spelling = np.full(CLASSES, 1 / CLASSES)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):  # each with the shorter context's prediction as 4 counts
        n = fours.sum(axis=axes)
        spelling = (n + 4 * spelling) / (n.sum(axis=-1, keepdims=True) + 4)
    spelling[..., -1] /= 256 - (classes < CLASSES - 1).sum()  # which of the other bytes
    spelling = np.log10(spelling).astype(np.float32).reshape(-1)
    deep = code.deep(first)
    known = np.concatenate([[0.0, 0.0], np.log10(seen + 1)])
    log_ends = math.log10(ends + 1)

    def run(batches):
        import pyarrow as pa

        for batch, texts in _slices(batches):
            tokens, offsets, words = tokens_of(texts)
            symbols = code.symbols_of(tokens)
            symbols[offsets[1:] - 1] = END
            hit, said = followed(predicted(batch["matches"].to_pylist(), offsets), brief(tokens), offsets)
            slots, bits, depth, begins = code.decisions(symbols, offsets, ~hit, max(DEPTHS))
            stretched = stretches(slots, first, stretch, pairs)
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            cost = mix(stretched, bits, depth, begins) + np.bincount(doc, said + np.where(hit, 0, deep[symbols]), len(texts))
            del slots, bits, depth, stretched
            base = np.bincount(doc, known[symbols], len(texts)) + log_ends
            had = np.bincount(doc, symbols > ESCAPE, len(texts)) + (ends > 0)
            rare = np.flatnonzero(symbols == ESCAPE)
            at, word, n_words = _spelled(words, rare - doc[rare], classes)
            spelled = pa.array(np.bincount(word, spelling[at], n_words), mask=hit[rare])  # none for what a match has said
            split = np.searchsorted(rare, offsets)
            names = ["doc_id", "n_tokens", "n_bytes", "had", "base", "bits", "tokens", "spelled"]
            lists = pa.array(split.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(offsets)), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(had.astype(np.int64)), pa.array(base), pa.array(cost), pa.ListArray.from_arrays(lists, pa.array(tokens[rare].view(np.int64))), pa.ListArray.from_arrays(lists, spelled)],
                names=names,
            )

    matched = docs.join(_matches(docs), "key", "left").drop("key")
    scored = matched.mapInArrow(trimmed(run), "doc_id long, n_tokens long, n_bytes long, had long, base double, bits double, tokens array<long>, spelled array<double>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "mixing-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tokens", "spelled")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.spelled").alias("spelled"))
    joined = rare.join(counts.where("token != 0"), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.lit(trust) * F.col("n") / F.lit(float(max(1, rest))) + F.lit(max(1 - trust, 1e-6)) * F.pow(F.lit(10.0), "spelled")
    beyond = joined.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_base"), F.sum(F.when(F.col("spelled").isNotNull(), F.log10(F.greatest(share, F.lit(1e-300))))).alias("rare_score"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("rare_known"))
    out = scored.drop("tokens", "spelled").join(beyond, "row", "left")
    zero = F.lit(0)
    total_score = F.coalesce("rare_score", zero) - F.col("bits") * math.log10(2)
    return out.select(
        "doc_id",
        (F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))).alias("held_out"),
        "n_tokens",
        (F.col("had") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(int(trained)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * math.log10(trained + distinct + 1)).alias("base_score"),
        total_score.alias("score"),
        (-total_score / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

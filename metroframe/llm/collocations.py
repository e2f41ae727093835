"""Phrase collocations by level-wise passes (Apriori).

Level one counts words. Each further level broadcasts which phrases of the level before are frequent, and a pass over the texts
emits a phrase of k words only where both phrases of k - 1 words in it may be. The broadcast is a table of bits by hash, of a size
that has a bound (BITS) whatever the corpus: a bit that another phrase has set lets a phrase through that the count then drops, so
levels are exact. Tasks count what they emit by ids of their own before it is shuffled. Cuts are scored from the level tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_bytes, trimmed

#: A-Z to a-z; what parts pieces to a full stop.
PIECES = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bytes of text whose phrases are counted together.
TOGETHER = 6_000_000
#: Rows of a record batch that are taken out of it at once.
AT_ONCE = 256
#: Bits of the broadcast table at most, and for each frequent phrase where they are fewer.
BITS, BITS_EACH = 1 << 28, 32
#: Rows of a language, and of its parts, that are ranked together: see best().
PARTS = 64


def slices(text: bytes, size: int):
    """The text in slices of about size bytes, cut where words end."""
    begin = 0
    while len(text) - begin > size:
        end = max(text.rfind(c, begin, begin + size) for c in (b" ", b"\t", b"."))
        if end < begin:
            ends = [e for e in (text.find(c, begin + size) for c in (b" ", b"\t", b".")) if e >= 0]
            if not ends:
                break
            end = min(ends)
        yield text[begin : end + 1]
        begin = end + 1
    yield text[begin:]


def seed(lang: str) -> int:
    import zlib

    return zlib.crc32(lang.encode())


def hashed(words, lang: str) -> np.ndarray:
    import xxhash

    own = seed(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, own) for w in words), np.uint64, len(words))


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    out = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    return out ^ (out >> np.uint64(29))


class Bits:
    """What a broadcast holds of the frequent phrases: a bit for each, by hash."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bits_of(level: DataFrame, most: int = BITS) -> Bits:
    """The table of bits of a level (lang, phrase). It is put together from words of 64 bits, of which there are most / 64 at most."""
    import pyarrow as pa

    n = 1 << max(10, (level.count() * BITS_EACH - 1).bit_length())
    n = min(n, most)

    @trimmed
    def places(batches):
        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), read_bytes(batch.column(1))
            out = np.empty(len(phrases), np.int64)
            for i, (lang, phrase) in enumerate(zip(langs, phrases)):
                words = hashed(phrase.split(b" "), lang)
                h = words[:1]
                for w in words[1:]:
                    h = mixed(h, np.array([w]))
                out[i] = int(h[0]) & (n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["place"])

    found = level.select("lang", "phrase").mapInArrow(places, "place long")
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = found.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(n // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Bits(table.view(np.uint8))


def grams(tokens: list[bytes], lang: str, k: int, known: Bits | None, skip: int):
    """(phrases, counts) of the phrases of k words in tokens that end after the first skip tokens; a full stop parts pieces."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ids: dict[bytes, int] = {b".": 0}
    at = np.fromiter((ids.setdefault(t, len(ids)) for t in tokens), np.int64, len(tokens))
    words = list(ids)
    n = len(at) - k + 1
    if n <= 0:
        return None
    if k == 1:
        counts = np.bincount(at[skip:], minlength=len(words))
        first = np.flatnonzero(counts[1:]) + 1
        return pa.array(words, pa.binary()).take(pa.array(first)), counts[first]
    own = hashed(words, lang)
    part = own[at]
    held = (known.has(own) & (np.arange(len(own)) > 0))[at] if k == 2 else None
    if k > 2:
        h = part
        for j in range(1, k - 1):
            h = mixed(h[: len(h) - 1], part[j:])
        held = known.has(h)
        stop = np.concatenate([[0], np.cumsum(at == 0)])
        held &= stop[k - 1 :][: len(held)] == stop[: len(held)]
    places = np.flatnonzero(held[:n] & held[1 : n + 1])
    places = places[places + k > skip]
    if not len(places):
        return None
    key = at[places]
    for j in range(1, k):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + at[places + j]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    table = pa.array(words, pa.binary())
    return pc.binary_join_element_wise(*(table.take(pa.array(at[places[first] + j])) for j in range(k)), b" "), counts


def rows(batches):
    """(lang, text as bytes) of record batches, a few rows at a time, so that a batch is not held twice."""
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            part = batch.slice(i, AT_ONCE)
            yield from zip(part.column(0).to_pylist(), read_bytes(part.column(1)))


def counted(docs: DataFrame, k: int, known: Bits | None = None) -> DataFrame:
    """(lang, phrase, n) of the phrases of k words of docs (lang, text) that known lets through."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(known) if known else None

    def emit(lang, tokens, skip):
        found = grams(tokens, lang, k, shared and shared.value, skip)
        if found is not None and len(found[0]):
            phrases, counts = found
            langs = pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int64)))
            yield pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    @trimmed
    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, texts in held.items():
                yield from emit(lang, b".".join(texts).replace(b".", b" . ").split(), 0)
            held.clear()

        for lang, text in rows(batches):
            text = text.translate(PIECES)
            if len(text) > TOGETHER:
                carried: list[bytes] = []
                for part in slices(text, TOGETHER):
                    tokens = carried + part.replace(b".", b" . ").split()
                    yield from emit(lang, tokens, len(carried))
                    carried = tokens[len(tokens) - (k - 1) :] if k > 1 else []
                continue
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > TOGETHER:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def scored(levels: list[DataFrame]) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, score) of the levels from two words on, by their lowest cut, the first of ties.

    A phrase's parts are as frequent as it is, so the level tables have them all; a part is a row there, so a popular part has many
    partners on one side only, which Spark splits where they are too many for a task.
    """
    parts = levels[0].select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    for level in levels[1:-1]:
        parts = parts.unionByName(level.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    phrases = None
    for size, level in enumerate(levels[1:], 2):
        one = level.select("lang", "phrase", F.lit(size).alias("size"), F.col("n").alias("a"))
        phrases = one if phrases is None else phrases.unionByName(one)
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("*", k).withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "lowest.l", "lowest.r", "lowest.score")


def contained(levels: list[DataFrame]) -> DataFrame:
    """(lang, phrase, f): phrases of two words or more that lie in longer ones, with the most frequent of those."""
    found = levels[0].select("lang", "phrase", F.col("n").alias("f")).limit(0)
    for size, level in enumerate(levels[2:], 3):
        words = F.split("phrase", " ")
        inner = F.array(*(F.array_join(F.slice(words, i + 1, n), " ") for n in range(2, size) for i in range(size - n + 1)))
        found = found.unionByName(level.select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("f")))
    return found.groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each lang, with rank. Parts of a lang are ranked first, so that one task gets top rows of each part at most."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    some = rows.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("place")


def mine(docs: DataFrame, longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """The best phrases of each language of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, pieces end at [.,;:!?] and line ends, words of a piece are parted by spaces and tabs. A candidate has 2 to
    longest words and is found at least least times (a), overlaps included; cut after k words it scores floor(2000000 * a / (l + r)),
    and the lowest cut counts, the first of ties. A candidate in a longer one with 100 * f(longer) >= inside * a is dropped. Of the rest,
    the first top of each lang by falling score, falling a, and phrase by its UTF-8 bytes; n is the number of all words of the lang.

    A null lang is und; null, empty and blank texts have no words. Texts are counted whole, however long, and repeated rows each.
    Without a candidate, as in an empty table, there are no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and are found once at least")
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    words = cut(counted(texts, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [cut(words.where(F.col("n") >= least), "level")]
    for k in range(2, longest + 1):
        known = bits_of(levels[-1])
        levels.append(cut(counted(texts, k, known).where(F.col("n") >= least), "level"))
    outer = contained(levels).withColumnRenamed("f", "outer_f")
    rows = scored(levels).join(outer, ["lang", "phrase"], "left").where(F.col("outer_f").isNull() | (exact("outer_f") * 100 < exact("a") * inside))
    return best(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same over the table documents, in DuckDB's SQL."""
    from .exact_dedup import LOWER, UPPER

    placed = "(SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)"
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS size FROM {placed} WHERE i <= len(w) - {k - 1}" for k in range(1, 5))
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x != '') AS w FROM pieces),
        g AS ({grams}),
        f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        often AS MATERIALIZED (SELECT lang || ' ' || phrase AS key, lang, phrase, size, f FROM f WHERE f >= 30),
        c AS MATERIALIZED (SELECT key, lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM often WHERE size > 1),
        cuts AS MATERIALIZED (SELECT key, k, lang || ' ' || array_to_string(w[:k], ' ') AS one, lang || ' ' || array_to_string(w[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        s AS (SELECT u.key, k, l, f AS r FROM (SELECT cuts.key, k, two, f AS l FROM cuts JOIN often ON often.key = one) u JOIN often ON often.key = two),
        lowest AS (SELECT lang, phrase, a, l, r, key, (2000000::HUGEINT * a // (l::HUGEINT + r)) AS score FROM s JOIN c USING (key)
                   QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, k) = 1),
        inner_of AS (SELECT a, lang || ' ' || array_to_string(w[i:i + m - 1], ' ') AS key FROM (
                         SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))),
        outer_of AS (SELECT key, max(a) AS f FROM inner_of GROUP BY ALL),
        kept AS (SELECT b.* FROM lowest b LEFT JOIN outer_of o USING (key) WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * b.a)
        SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang)
        WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""

"""b-bit MinHash near-duplicate detection.

Each document's set of word shingles has a MinHash signature. Of its minima only the low BITS bits are kept, packed into
longs. Bands of whole minima give candidate pairs; bit counts of the packed signatures estimate their similarity, corrected
for chance collisions of the low bits, and only pairs whose estimate is within reach of the threshold are confirmed on the
full sets. Documents with equal sets are one class from the start.

A band's bucket may hold very many documents that are all alike. Its pairs are never made: in each round every document is
tried against one other of its bucket's components (the bucket's leader), links join components, and buckets whose members
have all met drop out. Documents that are still apart at the end may be many versions of one text, each pair of them a candidate
and few of them links. They are joined by what sets them apart from their group (_residual_pairs), which loses no link and makes
few pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_bytes, cut, forget, read_bytes, sieve, trimmed
from .winnow import grams, word_units

SHINGLE = 5
ROWS, BANDS = 4, 16  # a pair at 0.85 misses all bands with probability 8e-6
BITS = 4
#: Minima in the packed signature; the first ROWS * BANDS also make the bands.
MINIMA = 128
#: Estimates this far below the threshold are not confirmed: over four standard deviations.
SLACK = 0.14
ROUNDS = 2
#: Leaders that a document is confirmed with in a round, the most similar of those of its buckets.
LEADERS = 2
#: Parts that a group is dealt in, at most and for each so many documents, so that a large one is joined in many tasks; each part has a copy of its common shingles.
SALTS, SALTED = 32, 64
SIGNED = "doc_id long, key long, n long, digest binary, bands array<long>, signature array<long>"


def shingles(raw: bytes) -> np.ndarray:
    """Hashes of the distinct shingles: sorted, 64 bits."""
    units = word_units(raw.lower())[0]
    return np.unique(grams(units, min(SHINGLE, len(units)))) if len(units) else np.empty(0, np.uint64)


_rng = np.random.default_rng(5)
_A, _B = (_rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None] | np.uint32(1) for _ in range(2))


def signature(found: np.ndarray) -> np.ndarray:
    """The minima of MINIMA permutations."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[i : i + 4096] * _A + _B).min(axis=1))
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each, scrambled first, in longs."""
    low = (least * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.uint64)
    per = 64 // BITS
    return (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _signed(docs: DataFrame, n_bands: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            n, digest, bands, signatures = [], [], [], []
            for raw in read_bytes(batch["text"]):
                found = shingles(raw or b"")
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = signature(found)
                rows = least[: ROWS * n_bands].reshape(n_bands, ROWS)
                bands.append([int.from_bytes(hashlib.blake2b(bytes([i]) + r.tobytes(), digest_size=8).digest(), "little", signed=True) for i, r in enumerate(rows)])
                signatures.append(packed(least).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(signatures, longs)], names=["doc_id", "key", "n", "digest", "bands", "signature"])

    return docs.mapInArrow(trimmed(run), SIGNED)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: the share of equal low parts, less what chance makes equal."""
    mask = sum(1 << (i * BITS) for i in range(64 // BITS))
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    differ = None
    for w in range(MINIMA * BITS // 64):
        x = a[w].bitwiseXOR(b[w])
        any_bit = x
        for i in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
        count = F.bit_count(any_bit.bitwiseAND(F.lit(mask)))
        differ = count if differ is None else differ + count
    equal = 1 - differ / F.lit(float(MINIMA))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _near(share: float, slack: float) -> Column:
    """Whether a pair (n, m sizes; s, t signatures) can reach the threshold."""
    sizes = F.least("n", "m") >= share * F.greatest("n", "m")
    return sizes & (estimate(F.col("s"), F.col("t")) >= share - slack)


def components(links: DataFrame) -> DataFrame:
    """links (a, b): (id, component), the least id reachable, for every id in them. Labels travel and jump until none changes."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = cut(both, "near-edges")
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "near-labels")
    while True:
        old = labels
        other = labels.withColumnsRenamed({"id": "b", "component": "other"})
        least = edges.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        new = labels.join(least, "id").select("id", F.least("component", "other").alias("component"), F.col("component").alias("was"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = cut(new.join(jump, "component").select("id", F.col("root").alias("component"), (F.col("root") != F.col("was")).alias("moved")), "near-labels")
        labels = new.select("id", "component")
        labels._scratch = new._scratch
        forget(old)
        if new.where("moved").isEmpty():
            forget(edges)
            return labels


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets' intersection is at least percent / 100 of the union."""
    one, two = (sets.select(F.col("id").alias(c), F.col("found").alias(f)) for c, f in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            found = [shingles(raw or b"").view(np.int64) for raw in read_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.int64()))], names=["id", "found"])

    return docs.mapInArrow(trimmed(run), "id long, found array<long>")


def _counted(docs: DataFrame) -> DataFrame:
    """docs (group, found): (group, shingle, count), how many of a group's sets hold a shingle, added up in each batch first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            groups, values = batch["group"].to_numpy(), batch["found"]
            of = np.repeat(groups, values.value_lengths().to_numpy(zero_copy_only=False))
            table = pa.table({"group": pa.array(of), "shingle": values.flatten()})
            found = table.group_by(["group", "shingle"]).aggregate([([], "count_all")]).select(["group", "shingle", "count_all"])
            yield from found.rename_columns(["group", "shingle", "count"]).combine_chunks().to_batches()

    partial = docs.mapInArrow(trimmed(run), "group long, shingle long, count long")
    return partial.groupBy("group", "shingle").agg(F.sum("count").alias("count"))


def _parts() -> Column:
    return F.least(F.lit(SALTS), 1 + F.floor(F.col("total") / SALTED)).cast("int")


def _salts() -> Column:
    """The parts of a group of total documents."""
    return F.sequence(F.lit(0), _parts() - 1)


def _salt() -> Column:
    """The part of document id in its group of total documents."""
    return F.pmod(F.xxhash64("id"), _parts()).cast("int")


def _residual_pairs(apart: DataFrame, sets: DataFrame, percent: int, slack: float, tables: Tables) -> DataFrame:
    """Pairs (a, b) to confirm among documents of open bands (band, id, component, n, signature) that are apart.

    Documents that share bands, directly or through others, are a group; a group's core is the shingles that over half of its
    sets hold, and a document's residual R is where its set differs from the core, so that two sets differ exactly where their
    residuals do. A link means that they differ in at most q * (n + m) places, q = (100 - percent) / (100 + percent). Let
    w = |R| - q * n. There are two cases, for any core:

    * The residuals share nothing. Then w(a) + w(b) <= 0, so both are linked with the document of the least w, too.
    * They share something. In the order of rarity in the group, what precedes the first shared place is theirs alone: at most
      q * (n + m) places in both. At most q * n of them are of the one with the smaller w, as its residual shares at least w.

    So each document is tried with its group's least w, and a join of the residuals' rare ends gives the rest. Versions of a text
    that were edited in different places meet only where one has few edits.
    """
    less, more = 100 - percent, 100 + percent
    first = apart.groupBy("band").agg(F.min("id").alias("b"))
    group = components(apart.join(tables.cut(first, "near-firsts"), "band").select(F.col("id").alias("a"), "b").distinct())
    tables.held.append(group)
    sizes = tables.cut(group.groupBy(F.col("component").alias("group")).agg(F.count("*").alias("total")), "near-sizes")
    heads = apart.select("id", "component", "n", "signature").dropDuplicates(["id"])
    heads = heads.join(group.select("id", F.col("component").alias("group")), "id").join(sizes, "group").join(sets, "id")
    heads = tables.cut(heads, "near-heads")
    counts = tables.cut(_counted(heads.select("group", "found")).join(sizes, "group"), "near-counts")
    common = F.col("count") * 2 > F.col("total")
    core = counts.where(common).groupBy("group").agg(F.collect_list("shingle").alias("core"), F.max("total").alias("total"))
    core = core.withColumn("salt", F.explode(_salts())).drop("total")
    own = heads.withColumn("salt", _salt()).join(tables.cut(core, "near-cores"), ["group", "salt"], "left")
    core = F.coalesce("core", F.array().cast("array<long>"))
    own = own.withColumn("residual", F.concat(F.array_except("found", core), F.array_except(core, "found")))
    own = own.withColumn("w", more * F.size("residual") - less * F.col("n"))
    own = tables.cut(own.select("group", "total", "id", "component", "n", F.col("signature").alias("s"), "w", "residual"), "near-residuals")

    least = own.groupBy("group", "total").agg(F.min(F.struct("w", F.col("id").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("s").alias("t"))).alias("x"))
    least = tables.cut(least.select("group", "x.b", "x.c", "x.m", "x.t", F.explode(_salts()).alias("salt")), "near-least")
    salted = own.withColumn("salt", _salt())
    central = salted.join(least, ["group", "salt"]).where("component != c").where(_near(percent / 100, slack)).select(F.col("id").alias("a"), "b")

    rarity = counts.select("group", F.col("shingle").alias("place"), F.when(common, F.col("total") - F.col("count")).otherwise(F.col("count")).alias("rarity"))
    places = own.select("group", "id", "n", F.explode("residual").alias("place")).join(rarity.where("rarity > 1"), ["group", "place"], "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("rarity", F.lit(1)).alias("rarity"), "place")))
    # Places of one document alone count in the order and meet none.
    reach = F.floor(less * F.col("n") / percent).cast("int") + 1  # q * (n + m) is at most less * n / percent
    ends = places.groupBy("group", "id", "n").agg(order.alias("order")).select("group", "id", F.posexplode(F.slice("order", 1, reach)).alias("rank", "x")).where("x.rarity > 1")
    ends = tables.cut(ends.select("group", "id", "rank", F.col("x.place").alias("place")).join(own.drop("residual", "group", "total"), "id"), "near-ends")
    few = ends.where(more * F.col("rank") <= less * F.col("n"))
    few = few.select("group", "place", F.col("id").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("w").alias("v"), F.col("rank").alias("at"))
    met = ends.join(few, ["group", "place"]).where((F.col("component") != F.col("c")) & (F.struct("v", "b") < F.struct("w", "id")))
    met = met.where(more * (F.col("rank") + F.col("at")) <= less * (F.col("n") + F.col("m"))).where(_near(percent / 100, slack))
    return central.union(met.select(F.col("id").alias("a"), "b")).distinct()


def classes(docs: DataFrame, percent: int = 85, bands: int = BANDS, slack: float = SLACK) -> DataFrame:
    """A row per document of docs (doc_id, text): n_shingles, component_id, kept.

    The words are lower-cased (A-Z); a set is the distinct shingles of SHINGLE words, or of all words where there are fewer.
    Two documents are linked if 100 times the intersection of their sets is at least percent times the union; component_id
    is the least doc_id reachable. Null and empty texts have an empty set and no links. Rows that repeat an id and have
    different texts keep a row each and are linked by their id; a null id has no component and is not kept. An empty table
    gives no rows. A lower percent needs more bands (at most MINIMA / ROWS) and more slack to miss as few links.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    signed = cut(_signed(keyed, bands), "near-signed")
    own = signed.where("n > 0 and doc_id is not null")
    grouped = own.groupBy("digest").agg(F.min(F.struct("doc_id", "key")).alias("one"))
    grouped = cut(grouped.select("digest", F.col("one.doc_id").alias("id"), F.col("one.key").alias("key")), "near-classes")
    firsts = own.join(grouped.select(F.col("id").alias("doc_id"), "key", "digest"), ["doc_id", "key", "digest"], "left_semi")
    banded = firsts.select(F.col("doc_id").alias("id"), "key", "n", "signature", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").count().where("count > 1").select("band"), "near-bands")
    members = cut(banded.where(sieve(shared)("band")).join(shared, "band", "left_semi"), "near-members")
    wanted = cut(members.select(F.col("id").alias("doc_id"), "key").distinct(), "near-wanted")  # written, so that its size is known to the join
    row = F.xxhash64("doc_id", "key")
    texts = keyed.where(sieve(wanted.select(row))(row)).join(wanted, ["doc_id", "key"], "left_semi")
    sets = cut(_sets(texts.select("doc_id", "text")).dropDuplicates(["id"]), "near-sets")

    same_id = signed.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("doc_id is not null and low != high")
    same_id = own.join(same_id.select("doc_id"), "doc_id", "left_semi").join(grouped.select("digest", "id"), "digest")
    links = cut(same_id.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a != b"), "near-links")
    label = None
    tried = None
    step = 0
    while step <= ROUNDS:
        at = members if label is None else members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        at = at if label is not None else at.withColumn("component", F.col("id"))
        apart = at.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        step_tables = Tables()
        apart = step_tables.cut(at.join(step_tables.cut(apart.select("band"), "near-apart"), "band", "left_semi"), "near-open")
        if apart.isEmpty():
            step_tables.forget()
            break
        if step < ROUNDS:
            pick = F.struct("id") if step == 0 else F.struct(F.xxhash64(F.col("id"), F.lit(step)), F.col("id"))
            leaders = apart.groupBy("band").agg(F.min(F.struct(pick.alias("order"), F.col("id").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("signature").alias("t"))).alias("lead"))
            leaders = step_tables.cut(leaders.select("band", "lead.b", "lead.c", "lead.m", "lead.t"), "near-leaders")
            pairs = apart.withColumnRenamed("signature", "s").join(leaders, "band").where("component != c").where(_near(percent / 100, slack))
            best = F.collect_set(F.struct(estimate(F.col("s"), F.col("t")).alias("e"), (-F.col("b")).alias("minus")))  # at most one for each band
            best = pairs.groupBy(F.col("id").alias("a")).agg(F.slice(F.sort_array(best, asc=False), 1, LEADERS).alias("best"))
            pairs = best.select("a", F.explode("best").alias("x")).select("a", (-F.col("x.minus")).alias("b"))
        else:
            pairs = _residual_pairs(apart, sets, percent, slack, step_tables)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        step_tables.forget()
        new = cut(_confirm(pairs, sets, percent), "near-links")
        before, links = links, cut(links.union(new), "near-links")
        if label is not None:
            forget(label)
        label = components(links)
        step = ROUNDS if step < ROUNDS and new.isEmpty() else step + 1  # if leaders find nothing, on to what is left
        forget(before)
        forget(new)
    for df in (members, sets, wanted):
        forget(df)
    if label is None and not links.isEmpty():
        label = components(links)
    owned = signed.join(grouped.select("digest", "id"), "digest", "left")
    if label is not None:
        owned = owned.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    else:
        owned = owned.withColumn("component", F.col("id"))
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return owned.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

"""Hard negatives, exact duplicates and collocations against plain loops: nulls, ties, repeats, long texts, clashing columns, no rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from metroframe.llm import collocations, exact_dedup, hard_negatives


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


DOCS = "doc_id long, text string, run string, stays long, n string, digest string, size int"


@pytest.mark.parametrize("ways", [2, 8])
@pytest.mark.parametrize("stays", ["smallest", "largest"])
def test_exact_dedup(spark, stays, ways):
    chance = random.Random(1)
    texts = ["same"] * 40 + [None, "", "A", "a", "É", "é", "İ", "i̇", "SAME", "Same ", "x" * 3_000_000, "X" * 3_000_000] + [chance.choice("abcdEF") for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same"), (3, "SAME"), (None, "same"), (None, "only null ids"), (None, "only null ids"), (7, "A")]
    chance.shuffle(rows)
    df = spark.createDataFrame([(*r, "r", 1, "n", "d", 2) for r in rows], DOCS).repartition(13)
    got = [tuple(r) for r in exact_dedup.deduplicate(df, stays, ways).collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    pick = min if stays == "smallest" else max
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        stay = ids.index(keep)
        want += [(i, keep, len(ids), n == stay, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    assert Counter(got) == Counter(want)


def test_exact_dedup_without_rows(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    rows = [(n, i, label, [int(x) for x in v]) for n, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda found: sorted(found, key=lambda r: (-r[1], r[0][1] is None, r[0][1] or 0, r[0][0]))
    out = []
    for a in rows:
        if a[1] is None or a[1] % 100:
            continue
        scores = [(r, sum(x * y for x, y in zip(a[3], r[3]))) for r in rows if r[0] != a[0]]
        for p, ps in first(s for s in scores if s[0][2] == a[2])[:positives]:
            fit = first(s for s in scores if s[0][2] != a[2] and low * ps <= 100 * s[1] <= high * ps)
            out += [(a[1], p[1], k, r[1], ps, s) for k, (r, s) in enumerate(fit[:negatives], 1)]
    return Counter(out)


def vectors(n, seed, dims=6):
    chance = np.random.default_rng(seed)
    rows = [(int(i), int(chance.integers(3)), [float(x) for x in chance.integers(-9, 30, dims)]) for i in chance.permutation(n)]
    rows += [(200, 1, rows[5][2]), (100, 2, [9.0] * dims), (None, 1, [8.0] * dims), (None, None, [1.0]), (300, 0, None), (400, 1, []), (500, 2, [float("nan")] * dims), (0, 0, [None] * dims)]
    return rows + [(1000 + i, i % 3, [7.0] * dims) for i in range(30)] + [(700, 1, [float("inf")]), (800, 0, [1.0, 2.0]), (900, 2, [0.0] * dims)]


SCHEMA = "id long, label long, vector array<double>, row string, norm string, score string"


@pytest.mark.parametrize("bucket,slice_,wave", [(1024, 256, 10**7), (7, 2, 200)])
def test_hard_negatives(spark, monkeypatch, bucket, slice_, wave):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_)
    rows = vectors(250, 4)
    df = spark.createDataFrame([(*r, "r", "n", "s") for r in rows], SCHEMA).coalesce(1)
    got = Counter(tuple(r) for r in hard_negatives.mine(df, wave_bytes=wave).collect())
    want = plain_negatives(rows)
    assert got == want and len(want) > 100


def test_hard_negatives_of_large_numbers(spark):
    rows = [(i, i % 2, [float(3 * 10**9 + i * 7), float(i)]) for i in range(12)] + [(100, 0, [1.0, 2.0])]
    got = Counter(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, "id long, label long, vector array<double>").coalesce(1), high=120).collect())
    assert got == plain_negatives(rows, high=120) and got


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(100, 1, [1.0], "r", "n", "s")], SCHEMA)
    assert hard_negatives.mine(alone).collect() == []


def test_buckets_are_left_out_only_beyond_their_bound():
    best = hard_negatives.Best(2, 3)
    best.add(np.array([0, 0, 0, 0, 1]), np.array([5, 9, 5, 5, 1]), np.array([4, 1, 2, 3, 8]), np.array([0, 1, 2, 3, 4]))
    assert best.score[0].tolist() == [9, 5, 5] and best.id[0].tolist() == [1, 2, 3] and best.n.tolist() == [3, 1]
    assert best.floor().tolist() == [5, hard_negatives.LEAST]
    best.add(np.array([0]), np.array([5]), np.array([2]), np.array([9]))
    assert best.id[0].tolist() == [1, 2, 2] and best.row[0].tolist() == [1, 2, 9]


def test_quantised(spark):
    rows = [(7, [0.5, -0.001], 9), (8, [1.0, 0.0039], 9), (None, [1e300, 2.0], 1), (14, None, None)]
    got = hard_negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [128.0, -1.0]), (8, 9, [256.0, 0.0]), (None, 1, [2.56e302, 512.0]), (14, None, None)]


def plain_phrases(rows, longest, least, inside, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in found.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return Counter(out)


def texts():
    chance = random.Random(2)
    words = ["the", "The", "of", "new", "york", "city", "é", "É", "naïve", "a\x00b", "x\x1fy", " ", "word1"] + [f"w{i}" for i in range(25)]
    weights = [9, 3, 8, 4, 4, 3, 2, 2] + [1] * (len(words) - 8)
    made = lambda n: "".join(w + chance.choice([" "] * 9 + ["\t", "  ", ". ", ", ", "\n", "\r\n", "!", ";x ", "\x0b"]) for w in chance.choices(words, weights, k=n))
    rows = [(chance.choice(["en", "fr", None, "und"]), made(chance.randint(0, 200))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", " \t "), ("fr", "..,;!"), ("en", "New York City! " * 50), ("fr", "a a a a a a a " * 20), ("en", made(5000))]
    return rows + [rows[0]] * 4


@pytest.mark.parametrize("together,bits,longest,top", [(6_000_000, 1 << 28, 4, 2000), (50, 1 << 28, 3, 40), (400, 1024, 4, 2000), (400, 1 << 28, 2, 5)])
def test_collocations(spark, monkeypatch, together, bits, longest, top):
    monkeypatch.setattr(collocations, "TOGETHER", together)
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], "lang string, text string, n long, phrase string, a long, rank int").repartition(3)
    got = Counter(tuple(r) for r in collocations.mine(df, longest=longest, least=8, top=top).collect())
    want = plain_phrases(rows, longest, 8, 80, top)
    assert got == want and len(want) > 10


def test_collocations_of_a_long_text(spark):
    text = "Alpha beta gamma delta, " * 300_000 + "w" * 7_000_000
    got = collocations.mine(spark.createDataFrame([("en", text)], "lang string, text string")).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in got] == [("alpha beta gamma delta", 300_000, 300_000, 300_000, 1_000_000)]
    assert got[0]["n"] == 1_200_001


def test_collocations_without_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.mine(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 6 * 10**16
    level = lambda *rows: spark.createDataFrame([("en", p, n) for p, n in rows], "lang string, phrase string, n long")
    levels = [level(("a", big), ("b", big + 1), ("c", big)), level(("a b", big - 1), ("b c", big)), level(("a b c", big - 2))]
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.scored(levels).collect()}
    score = lambda a, l, r: 2_000_000 * a // (l + r)
    assert got["a b"] == (big, big + 1, score(big - 1, big, big + 1)) and got["a b c"] == min(
        ((big, big, score(big - 2, big, big)), (big - 1, big, score(big - 2, big - 1, big))), key=lambda x: x[2]
    )


def plain_packing(texts, idf, window):
    """(document, ids before, length) in the order in which they are packed: a seed, its best unused neighbours, and again from the last one when they are used up."""
    from metroframe.llm import packing

    index, free, placed, filled, waiting, rest, last = packing.Inverted(texts, idf), set(range(len(texts))), [], 0, [], None, None

    def near(d):
        score = index.scores(d)
        return sorted((x for x in free if score[x] > 0), key=lambda x: (-score[x], -x))

    while free or rest:
        if rest is None:
            waiting = [x for x in waiting if x in free] if filled else []
            if filled and not waiting:
                waiting = near(last)
            d = waiting.pop(0) if waiting else min(free)
            free.remove(d)
            rest = (d, 0)
        d, before = rest
        if not filled:
            waiting = near(d)
        last = d
        length = min(window - filled, len(texts[d]) - before)
        placed.append((d, before, length))
        filled = (filled + length) % window
        rest = (d, before + length) if before + length < len(texts[d]) else None
    return placed


def merged(pieces):
    out = []
    for d, start, length in pieces:
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == start:
            out[-1] = (d, out[-1][1], out[-1][2] + length)
        else:
            out.append((d, start, length))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_fills_with_unused_neighbours(seed):
    from metroframe.llm import packing

    chance = np.random.default_rng(seed)
    texts = [np.append(chance.integers(10 * (i % 4), 10 * (i % 4) + 14, chance.integers(0, 40)), 99).astype("<u2") for i in range(50)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=100)
    idf = np.log(1 + (50 - df + 0.5) / (df + 0.5))
    pieces = packing.pack_shard(list(range(50)), texts, idf, 64)
    assert merged([p[:3] for p in pieces]) == merged(plain_packing(texts, idf, 64))
    sizes = Counter()
    for _, _, length, sequence, offset in pieces:
        assert offset == sizes[sequence]
        sizes[sequence] += length
    total = sum(map(len, texts))
    assert [sizes[s] for s in range(len(sizes))] == [64] * (total // 64) + [1 << k for k in range(5, -1, -1) if total % 64 >> k & 1]


def test_sieve(spark):
    from pyspark.sql import functions as F

    from metroframe.llm.common import sieve

    rows = spark.range(20000).select(F.xxhash64("id").alias("h"))
    wanted = rows.where("h % 50 = 0").cache()
    found = rows.where(sieve(wanted)("h"))
    assert wanted.join(found, "h", "left_anti").isEmpty() and found.count() < wanted.count() + 1500
    assert rows.where(sieve(wanted, 64)("h")).count() >= found.count()
    assert rows.where(sieve(wanted.limit(0))("h")).isEmpty()


def test_small_groups_have_their_common_shingles_once(spark, monkeypatch):
    """And only documents that share a band are shuffled with their texts."""
    from metroframe.llm import common, near_dedup

    rng, held, cut = random.Random(8), {}, common.cut

    def kept(df, label, *more):
        out = cut(df, label, *more)
        if label in ("near-cores", "near-residuals"):
            held[label] = out.select("group").collect()
        return out

    monkeypatch.setattr(common, "cut", kept)
    texts = []
    for g in range(3):
        words = ["g%dw%d" % (g, i) for i in range(200)]
        for k in range(12):
            own = list(words)
            for at in rng.sample(range(200), 6):
                own[at] = "e%d" % rng.randrange(10**6)
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in range(len(texts)) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in range(len(texts))]
    assert [got[i] for i in range(len(texts))] == least
    assert held["near-residuals"] and len(held["near-cores"]) == len(set(held["near-cores"]))

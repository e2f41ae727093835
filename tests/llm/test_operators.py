"""Each operator against brute force over small tables: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from metroframe.llm import decontamination, licenses, mixing, near_dedup, packing, pfor, quality, repeats, sharding, substring_dedup, suffix_dedup, token_ids
from metroframe.llm.substring_dedup import SuffixAutomaton

SCHEMA = "doc_id long, text string, key string, n long, shard string, size string"  # clashing names after text
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and", "é", "naïve", "tion", "ing", "alpha", "beta", "x1", "Gamma"] + ["w%d" % i for i in range(80)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    texts = [None, "", " \n\t", "one", "a  b\n\nc", prose(3000), prose(40), passage, "start " + passage + " end", prose(30) + "\n" + passage]
    near = prose(300).split()
    for i in range(8):
        copy = list(near)
        copy[i * 11] = "edit%d" % i
        texts.append(" ".join(copy))
    texts += [texts[6]] * 5 + ["ab" * 400, "ab" * 150 + "c", "Released under the MIT License.", "a <|endoftext|> b<|startoftext|>", "x y\nreleased under the MIT license\nz", "!!! ### $$$ " * 30]
    texts += [prose(rng.randint(1, 120)) for _ in range(30)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 7, "s", "z") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, and null ids."""
    return spark.createDataFrame([(1, "a b c d e f", "k", 7, "s", "z")] * 2 + [(None, "a b c d e f", "k", 7, "s", "z"), (None, None, None, None, None, None)], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(spark, docs, empty, odd):
    rows = sharding.shard(docs, 5).collect()
    texts = dict(corpus())
    groups = defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        groups[raw].add(r["shard"])
    assert len(rows) == len(texts) and all(len(s) == 1 for s in groups.values())
    slots = defaultdict(list)
    totals = Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        totals[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first, sizes = {}, Counter()
    for i, t in sorted(texts.items()):
        first.setdefault(t or "", i)
        sizes[t or ""] += len((t or "").encode()) + 16
    ordered = [sizes[t] for t in sorted(first, key=first.get)]

    def fits(capacity):
        used, room = 1, capacity
        for s in ordered:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= 5

    assert max(totals.values()) == next(c for c in range(sum(ordered)) if fits(c))
    assert sharding.shard(empty, 5).collect() == [] and len(sharding.shard(odd, 5).collect()) == 4


def test_sharding_refines_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 4)
    monkeypatch.setattr(sharding, "SPLIT", 3)
    sizes = [2, 1, 4000] + [random.Random(i).randint(1, 50) for i in range(200)] + [3, 2, 900]
    starts = np.cumsum(sizes) - sizes
    cuts = sharding.minimax_cuts(spark.createDataFrame(list(zip(starts.tolist(), sizes)), "start long, size long"), 7)
    edges = [0, *cuts, sum(sizes)]
    worst = max(b - a for a, b in zip(edges, edges[1:]))

    def need(capacity):
        used = room = 0
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
            if room < 0:
                return 99
        return used

    assert need(worst) <= 7 < need(worst - 1) and set(cuts) <= set(starts.tolist())


@pytest.mark.parametrize("part_bytes", [10**6, 60])
def test_decontamination(spark, docs, empty, odd, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    texts = dict(corpus())
    items = [(1, texts[7]), (2, "w1 w2"), (3, None), (None, "a"), (4, ""), (12, texts[6][:200]), (5, texts[8])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(13, len(w))
        if n:
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])] |= {str(i)} - {"None"}
    got = by_id(decontamination.contamination(docs, benchmark))
    for i, t in texts.items():
        w, hit, ids = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    ids |= windows[tuple(w[s : s + n])]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontamination.contamination(empty, benchmark).collect() == []
    assert len(decontamination.contamination(odd, benchmark.limit(0)).collect()) == 4


@pytest.mark.parametrize("part_bytes", [10**6, 12])
def test_decontamination_without_ids(spark, monkeypatch, part_bytes):
    """Documents without id, and repeated ones, have the hits of every part of the benchmark; items without id hit."""
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    names = ["p%d q%d r%d" % (i, i, i) for i in range(12)]
    benchmark = spark.createDataFrame(list(enumerate(names)), "item_id long, text string")
    rows = [(None, " x ".join(names)), (None, names[3] + " y"), (None, names[8]), (None, names[8]), (None, None), (7, " z ".join(names))]
    found = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found)
    assert got == Counter({(None, 47, 36, 12, True): 1, (None, 4, 3, 1, True): 1, (None, 3, 3, 1, True): 2, (None, 0, 0, 0, False): 1, (7, 47, 36, 12, True): 1})
    benchmark = spark.createDataFrame([(None, "a b c"), (None, "c d"), (5, "c d")], "item_id long, text string")
    found = decontamination.contamination(spark.createDataFrame([(1, "x y a b c"), (2, "c d e")], "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found} == {(1, 3, 0, hashlib.sha256(b"").hexdigest()), (2, 2, 1, hashlib.sha256(b"5").hexdigest())}


def test_decontamination_of_repeated_words(spark, monkeypatch):
    """Equal words, alternating ones, and a rare word in many windows take time in proportion to their number."""
    monkeypatch.setattr(decontamination, "STEP", 1000)
    varied = " ".join("rare v%d" % i for i in range(3000))
    benchmark = spark.createDataFrame([(1, "a " * 20_000), (2, "a b " * 5000), (3, varied), (4, "a"), (5, "A\tb")], "item_id long, text string")
    rows = [(1, "a " * 50_000), (2, "b a " * 6 + "b"), (3, "rare " * 20_000), (4, varied + " c" * 1000), (5, "b b"), (6, "a " * 12 + "c")]
    found = by_id(decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark))
    got = {i: (r["n_words"], r["n_hit"], r["n_items"]) for i, r in found.items()}
    assert got == {1: (50_000, 50_000, 2), 2: (13, 13, 3), 3: (20_000, 0, 0), 4: (7000, 6000, 1), 5: (2, 0, 0), 6: (13, 12, 1)}


def brute_repeats(texts, words, window):
    units = {i: ((t or "").encode().split() if words else (t or "").encode()) for i, t in texts.items()}
    first, count = {}, Counter()
    for i in sorted(units):
        for s in range(len(units[i]) - window + 1):
            k = tuple(units[i][s : s + window])
            first.setdefault(k, (i, s))
            count[k] += 1
    out = {}
    for i, u in units.items():
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - window + 1):
            k = tuple(u[s : s + window])
            if first[k] != (i, s) if words else count[k] > 1:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(u, gone) if not g) if words else bytes(b for b, g in zip(u, gone) if not g)
        out[i] = (len(u), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("module, window, most", [(substring_dedup, 20, 1000), (substring_dedup, 3, 1), (suffix_dedup, 200, 3), (suffix_dedup, 30, 1000)])
def test_repeats(docs, empty, odd, module, window, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST", most)
    got = {i: (r["n_units"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(module.deduplicate(docs, window)).items()}
    assert got == brute_repeats(dict(corpus()), module is substring_dedup, window)
    assert module.deduplicate(empty, window).collect() == []
    assert len(module.deduplicate(odd, window).collect()) == 4


@pytest.mark.parametrize("module, window", [(substring_dedup, 20), (suffix_dedup, 200)])
def test_repeats_of_hot_groups(spark, module, window, monkeypatch):
    """Periodic texts, and many versions of one passage, so that its anchor's group is halved again and again."""
    monkeypatch.setattr(repeats, "MOST", 100)
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = prose(70)
    texts = {i: prose(12) + " " + passage[: rng.randint(150, len(passage))] + prose(12) for i in range(600)}
    texts |= {1000: "a" * 30_000, 1001: "x " * 10_000, 1002: "a" * 300, 1003: "b" * 200, 1004: "yz " * 66 + "q", 1005: prose(300)}
    got = {i: (r["n_units"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(module.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), window)).items()}
    words = module is substring_dedup
    units = {i: t.encode().split() if words else t.encode() for i, t in texts.items()}
    piece = lambda u, s: b" ".join(u[s : s + window]) if words else u[s : s + window]
    first, count = {}, Counter()
    for i in sorted(units):
        for s in range(len(units[i]) - window + 1):
            first.setdefault(piece(units[i], s), (i, s))
            count[piece(units[i], s)] += 1
    for i, u in units.items():
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - window + 1):
            if first[piece(u, s)] != (i, s) if words else count[piece(u, s)] > 1:
                gone[s : s + window] = True
        kept = b" ".join(x for x, g in zip(u, gone) if not g) if words else bytes(b for b, g in zip(u, gone) if not g)
        assert got[i] == (len(u), int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


def test_cleaned_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x" * 400, "k", 3), (2, "abc", None, 4)], "doc_id long, text string, _kept string, _key long")
    assert [tuple(r) for r in suffix_dedup.cleaned(docs).orderBy("doc_id").collect()] == [(1, "", "k", 3), (2, "abc", None, 4)]


def test_cleaned_keeps_columns(docs):
    got = by_id(suffix_dedup.cleaned(docs))
    assert len(got) == len(corpus()) and got[7]["text"] == "" and got[6]["n"] == 7 and got[0]["text"] is None and got[3]["text"] == "one"


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(50):
        automaton, seen = SuffixAutomaton(), []
        for _ in range(6):
            s = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
            inside = lambda x: any(x == t[j : j + len(x)] for t in seen for j in range(len(t) - len(x) + 1))
            for end, size in enumerate(automaton.matches(s), 1):
                assert size == max(n for n in range(end + 1) if n == 0 or inside(s[end - n : end]))
            automaton.add(s)
            seen.append(s)


def test_near_dedup(docs, empty, odd):
    sets = {}
    for i, t in corpus():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = by_id(near_dedup.classes(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert near_dedup.classes(empty).collect() == [] and len(near_dedup.classes(odd).collect()) == 4


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_dedup_versions(spark, monkeypatch, rounds):
    """Versions of one text with few to many edits, most pairs of them just too far apart; also with only the last pass."""
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rng = random.Random(11)
    base = ["b%d" % rng.randrange(60) for _ in range(150)]
    texts = []
    for i in range(120):
        copy = list(base)
        for place in rng.sample(range(150), 2 + i % 5):
            copy[place] = "e%d" % rng.randrange(400)
        texts.append(copy)
        if i % 10 == 0:  # a version of this version
            texts.append([*copy[:-1], "last"])
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert 5 < len(set(root)) < len(root) - 5
    got = by_id(near_dedup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")))
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_quality(docs, empty, odd):
    got = by_id(quality.judge(docs))
    for i, t in corpus():
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        count = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        again = {p for s in range(len(w) - 7) if count[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.judge(empty).collect() == [] and len(quality.judge(odd).collect()) == 4 and quality.keep(empty).collect() == []


def test_quality_against_plain_em(docs):
    """The posterior of each document, from an expectation-maximisation that walks the documents one by one."""
    texts = dict(corpus())
    votes = {i: [quality.measure((t or "").encode())[5] // 3**r % 3 for r in range(len(quality.RULES))] for i, t in texts.items()}
    share = [[[v] * len(quality.RULES) for v in row] for row in ((0.4, 0.4, 0.2), (0.02, 0.48, 0.5))]
    prior = 0.8
    for _ in range(200):
        good = {}
        for i, cast in votes.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(share[1][v][r] / share[0][v][r]) for r, v in enumerate(cast))
            good[i] = 1 / (1 + math.exp(-odds))
        new = [[[0.0] * len(quality.RULES) for _ in range(3)] for _ in range(2)]
        for r in range(len(quality.RULES)):
            for c in range(2):
                weight = [2 + sum((p if c else 1 - p) for i, p in good.items() if votes[i][r] == v) for v in range(3)]
                for v in range(3):
                    new[c][v][r] = weight[v] / sum(weight)
            new[1][0][r] = min(max(new[1][0][r], 0.01), max(new[0][0][r], 0.02) / 2)
            new[0][2][r] = min(new[0][2][r], new[1][2][r])
            new[0][1][r] = new[1][1][r] = 1
        prior = min(max((sum(good.values()) + 8) / (len(good) + 10), 0.5), 0.99)
        moved = max(abs(a - b) for x, y in zip(new, share) for p, q in zip(x, y) for a, b in zip(p, q))
        share = new
        if moved < 1e-9:
            break
    got = by_id(quality.judge(docs))
    for i, r in got.items():
        assert abs(r["good"] - good[i]) < 1e-6 and r["kept"] == (not r["base_failed"] and good[i] >= 0.5)
    assert len({r["kept"] for r in got.values()}) == 2 and any(0.01 < g < 0.99 for g in good.values())


def test_licenses(docs, empty, odd):
    got = by_id(licenses.scan(docs))
    hits = {i for i, t in corpus() if t and "MIT" in t}
    assert {i for i, r in got.items() if r["license"]} == hits and all(got[i]["license"] == "MIT" and got[i]["dice"] == 1.0 for i in hits)
    assert len(got) == len(corpus()) and licenses.scan(empty).collect() == [] and len(licenses.scan(odd).collect()) == 4


def test_licenses_over_lines(spark):
    """Wrapped notices in comments, licence files and paragraphs; the SQL gives the same rows."""
    duckdb = pytest.importorskip("duckdb")
    text = dict(enumerate(t for _, t in licenses.TEMPLATES))
    wrap = lambda t, mark: "\n".join(mark + line for line in textwrap.wrap(t, 60))
    gpl, isc, mit = (next(t for k, t in licenses.TEMPLATES if k == name and len(t) > 150) for name in ("GPL-3.0", "ISC", "MIT"))
    rows = [
        (1, "#!/bin/sh\n#\n" + wrap(gpl, "# ") + "\n#\nrun and run again\nuntil it is done\n"),
        (2, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(mit, "") + "\n \n" + "what follows is\nno licence at all " * 40),
        (3, "/*\n" + wrap(isc, " * ") + "\n */\n\n\nint main;\nint other;"),
        (4, "\n\nsome words\nover lines\n\nand more\nof them\n"),
        (5, wrap(text[0], "")),
        (6, "é\n—\n" + wrap(gpl, "") + "\n…\nü\r\n\r\nlast"),
        (7, ""),
        (8, None),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["license"] for i, r in got.items()} == {1: "GPL-3.0", 2: "MIT", 3: "ISC", 4: None, 5: "MIT", 6: "GPL-3.0", 7: None, 8: None}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same = {r[0]: r for r in con.execute("SELECT doc_id, license, dice, template, n_matches FROM (" + licenses.oracle_sql() + ")").fetchall()}
    assert {i: tuple(r[c] for c in ("doc_id", "license", "dice", "template", "n_matches")) for i, r in got.items()} == same


def test_mixing(docs, empty, odd):
    got = by_id(mixing.score(docs))
    tokens = {i: [w.lower() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for i, t in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    total = sum(count.values())
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(count[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert mixing.score(empty).collect() == [] and len(mixing.score(odd).collect()) == 4


def test_mixing_follows_copies(spark):
    """A held-out copy costs far less than its words alone; a training document does not follow itself."""
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = [i for i in range(200) if i not in held and zlib.crc32(str(i).encode()) % 7 != 2][:3]
    texts = {i: prose() for i in train} | {held[1]: prose()}
    texts[held[0]] = texts[train[0]]
    got = {r["doc_id"]: r["score"] for r in mixing.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[held[0]] > 0.3 * got[train[0]] and got[held[0]] > 0.3 * got[held[1]]


def test_mixing_takes_what_follows_shared_contexts_alone(spark, monkeypatch):
    """What follows a context that one text alone has is neither written nor shuffled; texts with a shared passage have their matches as before."""
    from metroframe.llm import common

    rng, rows = random.Random(5), {}
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = prose(400)
    texts = [(i, prose(400) + (" " + shared if i < 3 else "")) for i in range(60)]

    def counted(df, label, codec="zstd"):
        out = cut(df, label, codec)
        rows[label] = out.count()
        return out

    cut = common.cut
    monkeypatch.setattr(common, "cut", counted)
    monkeypatch.setattr(mixing, "cut", counted)
    mixing.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    tokens, offsets, _ = mixing.tokens_of([shared.encode()])
    at = np.flatnonzero(mixing.grams(tokens, 4) % np.uint64(mixing.SPACING) == 0)
    common_contexts = int((at + 4 < len(tokens)).sum())
    assert common_contexts > 3 and rows["mixing-matches"] == 3
    assert 3 * (common_contexts - 1) <= rows["mixing-anchors"] <= 3 * (common_contexts + 1) + 60


def test_mixing_words():
    """Words are told apart whatever their length and bytes, and equal words are equal wherever they stand."""
    words = [b"a", b"a\0", b"\0a", b"\0", b"abcdefgh", b"abcdefgh\0", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 66, b"x" * 5000, b"y" + b"x" * 4999, "\u00e9".encode(), b"\xc2\xa0"]
    rng = random.Random(6)
    texts = [None, b"", b" \n", *(b" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(50)), b"A B", b"a b", b"\ta\x0bb\r"]
    tokens, offsets, (raw, starts, ends) = mixing.tokens_of(texts)
    plain = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or b"").lower()), None] for t in texts]
    assert np.diff(offsets).tolist() == list(map(len, plain))
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, tokens.tolist()))) == len(set(flat)) == len(set(tokens.tolist()))
    assert [bytes(raw[a:b]) for a, b in zip(starts, ends)] == [w for w in flat if w is not None] and (tokens[offsets[1:] - 1] == 0).all()
    empty = mixing.tokens_of([])
    assert len(empty[0]) == 0 and empty[1].tolist() == [0]


def test_mixing_against_plain_loops():
    rng = np.random.default_rng(1)
    offsets = np.array([0, 3, 3, 40, 60])
    guess, tokens = rng.integers(0, 3, 60).astype(np.uint32), rng.integers(1, 3, 60).astype(np.uint32)
    hit, bits = mixing.followed(guess, tokens, offsets)
    for a, b in zip(offsets, offsets[1:]):
        row = 0
        for i in range(a, b):
            right = (row + 1.5) / (row + 2)
            want = 0.0 if guess[i] == 0 else -math.log2(right if guess[i] == tokens[i] else 1 - right)
            assert hit[i] == (guess[i] != 0 and guess[i] == tokens[i]) and math.isclose(bits[i], want, abs_tol=1e-12)
            row = row + 1 if hit[i] else 0

    begins, n = np.array([0, 2500, 2500, 2900]), 2900
    bits, depth = rng.integers(0, 2, n).astype(np.uint8), rng.integers(0, 30, n).astype(np.uint8)
    stretched = [rng.normal(size=n).astype(np.float32) for _ in range(3)]
    got = mixing.mix(stretched, bits, depth, begins)
    squash = lambda x: 1 / (1 + math.exp(-x))
    for text, (a, b) in enumerate(zip(begins, begins[1:])):
        cost = 0.0
        for i in range(a, b):
            if (i - a) % mixing.SEGMENT == 0:
                weights = [[0.1, 0.3, 0.6] for _ in range(mixing.GATES)]
                fine = [squash(x) for x in np.linspace(-8, 8, mixing.BUCKETS)]
            w, x = weights[min(depth[i], mixing.GATES - 1)], [float(s[i]) for s in stretched]
            mixed = min(8.0, max(-8.0, sum(u * v for u, v in zip(w, x))))
            p = squash(mixed)
            for k in range(3):
                w[k] += mixing.RATE * (bits[i] - p) * x[k]
            j = int((mixed + 8) * (mixing.BUCKETS - 1) / 16 + 0.5)
            final = min(1 - 1e-5, max(1e-5, 0.75 * p + 0.25 * fine[j]))
            fine[j] += (bits[i] - fine[j]) / 64
            cost -= math.log2(final if bits[i] else 1 - final)
        assert math.isclose(got[text], cost, rel_tol=2e-3, abs_tol=1e-9)


def test_mixing_code_is_a_probability():
    code = mixing.Code(np.array([5, 9, 3], np.uint64), [4, 2, 9, 7, 1])
    assert math.isclose(sum(2.0 ** -int(n) for n in code.length), 1)


def test_mixing_of_deep_decisions():
    """A symbol's decisions are those that are mixed and those below, each of which has the prediction of its own counts."""
    code = mixing.Code(np.arange(1, 19, dtype=np.uint64), [2**i for i in range(20)])  # a chain
    first = np.random.default_rng(3).uniform(0.1, 0.9, mixing.SLOTS).astype(np.float32)
    symbols, offsets, most = np.arange(20), np.array([0, 20]), max(mixing.DEPTHS)
    (slots, *_), bits, depth, _ = code.decisions(symbols, offsets)
    _, few, shallow, begins = code.decisions(symbols, offsets, most=most)
    assert begins[-1] == len(few) == (depth < most).sum() and shallow.max() == most - 1 and (few == bits[depth < most]).all() and code.length.max() > most
    p = np.where(bits > 0, first[slots], 1 - first[slots])[depth >= most]
    assert math.isclose(code.deep(first).sum(), -np.log2(p.astype(np.float64)).sum(), rel_tol=1e-6) and (code.deep(first)[code.length <= most] == 0).all()


def test_pfor_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 1000):
        for top in (1, 2, 300, 50257, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            if n:
                ids[rng.integers(0, n, n // 20)] = top - 1
            starts, body = pfor.pack(ids)
            assert (pfor.unpack(starts, body, n) == ids).all()
            one = np.uint32(min(3, max(0, len(starts) - 2)))
            if n:
                part = pfor.unpack(starts[one : one + 2] - starts[one], body[starts[one] : starts[one + 1]], pfor.BLOCK)
                assert (part[: len(ids[one * 256 : (one + 1) * 256])] == ids[one * 256 : (one + 1) * 256]).all()


def encoded(name):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(token_ids.vocabulary(name))  # as the library has it: added tokens in a text are their own ids
    return {i: made.encode(t or "", add_special_tokens=False).ids for i, t in corpus()}


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_tokenizer(name, spaced):
    import pyarrow as pa
    from tokenizers import Tokenizer

    made, rng = Tokenizer.from_file(token_ids.vocabulary(name)), random.Random(9)
    parts = list("abé ABÉ\n\t ,.;'’!<|>01中\xa0\u0301Ⅷ") + ["don't", "word, ", "It's. ", " the", "<|startoftext|>"]
    parts += [f(t.content) for t in made.get_added_tokens_decoder().values() for f in (str, str.upper)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["", " ", "a <|endoftext|> b", "<|endoftext|>"]
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts += [" ".join(f"{a}{c}{m}" for c in letters for a in ("", "x", "T\u00dcRK")) for m in (",", ".", ";", ":", "!", "?", ".,", "!?;")] + ["T\u00dcRK\u0130, YEN\u0130.", "x\u0130y, \u0130\u0130!"]
    ids, offsets = token_ids.Encoder(token_ids.vocabulary(name), spaced).encode(pa.array(texts), 7)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*made.encode(t, add_special_tokens=False).ids, 7]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids(docs, empty, odd):
    path = token_ids.vocabulary("byte_bpe_50k.json")
    got, start = by_id(pfor.encode_documents(docs, path)), 0
    for i, ids in sorted(encoded("byte_bpe_50k.json").items()):
        ids = [*ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert pfor.encode_documents(empty, path).collect() == [] and len(pfor.encode_documents(odd, path).collect()) == 4


def test_packing(docs, empty, odd):
    path = token_ids.vocabulary("word_bpe_49k.json")
    ids = {i: [*x, 2] for i, x in encoded("word_bpe_49k.json").items()}
    pieces = packing.pack(docs, path, 49408, window=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, x in ids.items():
        rows = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [sum(q["length"] for q in rows[:k]) for k in range(len(rows))] and sum(r["length"] for r in rows) == len(x)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(q["length"] for q in rows[:k]) for k in range(len(rows))]
        size = sum(r["length"] for r in rows)
        assert size <= 256 and size & (size - 1) == 0
    assert packing.pack(empty, path, 49408).collect() == [] and sum(r["length"] for r in packing.pack(odd, path, 49408).collect()) == 22


def test_packing_scores_against_plain_bm25():
    texts = [np.array([*ids, 2]) for _, ids in sorted(encoded("word_bpe_49k.json").items())]
    n, df = len(texts), Counter(t for x in texts for t in set(x.tolist()))
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    index = packing.Inverted(texts, np.array([idf.get(t, 0) for t in range(49408)]))
    mean = sum(map(len, texts)) / n
    for seed in range(0, n, 7):
        query = sorted(set(texts[seed].tolist()), key=lambda t: (-idf[t], t))[: packing.QUERY_TOKENS]
        expected = []
        for x in texts:
            tf = Counter(x.tolist())
            expected.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in query))
        assert np.allclose(index.scores(seed), expected)


def test_packing_brings_neighbours_together(spark):
    """Documents on one subject share a shard, and so sequences, though their ids are far apart."""
    rng = random.Random(8)
    texts = [[*rng.sample(range(5 * (i % 40), 5 * (i % 40) + 5), 4), *rng.sample(range(200, 250), 20), 250] for i in range(400)]
    df = np.bincount([t for x in texts for t in x], minlength=300)
    rows = spark.createDataFrame([(i, np.array(x, "<u2").tobytes()) for i, x in enumerate(texts)], "doc_id long, ids binary")
    found = packing.keyed(rows, packing.orders(df, 400), "<u2").orderBy("key", "doc_id").collect()
    beside = sum(a["doc_id"] % 40 == b["doc_id"] % 40 for a, b in zip(found, found[1:]))
    assert len(found) == 400 and beside > 200


def test_pipeline(spark, tmp_path):
    """Junk goes, one of the near copies stays, the contaminated document goes, clean ones stay."""
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice(["ta", "ri", "mo", "len", "ku"]) for _ in range(3))
    prose = lambda n: " ".join(word() + ("." if i % 10 == 9 else "") for i in range(n))
    clean = {i: prose(120) for i in range(30)}
    base = prose(300).split()
    near = {100 + i: " ".join(base[: 20 * i] + ["edit%d" % i] + base[20 * i + 1 :]) for i in range(8)}
    junk = {200 + i: " ".join(word() + rng.choice(["###", "$$$"]) for _ in range(100)) for i in range(8)}
    item = prose(60)
    rows = [*clean.items(), *near.items(), *junk.items(), (300, prose(40) + " " + item), (301, None), (302, "")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in out}
    assert left >= set(clean) and len(left & set(near)) == 1 and left <= set(clean) | set(near)
    ids = token_ids.encoder(token_ids.vocabulary("word_bpe_49k.json"), False).tokenizer
    for i, t in clean.items():
        rows = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        whole = [*ids.encode(t, add_special_tokens=False).ids, 2]
        assert sum(r["length"] for r in rows) == len(whole) and all(crc(whole[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in rows)


def test_pipeline_near_copies(spark):
    """Copies between 0.80 and 0.85 of their base go, those below stay, whatever op5's threshold is."""
    import corpus_pipeline

    rng = random.Random(13)
    rows = []
    for g in range(12):
        base = ["g%dw%d" % (g, rng.randrange(5000)) for _ in range(300)]
        rows.append((100 * g, " ".join(base)))
        for i, edits in enumerate((6, 6, 6, 8)):  # 266 of 326 shingles, 256 of 336
            copy = list(base)
            for k in range(edits):
                copy[10 + 35 * k + 6 * i] = "e%d" % i
            rows.append((100 * g + 1 + i, " ".join(copy)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(296)} for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 <= share(100 * g, 100 * g + i) < 0.85 and share(100 * g, 100 * g + 4) < 0.8 for g in range(12) for i in (1, 2, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {100 * g + i for g in range(12) for i in (0, 4)}
    assert {r["doc_id"] for r in near_dedup.classes(docs).where("kept").collect()} == {i for i, _ in rows}


def test_pipeline_rows(spark, tmp_path):
    """Repeated rows, repeated ids and null ids: each row is decided on by itself, and one of equal rows keeps its whole text."""
    import corpus_pipeline

    rng = random.Random(17)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice(["ta", "ri", "mo", "len", "ku"]) for _ in range(3))
    prose = lambda n: " ".join(word() + ("." if i % 10 == 9 else "") for i in range(n))
    one, two = prose(60), prose(60)  # two, as what they share would go as a repeated passage
    rows = [(i, prose(120)) for i in range(1, 9)]
    twice, shared, other, nameless, lost = (prose(n) for n in (130, 140, 150, 160, 170))
    stay = [*rows, (20, twice), (30, shared), (40, other), (40, prose(155)), (None, nameless)]
    gone = [(20, twice), (20, twice), (30, prose(40) + " " + one), (None, prose(45) + " " + two), (None, nameless), (None, other), (None, lost + " more words"), (50, lost)]
    stay, gone = [*stay, gone[-1]], gone[:-1]
    spark.createDataFrame([(i, t, "x") for i, t in stay + gone], "doc_id long, text string, key string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, one), (2, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = token_ids.encoder(token_ids.vocabulary("word_bpe_49k.json"), False).tokenizer
    tokens = lambda t: [*ids.encode(t, add_special_tokens=False).ids, 2]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    firsts = Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0)
    assert firsts == Counter((i, len(tokens(t))) for i, t in stay)
    whole = {(i, len(tokens(t))): tokens(t) for i, t in stay}
    assert sum(r["length"] for r in out) == sum(map(len, whole.values()))
    assert all(crc(whole[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in out)


def test_every_query_on_the_smallest_tables(spark):
    from metroframe.llm.queries import QUERIES

    assert all(f(spark, "/root/testdata/sf0.001").count() >= 200 for f in QUERIES.values())


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_encoded_once_whatever_marks_follow(name, spaced):
    """By the model alone where they are of ASCII letters, with the library's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, made = random.Random(4), token_ids.Encoder(token_ids.vocabulary(name), spaced)
    words = ["".join(rng.choice("abcdefgXYZé") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["s", "t", "ll", "İ", "ǆ", "a'", "'s", "x\ny", "ß", "Ⅷ", "n2"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "?!", "...", ":;"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += [".", " .", "a.", "a .b", "a. .", "a.  b.", "<|endoftext|>. a.", "a.<|endoftext|>", "İ. a", "a. b.", "́a. b́."]
    ids, offsets = made.encode(pa.array(texts), 1)
    library = Tokenizer.from_file(token_ids.vocabulary(name))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    plain = {k for k in made.known if re.fullmatch("[a-zA-Z]+[.,;:!?]+", k)}
    assert not plain and made.bare is not None


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_are_encoded_once_whatever_line_they_are_on(name, spaced):
    """Words at the ends of lines and before any of the marks are looked up as others are, with the library's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, made = random.Random(7), token_ids.Encoder(token_ids.vocabulary(name), spaced)
    words = ["".join(rng.choice("abcdefgXYZ\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["s", "\u0130", "n2", "\u00d7", "'t", "\u0301x", "x\u0301", ""]
    ends = ["", ".", "$$$", ".%%%", "&", ",&&&", "*#", "#\u20e3", "%\u0301", "<|", "-", "\r"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) + rng.choice([" ", " ", "\n", "\n\n", " \n", "\n ", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    texts += [f"{a}{m}\n{b}{n}" for a in ("ab", "", "\u00e9") for b in ("cd", "", "\u00c9") for m in ("", ".", "$.") for n in ("", "!", "\n")]
    ids, offsets = made.encode(pa.array(texts), 1)
    library = Tokenizer.from_file(token_ids.vocabulary(name))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    made.known.clear()
    made.encode(pa.array(["ab cd$$$ ef.%%%\nGh&&& ij.\nKl mn\nop, qr" + m + " st" for m in ("#", "*")]), 1)
    assert all(re.fullmatch("[a-zA-Z]+|[^a-zA-Z\\s]+", k) for k in made.known)


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_with_accents_are_encoded_by_the_bare_model(name, spaced):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, made, asked = Tokenizer.from_file(token_ids.vocabulary(name)), token_ids.Encoder(token_ids.vocabulary(name), spaced), []

    class Slow:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    made.tokenizer = Slow()
    texts = ["grüße naïve café àáâÿ abc", "ción ñando"] + ["Zwei Étés Ångström"] * spaced
    ids, offsets = made.encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert asked == [t.split()[0] for t in texts if spaced]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_known_pieces_are_few_bytes_and_bounded(name, spaced):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    library, made, rng = Tokenizer.from_file(token_ids.vocabulary(name)), token_ids.Encoder(token_ids.vocabulary(name), spaced), random.Random(3)
    made.known.most, made.joined.most = 60, 20
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abéüKő", k=2)) + rng.choice(["", ".", "\n", "\nx!", "́", "7"]) for _ in range(rng.randrange(25))) for _ in range(2)]
        ids, offsets = made.encode(pa.array(texts), 1)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert len(made.known) <= 120 and len(set(made.known)) == len(made.known) == len(made.known.lengths) and made.known.lengths.sum() == len(made.known.flat)
    assert made.known.pieces.nbytes + made.known.flat.nbytes + made.known.lengths.nbytes < 60 * len(made.known)


def test_stages_hold_few_texts_at_a_time():
    import pyarrow as pa

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):
            self.run = run

    texts = [(w + " ") * 700_000 for w in "abcd"]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(4), "key": range(4), "text": texts})
    for make in (lambda d: near_dedup._signed(d, 16), near_dedup._sets, lambda d: repeats._base(d, suffix_dedup.kind())):
        docs = Docs()
        make(docs)
        out = list(docs.run(iter([batch])))
        assert [b.num_rows for b in out] == [2, 2] and [x for b in out for x in b[0].to_pylist()] == [0, 1, 2, 3]

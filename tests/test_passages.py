"""Chunks and sections against what they promise; patches, regions and detectors on small tables with nulls, repeats and no rows."""

from collections import deque

from metroframe.operators import detectors, passages, patches, regions


def test_chunks(spark):
    long = "One sentence of words. " * 400
    rows = [(1, long), (2, None), (3, ""), (4, " \n "), (5, "short"), (6, "x" * 5000), (1, long)]
    found = passages.chunks(spark.createDataFrame(rows, "id long, text string"), "id", "text", 500, 60).collect()
    assert {r["id"] for r in found} == {1, 5, 6} and len(found) == len({(r["id"], r["chunk"], r["content"]) for r in found}) + sum(r["id"] == 1 for r in found) // 2
    assert [r["content"] for r in found if r["id"] == 5] == ["short"]
    for key, text in ((1, long.strip()), (6, "x" * 5000)):
        parts = [c for _, c in sorted({(r["chunk"], r["content"]) for r in found if r["id"] == key})]
        at = 0
        for i, part in enumerate(parts):
            assert 0 < len(part) <= 500
            start = text.find(part, max(0, at - 60))
            assert 0 <= start <= at + 1  # nothing but a blank is left out
            assert key == 6 or i == len(parts) - 1 or part.endswith(".")
            at = start + len(part)
        assert at == len(text)
    assert passages.pieces("", 10, 2) == [] and passages.pieces("a" * 30, 10, 20)[-1] == (20, 30)
    assert passages.chunks(spark.createDataFrame([], "id long, text string"), "id", "text", 500, 60).count() == 0


def test_sections(spark):
    assert passages.line_groups([10] * 6, 30, 10, 5) == [(0, 3), (2, 5), (4, 6)]
    assert passages.line_groups([], 30, 10, 0) == [] and passages.line_groups([3], 30, 10, 5) == []
    assert passages.line_groups([100, 5], 30, 10, 1) == [(0, 1), (0, 2)]
    rows = spark.createDataFrame([(1, "\n".join(["line of text"] * 50)), (2, None), (3, "")], "id long, text string")
    found = passages.sections(rows, "id", "text", 100, 20, 1).collect()
    assert {r["id"] for r in found} == {1} and {i for r in found for i in range(r["first_line"], r["last_line"] + 1)} == set(range(50))


def test_chapters(spark):
    text = "before\n# One\na\nb\nChapter 2 of all\nc\n第三章 end\nd\n总则\ne"
    rows = [(1, text), (2, "no heading"), (3, None), (4, " \n"), (5, "# All\nbody"), (6, "# ")]
    found = {(r[0], r[1], r[2], r[3]) for r in passages.chapters(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert found == {(1, 0, 0, "前言"), (1, 1, 3, "One"), (1, 4, 5, "Chapter 2 of all"), (1, 6, 7, "第三章 end"), (1, 8, 9, "总则"), (2, 0, 0, "全文"), (5, 0, 1, "All"), (6, 0, 0, "全文")}


def test_search(spark):
    rows = spark.createDataFrame([(1, "cat cat dog", "pets"), (2, "dog", None), (3, None, "cat"), (4, "", "")], "id long, text string, title string")
    found = passages.search(rows, "id", {"text": 3.0, "title": 1.0}, ["Cat", "cat"], 10).collect()
    assert [r["id"] for r in found] == [1, 3] and found[0]["score"] > found[1]["score"] > 0
    assert passages.search(rows.where("id > 4"), "id", {"text": 1.0}, ["cat"], 3).count() == 0


def flooded(cells):
    left, out = set(cells), {}
    while left:
        start = min(left, key=lambda p: (p[1], p[0]))
        todo, seen = deque([start]), {start}
        while todo:
            x, y = todo.popleft()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left and n not in seen:
                    seen.add(n)
                    todo.append(n)
        out |= dict.fromkeys(seen, start[1] * 2**31 + start[0])
        left -= seen
    return out


def test_patches(spark):
    snake = [(x, 0) for x in range(20)] + [(19, 1)] + [(x, 2) for x in range(20)]
    cells = snake + [(0, 4), (1, 5), (2**31 - 2, 7), (0, 8)]
    df = spark.createDataFrame([*cells, cells[0], (None, 3), (3, None)], "x long, y long")
    found = patches.patches(df, "x", "y")
    assert {(r["x"], r["y"]): r["patch"] for r in found.collect()} == flooded(cells)
    sizes = patches.outlines(found)
    assert sorted(r["n_pixels"] for r in sizes.collect()) == [1, 1, 1, 1, 41]
    measured = patches.landscape(sizes, 450, 100.0, 1000.0).first()
    assert (measured["coverage"], measured["n_patches"], measured["n_large"]) == (10.0, 5, 1)
    none = patches.patches(df.where("x < 0"), "x", "y")
    assert none.count() == 0 and patches.landscape(patches.outlines(none), 0, 1.0, 1.0).first()["coverage"] == 0.0


def test_mask(spark):
    block = {(x, y) for x in range(2, 9) for y in range(2, 9)}
    df = spark.createDataFrame(sorted(block - {(5, 5)} | {(12, 12)}), "x long, y long")
    assert set(map(tuple, patches.closed(df, 15, 15, 1).collect())) >= block
    opened = set(map(tuple, patches.opened(spark.createDataFrame(sorted(block | {(12, 12)}), "x long, y long"), 15, 15, 2).collect()))
    assert (12, 12) not in opened and (5, 5) in opened
    values = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (5, 5, None), (9, 9, 2.0)], "x long, y long, v double")
    found = {(r["x"], r["y"]): (r["value"], r["mean"], r["deviation"]) for r in patches.local_statistics(values, "x", "y", "v", 2).collect()}
    assert found == {(0, 0): (1.0, 2.0, 1.0), (1, 0): (3.0, 2.0, 1.0), (9, 9): (2.0, 2.0, 0.0)}


def test_regions(spark):
    objects = spark.createDataFrame([(1, "a", [0.0, 0.0, 2.0, 2.0]), (2, "a", None), (3, "b", [0.0, 0.0, 2.0, 2.0]), (4, "a", [9.0, 9.0, 9.0, 9.0])], "id long, camera string, box array<double>")
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 1.5], [0.0, 1.5]]
    rings = spark.createDataFrame([("a", 7, ring), ("a", 8, [])], "camera string, region long, ring array<array<double>>")
    by = lambda how: {(r["id"], r["region"]): r["overlap_ratio"] for r in regions.matched(objects, rings, ["camera"], "box", how).collect()}
    assert by("foot") == {(1, 7): 0.0, (1, 8): 0.0, (4, 7): 0.0, (4, 8): 0.0}
    assert by("centre")[1, 7] == 1.0 and by("overlap")[1, 7] == 0.75 and by("overlap")[4, 7] == 0.0


def test_detectors(spark):
    days = [(k, f"2024-01-{d:02d}", (50 if d == 20 and k == "b" else d % 7) if d != 9 else None) for k in "ab" for d in range(1, 29)]
    rows = spark.createDataFrame(days, "unique_id string, ds string, y long").selectExpr("unique_id", "cast(ds AS date) AS ds", "y")
    found = detectors.seasonal(rows, 7, 3.0).where("seasonal").collect()
    assert {(r["unique_id"], r["ds"].day) for r in found} >= {("b", 20)} and all(r["unique_id"] == "b" for r in found)
    found = {r["unique_id"]: r for r in detectors.report(detectors.threshold(rows, high=10), ["threshold"], 3).collect()}
    assert (found["a"]["anomalies"], found["b"]["anomalies"], found["b"]["first_days"], found["a"]["first_days"]) == (0, 1, "2024-01-20", "")
    assert detectors.level_shift(detectors.persist(detectors.volatility_shift(rows.where("ds < '2023-01-01'")))).count() == 0

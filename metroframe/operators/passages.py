"""Passages of texts: chunks at sentence ends, chapters, sections of lines; lexical and mixed scores over them."""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..sources.tables import cut

#: What ends a sentence; a full stop or semicolon with the blank behind it.
MARK = re.compile("[。！？\n]|[.;] ")
BLANK = " \t\r\n"
#: What starts a chapter, and lines that are one by themselves.
HEADING = "|".join((r"^#\s+[^#]+$", r"^#{1,3}\s*第[一二三四五六七八九十百千万\d]+章", r"^第[一二三四五六七八九十百千万\d]+章", r"^(Chapter|CHAPTER)\s+\d+\b"))
HEADING_LINES = ("前言", "总则", "附则", "附件")


def sentence_ends(text: str) -> tuple[list[int], list[int]]:
    """Where sentences end, in order: how far the text must be seen to know it, and the end itself, behind the mark but before the blank that some need."""
    marks = list(MARK.finditer(text))
    return [m.end() for m in marks], [m.start() + 1 for m in marks]


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most size characters, ending behind the last sentence end of their second half (of all behind the first 80 characters, if the half is shorter);
    each starts overlap characters before the last one's end, and always later than that one. The ends are found once and looked up for each span."""
    seen, ends = sentence_ends(text)

    def stop(start: int) -> int:
        if start + size >= len(text):
            return len(text)
        last = bisect.bisect_right(seen, start + size) - 1
        return ends[last] if last >= 0 and ends[last] > start + max(size // 2, 80) else start + size

    spans = [(0, stop(0))] if text else []
    while spans and spans[-1][1] < len(text):
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1)
        spans.append((start, stop(start)))
    return spans


def chunks(documents: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """A row per chunk: key, chunk (from 0), content, content_hash and an id that key, place and content decide.

    Where the next chunk starts depends on where the last one ended, so a document's text is walked once, in Arrow batches. Null, empty and blank texts have no chunk.
    Other columns go; documents with equal keys have equal ids only for equal chunks."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        def one(t):
            t = (t or "").strip()
            return [c for s, e in pieces(t, size, overlap) if (c := t[s:e].strip())]

        return texts.map(one)

    rows = documents.select(F.col(key), F.posexplode(split(F.col(text))).alias("chunk", "content"))
    return rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk"), F.col("content_hash")))


def line_groups(lengths: list[int], most: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Groups of following lines (first, last + 1) of at most `most` characters; the next group starts with as many of the last lines as make `overlap` characters; groups below `least` go.

    Both ends are looked up in the running sums of the lengths. A group always has a line that the one before didn't."""
    sums = [0, *itertools.accumulate(lengths)]
    groups, first, done = [], 0, 0
    while done < len(lengths):
        done = max(done + 1, bisect.bisect_right(sums, sums[first] + most) - 1)
        groups.append((first, done))
        first = max(first, min(done, bisect.bisect_right(sums, sums[done] - overlap)) - 1)
    return [(a, b) for a, b in groups if sums[b] - sums[a] >= least]


def sections(documents: DataFrame, key: str, text: str, most: int, overlap: int, least: int) -> DataFrame:
    """A row per group of lines: key, section, first_line, last_line, content. Null texts have none; a line longer than `most` is a group of its own with the overlap before it."""

    @F.pandas_udf("array<struct<first_line:int,last_line:int,content:string>>")
    def split(texts: pd.Series) -> pd.Series:
        def one(t):
            lines = [] if t is None else t.split("\n")
            return [{"first_line": a, "last_line": b - 1, "content": "\n".join(lines[a:b])} for a, b in line_groups([len(x) for x in lines], most, overlap, least)]

        return texts.map(one)

    return documents.select(F.col(key), F.posexplode(split(F.col(text))).alias("section", "s")).select(key, "section", "s.*")


def chapters(documents: DataFrame, key: str, text: str) -> DataFrame:
    """A row per chapter: key, start_line, end_line, title, content. What stands before the first heading is a preface, a text without headings one whole chapter; blank ones go.

    Column functions alone: line numbers of the headings cut the array of lines, so no row of another document is needed."""
    stripped = lambda c: F.btrim(c, F.lit(BLANK))
    heads = lambda c: stripped(c).rlike(HEADING) | stripped(c).isin(*HEADING_LINES)
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key), F.split(F.col(text), "\n").alias("_lines"))
    marks = F.filter(F.transform("_lines", lambda line, i: F.when(heads(line), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_marks", marks).withColumn("_starts", F.array_distinct(F.concat(F.array(F.lit(0)), F.col("_marks"))))
    ends = F.transform("_starts", lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get("_starts", i + 1), F.size("_lines")).alias("e")))
    rows = rows.select(key, "_lines", F.size("_marks").alias("_n"), F.get("_marks", F.lit(0)).alias("_first"), F.explode(ends).alias("_at"))
    rows = rows.select(key, F.col("_at.s").alias("start_line"), (F.col("_at.e") - 1).alias("end_line"), "_n", "_first", stripped(F.array_join(F.slice("_lines", F.col("_at.s") + 1, F.col("_at.e") - F.col("_at.s")), "\n")).alias("content")).where("content != ''")
    name = F.when(F.col("_n") == 0, "全文").when(F.col("start_line") < F.col("_first"), "前言")
    titled = F.when(name.isNull() | F.col("content").startswith("# "), F.col("content")).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("content")))
    first = stripped(F.substring_index(titled, "\n", 1))
    bare = F.regexp_extract(first, r"^#{1,3}\s+(.+)$", 1)
    title = F.when(bare != "", stripped(bare)).when(first.rlike("^第[一二三四五六七八九十百千万\\d]+章"), first).when(F.length(first) > 30, F.concat(F.substring(first, 1, 30), F.lit("..."))).otherwise(first)
    return rows.select(key, "start_line", "end_line", title.alias("title"), titled.alias("content"))


def search(documents: DataFrame, key: str, fields: dict[str, float], query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for the query's terms: a field's BM25 times its boost, and the best field counts. Ties go by key; documents without a term are none of them.

    One scan, no shuffle of words: each row's fields' lengths and counts of terms are written, one row of totals goes out to all."""
    terms = sorted({t.lower() for t in query})
    if not terms:
        raise ValueError("no terms")
    words = {f: F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), "[^a-z0-9一-鿿]+") for f in fields}
    times = lambda found, term: F.size(F.filter(found, lambda w: w == term))
    # each text is split once; of its words only the asked ones are counted one by one
    split = documents.select(F.col(key), *(words[f].alias(f"_w{i}") for i, f in enumerate(fields)))
    blanks = lambda w: F.size(F.filter(w, lambda x: x == ""))
    cut_down = split.select(key, *(c for i in range(len(fields)) for c in ((F.size(f"_w{i}") - blanks(f"_w{i}")).alias(f"_l{i}"), F.filter(f"_w{i}", lambda w: w.isin(terms)).alias(f"_h{i}"))))
    columns, totals = [F.col(key)], [F.count("*").cast("double").alias("_n")]
    for i in range(len(fields)):
        columns.append(F.col(f"_l{i}"))
        columns += [times(F.col(f"_h{i}"), t).alias(f"_f{i}_{j}") for j, t in enumerate(terms)]
        totals += [F.avg(f"_l{i}").alias(f"_m{i}")] + [F.count_if(F.col(f"_f{i}_{j}") > 0).alias(f"_d{i}_{j}") for j in range(len(terms))]
    counted = cut(documents.sparkSession, cut_down.select(*columns))

    def part(i, j):
        idf = F.log(1 + (F.col("_n") - F.col(f"_d{i}_{j}") + 0.5) / (F.col(f"_d{i}_{j}") + 0.5))
        long = k1 * (1 - b + b * F.try_divide(F.col(f"_l{i}"), F.col(f"_m{i}")))
        return F.when(F.col(f"_f{i}_{j}") > 0, idf * F.col(f"_f{i}_{j}") / (F.col(f"_f{i}_{j}") + long)).otherwise(0.0)

    scores = [boost * sum((part(i, j) for j in range(len(terms))), F.lit(0.0)) for i, boost in enumerate(fields.values())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    scored = counted.crossJoin(F.broadcast(counted.agg(*totals)))  # one row of totals
    return scored.select(key, F.round(best, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def hybrid(semantic: Column, lexical: Column, numeric: Column) -> Column:
    """Fixed weights: 0.72 of the vectors' similarity, 0.22 of the words', 0.06 of the numbers'. A part that is null counts as 0."""
    zero = F.lit(0.0)
    return 0.72 * F.coalesce(semantic, zero) + 0.22 * F.coalesce(lexical, zero) + 0.06 * F.coalesce(numeric, zero)


def ngrams(text: Column, least: int, most: int, run: int = 2) -> Column:
    """Different character n-grams, from least to most characters, of the runs of at least so many CJK characters."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]{%d,}" % run), F.lit(0))
    cut = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.flatten(F.transform(runs, lambda r: F.array(*(cut(r, n) for n in range(least, most + 1)))))))

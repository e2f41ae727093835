"""Exact duplicates by a tree of merged runs of sorted digests.

Each partition of the input is a run: its different texts as digests in order, each with its number of rows and the identifier that
stays. Runs are exchanged in rounds of a binomial tree with several ways (run i goes to run i // ways), and each round merges them
by key and keeps the identifier that stays of what it met. The last round leaves one run, dealt over tasks by digest. The way back
is by the first runs: an entry for each text and run meets the last run, and rows meet the entries of their own run, so a text that
a third of all rows have is never one key for more than one partition's rows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What equal texts have in common: the digest, and, to verify it, the size and a hash of another kind.
KEY = ["digest", "size", "check"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null as empty. Texts of ASCII alone take the faster way to the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def merged(runs: DataFrame, run: Column, best) -> DataFrame:
    """The runs (run, KEY, stays, n) under their new numbers, each sorted by digest, one entry for a text."""
    return runs.groupBy(run.alias("run"), *KEY).agg(best("stays").alias("stays"), F.sum("n").alias("n")).sortWithinPartitions("run", *KEY)


def deduplicate(docs: DataFrame, stays: str = "smallest", ways: int = 8) -> DataFrame:
    """A row for each row of docs (doc_id, text), dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after A-Z are lower-cased; null counts as empty. Of equal texts, the row of the smallest
    or largest (stays) doc_id stays; a null id stays only if all ids of the group are null (keep_id is null then). Of rows that
    repeat the id that stays, one stays. An empty table gives no rows.
    """
    if stays not in ("smallest", "largest") or ways < 2:
        raise ValueError("stays is smallest or largest, and two runs meet at least")
    best = F.min if stays == "smallest" else F.max
    absent = F.col("doc_id").isNull() if stays == "smallest" else F.col("doc_id").isNotNull()
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), normalised(F.col("text")).alias("text"))
    digests = text.select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("check"))
    rows = cut(digests.withColumn("run", F.shiftright("row", 33).cast("int")), "digests")
    # one row's entry: what orders it among equal texts
    single = rows.select("run", *KEY, F.struct(absent.alias("absent"), "doc_id", "row").alias("stays"), F.lit(1).cast("long").alias("n"))
    first = cut(merged(single, F.col("run"), best), "run")
    last, n_runs, between = first, (first.agg(F.max("run")).first()[0] or 0) + 1, Tables()
    while n_runs > 1:
        step = cut(merged(last, F.floor(F.col("run") / ways).cast("int"), best), "run")
        between.forget()
        between.held.append(step)
        last, n_runs = step, -(-n_runs // ways)
    answers = first.select("run", *KEY).join(last.select(*KEY, "stays", F.col("n").alias("group_size")), KEY)
    return rows.join(answers, ["run", *KEY]).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def oracle_sql() -> str:
    """The same over the table documents, the largest id staying, in DuckDB's SQL."""
    return f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY text)"""

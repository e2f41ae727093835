"""Hard negatives by a search in buckets of like norm.

Candidates are sorted by norm and packed into buckets, each a matrix with the greatest norm in it; buckets are dealt over tasks, the
longest vectors first in each. Anchors are asked in waves of bounded size: a wave's anchors go to every task, which walks through its
buckets and keeps the best of each anchor's window so far. By Cauchy-Schwarz no score in a bucket is beyond the product of the
anchor's norm and the bucket's, so a bucket is left out where that is below the window's lower limit or the score of the last one
held. What tasks hold, a bounded number a window, is ranked in Spark. Positives are found the same way, before the windows that they
open: their window has no limits, and takes the anchor's own label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, parallelism, trimmed

#: Vectors of a bucket, at most.
BUCKET = 1024
#: Bytes of the anchors that are asked at once, with eight bytes a component; positives and windows of an anchor have a bound besides.
WAVE_BYTES = 16_000_000
#: Anchors whose scores with a bucket are held at once.
SLICE = 256
#: Stands for a null id, which comes last of ties.
NO_ID = 2**63 - 1
LEAST, MOST = -(2**63) + 1, 2**63 - 1
#: From here on doubles don't hold all whole numbers.
EXACT = 2.0**53


def _narrow(vectors: np.ndarray) -> tuple[str, bytes]:
    """The vectors' components in the smallest type that holds them, and its name."""
    most = np.abs(vectors).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, vectors.astype(kind).tobytes()


def _matrix(lists, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    width = max((len(x) for x in lists), default=0) if width is None else width
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (row, id, label, vector, norm) as buckets (bucket, top, n, kind, rows, ids, labels, vectors), of falling norm."""
    import pyarrow as pa

    kind = "bucket long, top double, n long, kind string, rows binary, ids binary, labels binary, vectors binary"

    @trimmed
    def pack(batches):
        from pyspark import TaskContext

        held, number = [], TaskContext.get().partitionId() << 33

        def emit(table):
            nonlocal number
            vectors = _matrix(table["vector"].to_pylist())
            name, packed = _narrow(vectors)
            arrays = [np.asarray(table[c], dtype="<i8").tobytes() for c in ("row", "id", "label")]
            values = [number, table["norm"][0].as_py(), len(vectors), name, *arrays, packed]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["bucket", "top", "n", "kind", "rows", "ids", "labels", "vectors"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while len(table) >= BUCKET:
                yield emit(table.slice(0, BUCKET))
                table = table.slice(BUCKET)
            held = table.to_batches()
        if sum(map(len, held)):
            yield emit(pa.Table.from_batches(held))

    n = parallelism(rows.sparkSession)
    ordered = rows.repartitionByRange(n, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    return ordered.mapInArrow(pack, kind).repartition(n, "bucket").sortWithinPartitions(F.desc("top"))


@dataclass
class Asked:
    """Windows of a wave: the anchor of each, its limits (inclusive), and what the answers repeat of it."""

    vectors: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive: np.ndarray
    positive_id: np.ndarray
    positive_score: np.ndarray


class Best:
    """The k best of each window so far, by falling score, then id, then row."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, np.zeros(n, np.int64)
        self.score, self.id, self.row = (np.full((n, k), LEAST, np.int64) for _ in range(3))

    def floor(self) -> np.ndarray:
        """The score of the last one held, where k are held."""
        return np.where(self.n == self.k, self.score[:, -1], LEAST)

    def add(self, window, score, ids, rows) -> None:
        touched = np.unique(window)
        held = np.arange(self.k)[None, :] < self.n[touched, None]
        old = np.broadcast_to(touched[:, None], held.shape)[held]
        window = np.concatenate([window, old])
        score, ids, rows = (np.concatenate([new, mine[touched][held]]) for new, mine in ((score, self.score), (ids, self.id), (rows, self.row)))
        order = np.lexsort((rows, ids, -score, window))
        window = window[order]
        start = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        size = np.diff(np.concatenate([start, [len(window)]]))
        place = np.arange(len(window)) - np.repeat(start, size)
        order, window, place = order[place < self.k], window[place < self.k], place[place < self.k]
        self.score[window, place], self.id[window, place], self.row[window, place] = score[order], ids[order], rows[order]
        self.n[touched] = np.minimum(size, self.k)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; those that a long doesn't hold are at its limits."""
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def search(buckets: DataFrame, asked: Asked, k: int, same: bool) -> DataFrame:
    """The k best rows of each window that each task found: of the anchor's label (same), or of others; never the anchor's own row."""
    import pyarrow as pa

    shared = buckets.sparkSession.sparkContext.broadcast(asked)
    names = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "id", "score"]

    @trimmed
    def walk(batches):
        q = shared.value
        norms = np.sqrt((q.vectors**2).sum(axis=1))
        best = Best(len(q.anchor), k)
        # windows stand in the order of their anchors
        bounds = np.searchsorted(q.anchor, np.arange(0, len(q.rows) + SLICE, SLICE))
        for batch in batches:
            for b in batch.to_pylist():
                rows, ids, labels = (np.frombuffer(b[c], "<i8") for c in ("rows", "ids", "labels"))
                vectors = np.frombuffer(b["vectors"], b["kind"]).reshape(b["n"], -1).astype(float)
                width = min(vectors.shape[1], q.vectors.shape[1])
                for begin, end in zip(bounds, bounds[1:]):
                    window = np.arange(begin, end)
                    reach = norms[q.anchor[window]] * b["top"] * (1 + 1e-9)
                    floor = np.maximum(q.low[window], best.floor()[window])
                    window, floor = window[(reach >= floor) & (-reach <= q.high[window])], floor[(reach >= floor) & (-reach <= q.high[window])]
                    if not len(window):
                        continue
                    anchors, which = np.unique(q.anchor[window], return_inverse=True)
                    score = products(q.vectors[anchors, :width], vectors[:, :width], float(reach.max()))[which]
                    of = q.anchor[window]
                    fits = (score >= floor[:, None]) & (score <= q.high[window][:, None]) & (rows[None, :] != q.rows[of][:, None])
                    fits &= (labels[None, :] == q.labels[of][:, None]) == same
                    w, c = np.nonzero(fits)
                    if len(w):
                        best.add(window[w], score[w, c], ids[c], rows[c])
        w = np.repeat(np.arange(len(best.n)), best.n)
        held = np.arange(k)[None, :] < best.n[:, None]
        a = q.anchor[w]
        columns = [q.rows[a], q.ids[a], q.positive[w], q.positive_id[w], q.positive_score[w], best.row[held], best.id[held], best.score[held]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return buckets.mapInArrow(walk, ", ".join(f"{c} long" for c in names))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window of what all tasks found, ranked from 1."""
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """For each anchor and each of its positives, negatives in the window of scores that the positive opens.

    rows (id long, label long, vector array<double>): vectors of whole numbers. A score is the inner product with the anchor; higher
    scores come first, ties by smaller id, then by the order of rows. Anchors are the rows whose id is divisible by every, each row by
    itself if they repeat an id. An anchor's positives are the first rows of its label, other than the row itself; for each of them
    the first rows of other labels with low * positive_score <= 100 * score <= high * positive_score are returned: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    A null label or vector, or a component that is null or not finite, keeps a row out. A null id is no anchor's, and comes last of
    ties. Of vectors of different lengths the shorter one counts as ending in zeros. Scores are exact; those beyond a long are at its
    limits. A positive without negatives, an anchor without positives and an empty table give no rows.
    """
    spark = rows.sparkSession
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    table = cut(whole.select(F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "vector", norm.alias("norm")), "vectors")
    anchors = table.where((F.col("id") != NO_ID) & (F.col("id") % every == 0))
    n_bytes = anchors.agg(F.sum(F.size("vector") + 8)).first()[0]
    buckets = cut(bucketed(table), "buckets")
    n_waves = -(-8 * (n_bytes or 0) // wave_bytes)
    out = []
    for wave in range(n_waves):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(n_waves)) == wave).select("row", "id", "label", "vector").orderBy("row").toPandas()
        numbers = [part[c].to_numpy(np.int64) for c in ("row", "id", "label")]
        n = len(part)
        asked = Asked(_matrix(list(part["vector"])), *numbers, np.arange(n), np.full(n, LEAST), np.full(n, MOST), *(np.zeros(n, np.int64) for _ in range(3)))
        near = ranked(search(buckets, asked, positives, True), positives).orderBy("anchor_row", "rank").toPandas()
        score = near["score"].to_numpy(np.int64)
        limits = [np.array([max(LEAST, min(MOST, f(int(s)))) for s in score], np.int64) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100)]
        at = np.searchsorted(asked.rows, near["anchor_row"].to_numpy(np.int64))
        windows = Asked(asked.vectors, *numbers, at, *limits, near["row"].to_numpy(np.int64), near["id"].to_numpy(np.int64), score)
        out.append(cut(ranked(search(buckets, windows, negatives, False), negatives), "negatives"))
    forget(buckets)
    forget(table)
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, id long, positive_score long, score long")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    for found in out:
        nothing = nothing.unionByName(found.select(nothing.columns))
    return nothing.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def quantised(embeddings: DataFrame) -> DataFrame:
    """The table embeddings (vec_id, embedding, label) as rows for mine(): components floor(256 * x), and labels moved on by one where vec_id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def whole(x):
        x = 256.0 * x.cast("double")
        return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)  # from there on doubles are whole

    return embeddings.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), F.transform("embedding", whole).alias("vector"))


def oracle_sql() -> str:
    """The query over the table embeddings, in DuckDB's SQL."""
    return """
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

"""Quality rules as weak supervision.

Each rule votes good or bad or abstains. Expectation-maximisation estimates, without labels, how often each rule is right
on good and on bad documents; a document stays if its posterior probability of being good is at least one half. The
documents enter the estimate as counts of vote patterns, so that it covers all of them and has at most 3^rules rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, read_bytes, trimmed
from .winnow import covered, grams, word_units

SYMBOLS = b"#*$%&|<>"
#: Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all their there been has when who will more no if out so up "
    b"le la les de des du et un une en que qui dans pour par sur au aux avec est pas ce il elle ne se plus sont ou mais "
    b"der die das und den von zu dem mit sich des auf ist im eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem ein so nicht "
    b"el los las y del se con por para como su al lo este esta pero sus ha son una es".split()
)
RULES = ("symbols", "capitals", "function_words", "repeated_lines", "repeated_windows", "distinct_words", "word_length", "shouting", "punctuation")
WINDOW = 8
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def measure(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rules' votes as a number to base 3.

    A rule that knows one kind of junk votes bad or abstains; those on function words, word length and punctuation vote both ways.
    """
    words = raw.split()
    n = len(words)
    n_symbols = sum(map(raw.count, (bytes([s]) for s in SYMBOLS)))
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= len(raw) - len(raw.decode("utf-8", "surrogatepass"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)] if b"\n" in raw else [raw] if n else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        h = grams(word_units(raw)[0], WINDOW)
        _, at, counts = np.unique(h, return_inverse=True, return_counts=True)
        if len(counts) < len(h):
            again = np.flatnonzero(counts[at] > 1)
            repeat = int(covered(n, again, again + WINDOW).sum())
    lower = raw.lower()
    capitals, letters = len(raw) - len(raw.translate(None, _CAPITALS)), max(1, len(raw.translate(None, _NO_LETTERS)))
    common = sum(map(FUNCTION_WORDS.__contains__, lower.split()))
    shouts, stops = raw.count(b"!"), sum(w[-1] in b".,;:!?" for w in words)
    long = n >= 50
    votes = (
        _vote(n_symbols * 10 > n, False) if n else 1,
        _vote(capitals * 10 > 3 * letters, False) if n >= 10 else 1,
        _vote(common * 50 < n, common * 16 >= n) if long else 1,
        _vote(dup * 10 > 3 * len(lines), False) if len(lines) > 2 else 1,
        _vote(repeat * 5 > n, False) if long else 1,
        _vote(len(set(words)) * 10 < 3 * n, False) if 50 <= n <= 1000 else 1,
        _vote(chars < 2 * n or chars > 12 * n, 4 * n <= chars <= 8 * n) if n >= 10 else 1,
        _vote(shouts * 10 > n, False) if n >= 10 else 1,
        _vote(stops * 2 > n or stops * 100 < n, stops * 20 >= n and stops * 3 <= n) if long else 1,
    )
    return n, chars, n_symbols, dup, repeat, sum(v * 3**i for i, v in enumerate(votes))


_CAPITALS = bytes(range(0x41, 0x5B))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior probability of being good of each pattern.

    share[c, v, r] is how often rule r votes v on documents of class c (bad, good). It starts from rules that are mostly
    right, and no rule can be turned round: a vote never speaks against itself.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
    cast = np.stack([votes == v for v in range(3)]).astype(np.float64)
    share = np.empty((2, 3, len(RULES)))
    share[0], share[1] = np.array([[0.4], [0.4], [0.2]]), np.array([[0.02], [0.48], [0.5]])
    prior = 0.8
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sum(cast[v] @ np.log(share[1, v] / share[0, v]) for v in range(3))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        new = np.empty_like(share)
        for c, w in enumerate(((1 - p) * counts, p * counts)):
            new[c] = np.stack([w @ cast[v] for v in range(3)]) + np.array([[2.0], [2.0], [2.0]])
        new /= new.sum(axis=1, keepdims=True)
        new[1, 0] = np.clip(new[1, 0], 0.01, new[0, 0].clip(0.02) / 2)
        new[0, 2] = np.minimum(new[0, 2], new[1, 2])
        new[:, 1] = 1  # that a rule abstains says nothing
        prior = float(np.clip((p @ counts + 8) / (counts.sum() + 10), 0.5, 0.99))
        done = np.abs(new - share).max() < 1e-9
        share = new
        if done:
            break
    return p


def _verdicts(measured: DataFrame) -> dict[int, float]:
    counts = measured.groupBy("votes").count().collect()  # at most 3^rules rows
    patterns = np.array([r["votes"] for r in counts], dtype=np.int64)
    good = fit(patterns, np.array([r["count"] for r in counts], dtype=np.float64)) if len(patterns) else []
    return {int(v): float(g) for v, g in zip(patterns, good)}


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): measures, base_failed, good (the posterior probability) and kept.

    Null texts have no words and fail the base; so do empty ones. Repeated rows are judged alike. Other columns stay out.
    """

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in BASE.split(", ")]
        for batch in batches:
            rows = [measure(t or b"") for t in read_bytes(batch["text"])]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.int32())], names=names)

    measured = cut(docs.select("doc_id", "text").mapInArrow(trimmed(run), BASE), "quality")
    verdicts = docs.sparkSession.createDataFrame(list(_verdicts(measured).items()), "votes int, good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.join(F.broadcast(verdicts), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("good") >= 0.5)).alias("kept"), "good"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. The texts stay where they are: they are measured twice, not shuffled."""

    def votes(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_pydict({"votes": pa.array([measure(t or b"")[5] for t in read_bytes(batch["text"])], pa.int32())})

    good = _verdicts(cut(docs.select("text").mapInArrow(trimmed(votes), "votes int"), "quality-votes"))

    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches):
            rows = [measure(t or b"") for t in read_bytes(batch["text"])]
            yield batch.filter(pa.array([r[0] >= 20 and 100 * r[4] <= 30 * r[0] and good[r[5]] >= 0.5 for r in rows], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)

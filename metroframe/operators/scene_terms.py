"""Which scene a text is about, by weighted terms: one automaton over all scenes' terms goes through each text once.

The terms of the scenes are a parameter of the question, not data, and go to every task."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The weight of a term by where it stands; what terms against a scene take away; score = BASE + points / DIVISOR, at most MOST; limits of the resolver.
WEIGHTS = {"name": 2.5, "description": 1.5, "example": 1.0, "strong_keywords": 4.5, "keywords": 2.7, "positive_examples": 1.2, "parameter_names": 1.2, "parameter_notes": 0.9, "parameter_options": 2.0}
PENALTIES = {"strong_anti_keywords": -6.0, "anti_keywords": -3.0, "negative_examples": -0.8}
BASE, DIVISOR, MOST = 0.45, 10.0, 0.95
LEAST_SCORE, SUPPORT_RATIO = 0.65, 0.72
SPLIT = re.compile(r"[^0-9a-z一-鿿]+")


def term_table(scenes: dict[str, dict[str, list[str]]]) -> list[tuple[str, str, float, float]]:
    """(scene, term, weight, penalty): the terms (two characters or more) of a scene's texts, each with the greatest weight of where it stands, and the penalties of those against it.

    Texts are lower-cased and parted at what is no letter, digit or Chinese character; keywords are terms as a whole, without their blanks."""
    rows = []
    for scene, fields in scenes.items():
        weight: dict[str, float] = {}
        penalty: dict[str, float] = {}
        for field, values in fields.items():
            whole = "keywords" in field
            terms = {"".join(t.split()) for v in values for t in ([v.lower()] if whole else SPLIT.split(v.lower()))}
            for t in terms:
                if field in WEIGHTS and len(t) >= 2:
                    weight[t] = max(weight.get(t, 0.0), WEIGHTS[field])
                if field in PENALTIES and t:
                    penalty[t] = penalty.get(t, 0.0) + PENALTIES[field]
        rows += [(scene, t, weight.get(t, 0.0), penalty.get(t, 0.0)) for t in sorted(weight.keys() | penalty.keys())]
    return rows


def scene_scores(texts: DataFrame, key: str, text: str, terms: list[tuple[str, str, float, float]]) -> DataFrame:
    """(key, scene, points, score) of the scenes that a text has a weighted term of: the weights of the terms in it, each once, and the penalties; scenes at or below 0 have no row.

    Terms are looked for in the lower-cased text without its blanks. Null and empty texts have no rows; rows that repeat have their own."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton, of = ahocorasick.Automaton(), {}
        for scene, term, weight, penalty in shared.value:
            of.setdefault(term, []).append((scene, weight, penalty))
        for term in of:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            keys, scenes, points = [], [], []
            for i, t in enumerate(batch["text"].to_pylist()):
                found = {term for _, term in automaton.iter("".join((t or "").lower().split()))} if of else set()
                sums: dict[str, list[float]] = {}
                for term in sorted(found):
                    for scene, weight, penalty in of[term]:
                        own = sums.setdefault(scene, [0.0, 0.0])
                        own[0] += weight
                        own[1] += penalty
                for scene, (weight, penalty) in sums.items():
                    if weight > 0 and weight + penalty > 0:
                        keys.append(i)
                        scenes.append(scene)
                        points.append(weight + penalty)
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(keys, pa.int64())), pa.array(scenes, pa.string()), pa.array(points, pa.float64())], names=["key", "scene", "points"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, scene string, points double")
    return found.select(F.col("key").alias(key), "scene", F.round("points", 4).alias("points"), F.round(F.least(F.lit(MOST), BASE + F.col("points") / DIVISOR), 2).alias("score"))


def resolved(candidates: DataFrame, key: str) -> DataFrame:
    """Of candidates (key, skill, score, in_scene, refused, asked_for), those selected with their role.

    Refused ones go. The best in the scene (the first by name of ties) is primary, or, without one, the best that reaches LEAST_SCORE or is asked for. Others support it
    from max(LEAST_SCORE, SUPPORT_RATIO of the primary's score in the scene) on, or if they are asked for."""
    rows = candidates.where("NOT refused")
    scene = rows.where("in_scene").groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("n"), "skill")).alias("_p")).select(key, F.col("_p.skill").alias("_first"), (-F.col("_p.n")).alias("_best"))
    joined = rows.join(scene, key, "left")
    least = F.when(F.col("_first").isNull(), LEAST_SCORE).otherwise(F.greatest(F.lit(LEAST_SCORE), F.col("_best") * SUPPORT_RATIO))
    kept = joined.where((F.col("skill") == F.col("_first")) | (F.col("score") >= least) | F.col("asked_for"))
    top = kept.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("n"), "skill")).alias("_t")).select(key, F.col("_t.skill").alias("_top"))
    primary = F.col("skill") == F.coalesce("_first", "_top")
    return kept.join(top, key).select(key, "skill", "score", F.when(primary, "primary").otherwise("supporting").alias("role"))

"""Queries over chunks, chapters and sections of documents, and searches in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import passages, retrieval
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
ASKED = ["the", "ing", "thans", "que"]


def chunked_documents(spark, folder):
    return passages.chunks(load(spark, folder, "documents"), "doc_id", "text", 1200, 150).select("doc_id", "chunk", "content_hash", "chunk_id")


def line_sections(spark, folder):
    found = passages.sections(load(spark, folder, "documents"), "doc_id", "text", 900, 120, 80)
    return found.select("doc_id", "section", "first_line", "last_line", F.md5("content").alias("digest"))


QUERIES |= {"chunked_documents": chunked_documents, "line_sections": line_sections}  # no SQL: each piece starts where the last one ended

_HEADED = r"regexp_replace(text, '\. ([A-Z])', chr(10) || '# \1', 'g')"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, {_HEADED} AS t FROM documents WHERE text IS NOT NULL)),
    h AS (SELECT *, regexp_matches(trim(line, ' ' || chr(9) || chr(10) || chr(13)), '^#\s+[^#]+$') AS head FROM l), c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c, count(*) FILTER (head) OVER (PARTITION BY doc_id) AS heads FROM h),
    g AS (SELECT doc_id, min(i)::INT AS start_line, max(i)::INT AS end_line, c, heads, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM c GROUP BY doc_id, c, heads),
    f AS (SELECT *, CASE WHEN starts_with(body, '# ') OR c > 0 THEN body WHEN heads = 0 THEN '# 全文' || chr(10) || chr(10) || body ELSE '# 前言' || chr(10) || chr(10) || body END AS content FROM g WHERE body != '')
    SELECT doc_id, start_line, end_line, trim(regexp_extract(string_split(content, chr(10))[1], '^#+\s+(.+)$', 1), ' ' || chr(9) || chr(10) || chr(13)) AS title, md5(content) AS digest FROM f""")
def document_chapters(spark, folder):
    """Chapters of documents in which each sentence that follows another one in its line becomes a heading."""
    headed = load(spark, folder, "documents").withColumn("text", F.regexp_replace("text", r"\. ([A-Z])", "\n# $1"))
    return passages.chapters(headed, "doc_id", "text").select("doc_id", "start_line", "end_line", "title", F.md5("content").alias("digest"))


def _field_sql(name, of):
    words = f"list_filter(string_split_regex(lower(coalesce({of}, '')), '[^a-z0-9一-鿿]+'), lambda x: x != '')"
    return f"""{name}_w AS (SELECT doc_id, {words} AS w FROM documents), {name}_n AS (SELECT count(*) AS n, avg(len(w)) AS m FROM {name}_w), {name}_t AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS f FROM {name}_w, (SELECT unnest({ASKED}) AS term)),
    {name}_d AS (SELECT term, count(*) FILTER (f > 0) AS d FROM {name}_t GROUP BY 1), {name} AS (SELECT doc_id, sum(ln(1 + (n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * f / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))) FILTER (f > 0) AS s FROM {name}_t JOIN {name}_d USING (term), {name}_n GROUP BY 1)"""


@query(f"WITH {_field_sql('a', 'text')}, {_field_sql('b', 'source')} SELECT doc_id, round(greatest(3 * coalesce(a.s, 0), coalesce(b.s, 0)), 6) AS score FROM a JOIN b USING (doc_id) WHERE round(greatest(3 * coalesce(a.s, 0), coalesce(b.s, 0)), 6) > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def ranked_passages(spark, folder):
    return passages.search(load(spark, folder, "documents"), "doc_id", {"text": 3.0, "source": 1.0}, ASKED, 20)


@query(r"""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), w AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[一-鿿]{2,}|[A-Za-z0-9]+(?:[.][0-9]+)?'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS t, text FROM documents)
    SELECT doc_id, round(0.72::DOUBLE * coalesce(CASE WHEN v.embedding IS NOT NULL THEN list_cosine_similarity(v.embedding::DOUBLE[], q.e) END, 0) + 0.22::DOUBLE * coalesce(len(list_intersect(t, ['the', 'and', 'of', '12'])) / nullif(sqrt(len(t) * 4), 0)::DOUBLE, 0) + 0.06::DOUBLE * coalesce(contains(replace(text, ' ', ''), '12')::INT, 0), 6) AS score
    FROM w LEFT JOIN embeddings v ON v.vec_id = doc_id, q""")
def hybrid_scores(spark, folder):
    """Documents, each with the vector of its number, against a question with the least vector."""
    asked = "the and of 12"
    vectors = load(spark, folder, "embeddings")
    first = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("_q"))  # one row
    rows = load(spark, folder, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").crossJoin(F.broadcast(first))
    semantic = F.when(F.col("embedding").isNotNull(), retrieval.cosine(F.col("embedding"), F.col("_q")))
    lexical = texts.token_overlap(texts.tokens(F.col("text")), texts.tokens(F.lit(asked)))
    return rows.select("doc_id", F.round(passages.hybrid(semantic, lexical, texts.numeric_mentions(asked, F.col("text")).cast("double")), 6).alias("score"))


_CJK = "concat('约', CASE p_size % 3 WHEN 0 THEN '城市道路' WHEN 1 THEN '轨迹' ELSE '人口流动分析' END, p_size, '区域')"


@query(f"""WITH r AS (SELECT p_partkey, unnest(regexp_extract_all({_CJK}, '[一-鿿]{{2,}}')) AS r FROM part), g AS (SELECT DISTINCT p_partkey, substr(r, i, n) AS g FROM r, range(2, 4) a(n), range(1, 12) b(i) WHERE i + n - 1 <= length(r))
    SELECT p_partkey, string_agg(g, ',' ORDER BY g) AS grams FROM g GROUP BY 1""")
def phrase_grams(spark, folder):
    return load(spark, folder, "part").select("p_partkey", F.array_join(F.array_sort(passages.ngrams(F.expr(_CJK), 2, 3)), ",").alias("grams"))

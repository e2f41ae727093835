"""Queries that write a table in some format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import load, scratch
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


def _customers(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


def _typed(df):
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"), F.col("c_acctbal").cast("double"))


@query(CUSTOMER)
def csv_scan(spark, folder):
    """Written with semicolons, read by the separator found, types from the data."""
    path = f"{scratch(spark, 'csv')}/customers.csv"
    _customers(spark, folder).write.csv(path, header=True, sep=";")
    return _typed(files.read_csv(spark, path))


@query("SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, c_name FROM customer")
def text_csv_view(spark, folder):
    """Ids keep their zeros, as all columns stay text."""
    path = f"{scratch(spark, 'csv')}/ids.csv"
    load(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), "c_name").write.csv(path, header=True)
    return files.read_any(spark, path, text=True)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def mixed_load(spark, folder):
    """Files of three formats as views, one that isn't there left out; then plain SQL over them."""
    root = scratch(spark, "mixed")
    load(spark, folder, "nation").write.csv(f"{root}/nation.csv", header=True)
    load(spark, folder, "region").write.json(f"{root}/1region.jsonl")
    load(spark, folder, "supplier").write.parquet(f"{root}/supplier.parquet")
    made, skipped = files.load_views(spark, [f"{root}/{n}" for n in ("nation.csv", "1region.jsonl", "supplier.parquet", "gone.csv", "x.doc")])
    assert len(made) == 3 and len(skipped) == 2
    return spark.sql("SELECT CAST(n_nationkey AS INT), n_name, r_name FROM nation JOIN t_1region ON n_regionkey = r_regionkey")


@query("SELECT event_id, user_id, event_type FROM events")
def json_lines_scan(spark, folder):
    """Lines that are no JSON are left out."""
    path = f"{scratch(spark, 'jsonl')}/events.jsonl"
    rows = load(spark, folder, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    rows.union(rows.limit(3).select(F.lit("{broken"))).write.text(path)
    return files.read_json(spark, path).select("event_id", "user_id", "event_type")


@query("SELECT n_nationkey, n_name FROM nation")
def wrapped_records(spark, folder):
    """Search results: a list of hits, each with its record under 'source'."""
    path = f"{scratch(spark, 'json')}/hits.json"
    hits = load(spark, folder, "nation").select(F.struct(F.lit(1.0).alias("score"), F.struct("n_nationkey", "n_name").alias("source")).alias("h"))
    hits.agg(F.collect_list("h").alias("results")).select(F.lit(True).alias("ok"), "results").coalesce(1).write.json(path)
    return files.read_json(spark, path, lines=False).select(F.col("n_nationkey").cast("int"), "n_name")


@query("""SELECT r_regionkey AS "id", r_name AS "name.full", r_regionkey * 2 AS "name.more.twice" FROM region""")
def flat_records(spark, folder):
    """A list under 'data', its structs as dotted columns."""
    path = f"{scratch(spark, 'json')}/data.json"
    name = F.struct(F.col("r_name").alias("full"), F.struct((F.col("r_regionkey") * 2).alias("twice")).alias("more"))
    load(spark, folder, "region").select(F.struct(F.col("r_regionkey").alias("id"), name.alias("name")).alias("d")).agg(F.collect_list("d").alias("data")).write.json(path)
    df = files.flattened(files.read_json(spark, path, lines=False))
    return df.select(F.col("id").cast("int"), "`name.full`", F.col("`name.more.twice`").cast("int"))


@query("SELECT p_partkey::VARCHAR AS id, translate(p_name, 'abcdefgh', '中文城市数据分析') AS name FROM part")
def foreign_csv(spark, folder):
    path = f"{scratch(spark, 'csv')}/gbk.csv"
    names = load(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.translate("p_name", "abcdefgh", "中文城市数据分析").alias("name"))
    with files.foreign_encodings(spark):
        names.write.csv(path, header=True, encoding="GBK")
    return files.read_foreign_csv(spark, path)


@query("SELECT 'csv' AS suffix, 2::BIGINT AS n UNION ALL SELECT 'json', 1 UNION ALL SELECT 'parquet', 1")
def discovered_files(spark, folder):
    root, one = scratch(spark, "tree"), load(spark, folder, "region").coalesce(1)
    one.write.csv(f"{root}/a")
    one.write.csv(f"{root}/a/b")
    one.write.json(f"{root}/c")
    one.write.parquet(f"{root}/c/d")
    return files.discovered(spark, root).groupBy("suffix").agg(F.count("*").alias("n"))


@query(CUSTOMER)
def content_cache(spark, folder):
    """The second read finds what the first one has parsed."""
    root = scratch(spark, "cache")
    _customers(spark, folder).coalesce(1).write.csv(f"{root}/c.csv", header=True)
    files.cached(spark, f"{root}/c.csv", f"{root}/cache")
    return _typed(files.cached(spark, f"{root}/c.csv", f"{root}/cache"))


@query("SELECT DISTINCT c_mktsegment AS id FROM customer UNION SELECT 'extra'")
def id_sources(spark, folder):
    path = f"{scratch(spark, 'ids')}/ids.csv"
    load(spark, folder, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("segment")).write.csv(path, header=True)
    found = files.id_list(spark, path=path, column="segment").select("id").union(files.id_list(spark, inline="extra, ,extra").select("id"))
    return found.distinct()


@query("SELECT kind, s_suppkey::VARCHAR AS src, s_nationkey::VARCHAR AS dst FROM supplier, (SELECT unnest(['csv', 'edgelist', 'graphml', 'json']) AS kind)")
def graph_files(spark, folder):
    root = scratch(spark, "graph")
    edges = load(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))
    edges.write.csv(f"{root}/csv", header=True)
    files.write_graph(edges, f"{root}/edgelist", "edgelist")
    edges.select(F.format_string('<edge source="%s" target="%s"/>', "src", "dst")).write.text(f"{root}/graphml")
    edges.agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("links")).write.json(f"{root}/json")
    read = [files.read_graph(spark, f"{root}/{k}", k).withColumn("kind", F.lit(k)) for k in ("csv", "edgelist", "graphml", "json")]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")
def pair_scan(spark, folder):
    return files.pair_columns(load(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT page_id, length(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title_chars, length(html) AS n_chars FROM pages")
def page_source(spark, folder):
    return load(spark, folder, "pages").select("page_id", F.length(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).cast("long").alias("title_chars"), F.length("html").cast("long").alias("n_chars"))


@query("SELECT user_id::VARCHAR AS src_ip, event_type AS proto, value AS bytes, NULL::VARCHAR AS dst_ip FROM events")
def flow_scan(spark, folder):
    """Columns of a log under other names, as one set of names."""
    log = load(spark, folder, "events").withColumn("source_address", F.col("user_id").cast("string"))
    return files.canonical(log, {"src_ip": ["source_address", "sip"], "proto": ["protocol", "event_type"], "bytes": ["octets"], "dst_ip": ["dip"]}, {"bytes": "value"})


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, lower(hex(o_orderstatus::BLOB)) AS raw FROM orders")
def exported_csv(spark, folder):
    path = f"{scratch(spark, 'export')}/orders.csv"
    files.export(load(spark, folder, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderstatus").cast("binary").alias("raw")), path, "csv")
    return files.read_any(spark, path, text=True)


@query("SELECT count(*) AS rows, count(c_name) AS known_c_name, count(c_acctbal) AS known_c_acctbal FROM customer")
def result_summary(spark, folder):
    root = scratch(spark, "result")
    files.write_result(load(spark, folder, "customer").select("c_name", "c_acctbal"), root, "customers")
    assert files.read_json(spark, f"{root}/customers.jsonl").columns
    return spark.read.json(f"{root}/summary.json").select("rows", "known_c_name", "known_c_acctbal")


@query("SELECT dataset_id, version_id, is_current, count(*) AS n FROM (SELECT 'parts' AS dataset_id, 'v1' AS version_id, false AS is_current FROM part UNION ALL SELECT 'parts', 'v2', true FROM part WHERE p_size < 20 UNION ALL SELECT 'people', 'v1', true FROM customer) GROUP BY ALL")
def published_versions(spark, folder):
    """A version published again replaces itself; the last one is current; the other dataset is left alone."""
    table, part = scratch(spark, "versions"), load(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_size")
    files.publish(part, table, "parts", "v1")
    files.publish(load(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("p_size")), table, "people", "v1")
    files.publish(part, table, "parts", "v2")
    files.publish(part.where("p_size < 20"), table, "parts", "v2")
    return files.published(spark, table).groupBy("dataset_id", "version_id", "is_current").agg(F.count("*").alias("n"))


@query("SELECT 0 AS place, 'r_regionkey' AS column_name, 'int' AS type, true AS nullable, count(*) AS rows, count(r_regionkey) AS known FROM region UNION ALL SELECT 1, 'r_name', 'string', true, count(*), count(r_name) FROM region")
def schema_inspection(spark, folder):
    return files.described(load(spark, folder, "region"))

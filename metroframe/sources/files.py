"""Files of several formats as tables, and tables as files.

Everything goes through Spark's own readers and writers, so any store that Spark reaches will do, and files are read where they lie.
The driver sees names of files, schemas and at most one line of a file."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import cut

SUFFIXES = ("csv", "tsv", "json", "jsonl", "parquet")
#: Names under which a JSON object may hold its list of records.
WRAPPERS = ("data", "records", "rows", "items", "result", "results")


def table_name(path: str, taken: set[str] | None = None) -> str:
    """A name for SQL from that of a file: other characters than letters, digits and _ as _, t_ before a digit, _1, _2 .. behind one that is taken."""
    base = re.sub(r"\W", "_", re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1]))
    base = f"t_{base}" if base[:1].isdigit() else base
    name, n = base, 0
    while taken is not None and name in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return row[0].lstrip("\ufeff") if row else ""


def sniffed(line: str) -> str:
    """The separator that is in a line most often: comma, tab, semicolon or bar; a comma if none is."""
    return max(",\t;|", key=line.count)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, text: bool = False, encoding: str = "UTF-8", multiline: bool | None = None) -> DataFrame:
    """A table with a header. sep: None finds it in the first line. text: all columns stay text, so ids keep their zeros.

    multiline: whether values in quotes may hold line breaks; files are then read whole, a task each. None looks for a line with an
    odd number of quotes first, so that files without any are read in parts."""
    sep = sniffed(first_line(spark, path)) if sep is None else sep
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()
    return spark.read.csv(path, header=True, sep=sep, inferSchema=not text, encoding=encoding, multiLine=multiline, escape='"', ignoreLeadingWhiteSpace=False)


@contextlib.contextmanager
def foreign_encodings(spark: SparkSession):
    """Inside, Spark reads and writes encodings beyond its own; the session's setting is as before afterwards."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_foreign_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "GBK")) -> DataFrame:
    """All columns as text, in the first encoding in which the file has no character that can't be read; else in the last.

    The rows are written anew as a table, as the encoding needs a setting that isn't left on for the session."""
    with foreign_encodings(spark):
        for encoding in encodings:
            df = read_csv(spark, path, ",", text=True, encoding=encoding)
            broken = F.concat_ws("", *df.columns).contains("\ufffd")
            if encoding == encodings[-1] or df.where(broken).limit(1).isEmpty():
                return cut(spark, df)
    raise ValueError("no encodings")


def flat_columns(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(dotted name, expression) of all values in a schema that aren't structs. Uses the schema alone."""
    found = []
    for f in schema.fields:
        at = (*path, f.name)
        found += flat_columns(f.dataType, at) if isinstance(f.dataType, T.StructType) else [(".".join(at), ".".join(f"`{p}`" for p in at))]
    return found


def flattened(df: DataFrame) -> DataFrame:
    """Structs in structs as columns with dotted names."""
    return df.select(*(F.col(e).alias(n) for n, e in flat_columns(df.schema)))


def unwrapped(df: DataFrame) -> DataFrame:
    """The records that a JSON file holds: a list under one of WRAPPERS (search results have theirs in a field 'source'), else the rows themselves."""
    for f in df.schema.fields:
        if f.name in WRAPPERS and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            rows = df.select(F.explode(f"`{f.name}`").alias("r"))
            inner = rows.schema["r"].dataType
            return rows.select("r.source.*") if "source" in inner.names and isinstance(inner["source"].dataType, T.StructType) else rows.select("r.*")
    return df


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON Lines (lines that can't be read are dropped), a list of objects, or an object that wraps one."""
    lines = suffix(path) == "jsonl" if lines is None else lines
    if lines:
        df = spark.read.json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
        return df.where("_broken is null").drop("_broken") if "_broken" in df.columns and len(df.columns) > 1 else df
    return unwrapped(spark.read.json(path, multiLine=True))


def read_any(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """By suffix; text: columns of CSV stay text."""
    kind = suffix(path)
    if kind in ("csv", "tsv", "txt"):
        return read_csv(spark, path, "\t" if kind == "tsv" else None, text)
    if kind in ("json", "jsonl"):
        return read_json(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{kind}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((p for p in candidates if exists(spark, p)), None)


def load_views(spark: SparkSession, paths: list[str]) -> tuple[dict[str, str], list[str]]:
    """A temporary view for each file that is there and has a reader: (path by name, what was left out)."""
    made: dict[str, str] = {}
    skipped = []
    for path in paths:
        if suffix(path) not in SUFFIXES or not exists(spark, path):
            skipped.append(path)
            continue
        name = table_name(path, set(made))
        read_any(spark, path).createOrReplaceTempView(name)
        made[name] = path
    return made, skipped


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and suffix of all files below a folder that have a reader, each once. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.withColumn("suffix", F.lower(F.substring_index("path", ".", -1))).where(F.col("suffix").isin(*SUFFIXES)).distinct()


def content_key(spark: SparkSession, path: str) -> str:
    """A hash of what all files there hold, whatever their names' order; each file is hashed where it lies (at most 2 GB each)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("h"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).first()[0]


def cached(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The table at path as Parquet in the cache, parsed only if nothing with the same content is there yet."""
    at = f"{cache}/{content_key(spark, path)}"
    if not exists(spark, f"{at}/_SUCCESS"):
        read_any(spark, path).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def id_list(spark: SparkSession, inline: str | None = None, path: str | None = None, column: str | None = None) -> DataFrame:
    """id and its place: from a list with commas, a text file with one in each line, or a column of a table. Blank and repeated ones go, order stays."""
    if inline is not None:
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inline.split(","))], "place long, id string")
    else:
        rows = spark.read.text(path).select(F.col("value").alias("id")) if column is None else read_any(spark, path, text=True).select(F.col(column).alias("id"))
        rows = rows.select(F.monotonically_increasing_id().alias("place"), "id")
    return rows.select("place", F.trim("id").alias("id")).where("id != ''").groupBy("id").agg(F.min("place").alias("place"))


def pair_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two columns, trimmed, where neither is empty; the scan reads no others."""
    return df.select(F.trim(F.col(a).cast("string")).alias("src"), F.trim(F.col(b).cast("string")).alias("dst")).where("src != '' AND dst != ''")


def read_graph(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Edges (src, dst) of CSV pairs, of lines 'a b', of GraphML, or of JSON with nodes and links."""
    if kind == "csv":
        df = read_csv(spark, path, None, text=True)
        return pair_columns(df, *df.columns[:2])
    if kind == "edgelist":
        parts = F.split(F.trim("value"), "[ \\t]+")
        return spark.read.text(path).where("trim(value) != '' AND NOT startswith(trim(value), '#')").select(parts[0].alias("src"), parts[1].alias("dst"))
    if kind == "graphml":
        tag = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit("<edge[ \\t][^>]*>"), F.lit(0))).alias("t"))
        value = lambda name: F.regexp_extract("t", f"[ \\t]{name}=[\"']([^\"']*)[\"']", 1)
        return tag.select(value("source").alias("src"), value("target").alias("dst"))
    df = spark.read.json(path, multiLine=True)
    name = next(c for c in ("edges", "links") if c in df.columns)
    edges = df.select(F.explode(name).alias("e")).select("e.*")
    a, b = next((p for p in (("source", "target"), ("src", "dst")) if set(p) <= set(edges.columns)))
    return pair_columns(edges, a, b)


def write_graph(edges: DataFrame, path: str, kind: str) -> None:
    """src and dst as lines 'a b', or as JSON Lines. Many files in a folder."""
    if kind == "edgelist":
        edges.select(F.concat_ws(" ", "src", "dst")).write.text(path)
    else:
        edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).write.json(path)


def exportable(df: DataFrame) -> DataFrame:
    """Times as ISO 8601 text and bytes as hex, as files for people have them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str) -> None:
    writer = exportable(df).write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if kind == "csv" else writer.json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A table for a report, of at most so many rows, in the order given."""
    cell = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *exportable(df).limit(rows).collect()]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def write_result(df: DataFrame, folder: str, name: str) -> None:
    """JSON Lines, and beside them one file of counts: rows, and what isn't null of each column."""
    df.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    counts = df.agg(F.count("*").alias("rows"), *(F.count(f"`{c}`").alias(f"known_{c}") for c in df.columns))
    counts.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")


def publish(df: DataFrame, table: str, dataset: str, version: str) -> None:
    """A version of a dataset in a table: what the same version had is replaced, by nothing if there are no rows; others stay as they are.

    Rows go to a folder of their own first; the row of state that names it is one small write, so a publication that fails leaves what was there."""
    spark, publication = df.sparkSession, uuid.uuid4().hex
    df.withColumns({"dataset_id": F.lit(dataset), "version_id": F.lit(version)}).write.parquet(f"{table}/rows/publication={publication}")
    _state(spark, table, dataset, version, publication)


def retire(spark: SparkSession, table: str, dataset: str, version: str) -> None:
    """Take one exact version away; the one published last of those left is current."""
    _state(spark, table, dataset, version, None)


def _state(spark: SparkSession, table: str, dataset: str, version: str, publication: str | None) -> None:
    state = spark.createDataFrame([(dataset, version, publication)], "dataset_id string, version_id string, publication string")
    state.withColumn("at", F.unix_micros(F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{table}/state")


def published(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all versions; is_current: the version is the one published last of its dataset, with or without rows."""
    latest = spark.read.parquet(f"{table}/state").groupBy("dataset_id", "version_id").agg(F.max("at").alias("_at"), F.max_by("publication", "at").alias("publication")).where("publication IS NOT NULL")
    last = latest.groupBy("dataset_id").agg(F.max_by("version_id", "_at").alias("_current"))
    state = latest.join(last, "dataset_id").select("publication", (F.col("version_id") == F.col("_current")).alias("is_current"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{table}/rows").withColumn("publication", F.col("publication").cast("string"))
    return rows.join(F.broadcast(state), "publication").drop("publication")  # a row for each version


def clean(spark: SparkSession, table: str) -> int:
    """Delete the rows of publications that were replaced or taken away, and say how many; not while one is being published."""
    latest = spark.read.parquet(f"{table}/state").groupBy("dataset_id", "version_id").agg(F.max_by("publication", "at").alias("p")).where("p IS NOT NULL")
    used = {r["p"] for r in latest.collect()}  # one for each version
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/rows")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("publication=") and f.getPath().getName().partition("=")[2] not in used]
    for path in gone:
        files.delete(path, True)
    return len(gone)


def described(df: DataFrame) -> DataFrame:
    """A row per column: its place, name, type, whether it may be null, rows and how many have a value; one pass."""
    known = df.agg(F.count("*").alias("rows"), *(F.count(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
    made = [F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col("rows"), F.col(f"c{i}").alias("known")) for i, f in enumerate(df.schema.fields)]
    return known.select(F.explode(F.array(*made)).alias("c")).select("c.*")


def canonical(df: DataFrame, aliases: dict[str, list[str]], overrides: dict[str, str] | None = None) -> DataFrame:
    """Columns by one set of names: of each name's aliases that the table has, the first that isn't null; an override stands alone. Names without any are null."""
    have = {n.lower(): e for n, e in flat_columns(df.schema)}
    out = []
    for name, others in aliases.items():
        wanted = [overrides[name]] if overrides and name in overrides else [name, *others]
        found = [F.col(have[o.lower()]) for o in wanted if o.lower() in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)

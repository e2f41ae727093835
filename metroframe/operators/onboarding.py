"""Raw tables of calls as users, calls and device links with hashed ids; how far two datasets' ids go together. Column expressions, no loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for nothing; labels of a risk and of none; lengths of hex ids that are hashes already; levels of linkability by number of signals.
NOTHING = ("nan", "none", "null", "nat")
RISKS = ("1", "true", "yes", "risk", "fraud", "purefraud", "mutation", "black", "高风险", "风险", "疑似风险")
NORMAL = ("0", "false", "no", "normal", "white", "whitelist", "正常", "白名单", "低风险")
HASH_LENGTHS = (16, 32, 40, 64, 96, 128)
MANY, ONE, APART, UNKNOWN = (
    "linkable_with_multiple_cross_province_signals",
    "partially_linkable_with_one_cross_province_signal",
    "not_linkable_due_to_visible_namespace_difference",
    "no_cross_province_overlap_found_namespace_unknown",
)
BLANK = " \t\r\n\x0b\x0c"


def clean_value(c: Column) -> Column:
    """Text without blanks around it, whole numbers without '.0'; empty for null and for what stands for nothing."""
    text = F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANK))
    return F.when(F.lower(text).isin(*NOTHING), F.lit("")).when(text.rlike(r"\A[0-9]+\.0\z"), F.substring_index(text, ".", 1)).otherwise(text)


def typed_id(c: Column, kind: str, salt: str, length: int = 24, keep: bool = True, bits: int = 512) -> Column:
    """The first characters of the hex SHA-2 of kind, cleaned value and salt; null for values that are nothing. keep: values that are hashes already stay, in lower case."""
    value = clean_value(c)
    hashed = F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), value, F.lit(f"|{salt}")), bits), 1, length)
    already = F.length(value).isin(*HASH_LENGTHS) & value.rlike(r"\A[0-9A-Fa-f]+\z")
    return F.when(value == "", None).otherwise(F.when(already, F.lower(value)).otherwise(hashed) if keep else hashed)


def label(c: Column) -> Column:
    """1 for a risk, 0 for none, another whole number as it is; null for nothing and for other words."""
    text = F.lower(clean_value(c))
    return F.when(text.isin(*RISKS), 1).when(text.isin(*NORMAL), 0).otherwise(text.try_cast("double").cast("int"))


def sub_label(found: Column, given: Column) -> Column:
    """The given one in lower case, else risk, normal or unknown by the label."""
    own = F.lower(clean_value(given))
    return F.when(own != "", own).when(found == 1, "risk").when(found == 0, "normal").otherwise("unknown")


def onboard(raw: DataFrame, roles: dict[str, str], dataset: str, salt: str, source: str, length: int = 24, bits: int = 512) -> dict[str, DataFrame]:
    """users, calls and devices from a table, by the columns that roles name (phone; and counterparty, device, province, label, sub_label, time, duration).

    Rows without a phone give nothing; a call needs a counterpart, a device link a device, which are dropped row by row. A time that can't be
    read is null, and so are its date and hour. Rows that repeat are rows each; users are one for each row, as those tables are. Without the
    role of a phone all three are empty."""
    of = lambda role: F.col(f"`{roles[role]}`") if role in roles else F.lit(None).cast("string")
    ids = lambda role, kind: typed_id(of(role), kind, salt, length, bits=bits)
    province = clean_value(of("province"))
    found = label(of("label"))
    when = of("time").try_cast("timestamp_ntz")
    rows = raw.select(
        F.lit(dataset).alias("dataset_name"), F.when(province == "", "unknown").otherwise(province).alias("province"), ids("phone", "phone").alias("user_id"), ids("counterparty", "phone").alias("dst_counterparty_id"),
        ids("device", "device").alias("imei"), found.alias("label"), sub_label(found, of("sub_label")).alias("sub_label"), when.alias("event_time"), F.to_date(when).alias("event_date"), F.hour(when).alias("event_hour"),
        of("duration").try_cast("double").alias("duration"), F.lit(source).alias("source_table"),
    ).where("user_id IS NOT NULL")
    return {
        "users": rows.select("province", "dataset_name", "user_id", "label", "sub_label", "source_table"),
        "calls": rows.where("dst_counterparty_id IS NOT NULL").select("province", "dataset_name", F.col("user_id").alias("src_user_id"), "dst_counterparty_id", "event_time", "event_date", "event_hour", "duration", "imei", "source_table"),
        "devices": rows.where("imei IS NOT NULL").select(F.col("user_id").alias("src_id"), F.col("imei").alias("dst_id"), F.lit("phone").alias("src_type"), F.lit("imei").alias("dst_type"), F.lit("phone_imei").alias("edge_type"), F.lit(1).alias("edge_count"), "source_table"),
    }


def quality(raw: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row: rows, those that repeat another, and those without a phone, a counterpart or a device, or with a time that can't be read. 0 where there is no such role."""
    empty = lambda role: F.count_if(clean_value(F.col(f"`{roles[role]}`")) == "") if role in roles else F.lit(0).cast("long")
    cleaned = clean_value(F.col(f"`{roles['time']}`")) if "time" in roles else F.lit("")
    broken = F.count_if((cleaned != "") & F.col(f"`{roles['time']}`").try_cast("timestamp_ntz").isNull()) if "time" in roles else F.lit(0).cast("long")
    once = raw.groupBy(*(f"`{c}`" for c in raw.columns)).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))
    return raw.agg(F.count("*").alias("rows"), empty("phone").alias("without_phone"), empty("counterparty").alias("without_counterpart"), empty("device").alias("without_device"), broken.alias("broken_times")).crossJoin(F.broadcast(once))


def linkability(one: DataFrame, two: DataFrame) -> DataFrame:
    """Whether two provinces' calls (src_user_id, dst_counterparty_id, imei) have ids in common: one row with the counts, the level and its score.

    Signals are devices of both, counterparts of both, and pairs in which one calls the other's users. Without any, ids whose lengths differ
    are of different kinds (score 0), else nothing is known (1)."""
    both = lambda c: one.select(c).where(F.col(c).isNotNull()).distinct().join(two.select(c).distinct(), c, "left_semi").agg(F.count("*").alias(f"{c}_shared"))
    calls = lambda a, b: a.join(b.select(F.col("src_user_id").alias("dst_counterparty_id")).distinct(), "dst_counterparty_id", "left_semi").select(F.least("src_user_id", "dst_counterparty_id").alias("a"), F.greatest("src_user_id", "dst_counterparty_id").alias("b"))
    pairs = calls(one, two).union(calls(two, one)).distinct().agg(F.count("*").alias("cross_calls"))
    columns = ("src_user_id", "dst_counterparty_id", "imei")
    spans = lambda df, name: df.agg(F.array(*(F.struct(F.min(F.length(c)).alias("a"), F.max(F.length(c)).alias("b")) for c in columns)).alias(name))
    row = both("imei").crossJoin(both("dst_counterparty_id")).crossJoin(pairs).crossJoin(spans(one, "_one")).crossJoin(spans(two, "_two"))  # one row each
    signals = sum((F.col(c) > 0).cast("int") for c in ("imei_shared", "dst_counterparty_id_shared", "cross_calls"))
    differ = sum(F.coalesce((F.col("_one")[i]["a"] != F.col("_two")[i]["a"]) | (F.col("_one")[i]["b"] != F.col("_two")[i]["b"]), F.lit(False)).cast("int") for i in range(3))
    named = row.withColumns({"signals": signals, "differing_ids": differ})
    choose = lambda a, b, c, d: F.when(F.col("signals") >= 2, a).when(F.col("signals") == 1, b).when(F.col("differing_ids") > 0, c).otherwise(d)
    return named.select("imei_shared", "dst_counterparty_id_shared", "cross_calls", "signals", "differing_ids", choose(MANY, ONE, APART, UNKNOWN).alias("level"), choose(3, 2, 0, 1).alias("score"))

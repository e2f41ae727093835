"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = "(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>"


def normal_name(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def salted_id(c: Column, salt: str, length: int = 12) -> Column:
    """The first hex digits of the SHA-256 of salt and value."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, length)


def clean_html(c: Column) -> Column:
    """Scripts, styles and tags out, white space as single spaces."""
    text = F.regexp_replace(F.regexp_replace(c, DROPPED, " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


UTM_LINKS, LONG_NUMBERS = "(?i)https?://[^ \\t\\n\\r]*utm_[^ \\t\\n\\r]*", "\\b[0-9]{10,13}\\b"
SEPARATORS = "[ \\t\\n\\r,，。、:：]+"
TOKENS = "[一-鿿]{2,}|[A-Za-z0-9]+(?:[.][0-9]+)?"


def preview(c: Column, length: int = 12) -> Column:
    """The first characters and three dots."""
    return F.concat(F.substring(c.cast("string"), 1, length), F.lit("..."))


def normal_text(html: Column) -> Column:
    """clean_html without links that carry utm_ parameters and without numbers of 10 to 13 digits, so that a page that only counts visits stays the same."""
    text = F.regexp_replace(F.regexp_replace(html, DROPPED, " "), "<[^>]+>", " ")
    text = F.regexp_replace(F.regexp_replace(text, UTM_LINKS, ""), LONG_NUMBERS, "")
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def query_score(query: str, text: Column) -> Column:
    """Tokens of the text that are in the query, over the root of their number; 0 for null or empty texts."""
    wanted = sorted({t for t in re.split(SEPARATORS, query.lower()) if t})
    tokens = F.split(F.lower(text), SEPARATORS, -1)
    hits = F.size(F.filter(tokens, lambda t: t.isin(*wanted))) if wanted else F.lit(0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(hits / F.sqrt(F.size(tokens)))


def tokens(text: Column) -> Column:
    """Different lower-case tokens of at least two characters: runs of CJK characters, or letters and digits."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the root of the product of both numbers; 0 if one has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))


def numeric_mentions(query: str, text: Column) -> Column:
    """The share of the query's numbers (with a unit of 万亿千百% behind) that the text has, spaces aside; 0 without numbers."""
    numbers = [n.replace(" ", "") for n in re.findall(r"[0-9]+(?:\.[0-9]+)?\s*[万亿千百%]?", query)]
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))
    return sum((plain.contains(n).cast("int") for n in numbers), F.lit(0)) / max(1, len(numbers))


def chunk_id(*parts: Column, prefix: str = "chunk-") -> Column:
    """The SHA-256 of the parts, which a unit separator joins, behind a prefix: equal parts have equal ids, in any run."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256))


def keyword_class(c: Column, classes: dict[str, list[str]], rest: str) -> Column:
    """The first class that has a keyword in the value."""
    found = F.lit(rest)
    for name, keys in reversed(classes.items()):
        found = F.when(F.lower(c).rlike("|".join(re.escape(k) for k in keys)), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(rest))


def nested(c: Column, path: str) -> Column:
    """The value at a dotted path of a JSON object; where there is none, that of a key spelt like the path."""
    return F.coalesce(F.get_json_object(c, "$." + path), F.get_json_object(c, f"$['{path}']"))

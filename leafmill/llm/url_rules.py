"""URL filters by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, in_order, lower_ascii

#: Between host and path in a key, so that no host is the beginning of another.
CUT = "\x00"

#: The rules of the standard query: host, path, verdict.
OP4_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_hosts(host: Column) -> Column:
    """The host and the domains above it with their labels in reverse: a.b.c gives c, c.b and c.b.a."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))


def rule_bounds(rules: DataFrame) -> DataFrame:
    """The rules (host, path, verdict) as points (key, kind, top) of a sweep over keys.

    A rule covers the keys that begin with its own, from key up to key and a byte that UTF-8 does not
    have. Such intervals nest or are apart, so what a stack of open rules would have on top from a point
    on is known: the rule itself where it opens, and the longest rule around it where it closes. The
    rule around it is found by an equi-join on the prefixes of its key. Of rules with one key, the
    smallest verdict counts.
    """
    key = F.concat(F.array_join(F.reverse(F.split(lower_ascii(F.col("host")), r"\.", -1)), "."), F.lit(CUT), F.col("path"))
    r = rules.select(key.alias("key"), F.concat("host", "path").alias("rule"), "verdict").groupBy("key").agg(F.min(F.struct("verdict", "rule")).alias("v"))
    r = r.select("key", F.struct(F.length("key").alias("len"), F.col("v.rule").alias("rule"), F.col("v.verdict").alias("verdict")).alias("own"))
    lengths = F.sequence(F.lit(0), F.greatest(F.length("key") - 1, F.lit(0)))
    prefixes = r.select("key", F.explode(F.transform(lengths, lambda n: F.substring("key", F.lit(1), n))).alias("prefix")).where("prefix != key")
    outer = prefixes.join(r.select(F.col("key").alias("prefix"), F.col("own").alias("above")), "prefix").groupBy("key").agg(F.max("above").alias("above"))
    r = r.join(outer, "key", "left")
    opens = r.select(F.encode("key", "utf-8").alias("key"), F.lit(1).alias("kind"), F.col("own").alias("top"))
    closes = r.select(F.concat(F.encode("key", "utf-8"), F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), F.col("above").alias("top"))
    return opens.unionByName(closes)


def match_rules(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Judges each row of `pages` (page_id, url) by the longest rule (host, path, verdict) that fits it.

    A rule fits its host and all subdomains if the url's path begins with the rule's. Each url gives one
    key for its host and each domain above it: reversed labels, then the path. Keys and rule bounds are
    sorted together over all partitions, and a sweep carries the innermost open rule forward, also from
    one partition to the next. The longest rule over a url's keys wins; without one the verdict is
    `otherwise`. A null url or one without :// has empty host and path, repeated rows are judged each by
    itself, empty tables of pages or rules work. Other columns of `pages` are kept; host, path, rule and
    verdict are replaced.
    """
    written = Written(pages.sparkSession, "rules")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    urls = pages.select(*kept, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    names = urls.select("host", "path").distinct()
    keys = names.select("host", "path", F.explode(reversed_hosts(F.col("host"))).alias("_h"))
    keys = keys.select(F.encode(F.concat("_h", F.lit(CUT), "path"), "utf-8").alias("key"), F.lit(2).alias("kind"), F.lit(None).cast("struct<len:int,rule:string,verdict:string>").alias("top"), "host", "path")
    bounds = rule_bounds(rules).withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    swept = in_order(keys.unionByName(bounds), [F.col("key"), F.col("kind"), F.xxhash64("host", "path")], written, "swept")

    marked = swept.withColumn("_top", F.when(F.col("kind") < 2, F.struct(F.col("top").alias("t"))))
    ends = marked.groupBy("_part").agg(F.max_by("_top", F.when(F.col("kind") < 2, F.col("_at"))).alias("_end"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.join(F.broadcast(carried), "_part")
    found = found.withColumn("_open", F.coalesce(F.last("_top", ignorenulls=True).over(so_far), "_carried")["t"]).where("kind = 2")
    best = found.groupBy("host", "path").agg(F.max("_open").alias("_best"))
    return urls.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in OP4_RULES])
    rules = spark.range(1).select(F.inline(listed))
    return match_rules(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM u
), r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.n, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY p.n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""

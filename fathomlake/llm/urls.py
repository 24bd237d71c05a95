"""URL filters: host-suffix and path-prefix expressions, joined to the rules on short hash prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host, path, verdict. A rule holds for its host and all subdomains and for every path that begins with its own.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Rules of up to so many bytes (with their digests) are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) == 0, "").otherwise(F.translate(host, string.ascii_uppercase, string.ascii_lowercase))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) == 0, "").otherwise(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", hash_chars: int = 8) -> DataFrame:
    """One row (id, host, path, rule, verdict) for every row of pages; rule is null and verdict the default if no rule fits.

    Hosts are expanded to the suffixes, and paths to the prefixes, of the lengths that rules have; expressions meet rules on
    the first `hash_chars` hex digits of their SHA-256, and the whole digest decides. The longest rule wins, then the one
    with the longer host, then block before allow. Null urls and urls without :// have an empty host and path, which no
    rule fits. Repeated rows keep their number; other columns are left out; an empty table gives an empty result.
    """
    spec = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).na.drop()
    shape = spec.agg(F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("chars"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 200).alias("bytes")).first()
    keyed = spec.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("r_key", F.substring("r_digest", 1, hash_chars))
    keyed = F.broadcast(keyed) if (shape["bytes"] or 0) <= BROADCAST_BYTES else keyed
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).groupBy("__id", "__url").agg(F.count("*").alias("__n"))
    rows = rows.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(k) for k in sorted(shape["labels"])] or [F.lit(0)]), lambda k: (k > 0) & (k <= F.size(labels))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(k) for k in sorted(shape["chars"])] or [F.lit(-1)]), lambda k: (k >= 0) & (k <= F.length("path"))), lambda k: F.substring(F.col("path"), F.lit(1), k))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    asked = rows.withColumn("__e", F.explode_outer(expressions)).withColumn("__digest", digest(F.col("__e.h"), F.col("__e.p"))).withColumn("__key", F.substring("__digest", 1, hash_chars))
    met = asked.join(keyed, F.col("__key") == F.col("r_key"), "left")
    meant = F.col("__digest") == F.col("r_digest")  # the prefix only retrieves
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = met.groupBy("__id", "__url", "host", "path", "__n").agg(F.max(F.when(meant, rank)).alias("__best"))
    out = best.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return out.select(F.col("__id").alias(id_col), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


def judge_sql(rules=RULES, table: str = "pages") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(h, p, v) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest, row_number() OVER () AS n FROM {table}),
s AS (SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u),
m AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC) AS k FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)"""

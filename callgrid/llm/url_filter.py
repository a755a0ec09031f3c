"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests.

Main path: DataFrame functions only. Every URL is expanded into (host suffix, path prefix) expressions, but only for
the label counts and path lengths that occur among the rules, so the expansion is bounded by the rule set and exact
for any rule. Expressions meet the rules on the first 8 hex digits of their SHA-256; the full digest decides.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule, so the default verdict. An
empty rule table gives the default for all. Of equal rules with different actions, block wins; among rules of equal
length the one with the longer host wins. Repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.text import LOWER, UPPER, let, lower_ascii

SHORT = 8
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules (action, host, path) as a table; a long list belongs in a file instead."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, host, path)")


def indexed_rules(rules: DataFrame) -> DataFrame:
    """One row per short prefix with the rules behind it, so that a probe meets at most one row."""
    host = lower_ascii(F.col("host"))
    digest = F.sha2(F.concat(host, F.col("path")), 256)
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
        (F.col("action") == "block").alias("blocks"), F.concat(host, F.col("path")).alias("rule"), "action", digest.alias("digest"),
    )
    whole = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    return whole.select(F.substring(digest, 1, SHORT).alias("__short"), rule.alias("__rule")).groupBy("__short").agg(F.collect_set("__rule").alias("__rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """Columns ``keep``, the URL, host, path, rule and verdict of every row of ``pages``.

    One shuffle, on the kept columns and the URL; partial aggregation folds the expressions of a row in its own task.
    The rules are broadcast only if Spark's own size check allows it; else both sides are shuffled on the prefix.
    """
    whole = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    labels, sizes = (
        sorted(r[0] for r in whole.select(x.alias("n")).distinct().collect())  # small integers: at most the longest rule
        for x in (F.size(F.split("host", "[.]")), F.length("path"))
    )
    host, path = url_parts(F.col("__url"))
    rows = pages.select(*[F.col(k).alias(f"__keep_{i}") for i, k in enumerate(keep)], F.col(url).alias("__url"))
    keys = [f"__keep_{i}" for i in range(len(keep))] + ["__url"]

    def expressions(h: Column, p: Column) -> Column:
        n_labels = F.size(F.split(h, "[.]"))
        hosts = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index(h, ".", -n)) for n in labels]))
        paths = F.array_compact(F.array(*[F.when(F.length(p) >= n, F.substring(p, 1, n)) for n in sizes]))
        return F.flatten(F.transform(hosts, lambda x: F.transform(paths, lambda y: F.sha2(F.concat(x, y), 256))))

    none = F.array().cast("array<string>")
    digests = let(F.struct(host.alias("h"), path.alias("p")), lambda x: F.when(x["h"] != "", expressions(x["h"],
        x["p"])).otherwise(none)) if labels and sizes else none
    probes = rows.select(*keys, F.posexplode_outer(digests).alias("__at", "__digest"))
    probes = probes.withColumn("__short", F.substring("__digest", 1, SHORT))
    met = probes.join(indexed_rules(rules), "__short", "left")
    confirmed = F.filter("__rules", lambda r: r["digest"] == F.col("__digest"))
    best = met.select(*keys, "__at", F.array_max(confirmed).alias("__best"))
    best = best.groupBy(*keys).agg(F.max("__best").alias("__best"), F.count_if(F.coalesce(F.col("__at"), F.lit(0)) == 0).alias("__times"))
    best = best.withColumn("__again", F.explode(F.expr("sequence(1L, __times)")))
    return best.select(
        *[F.col(f"__keep_{i}").alias(k) for i, k in enumerate(keep)], F.col("__url").alias(url), host.alias("host"), path.alias("path"),
        F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.action"), F.lit(default)).alias("verdict"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rule_table(spark), ["page_id"]).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS rid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(action, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}), hits AS (
  SELECT p.*, r.action, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY rid ORDER BY length(r.rhost) + length(r.rpath) DESC NULLS LAST) AS nth
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hits WHERE nth = 1
"""

"""Operator 4: URL rules by a sorted sweep over reversed-host keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict): a rule holds for its host and all subdomains where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rows of a hot top label that meet in one sorted run, and the least number of runs of a label.
RUN_ROWS, LEAST_SALTS = 4_000_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty if there is no ://, or the url is null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty as above."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it: a domain with its subdomains is an interval of keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given as tuples, as a DataFrame made of literals."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url) -> (id, host, path, rule, verdict): the longest fitting rule of (host, path, verdict) rows decides.

    A host and its subdomains are the keys from "net.example." up to "net.example/", so intervals of rules nest or
    are apart. Urls and rule starts are merged into one stream, sorted by key within (last label, salt), and swept once: slot d
    of the stack holds the last rule host of nesting depth d, live while its interval's end lies ahead. Rules are copied to
    the salts of their own last label only; a hot host is spread over all salts by a hash of the row. There are so many salts that
    a run of a label that holds all urls has about RUN_ROWS of them, but no more than keep the copies of rules below the urls. Urls are
    shuffled once, and not joined.

    Rules of one host are one entry of the stack, tried by their paths; among all that fit, the most code points of
    host + path win, then block before allow, then the smaller text. The greatest depth and counts of urls and rule hosts are all that is collected.
    Nulls: a null url has an empty host and path; null parts of a rule are empty, and a rule with an empty host fits
    only an empty host. Repeated rows are judged each, very long urls as others. No rules: every url gets the default. An empty table gives no rows. Extra columns of pages are
    ignored, whatever their names.
    """
    rules = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")]).withColumn("host", F.translate("host", UPPER, LOWER))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "path", "verdict")
    hosts = rules.groupBy("host").agg(F.collect_set(rule).alias("rules")).withColumn("key", host_key(F.col("host")))
    labels = F.split("host", r"\.", -1)
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))).alias("up"))
    depth = above.join(hosts.select(F.col("host").alias("up")), "up").groupBy("host").agg(F.count("*").cast("int").alias("depth"))
    hosts = hosts.join(depth, "host").withColumn("entry", F.struct(F.regexp_replace("key", r"\.$", "/").alias("end"), "rules"))
    deepest, n_hosts = hosts.agg(F.max("depth"), F.count("*")).first()
    deepest = deepest or 0
    if salts is None:
        n = pages.count()  # of a Parquet table from its footers
        salts = max(LEAST_SALTS, min(n // RUN_ROWS, n // max(1, n_hosts)))

    top = F.split_part(F.col("key"), F.lit("."), F.lit(1))
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).select("*", F.lit(1).alias("kind"), F.lit(0).alias("depth"), top.alias("top"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast(hosts.schema["entry"].dataType).alias("entry"))
    starts = hosts.select(F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", F.lit("").alias("path"), "key", F.lit(0).alias("kind"), "depth", top.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "entry")
    swept = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("depth") == d, F.col("entry")), ignorenulls=True).over(swept).alias(f"slot{d}") for d in range(1, deepest + 1)]
    live = [F.when(F.col(f"slot{d}.end") > F.col("key"), F.filter(f"slot{d}.rules", lambda r: F.col("path").startswith(r["path"]))) for d in range(1, deepest + 1)]
    if not live:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    none = F.array().cast(hosts.schema["rules"].dataType)
    best = F.array_max(F.flatten(F.array(*[F.coalesce(x, none) for x in live])))
    out = urls.unionByName(starts).select("*", *stack).where("kind = 1").withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


OP4_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST) = 1
"""

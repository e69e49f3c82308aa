"""URL rules by a sort-merge range join with a stack of nested rules.

A rule (host, path) holds for its host and every subdomain, if the url's path
begins with the rule's. Hosts are turned into canonical keys - labels
reversed, each closed by a dot: ``www.example.com`` is ``com.example.www.`` - so
that a host and its subdomains are one interval of keys, and the intervals of
rules are nested or apart, never overlapping otherwise.

Rules' starts and urls are range-partitioned and sorted by key. The sweep
carries the last rule start that it has passed, with the stack of rules it is
nested in; at a url, the rules of the stack whose interval is still open and
whose path fits are active, and the longest wins (block before allow on a
tie). The stack that is open where a range begins is looked up once for each
range. A host that a third of all rows have is spread over many ranges, since
the range key ends with a hash of the whole row (map columns aside), so the
pages of one much linked url are spread as well.

Cases: a null url or one without ``://`` has an empty host and path and no
rule; rules with null fields are left out; equal rules count once; an empty
table gives an empty result; extra columns of the table stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import column, cut, literal_rows

#: The rules of the url contract (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot; the empty host has the empty key."""
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _key_prefixes(key: Column) -> Column:
    """The keys of a host and of all the hosts it is a subdomain of."""
    labels = F.slice(F.split(key, r"\.", -1), 1, F.greatest(F.size(F.split(key, r"\.", -1)) - 1, F.lit(0)))
    return F.transform(labels, lambda _, i: F.concat(F.array_join(F.slice(labels, F.lit(1), i + 1), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return literal_rows(spark, rules, "action string, host string, path string")


def _stacks(rules: DataFrame) -> DataFrame:
    """start key -> rules of this host and of the hosts it is nested in."""
    clean = (rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), "path").dropna().distinct())
    own = (clean.withColumn("key", host_key(F.col("host")))
           .groupBy("key").agg(F.collect_list(F.struct("key", "path", "action", "host")).alias("own")))
    around = own.select(F.col("key").alias("start"), F.explode(_key_prefixes(F.col("key"))).alias("key"))
    return around.join(own, "key").groupBy("start").agg(F.flatten(F.collect_list("own")).alias("stack"))


def apply_rules(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    Names that ``urls`` has already are replaced. The sorted
    rows (without other columns of a page than the given ones) are checkpointed,
    since the sweep and the look-up must see the same ranges.
    """
    keep = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    kinds = dict(urls.dtypes)
    row = F.struct(*[column(c) for c in keep]).alias("__row")
    hosts = urls.select(row, host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    events = hosts.select("__row", "host", "path", host_key(F.col("host")).alias("key"),
                          F.xxhash64("host", "path", *[F.col("__row").getField(c) for c in keep if "map<" not in kinds[c]]).alias("spread"))
    starts = _stacks(rules)
    opened = starts.select(F.col("start").alias("key"), "stack")
    both = events.unionByName(opened.withColumn("spread", F.lit(-(1 << 63)).cast("long")), allowMissingColumns=True)
    ranged = cut(both.repartitionByRange("key", "spread").withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    outer = (first.select("part", F.explode(_key_prefixes(F.col("first"))).alias("start")).join(starts, "start")
             .groupBy("part").agg(F.max_by("stack", F.length("start")).alias("outer")))  # one row per range at most
    sweep = Window.partitionBy("part").orderBy("key", "spread", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = (ranged.withColumn("passed", F.last("stack", ignorenulls=True).over(sweep)).filter(F.col("host").isNotNull())
             .join(outer, "part", "left"))
    known = F.coalesce(F.col("passed"), F.col("outer"))
    swept = swept.withColumn("open", F.filter(known, lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"])))
    best = F.array_max(F.transform("open", lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("size"), (r["action"] == "block").alias("block"),
        F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action"))))
    swept = swept.withColumn("best", best)
    return swept.select(*[F.col("__row").getField(c).alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.action", F.lit(default)).alias("verdict"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page's url."""
    return (apply_rules(pages.select("page_id", "url"), rules_table(pages.sparkSession))
            .select("page_id", "host", "path", "rule", "verdict"))


#: The same rows in DuckDB: rules tried one by one.
JUDGE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (
  SELECT u.page_id, u.host, u.path, r.action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM j WHERE k = 1
"""

"""URL filters as a sort-merge range join, in DataFrame functions only.

A host's labels are reversed, so a rule (host, path) is the key ``com.example/en/`` (with a separator between its
parts that sorts before all others) and covers the interval of keys that begin with it. A url has the keys of its
host and of each ancestor (``com``, ``com.example``, ...) with its path, since a rule fits its host and all
subdomains. Rules and url keys are sorted together over the whole key space, by ranges: one key of very many urls
goes on in the next range. A sweep carries the stack of nested rules that were open when the last rule began, from
range to range too; the innermost one that still covers a key is that ancestor's rule, and over a url's ancestors the
longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; so has one whose host
is empty; no rule means the default verdict; equal urls are judged once and rows that repeat are all returned; of
rules that repeat the blocking one holds, and of rules of one length the deeper host's; null rules and rules without
a host fit nothing, a rule without an action blocks; an empty table of pages gives an empty result, one of rules the
default for all; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
#: Between host and path of a key; sorts before what can follow a host, so nested keys stand together.
BETWEEN = "\x01"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://(.*)$", "$1"))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, "\\.")), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """rule, action, from texts like ``example.com/en/``."""
    return spark.createDataFrame(rules, "rule string, action string")


def with_stacks(rules: DataFrame) -> DataFrame:
    """key, stack: for each rule, the rules whose intervals hold its own (itself last), outermost first."""
    named = rules.groupBy("rule").agg(F.max(F.coalesce("action", F.lit("block"))).alias("action")).select(
        "rule",
        "action",
        reversed_host(F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)).alias("rev"),
        F.regexp_extract("rule", "(?s)^[^/]*(/.*)$", 1).alias("path"),
    ).where("rev <> ''")
    key = F.concat("rev", F.lit(BETWEEN), "path")
    keyed = named.groupBy(key.alias("key")).agg(F.max(F.struct("action", "rule")).alias("best"), F.first("rev").alias("rev"), F.first("path").alias("path"))
    inner = keyed.select("key", "rev", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("part"))
    outer = keyed.select(F.col("key").alias("outer_key"), "best")
    nested = inner.withColumn("outer_key", F.concat("rev", F.lit(BETWEEN), "part")).join(outer, "outer_key")
    entry = F.struct(F.length("outer_key").alias("n"), "outer_key", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return nested.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.reverse(F.split("host", "\\."))
    # a rule fits ancestors of as many labels as its own host has, so no longer ones are looked up
    most = rules.agg(F.max(F.size(F.split(F.regexp_extract("rule", "^[^/]*", 0), "\\."))).alias("n")).first()["n"] or 1
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    probes = urls.select("host", "path", F.explode(ancestors).alias("rev")).select(F.concat("rev", F.lit(BETWEEN), "path").alias("key"), F.lit(1).alias("kind"), "host", "path")
    starts = with_stacks(rules).select("key", F.lit(0).alias("kind"), "stack")
    events = starts.unionByName(probes, allowMissingColumns=True)
    # Hosts break ties, so one key may reach over several ranges. Written, so that all below see the same ranges.
    sorted_ = events.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "kind", "host")
    placed = materialize(sorted_.withColumn("range", F.spark_partition_id()), "urls")

    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What each range leaves open for the next ones: one row a range.
    ends = placed.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left_open"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("left_open", ignorenulls=True).over(earlier).alias("carried"))
    swept = placed.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(F.broadcast(carried), "range")
    covering = F.filter(F.coalesce("open", "carried"), lambda r: F.startswith("key", r["outer_key"]))
    hit = swept.select("host", "path", "key", F.try_element_at(covering, F.lit(-1)).alias("hit")).where("hit is not null")
    rank = F.struct(F.length("hit.rule").alias("n"), F.length("key").alias("host_n"), F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"))
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = rows.where("host <> ''").join(best, ["host", "path"], "left")
    nowhere = rows.where("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return judged.unionByName(nowhere).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, q, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.action,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.q) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""

"""URL allow and block rules by a sort-merge range join over reversed-host keys; DataFrame operations only.

A host becomes the key of its labels from the right, each ended by U+0001, so that a domain and all its subdomains are the
half-open range from the domain's key to the same key with its last character raised.  Such ranges nest or are disjoint.
Rule boundaries and URLs are ordered together in one range-partitioned sort; a running window hands every URL the stack of
rules that are open at its place, innermost first, and the first whose path begins the URL's path decides.

* Null URLs, and those without ``://``, have empty host and path; no rule with a host fits them.
* Of equal rules the one that blocks wins.  Without a fitting rule the verdict is ``default``.
* A host's path rules travel in its stack, so memory follows the rules above one host, not the rule set; the rule set is
  never broadcast.  URLs on a hot host are spread over ranges by a salt, and each range is handed the stack open at its start.
* A rule without a path covers its hosts whole; without a host or verdict it is no rule.  An empty table of either kind is fine.
* Extra columns pass through, whatever their names; a column named like an output is replaced.  Repeated rows and ties are judged
  alike; very long URLs are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import ascii_lower, cut, session

HOST_PATH = "://([^/?#]*)([^?#]*)"
MAX_SENT = 100_000  # rules in the stacks of all ranges that are broadcast
OPEN, CLOSE = "\x01", "\x02"
OUTPUTS = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST_PATH, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def labels(host: Column) -> Column:
    """Labels from the right; the three lowest characters, which the keys need, become a fourth."""
    return F.reverse(F.split(F.translate(host, "\x00\x01\x02", "\x03\x03\x03"), "\\."))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(OPEN, labels(host)), F.lit(OPEN))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) tuples as a rule table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def boundaries(rules: DataFrame) -> DataFrame:
    """Where the set of open rules changes: key and the stack open from there on, innermost first."""
    rules = rules.filter("host is not null and verdict is not null").withColumn("path", F.coalesce("path", F.lit("")))
    rules = rules.select(
        host_key(ascii_lower("host")).alias("k"),
        F.size(labels(F.col("host"))).alias("depth"),
        F.col("path").alias("path"),
        F.col("verdict").alias("verdict"),
        F.concat(ascii_lower("host"), "path").alias("rule"),
    ).distinct()
    hosts = rules.select("k").distinct()
    above = hosts.select(
        "k",
        F.explode(
            F.expr(
                "transform(sequence(1, size(split(k, '\\u0001')) - 1), "
                "i -> concat(array_join(slice(split(k, '\\u0001'), 1, i), '\\u0001'), '\\u0001'))"
            )
        ).alias("up"),
    )
    entry = F.struct(
        (-F.col("depth")).alias("d"), (-F.length("path")).alias("p"), (F.col("verdict") != "block").alias("a"), "path", "verdict", "rule"
    )
    open_at = above.join(rules.withColumnRenamed("k", "up"), "up")
    starts = open_at.groupBy("k").agg(F.sort_array(F.collect_list(entry)).alias("stack"))
    ends = open_at.groupBy("k").agg(F.sort_array(F.collect_list(F.when(F.col("up") != F.col("k"), entry))).alias("stack"))
    ends = ends.withColumn("k", F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit(CLOSE)))
    return starts.unionByName(ends)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of urls with host, path, rule (null if none fits) and verdict."""
    spark = session(urls)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in urls.columns if c.lower() not in OUTPUTS]
    points = urls.select(
        host_key(url_host(F.col(url))).alias("k"),
        F.lit(1).alias("o"),
        F.xxhash64(*[F.col(c) for c in kept if dict(urls.dtypes)[c][:3] != "map"]).alias("salt"),
        F.struct(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).alias("row"),
    )
    edges = boundaries(rules).select("k", F.lit(0).alias("o"), F.lit(0).cast("long").alias("salt"), "stack")
    events = points.unionByName(edges, allowMissingColumns=True).repartitionByRange(n, "k", "o", "salt")
    events = cut(events.withColumn("part", F.spark_partition_id()))
    # the stack open at the start of each range: the last boundary of the ranges before it; one row for each range
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("part")
        .agg(F.max_by("stack", F.when(F.col("o") == 0, F.col("k"))).alias("tail"))
        .select("part", F.last("tail", ignorenulls=True).over(order).alias("carry"))
    )
    carried = cut(carried, "carried")
    held = carried.agg(F.sum(F.greatest(F.size("carry"), F.lit(0)))).first()[0] or 0
    carried = F.broadcast(carried) if held <= MAX_SENT else carried  # else the sweep's own partitions are joined
    sweep = Window.partitionBy("part").orderBy("k", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("o = 1")
    swept = swept.join(carried, "part")
    fits = F.filter(F.coalesce("stack", "carry"), lambda r: F.startswith(F.col("row.path"), r["path"]))
    hit = F.get(fits, F.lit(0))
    return swept.select("row.*", hit.alias("hit")).select(
        *kept, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )

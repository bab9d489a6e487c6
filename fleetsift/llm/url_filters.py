"""URL rules for hosts with their subdomains and for path prefixes, by a sort-merge range join.

With its host's labels reversed, a rule is a prefix of a key, and the keys under a prefix are one
interval; intervals of rules nest or are apart.  A url is asked once for each of its host's
suffixes: `org|/a`, `org.example|/a`, `org.example.www|/a`.  Keys and the interval ends of rules are
sorted together and swept in order; each end carries the stack of rules that are open from there on,
and a key takes the stack of the last end before it.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import range_of, splitters, written

#: Between host and path in a key; below every character of a host.
BAR = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for other texts."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def open_rules(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Adds to points (…, key binary) the `stack` of rules whose keys theirs starts with, outermost first.

    A stack holds (depth, length, rule, verdict), at most one entry for each byte of the key.
    """
    prefixes = points.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("key")))).withColumn("prefix", F.expr("substring(key, 1, n)"))
    entry = F.struct(F.length("prefix").alias("depth"), "length", "rule", "verdict")
    found = prefixes.join(rules.select(F.col("key").alias("prefix"), "length", "rule", "verdict"), "prefix")
    stacks = found.groupBy(*points.columns).agg(F.sort_array(F.collect_list(entry)).alias("stack"))
    return stacks


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
               ranges: int = 64, salts: int = 8) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of `pages`.

    `rules` has rule (its name), host, path and verdict.  A rule fits its host and all subdomains
    if the url's path starts with the rule's; the longest (host and path together) wins, of equal
    ones `block` and then the smaller name.  Without a rule `rule` is null and the verdict is
    `default`.  Null urls and those without `://` have an empty host and path, which only a rule
    with empty host and path fits.  Rules with a null field never apply; null ids and repeated rows
    are judged as any other; other columns are ignored; an empty table gives no rows.
    """
    ready = rules.where("rule is not null and host is not null and path is not null and verdict is not null").select(
        "rule", "verdict", (F.length("host") + F.length("path")).alias("length"),
        F.concat(reversed_host(F.translate("host", UPPER, LOWER)), F.lit(BAR), "path").cast("binary").alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col("verdict") != "block", "rule"))
    ready = written(ready.withColumn("first", first).where("first = 1").drop("first"), "rules")

    rows = written(pages.select(F.col(id_col).cast("bigint").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
                   .groupBy("page_id", "host", "path").agg(F.count("*").alias("times")), "urls")
    probes = rows.withColumn("labels", F.reverse(F.split("host", r"\."))).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels")))).select(
        "page_id", "host", "path", "times", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."), F.lit(BAR), "path").cast("binary").alias("key"))
    boundaries = splitters(probes.select("key", F.lit(1).alias("size")), "key", "size", ranges)

    # Interval ends: a rule opens at its key and closes after every key that starts with it.
    opened = open_rules(ready, ready.select("key"))
    closed = opened.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    events = opened.union(closed).select(range_of("key", boundaries).alias("range"), "key", F.lit(1).alias("kind"), "stack")
    # Each range begins with the stack at its boundary.
    bounds = pages.sparkSession.createDataFrame([(k + 1, b) for k, b in enumerate(boundaries)], "range int, key binary")
    carried = open_rules(ready, bounds).select("range", "key", F.lit(0).alias("kind"), "stack")
    nobody = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", "bigint"), ("host", "string"), ("path", "string"), ("times", "bigint"))]
    ends = events.union(carried).select("range", F.explode(F.array(*[F.lit(k) for k in range(salts)])).alias("salt"), "key", "kind", "stack", *nobody)
    # A key that very many urls share stays in one range; salts part it, each with the range's ends.
    asked = probes.select(range_of("key", boundaries).alias("range"), F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int").alias("salt"),
                          "key", F.lit(2).alias("kind"), F.lit(None).cast(ends.schema["stack"].dataType).alias("stack"), "page_id", "host", "path", "times")
    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.union(asked).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
    best = swept.withColumn("top", top).groupBy("page_id", "host", "path", "times").agg(
        F.min(F.when(F.col("top").isNotNull(), F.struct((-F.col("top.length")).alias("length"), (F.col("top.verdict") != "block").alias("allows"),
                                                        F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                       F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")).drop("one")

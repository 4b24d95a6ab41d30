"""URL filters as a sort-merge range join.

A rule (host, path prefix) covers the keys of one interval: its host with the
labels reversed, then the path, as bytes; the interval ends at the same key
followed by 0xFF, a byte that no UTF-8 text has. A rule also holds for
subdomains, whose keys lie elsewhere as soon as a path follows the host; so a URL
has a key for each number of labels that any rule's host has. Rule events and the
keys of all different URLs are sorted together by range; one sweep over the sorted
rows keeps the stack of rules that are open at the current key. Sorting splits a
hot host, or a path that many hosts share, over many partitions. A partition's
sweep begins with the stack that is open at its first key, found by the rules that
are prefixes of that key: no partition waits for another, and none sees more than
its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, pieces_for

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ROWS_PER_PARTITION = 200_000
SALTS = 1024


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def label_count(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _around(keys: DataFrame, rules: DataFrame, lengths: list[int]) -> DataFrame:
    """keys (rhost, path, ...) with each rule of their host whose path is a prefix of theirs, as at, outer_verdict.

    Joined by prefix, at those lengths alone that some rule has.
    """
    outer = rules.select("rhost", F.col("path").alias("at"), F.col("verdict").alias("outer_verdict"))
    own = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    cut = keys.select("*", F.explode(own).alias("n")).select("*", F.expr("substring(path, 1, n)").alias("at")).drop("n")
    return cut.join(outer, ["rhost", "at"])


def _stack() -> Column:
    entry = F.struct(F.length("at").alias("n"), F.col("at").alias("path"), F.col("outer_verdict").alias("verdict"))
    return F.array_sort(F.collect_list(entry)).alias("stack")


def rule_events(rules: DataFrame, lengths: list[int]) -> DataFrame:
    """Two rows a rule: (rhost, key, stack) where it opens and where it closes; ``stack`` holds the rules open from that key on, the innermost last."""
    stacks = _around(rules.select("rhost", "path"), rules, lengths).groupBy("rhost", "path").agg(_stack())
    opened = stacks.select("rhost", F.encode("path", "utf-8").alias("key"), "stack")
    closed = stacks.select("rhost", F.concat(F.encode("path", "utf-8"), F.lit(b"\xff")).alias("key"), F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    return opened.unionByName(closed)


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those different (host, path) pairs that a rule fits."""
    spark = urls.sparkSession
    # of two rules with one host and path, block wins
    rules = rules.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    rules = checkpoint(rules.where("host is not null and path is not null").withColumn("rhost", reversed_host(F.col("host"))))
    # no more numbers than the longest rule has characters
    known = rules.agg(F.collect_set(label_count(F.col("host"))), F.collect_set(F.length("path"))).head()
    levels, lengths = sorted(known[0]), sorted(known[1])
    labels = F.split("host", r"\.")
    own = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda i: i <= F.size(labels))
    parent = F.array_join(F.reverse(F.slice(labels, F.size(labels) - F.col("level") + 1, F.col("level"))), ".")
    keys = urls.select("*", F.explode(own).alias("level")).select(parent.alias("rhost"), F.encode("path", "utf-8").alias("key"), F.lit(1).alias("kind"), "host", "path")
    events = rule_events(rules, lengths)
    kind = events.schema["stack"].dataType
    rows = keys.withColumn("stack", F.lit(None).cast(kind)).unionByName(events.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    n = pieces_for(max(1, len(levels)) * urls.count(), ROWS_PER_PARTITION, spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)))
    order = ("rhost", "key", "kind")
    # a checkpoint fixes which rows a partition has, whatever is rerun later
    ranged = checkpoint(rows.repartitionByRange(n, *order, "salt").drop("salt").select("*", F.spark_partition_id().alias("part")))
    first = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("first")).select("part", "first.*").where("kind = 1")
    start = _around(first.select("part", "rhost", "key", F.decode("key", "utf-8").alias("path")), rules, lengths).groupBy("part", "rhost", "key").agg(_stack())
    swept = ranged.unionByName(start.withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("stack").isNotNull(), F.struct("rhost", "stack"))
    state = F.col("open")
    swept = swept.select("*", F.last(mark, True).over(sweep).alias("open")).where("kind = 1")
    top = F.element_at(state["stack"], -1)
    size = F.length("rhost") + F.col("top")["n"]
    best = F.max(F.struct(size.alias("n"), F.length("rhost").alias("h"), "rhost", "top")).alias("best")
    found = swept.where((state["rhost"] == F.col("rhost")) & (F.size(state["stack"]) > 0)).select("host", "path", "rhost", top.alias("top")).groupBy("host", "path").agg(best)
    rule = F.concat(reversed_host(F.col("best.rhost")), F.col("best.top.path"))
    return found.select("host", "path", rule.alias("rule"), F.col("best.top.verdict").alias("verdict"))


def url_filters(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (verdict, host, path) rows; one with a null host or path fits nothing.
    A rule fits its host and every subdomain where the URL's path starts with the
    rule's; the longest host + path wins, a tie goes to the longer host. Without a
    rule the verdict is ``default``. A null URL, or one without ://, has an empty
    host and path and fits no rule. A very long URL is judged whole. Repeated rows
    get equal verdicts; equal URLs are judged once. An empty table of pages has no
    rows, an empty one of rules fits nothing. Columns named like an output are
    replaced; other extra columns stay, ``url`` too unless it has such a name.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    own_host, own_path = fresh(pages, "__u_host"), fresh(pages, "__u_path")
    base = pages.withColumns({own_host: host_of(F.col(url)), own_path: path_of(F.col(url))}).drop("host", "path", "rule", "verdict")
    urls = checkpoint(base.where(F.col(own_host) != "").select(F.col(own_host).alias("host"), F.col(own_path).alias("path")).distinct())
    # from a checkpoint, so that a URL that very many rows have can be split in the join
    found = checkpoint(judged(urls, rules).withColumnsRenamed({"host": own_host, "path": own_path}))
    out = base.join(found, [own_host, own_path], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    kept = [c for c in base.columns if c not in (own_host, own_path)]
    return out.select(*kept, F.col(own_host).alias("host"), F.col(own_path).alias("path"), "rule", "verdict")

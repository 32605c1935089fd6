"""URL filters: a sort-merge range join of urls and (host, path) rules.

A rule fits its host and all subdomains if the url's path starts with the rule's. The canonical key of a rule is its host with
the labels reversed, a zero character and its path: the urls of that very host which it fits are the interval of keys
that start with the rule's. A url on ``a.b.c`` has one key per ancestor host (``c``, ``c.b``, ``c.b.a``), so subdomains
fall into the interval too; ancestors without any rule are left out first. Rules and keys are sorted together by range
partitions, and each partition is swept in order with a stack of the active rules: a rule is pushed on top of those that hold it,
and popped when a key lies beyond its interval, so the top is the longest path for a key. What is on the stack at the
start of a partition are the rules whose keys are prefixes of the first key; they are looked up by equality beforehand, a few per
partition. Of a url's ancestors the longest rule (host and path together) wins, then the longer host, then ``block``.

Only distinct (host, path) pairs are swept, so copies of a url cost nothing; keys of one hot host spread over partitions by their
paths. Nothing but the stacks' starts (partitions times nesting depth) passes through the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits (a rule with an empty host
fits an empty host); without a rule a url has rule null and the default verdict; an empty rule table gives that to all; copies of
a rule count once; a null host or path of a rule is empty; repeated pages are returned each.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.tables import small
from sparkrules.storage import checkpointed, stored

DEFAULT = "allow"
END = "\x00"  # between host and path; sorts before every other character
SWEPT = "rank long, host string, path string, rule string, verdict string"


def _lower(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def canonical(rules: DataFrame) -> DataFrame:
    """One row per rule: ``key, rule, size, host_size, verdict``. ``block`` wins over ``allow`` for one key."""
    host, path = _lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    df = rules.select(host.alias("host"), path.alias("path"), "verdict")
    df = df.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return df.select(
        F.concat(_reversed(F.col("host")), F.lit(END), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        _reversed(F.col("host")).alias("level"),
        F.length("host").alias("host_size"),
        "verdict",
    )


def _keys(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` per url and ancestor host that has a rule."""
    labels = F.reverse(F.split("host", r"\."))
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    df = urls.select("host", "path", F.explode(levels).alias("level"))
    some = small(rules.select("level").distinct())
    return df.join(some, "level", "left_semi").withColumn("key", F.concat("level", F.lit(END), "path"))


def _sweep(starts: dict[int, list[tuple]]):
    """The sweep of the partitions, each from its starting stack of ``(key, rule, host_size, verdict)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] | None = None
        kind = pa.schema([("rank", pa.int64())] + [(n, pa.string()) for n in ("host", "path", "rule", "verdict")])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if stack is None:
                    stack = list(starts.get(row["part"], []))
                while stack and not row["key"].startswith(stack[-1][0]):
                    stack.pop()
                if row["rule"] is not None:
                    stack.append((row["key"], row["rule"], row["host_size"], row["verdict"]))
                elif stack:
                    _, rule, host_size, verdict = stack[-1]
                    out.append({"rank": len(rule) << 20 | host_size, "host": row["host"], "path": row["path"], "rule": rule, "verdict": verdict})
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` for the distinct ``(host, path)`` of ``urls`` that some rule fits."""
    rules = stored(canonical(rules))
    keys = _keys(urls.select("host", "path").distinct(), rules)
    both = keys.selectExpr("key", "host", "path", "cast(null as string) as rule", "cast(null as int) as host_size", "cast(null as string) as verdict")
    both = both.unionByName(rules.selectExpr("key", "cast(null as string) as host", "cast(null as string) as path", "rule", "host_size", "verdict"))
    # a rule sorts before the equal key of a url; the host only spreads equal keys over partitions
    order = ["key", F.col("rule").isNull(), "host"]
    ranged = checkpointed(both.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    longest = rules.agg(F.max(F.length("key"))).first()[0] or 0
    first = ranged.groupBy("part").agg(F.min("key").alias("first"))
    sizes = F.sequence(F.lit(0), F.least(F.length("first"), F.lit(longest)))
    prefixes = first.select("part", F.explode(F.transform(sizes, lambda n: F.substring("first", F.lit(1), n))).alias("key"))
    starts: dict[int, list[tuple]] = {}
    for row in sorted(prefixes.join(rules, "key").collect(), key=lambda r: len(r["key"])):
        starts.setdefault(row["part"], []).append((row["key"], row["rule"], row["host_size"], row["verdict"]))
    swept = ranged.mapInArrow(_sweep(starts), SWEPT)
    best = swept.groupBy("host", "path").agg(F.max(F.struct("rank", "verdict", "rule")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Every page's ``page_id`` with ``host, path, rule, verdict``."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    best = best_rules(urls, rules)
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

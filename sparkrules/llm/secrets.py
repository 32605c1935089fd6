"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its bytes; a path (here a ``doc_id``) is one place that holds it, now or in an earlier version. The
ledger is a table in the shared folder with one row per scan of a blob: the rules it was scanned with, each as ``name@version``, and
their findings. A scan

1. names the blobs of all paths and takes one path per blob,
2. looks the blobs up in the ledger and keeps those with unseen (blob, rule version) pairs,
3. reads the texts of these only, scans each with its unseen rules only, and appends the result to the ledger,
4. joins the findings of the current rule versions back to every path.

Copies are scanned once however many paths hold them; the hot blob of step 4 is one key of an ordinary join whose skew AQE
splits, and no text is grouped. Appended files are whole or absent, so a scan that was broken off repeats only its own blobs; should two
scans append the same pair, equal findings collapse on reading.

Defined cases: a null text is an empty blob; a null path is a path; repeated rows are returned each; an empty table gives no rows and
appends none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrules.llm.tables import body
from sparkrules.storage import scratch_path, stored

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; ``order`` breaks ties of the start."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    # a run of such signs is a match or none of its parts is, so the least length can stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


def scan_text(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then rule as listed; leftmost matches of a rule do not overlap."""
    found = []
    for order, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.any_case else 0)):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.name))
    return [(name, a, b) for a, _, b, name in sorted(found)]


def named(paths: DataFrame, path: str = "doc_id") -> DataFrame:
    """``path, blob``."""
    return paths.select(F.col(path).alias("path"), F.sha2(body(), 256).alias("blob"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger)


def start_ledger(spark: SparkSession) -> str:
    """A new, empty ledger in the shared folder."""
    path = scratch_path(spark)
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def unseen(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule], path: str = "doc_id") -> DataFrame:
    """``blob, path, pending``: a blob with rules that it was not scanned with, and one path that holds it."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = named(paths, path).groupBy("blob").agg(F.min("path").alias("path"))
    done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    pending = F.array_except(wanted, F.coalesce("done", F.expr("cast(array() as array<string>)")))
    return blobs.join(done, "blob", "left").select("blob", "path", pending.alias("pending")).filter(F.size("pending") > 0)


def update(paths: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "doc_id") -> DataFrame:
    """Scan the unseen pairs and append them to the ledger. Returns the blobs that were scanned, with their ``pending`` rules."""
    spark = paths.sparkSession
    todo = stored(unseen(paths, read_ledger(spark, ledger), rules, path))
    texts = paths.select(F.col(path).alias("path"), F.sha2(body(), 256).alias("blob"), body().alias("text"))
    # no broadcast by hand: AQE sends a small rest of unseen blobs to the texts, and a first scan is a plain shuffle
    picked = texts.join(todo, (texts["blob"] == todo["blob"]) & texts["path"].eqNullSafe(todo["path"])).select(texts["blob"], "pending", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for pending, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                spans = scan_text(text.as_py(), [r for r in rules if r.key in pending])
                found.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["blob", "rules", "findings"])

    picked.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)
    return todo.select("blob", "pending")


def findings(paths: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "doc_id") -> DataFrame:
    """Every path with its ``blob`` and the findings of the given rule versions."""
    wanted = [r.key for r in rules]
    names = F.array(*[F.lit(r.name) for r in rules])
    rows = read_ledger(paths.sparkSession, ledger)
    # a rule's findings count only from a scan with the wanted version; F.filter keeps them in the row
    current = F.transform(F.filter("rules", lambda r: r.isin(wanted)), lambda r: F.substring_index(r, "@", 1))
    rows = rows.select("blob", F.filter("findings", lambda x: F.array_contains(current, x["kind"])).alias("f")).filter(F.size("f") > 0)
    once = rows.select("blob", F.explode("f").alias("x")).distinct()
    ranked = F.struct(F.col("x.start").alias("start"), F.array_position(names, F.col("x.kind")).alias("rank"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind"))
    per_blob = once.groupBy("blob").agg(F.sort_array(F.collect_list(ranked)).alias("f"))
    found = F.transform("f", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    per_blob = per_blob.select("blob", found.alias("findings"))
    out = named(paths, path).join(per_blob, "blob", "left")
    return out.select("path", "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


def scan(paths: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "doc_id") -> DataFrame:
    """Bring the ledger up to date with ``paths`` and return their findings."""
    update(paths, ledger, rules, path)
    return findings(paths, ledger, rules, path)

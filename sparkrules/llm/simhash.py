"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of three words (fewer words: the whole
sequence). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42). Two
fingerprints link when at most ``RADIUS`` = 2 of 64 bits differ.

Copies collapse first: what follows works on distinct fingerprints. Each is indexed under both of its 32-bit segments. Of two
linked fingerprints, one segment differs in at most one bit, so a probe with the segment and with the segment one bit changed finds
the other in that segment's table; complete distances are then verified. To find a pair once, only 0 bits
are flipped. A table entry shared by more than ``bucket`` fingerprints is not probed, since candidates would grow
with its square. Its members are *crowded*: they also probe with 1 bits cleared, which reaches members of small
entries, and links among crowded ones are found by hiding every choice of two bits: fingerprints that agree on the other 62
are linked to the least of them, and there are at most four. That is 2016 rows per crowded fingerprint, however large the
crowd. Both ways are exact; ``bucket`` only decides which one is cheaper.

Defined cases: null and empty texts have fingerprint zero and link like any other; null ids get a component like other
rows but never name it unless the whole component has none; repeated rows are returned each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.components import components
from sparkrules.llm.tables import body, packed, pieces, same, small, with_fields
from sparkrules.storage import stored

SHINGLE, SEED, RADIUS = 3, 42, 2
BUCKET = 512
BLOCK = 1 << 15  # shingles whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in pieces(batches):
        prints = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows, pa.array(prints, pa.int64())], ["_row", "fp"])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and ``fp``, the fingerprint as a signed long."""
    df = docs.select(packed(carry), body().alias("_text"))
    return df.mapInArrow(_fingerprints, with_fields(df, "fp bigint")).select("_row.*", "fp")


#: A segment and its neighbours at one bit: those with a 0 bit set, or those with a 1 bit cleared.
FLIPS = "concat(array(seg), transform(filter(sequence(0, 31), i -> getbit(seg, i) = {old}), i -> seg ^ shiftleft(1L, i)))"


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that join every two of the distinct ``fp`` within ``RADIUS``, directly or, in a crowd, over a third one."""
    parts = "inline(array(named_struct('side', 0, 'seg', shiftrightunsigned(fp, 32)), named_struct('side', 1, 'seg', fp & 4294967295L)))"
    index = stored(prints.selectExpr("fp", parts))
    on = ["side", "seg"]
    crowds = stored(index.groupBy(on).count().filter(F.col("count") > bucket).select(on))

    def probed(rows: DataFrame, table: DataFrame, old: int) -> DataFrame:
        probes = rows.selectExpr("fp as a", "side", f"posexplode({FLIPS.format(old=old)}) as (flip, seg)")
        found = probes.join(table.withColumnRenamed("fp", "b"), on).filter(F.bit_count(F.expr("a ^ b")) <= RADIUS)
        return found.filter("flip > 0 or a < b").selectExpr("least(a, b) as a", "greatest(a, b) as b")

    if crowds.isEmpty():
        return probed(index, index, 0).distinct()
    table = index.join(crowds, on, "left_anti")
    crowded = stored(index.join(crowds, on, "left_semi").select("fp").distinct())
    back = probed(index.join(crowded, "fp", "left_semi"), table, 1)
    return probed(index, table, 0).union(back).union(_hidden(crowded)).distinct()


def _hidden(crowded: DataFrame) -> DataFrame:
    """Links among fingerprints that agree on all but two bits, to the least of them. There are four at most."""
    first = crowded.selectExpr("fp", "explode(sequence(1, 63)) as i")
    both = first.selectExpr("fp", "i", "explode(sequence(0, i - 1)) as j")
    keyed = both.selectExpr("fp", "i", "j", "fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest")
    groups = keyed.groupBy("i", "j", "rest").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return groups.select(F.col("b").alias("a"), F.explode("all").alias("b")).filter("a <> b")


def components_of(docs: DataFrame, carry: tuple[str, ...], bucket: int = BUCKET) -> DataFrame:
    """Every document's ``carry`` columns, ``fp``, ``root`` (a fingerprint) and ``component_id``."""
    prints = stored(fingerprints(docs, *carry))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), bucket)).withColumnRenamed("node", "fp")
    named = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every document with ``fp`` and ``component_id``, the smallest ``doc_id`` that it reaches over links."""
    return components_of(docs, ("doc_id",), bucket).select("doc_id", "fp", "component_id")


def clean(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One document of each component, with its columns: that of the smallest ``doc_id`` (null last), then of the least text digest.

    Rows that are equal in id and text are copies, so one of them stays.
    """
    slim = docs.select("doc_id", F.md5(body()).alias("digest"), "text")
    return first_of(docs, components_of(slim, ("doc_id", "digest"), bucket))


def first_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The first document of each ``root`` of ``named(doc_id, digest, root)``, by ``doc_id`` (null last) and digest, with its columns."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.md5(body()).alias("digest"))
    counts = named.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "copies")).alias("k")
    keep = stored(counts.groupBy("root").agg(first).select("k.doc_id", "k.digest", "k.copies"))
    side = small(keep)
    kept = rows.join(side, same(rows, side, "doc_id", "digest")).select("row", rows["doc_id"], rows["digest"], "copies")
    if keep.filter("copies > 1").isEmpty():
        return kept.select("row.*")
    repeats = kept.filter("copies > 1").dropDuplicates(["doc_id", "digest"])
    return kept.filter("copies = 1").union(repeats).select("row.*")

"""Prefix tries of rebuilt conversations by composable monoid fingerprints.

A rebuilt conversation is a head of a base conversation followed by the rest of its own turns. The fingerprint of a sequence of turns is
``(n, sum of t_i * B^i mod p)``, one sum per prime of ``PRIMES``; two of them compose as ``(n, x) * (m, y) = (n + m, x + B^n * y)``. A scan over range
partitions, which carries the products of earlier partitions forward, gives these products for all prefixes of all original
conversations. The prefixes of a rebuilt conversation follow symbolically: those of the head are the base's, those of the rest are
``x_base(k) + B^(k - head) * (x_own(i) - x_own(head))``. No rebuilt text or list of turns is ever made; a prefix is one slim row with a reference to
its last turn.

Equal (depth, fingerprint) make a node. Equality is verified: the members of a node must agree in the SHA-256 digest of the turn they refer to and
in the fingerprint of the prefix before it, which by induction makes all their turns equal. A collision starts anew with other bases.

Figures of subtrees need no walk along the tree. A node belongs to the chain of its smallest member; every other member's own chain hangs below the
node. So a sum over a subtree is the sum of the members' chain totals less the part of the node's own chain above it, a running sum.

Order and defined cases: turns go by ``turn``, null first, ties by the digest of role and text; a null role or text is empty. Rows without a
conversation id belong to no conversation. Repeated rows are turns of their own. A missing base gives no head, a head longer than its base all of
it; a conversation may be rebuilt without turns and is a member of the root alone. An empty table has no nodes. Other columns are
not read. Conversations, nodes and members of a node may each hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from sparkrules.storage import stored

PRIMES = (2147483647, 2147483629, 2147483587)
IDS = 4096  # joined ids per block of a node's ends
NODE = ("depth", "k0", "k1")
ROOT = (0, 0, 0)


def _bases(attempt: int) -> tuple[int, ...]:
    return tuple(2 + int(hashlib.md5(f"{p}:{attempt}".encode()).hexdigest(), 16) % (p - 2) for p in PRIMES)


def _power(base: int, p: int, exponent: Column) -> Column:
    """``base ** exponent % p`` for exponents below 2^31, by the bits of the exponent."""
    out = F.lit(1).cast("long")
    for bit in range(31):
        factor = pow(base, 1 << bit, p)
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(factor)).otherwise(F.lit(1)) % F.lit(p)
    return out


# --- scan -------------------------------------------------------------------------------------------


class _Scan:
    """One partition's running products, key by key, over sorted batches."""

    def __init__(self, sums: list[tuple[int, int]]):
        self.sums, self.key, self.count, self.totals = sums, None, 0, [0] * len(sums)

    def step(self, keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Positions from 1, and every sum with and without the row itself."""
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(keys)])))
        place = np.arange(len(keys)) - np.repeat(starts, lengths)
        head = int(lengths[0]) if keys[0] == self.key else 0  # rows that go on with the key before
        longest, upto, before = int(lengths.max()), [], []
        for (base, p), total, value in zip(self.sums, self.totals, values):
            if p:
                powers = np.ones(longest, np.int64)
                for width in (1 << b for b in range(longest.bit_length())):
                    powers[width : 2 * width] = powers[:width][: max(longest - width, 0)] * pow(base, width, p) % p
                value = value * powers[place] % p
            running = np.cumsum(value)
            running -= np.repeat(running[starts] - value[starts], lengths)
            earlier = running - value
            if p:
                running, earlier = running % p, earlier % p
            if head:
                factor = pow(base, self.count, p) if p else 1
                for x in (running, earlier):
                    x[:head] = total + x[:head] * factor
                    if p:
                        x[:head] %= p
            upto.append(running)
            before.append(earlier)
        place[:head] += self.count
        self.key, self.count, self.totals = keys[-1], int(place[-1]) + 1, [int(x[-1]) for x in upto]
        return place + 1, upto, before


def prefix_products(df: DataFrame, key: str, order: list[Column], sums: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The rows with ``pos`` (from 1) within ``key`` and, for every column of ``sums``, its running product ``<name>`` with this row
    and ``<name>_before`` without it; ``last`` marks the last row of a key.

    ``sums`` gives ``(base, modulus)``; modulus 0 makes a plain sum. Keys are not null. A key of any size is spread over the range partitions:
    each is scanned alone, and the products of at most two keys per partition, its first and its last, are carried on.
    """
    names = list(sums)
    others = [c for c in df.columns if c not in (key, *names)]
    packed = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    packed = packed.select(F.col(key).alias("_key"), F.struct(*others).alias("_row") if others else F.struct(F.lit(0)).alias("_row"), *[F.col(n).cast("long") for n in names])
    fields = st.StructType.fromDDL(", ".join(["pid int, pos long, last boolean, edge boolean", *[f"`{n}` long, `{n}_before` long" for n in names]]))
    schema = st.StructType([packed.schema["_key"], packed.schema["_row"], *fields.fields])
    spec = list(sums.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, scan, first = TaskContext.get().partitionId(), _Scan(spec), None

        def scanned(batch: pa.RecordBatch, following) -> pa.RecordBatch:
            nonlocal first
            keys = batch.column(0).to_numpy()
            first = keys[0] if first is None else first
            values = [batch.column(i).to_numpy() for i in range(2, batch.num_columns)]
            pos, upto, before = scan.step(keys, values)
            last = np.concatenate((keys[1:] != keys[:-1], [following is None or following != keys[-1]]))
            edge = last & ((keys == first) | (following is None) & (keys == keys[-1]))
            pairs = [pa.array(x) for both in zip(upto, before) for x in both]
            columns = [batch.column(0), batch.column(1), pa.array(np.full(len(keys), pid, np.int32)), pa.array(pos), pa.array(last), pa.array(edge), *pairs]
            return pa.RecordBatch.from_arrays(columns, ["_key", "_row", *fields.names])

        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield scanned(held, batch.column(0)[0].as_py())
                held = batch
        if held is not None:
            yield scanned(held, None)

    local = stored(packed.mapInArrow(run, schema))
    parts = Window.partitionBy("_key").orderBy("pid")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    carry = local.filter("edge").select("_key", "pid", F.col("pos").alias("n"), *names)
    carry = carry.withColumn("_skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("_more", F.lead("pid").over(parts).isNotNull())
    for name, (base, p) in sums.items():
        carry = carry.withColumn(f"_w_{name}", _power(base, p, F.col("_skip")) if p else F.lit(1).cast("long"))
        weighted = F.col(f"_w_{name}") * F.col(name)
        total = F.coalesce(F.sum(weighted % p if p else weighted).over(earlier), F.lit(0))
        carry = carry.withColumn(f"_c_{name}", total % p if p else total)
    carry = carry.filter("_skip > 0 or _more").drop("n", *names)
    # at most two rows per partition of the scan
    out = local.join(F.broadcast(carry), ["_key", "pid"], "left")
    fits = F.col("_skip").isNotNull()
    columns = [F.col("_key").alias(key), *[F.col(f"_row.{c}").alias(c) for c in others], (F.col("pos") + F.coalesce("_skip", F.lit(0))).alias("pos")]
    for name, (_, p) in sums.items():
        for c in (name, f"{name}_before"):
            moved = F.col(f"_c_{name}") + F.col(f"_w_{name}") * F.col(c)
            columns.append(F.when(fits, moved % p if p else moved).otherwise(F.col(c)).alias(c))
    return out.select(*columns, (F.col("last") & ~F.coalesce("_more", F.lit(False))).alias("last"))


# --- fingerprints -----------------------------------------------------------------------------------


def turns(conversations: DataFrame, attempt: int = 0) -> DataFrame:
    """``conv_id, turn, d0, d1, n_bytes, pos, f0.., f0_before.., last``: every original turn with the products up to it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("_d"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    parts = [F.conv(F.substring("_d", at, 15), 16, 10).cast("long").alias(n) for at, n in ((1, "d0"), (16, "d1"))]
    slim = slim.select("conv_id", "turn", "n_bytes", *parts)
    values = [F.pmod(F.xxhash64("d0", "d1", F.lit(attempt), F.lit(i)), F.lit(p)).alias(f"f{i}") for i, p in enumerate(PRIMES)]
    order = [F.col("turn").asc_nulls_first(), F.col("d0"), F.col("d1")]
    sums = {f"f{i}": (b, p) for i, (b, p) in enumerate(zip(_bases(attempt), PRIMES))}
    return prefix_products(slim.select("*", *values), "conv_id", order, sums)


def _packed(values: list[Column], names: tuple[str, str]) -> list[Column]:
    """The sums of a fingerprint in two numbers."""
    return [(values[0] + values[1] * F.lit(1 << 31)).alias(names[0]), values[2].alias(names[1])]


def prefixes(turns: DataFrame, base: Column, head: Column, attempt: int = 0) -> DataFrame:
    """One row per rebuilt conversation and depth: ``conv_id, depth, k0, k1`` (the node), ``p0, p1`` (the fingerprint before its last turn), the
    reference ``turn_conv, turn_pos`` to that turn with its digest ``d0, d1`` and ``n_bytes``, and whether the conversation has ``ended`` there.

    ``base`` and ``head`` are expressions of ``conv_id``.
    """
    bases, at = _bases(attempt), [f"f{i}" for i in range(len(PRIMES))]
    before = [f"{f}_before" for f in at]
    plan = turns.filter("last").select("conv_id", base.cast("long").alias("base"), head.cast("long").alias("head"), F.col("pos").alias("own"))
    source = turns.select(F.col("conv_id").alias("base"), "pos", F.col("last").alias("all"), "d0", "d1", "n_bytes", *at, *before)
    joined = plan.join(source.withColumnRenamed("base", "_base"), (F.col("base") == F.col("_base")) & (F.col("pos") <= F.col("head")), "left")
    top = F.col("all") | (F.col("pos") == F.col("head"))  # the head ends with this row
    heads = joined.filter("pos is not null").select(
        "conv_id", F.col("pos").alias("depth"), *_packed([F.col(f) for f in at], ("k0", "k1")), *_packed([F.col(f) for f in before], ("p0", "p1")),
        F.col("base").alias("turn_conv"), F.col("pos").alias("turn_pos"), "d0", "d1", "n_bytes", (top & (F.col("own") <= F.col("head"))).alias("ended"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    # the left join leaves one row for a conversation without a head; others show their first row
    roots = joined.filter("pos is null or pos = 1").select(
        "conv_id", zero.alias("depth"), zero.alias("k0"), zero.alias("k1"), zero.alias("p0"), zero.alias("p1"),
        none.alias("turn_conv"), none.alias("turn_pos"), zero.alias("d0"), zero.alias("d1"), zero.alias("n_bytes"),
        (F.col("pos").isNull() & (F.col("own") <= F.col("head"))).alias("ended"),
    )

    tops = joined.filter(top & F.col("pos").isNotNull()).select("conv_id", F.col("pos").alias("_k"), *[F.col(f).alias(f"_b_{f}") for f in at])
    own = turns.withColumn("_head", head.cast("long"))
    first = own.filter("pos = _head + 1").select("conv_id", "_head", *[F.col(b).alias(f"_o_{f}") for b, f in zip(before, at)])
    found = first.join(tops, "conv_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0).cast("long")))
    shift, parts = F.col("_head") - F.col("_k"), []
    for f, b, p in zip(at, bases, PRIMES):
        parts.append(_power(pow(b, -1, p), p, shift).alias(f"_m_{f}"))
    found = found.select("*", *parts)
    moves = [((F.coalesce(F.col(f"_b_{f}"), zero) + F.lit(p) - F.col(f"_m_{f}") * F.col(f"_o_{f}") % p) % p).alias(f"_a_{f}") for f, p in zip(at, PRIMES)]
    symbolic = found.select("conv_id", "_k", *[f"_m_{f}" for f in at], *moves)
    suffix = own.filter("pos > _head").join(symbolic, "conv_id")

    def composed(names: list[str]) -> list[Column]:
        return [(F.col(f"_a_{f}") + F.col(f"_m_{f}") * F.col(n) % p) % p for n, f, p in zip(names, at, PRIMES)]

    rest = suffix.select(
        "conv_id", (F.col("_k") + F.col("pos") - F.col("_head")).alias("depth"), *_packed(composed(at), ("k0", "k1")), *_packed(composed(before), ("p0", "p1")),
        F.col("conv_id").alias("turn_conv"), F.col("pos").alias("turn_pos"), "d0", "d1", "n_bytes", F.col("last").alias("ended"),
    )
    return roots.unionByName(heads).unionByName(rest)


# --- trie -------------------------------------------------------------------------------------------


@dataclass
class Trie:
    """``nodes``: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; (conv_id, depth) names a node.

    ``ends``: the same pair and ``member``, one row per conversation, at the node where it ends.
    ``prefixes``: the rows of the function of this name, for looking up the turns of a path.
    """

    nodes: DataFrame
    ends: DataFrame
    prefixes: DataFrame


def _verified(conversations: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """The prefixes and the nodes they make, without collisions."""
    attempt = 0
    while True:
        rows = stored(prefixes(turns(conversations, attempt), base, head, attempt))
        checked = ("p0", "p1", "d0", "d1")
        nodes = rows.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("n_bytes").alias("n_bytes"),
            *[F.min(c).alias(c) for c in checked],
            *[F.max(c).alias(f"_{c}") for c in checked],
        )
        nodes = stored(nodes)
        if nodes.filter(" or ".join(f"{c} <> _{c}" for c in checked)).isEmpty():
            return rows, nodes.drop(*[f"_{c}" for c in checked], "d0", "d1")
        attempt += 1


def trie(conversations: DataFrame, base: Column, head: Column) -> Trie:
    """The prefix trie of ``conversations(conv_id, turn, role, text)``, each rebuilt from the first ``head`` turns of ``base`` and its own after
    its first ``head``. ``base`` and ``head`` are expressions of ``conv_id``."""
    rows, nodes = _verified(conversations, base, head)
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1"))
    children = below.agg(F.count(F.lit(1)).alias("n_children"))
    value = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("value")
    facts = nodes.join(children, list(NODE), "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), value)
    facts = stored(facts)

    chains = facts.groupBy("conv_id").agg(F.sum("value").alias("_sum"), F.sum((F.col("n_children") == 0).cast("long")).alias("_leaves"))
    below = rows.select("conv_id", *NODE).join(chains, "conv_id").groupBy(*NODE).agg(F.sum("_sum").alias("_sum"), F.sum("_leaves").alias("n_leaves"))
    # what a node's own chain holds above it; only nodes with several members save anything
    shared = facts.filter("n_convs > 1").select("conv_id", *NODE, "value")
    above = prefix_products(shared, "conv_id", [F.col("depth")], {"value": (1, 0)}).select(*NODE, F.col("value_before").alias("_above"))
    parents = facts.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    top = parents.filter("depth = 1").select(F.col("parent_conv_id").alias("_root"))  # one row at most
    named = facts.join(parents.filter("depth > 1"), ["depth", "p0", "p1"], "left").join(F.broadcast(top), F.lit(True), "left")
    parent = F.when(F.col("depth") > 1, F.col("parent_conv_id")).when(F.col("depth") == 1, F.col("_root"))
    full = named.join(below, list(NODE), "left").join(above, list(NODE), "left")
    # a node of one member is a path to one leaf: its chain saves nothing from there on
    saved = F.when(F.col("n_convs") > 1, F.coalesce("_sum", F.lit(0)) - F.coalesce("_above", F.lit(0))).otherwise(F.lit(0))
    out = full.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.cast("long").alias("saved_tokens"))
    reps = nodes.select(*NODE, F.col("conv_id").alias("_rep"))
    ends = rows.filter("ended").join(reps, list(NODE)).select(F.col("_rep").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    return Trie(out, ends, rows)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of every node where a conversation ends: the digest of its members, ascending and comma-joined.

    Members are joined to blocks of ``IDS`` in range partitions, wherever a node's members lie; a digest then reads its blocks one after the other, since
    SHA-256 has no other way, and holds one of them.
    """
    ranged = ends.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, member = (c.to_numpy() for c in batch.columns)
            edge = np.concatenate(([True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])))
            starts = np.flatnonzero(edge)
            place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(conv)]))))
            starts = np.flatnonzero(place % IDS == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(conv)])), pa.int32()), batch.column(2).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pc.binary_join(lists, ",")], ["conv_id", "depth", "member", "ids"]
            )

    joined = ranged.select("conv_id", "depth", "member").mapInArrow(blocks, "conv_id long, depth long, member long, ids string")
    per_node = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")

    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seal = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (conv, depth) == key:
                    seal.update(b"," + ids.as_py().encode())
                    continue
                if key is not None:
                    done.append((*key, seal.hexdigest()))
                key, seal = (conv, depth), hashlib.sha256(ids.as_py().encode())
            yield _table(done)
        if key is not None:
            yield _table([(*key, seal.hexdigest())])

    def _table(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        conv, depth, digest = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["conv_id", "depth", "ends_sha256"])

    return per_node.mapInArrow(sealed, "conv_id long, depth long, ends_sha256 string")

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkrules.llm import prefixtrie as t
from sparkrules.llm.queries import op11_prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k0 string, pos string, f0 string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, base, head):
    """Every rebuilt conversation in full, every prefix as a tuple."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(ts, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, ts in own.items()}
    full = {c: tuple(own.get(base(c), [])[: head(c)] + ts[head(c) :]) for c, ts in own.items()}
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
            if d:
                children[full[c][: d - 1]].add(full[c][:d])

    out, below = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own_saved = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        saved = own_saved + sum(below[k][0] for k in children[path])
        leaves = sum(below[k][1] for k in children[path]) if children[path] else 1
        below[path] = saved, leaves
        ends = ",".join(str(c) for c in members[path] if full[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out[min(members[path]), len(path)] = (parent, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def built(spark, rows, base=lambda c: c - c % 5, head=lambda c: c % 9):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)
    found = t.trie(df, base(F.col("conv_id")), head(F.col("conv_id")))
    nodes = found.nodes.join(t.ends_digests(found.ends), ["conv_id", "depth"], "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    got = {(r[0], r[1]): (*r[2:7], r[7] or none) for r in nodes}
    assert len(got) == len(nodes)
    return got


def conversations(seed, n=60, longest=7):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for turn in range(r.randrange(1, longest)):
            rows.append((c, turn, r.choice(["user", "bot", None]), r.choice(["a", "b", "äö", "", None]) if r.random() < 0.9 else "long " * 500))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_brute_force(spark, seed):
    rows = conversations(seed)
    # null and equal turns, repeated rows, no conversation, a copy of a whole conversation
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (7, 2, None, "x"), (7, 2, "bot", "y"), (None, 1, "user", "lost")]
    rows += [(1000, *r[1:]) for r in rows if r[0] == 7]
    assert built(spark, rows) == brute(rows, lambda c: c - c % 5, lambda c: c % 9)


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(3)
    hot = [(50, i, "user", r.choice("abc")) for i in range(900)]
    rows = hot + [(90, *x[1:]) for x in hot[:600]] + conversations(4, 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert built(spark, rows) == brute(rows, lambda c: c - c % 5, lambda c: c % 9)
        pieces = t.turns(spark.createDataFrame([(*x, 1, "x", "y", "z") for x in rows], SCHEMA)).filter("conv_id = 50")
        assert sorted(x.pos for x in pieces.collect()) == list(range(1, 901)) and pieces.filter("last").count() == 1
        # long heads: most of the rest of the conversations is taken from the base
        want = brute(rows, lambda c: c * 0 + 50, lambda c: c * 5)
        assert built(spark, rows, lambda c: c * 0 + 50, lambda c: c * 5) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches(spark):
    rows = conversations(5, 30) + [(31, i, "user", "same") for i in range(40)] + [(36, i, "user", "same") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert built(spark, rows) == brute(rows, lambda c: c - c % 5, lambda c: c % 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_collision_starts_anew(spark, monkeypatch):
    real, asked = t._bases, []

    def weak(attempt):
        asked.append(attempt)
        return (1, 1, 1) if attempt == 0 else real(attempt)  # a base of 1 forgets the order

    monkeypatch.setattr(t, "_bases", weak)
    rows = [(10, 0, "u", "a"), (10, 1, "u", "b"), (15, 0, "u", "b"), (15, 1, "u", "a")]
    assert built(spark, rows) == brute(rows, lambda c: c - c % 5, lambda c: c % 9)
    assert set(asked) == {0, 1}


def test_absent_bases_negative_ids_and_empty_tables(spark):
    rows = [(3, 0, "u", "a"), (4, 0, "u", "a"), (-7, 0, "u", "b"), (-7, 1, "u", "c"), (8, 0, None, None)]
    base, head = (lambda c: c + 100), (lambda c: c * 0 + 1)
    got = built(spark, rows, base, head)
    assert got == brute(rows, base, head)
    assert got[-7, 0][:4] == (None, 4, 1, 1)  # three conversations are rebuilt without turns
    assert built(spark, []) == {} and built(spark, [(None, 0, "u", "a")]) == {}


def test_ends_in_blocks(spark, monkeypatch):
    ids = [*range(5000, 14000), 3]
    ends = spark.createDataFrame([(3, 1, m) for m in ids] + [(4, 2, 4)], "conv_id long, depth long, member long")
    got = {(r[0], r[1]): r[2] for r in t.ends_digests(ends).collect()}
    assert got == {(3, 1): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (4, 2): hashlib.sha256(b"4").hexdigest()}


def test_turn_references(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = F.col("conv_id")
    found = t.trie(df, own - own % 5, F.crc32(own.cast("string")) % 9)
    texts = t.turns(df).select(F.col("conv_id").alias("turn_conv"), F.col("pos").alias("turn_pos"), F.col("d0").alias("e0"))
    looked = found.prefixes.filter("depth > 0").join(texts, ["turn_conv", "turn_pos"], "left")
    assert looked.filter("e0 is null or e0 <> d0").count() == 0 and op11_prefixtrie(spark, sf_dir).count() == found.nodes.count()

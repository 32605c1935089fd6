"""Removal of long repeats by sorted suffixes, for texts as UTF-8 bytes.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed; the strings are judged on the input.

**Which strings can repeat.** The least hash among the ``GRAM``-byte pieces of a string depends on nothing else, so equal strings
share it. A text is cut into runs of neighbouring start places with one least hash (about one run in 170 bytes); a hash that comes from one
run only, and from one piece in it, rules out all its strings. What stays are the runs whose hash comes from two or more places.

**Which do repeat.** The bytes of these runs are dealt by their hash. A task sorts the suffixes at the start places of a block of runs in
two stages: a suffix smaller than its successor (kind B) is sorted directly by its first ``length`` bytes; every other one (kind A) is
induced by scanning the buckets of first bytes in order: where suffix i stands, suffix i-1 is the next of kind A in the bucket of its byte.
Within a bucket, kind A comes before kind B. Adjacent suffixes with a common prefix of ``length`` bytes are repeats.

**Hot hashes.** A hash with more than ``HOT`` runs is split over as many blocks as it needs. Each block finds its own repeats and
passes on one place for each distinct string, as a 128-bit hash; a string that more than one block has is a repeat in all. So a passage in a
third of all documents is never one task's work.

**Copies.** Equal texts are one text with a count: all their strings repeat if there are two or more. Only one of them is cut into runs' bytes.

Defined cases: a null or empty text has no bytes and keeps none; a text shorter than ``length`` keeps all; repeated rows are copies of
each other; a null ``doc_id`` is a value; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrules.llm.tables import body, packed, with_fields
from sparkrules.storage import stored

LENGTH, GRAM = 400, 64
HOT = 8000  # runs of one hash in one block, about: some 5 MB of bytes
BLOCK = 1 << 20  # bytes that are sorted together, about
BASE = 0x9E3779B97F4A7C15
RUNS = "key binary, s int, e int, g long, own boolean"
PIECES = "g long, salt int, hot boolean, key binary, s int, bytes binary"
MARKS = "key binary, s int, e int, salt int, hash binary"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


class Runs:
    """Cuts byte strings into runs of start places with one least hash."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (exclusive) and hashes of the runs, and whether the text has a run's piece more than once."""
        n, width = len(raw), self.length - self.gram + 1
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.frombuffer(raw, np.uint8) * self.powers[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        for _ in range(2):  # spread the bits: low ones of a polynomial are weak
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        tiles = np.concatenate([h, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(tiles, axis=1).reshape(-1)
        back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        places = n - self.length + 1
        least = np.minimum(back[:places], ahead[width - 1 : width - 1 + places])
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        chosen = least[starts]
        sieve = np.zeros(1 << 16, bool)
        sieve[chosen & np.uint64(0xFFFF)] = True
        values, counts = np.unique(h[sieve[h & np.uint64(0xFFFF)]], return_counts=True)
        own = counts[np.searchsorted(values, chosen)] > 1
        return starts, np.concatenate([starts[1:], [places]]), chosen.view(np.int64), own


def _sorted_directly(joined: bytes, codes: np.ndarray, places: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places in the order of their bytes up to ``stop``, by buckets of the first two bytes, so few keys are held at a time."""
    two = codes[places].astype(np.uint16) << 8 | np.where(places + 1 < stop, codes[np.minimum(places + 1, len(codes) - 1)], 0)
    order = np.argsort(two, kind="stable")
    places, stop, out = places[order], stop[order], []
    cuts = [0, *(np.flatnonzero(np.diff(two[order])) + 1).tolist(), len(places)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            keys = [joined[x:y] for x, y in zip(places[a:b].tolist(), stop[a:b].tolist())]
            out.append(places[a:b][sorted(range(len(keys)), key=keys.__getitem__)])
    return np.concatenate(out) if out else places


def sorted_places(pieces: list[bytes], starts: list[int], length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Two-stage sorting of the suffixes at the first ``starts[k]`` places of each piece.

    Returns the joined bytes, the places in the order of their first ``length`` bytes, and whether each place's successor in that order
    shares them all.
    """
    joined = b"".join(pieces)
    codes = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n = len(codes)
    # kind B: smaller than the successor; what ends a piece is smaller than any byte
    differs = np.ones(n, bool)
    differs[:-1] = codes[1:] != codes[:-1]
    differs[ends - 1] = True
    rises = np.zeros(n, bool)
    rises[:-1] = codes[:-1] < codes[1:]
    rises[ends - 1] = False
    turn = np.flatnonzero(differs)
    kind_b = rises[turn[np.searchsorted(turn, np.arange(n))]]
    # a run of kind A at the end of the starts goes on to the next B, or to the end of the piece
    all_b = np.append(np.flatnonzero(kind_b), n)
    last = begins + np.array(starts) - 1
    upto = np.minimum(all_b[np.searchsorted(all_b, last)], ends - 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, upto + 1, -1)
    used = np.cumsum(edge[:-1]) > 0
    wanted = np.zeros(n + 1, np.int64)
    np.add.at(wanted, begins, 1)
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    # first stage
    direct = np.flatnonzero(used & kind_b)
    stop = np.minimum(direct + length, ends[np.searchsorted(ends, direct, side="right")])
    direct = _sorted_directly(joined, codes, direct, stop)
    by_code = np.searchsorted(codes[direct], np.arange(257))
    # second stage; the end of a piece is induced by what ends it, never by the start of the next piece
    induced = used & ~kind_b
    tails = ends[induced[ends - 1]] - 1
    induced[ends - 1] = False
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(places: np.ndarray, above: int) -> None:
        """Deal the kind A predecessors of ``places``, in their order, to the buckets above ``above``."""
        before = places - 1
        before = before[before >= 0]
        before = before[induced[before] & (codes[before] > above)]
        if len(before):
            order = np.argsort(codes[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(codes[before])) + 1
            for part in np.split(before, cuts):
                waiting[codes[part[0]]].append(part)

    for code in np.unique(codes[tails]):
        waiting[code].append(tails[codes[tails] == code])
    out = []
    for code in range(256):
        now = np.concatenate(waiting[code]) if waiting[code] else np.zeros(0, np.int64)
        bucket = []
        while len(now):
            bucket.append(now)
            now = now[now > 0] - 1
            now = now[induced[now] & (codes[now] == code)]
        bucket.append(direct[by_code[code] : by_code[code + 1]])
        bucket = np.concatenate(bucket)
        waiting[code] = []
        if len(bucket):
            out.append(bucket)
            induce(bucket, code)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    order = order[wanted[order]]
    return joined, order, common(joined, order, length)


def common(joined: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each place and the next in the order have ``length`` bytes in common."""
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    codes = np.frombuffer(joined, np.uint8)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((codes[a] == codes[b]) & (codes[a + length // 2] == codes[b + length // 2]) & (codes[a + length - 1] == codes[b + length - 1]))
    for k, x, y in zip(near.tolist(), a[near].tolist(), b[near].tolist()):
        out[k] = joined[x : x + length] == joined[y : y + length]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, dict[bytes, list]]]:
    """The pieces of one (hash, salt) after the other: equal bytes once, with the distinct ``(key, s)`` that hold them."""
    now, hot, pieces = None, False, {}
    for batch in batches:
        for row in batch.to_pylist():
            if (row["g"], row["salt"]) != now:
                if pieces:
                    yield now, hot, pieces
                now, hot, pieces = (row["g"], row["salt"]), row["hot"], {}
            places = pieces.setdefault(row["bytes"], [])
            if (row["key"], row["s"]) not in places[-1:]:
                places.append((row["key"], row["s"]))
    if pieces:
        yield now, hot, pieces


def _marked(length: int):
    """Repeats among the pieces of a partition that is sorted by hash, salt, key and start."""

    def block(groups: list[tuple[tuple, bool, dict[bytes, list]]]) -> pa.RecordBatch:
        rows: list[tuple] = []
        pieces, owners, salts = [], [], []
        for (_, salt), hot, group in groups:
            for raw, places in group.items():
                if len(places) > 1:
                    rows += [(key, s, s + len(raw) - length + 1, None, None) for key, s in places]
                if hot or len(group) > 1 or len(places) == 1:
                    pieces.append(raw)
                    owners.append(places)
                    salts.append(salt if hot else None)
        if pieces:
            begins = np.cumsum([0] + [len(p) for p in pieces])
            joined, order, equal = sorted_places(pieces, [len(p) - length + 1 for p in pieces], length)
            repeat = np.zeros(len(joined) + 1, bool)
            repeat[order[:-1][equal[:-1]]] = True
            repeat[order[1:][equal[:-1]]] = True
            for k, places in enumerate(owners):
                if len(places) == 1 and repeat[begins[k] : begins[k + 1]].any():
                    flags = np.diff(repeat[begins[k] : begins[k + 1]].astype(np.int8), prepend=0, append=0)
                    key, s = places[0]
                    rows += [(key, s + a, s + b, None, None) for a, b in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist())]
            if any(salt is not None for salt in salts):
                first = order[np.concatenate([[True], ~equal[:-1]])]
                for place, k in zip(first.tolist(), (np.searchsorted(begins, first, side="right") - 1).tolist()):
                    if salts[k] is not None:
                        key, s = owners[k][0]
                        at = s + place - int(begins[k])
                        rows.append((key, at, at + 1, salts[k], hashlib.blake2b(joined[place : place + length], digest_size=16).digest()))
        kinds = [("key", pa.binary()), ("s", pa.int32()), ("e", pa.int32()), ("salt", pa.int32()), ("hash", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = [], 0
        for group in _groups(batches):
            groups.append(group)
            size += sum(map(len, group[2]))
            if size >= BLOCK:
                yield block(groups)
                groups, size = [], 0
        if groups:
            yield block(groups)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``key, copies, spans`` of the texts that have copies or repeats; a span ``(s, e)`` holds start places of repeated strings."""
    gram = min(GRAM, max(1, length // 4))
    rows = docs.select("doc_id", text_key(body()).alias("key"), body().alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(length, gram)
        for batch in batches:
            found = [runs(t.as_py().encode()) for t in batch.column(1)]
            take = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            columns = [pa.array(np.concatenate([f[i] for f in found]), t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *columns], ["key", "s", "e", "g", "own"])

    runs = stored(rows.select("key", "text").mapInArrow(cut, RUNS))
    place = F.xxhash64("key", "s")
    shared = runs.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    shared = shared.filter("a <> b or own").select("g", "n")
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies"))
    wanted = runs.join(shared, "g").groupBy("key").agg(F.collect_set(F.struct("g", "s", "e", "n")).alias("runs"))
    wanted = wanted.join(copies, "key").withColumnRenamed("key", "k")
    texts = rows.join(wanted, (rows["key"] == wanted["k"]) & rows["doc_id"].eqNullSafe(wanted["one"])).select("key", "text", "runs")

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("g", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()), ("key", pa.binary()), ("s", pa.int32()), ("bytes", pa.binary())])
        for batch in batches:
            for key, text, own in zip(batch.column(0), batch.column(1), batch.column(2)):
                key, raw = key.as_py(), text.as_py().encode()
                out = []
                for r in own.as_py():
                    blocks = -(-r["n"] // hot)
                    salt = int.from_bytes(key[:8], "big") % blocks
                    out.append({"g": r["g"], "salt": salt, "hot": blocks > 1, "key": key, "s": r["s"], "bytes": raw[r["s"] : r["e"] - 1 + length]})
                yield pa.RecordBatch.from_pylist(out, kinds)

    pieces = texts.mapInArrow(bring, PIECES).repartition("g", "salt").sortWithinPartitions("g", "salt", "key", "s")
    marks = stored(pieces.mapInArrow(_marked(length), MARKS))
    classes = marks.filter("hash is not null")
    several = classes.groupBy("hash").agg(F.min("salt").alias("a"), F.max("salt").alias("b")).filter("a < b").select("hash")
    found = marks.filter("hash is null").select("key", "s", "e").union(classes.join(several, "hash").select("key", "s", "e"))
    spans = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return copies.filter("copies > 1").select("key", "copies").join(spans, "key", "full")


def removed(docs: DataFrame, *carry: str, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The ``carry`` columns, ``n_bytes``, ``removed`` (maximal runs of removed bytes) and ``kept`` (the other bytes, joined)."""
    found = repeats(docs, length, hot).withColumnRenamed("key", "_k")
    rows = docs.select(packed(carry), text_key(body()).alias("_key"), body().alias("_text"))
    rows = rows.join(found, F.col("_key") == F.col("_k"), "left").select("_row", "_text", "copies", "spans")
    schema = with_fields(rows, "n_bytes long, removed array<struct<start:int,end:int>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, gone, kept = [], [], []
                for text, copies, spans in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    raw = text.encode()
                    if copies and len(raw) >= length:
                        spans = [{"s": 0, "e": len(raw) - length + 1}]
                    merged: list[list[int]] = []
                    for span in spans or ():
                        a, b = span["s"], span["e"] - 1 + length
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for ab in merged for x in ab), len(raw)]
                    sizes.append(len(raw))
                    gone.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                columns = [pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["_row", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(run, schema).select("_row.*", "n_bytes", "removed", "kept")

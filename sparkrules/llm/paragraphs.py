"""Substring dedup: near-equal paragraphs by MinHash banding, exact Jaccard and components.

A paragraph is a line of ``LEAST_WORDS`` words or more, its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; its shingles are five words. Two
paragraphs are linked at a Jaccard similarity of ``SIMILARITY`` or more. Equal paragraphs are one *form*, so what follows works on
distinct forms. Bands and rows are tuned: the most rows per band for which ``RECALL`` at the threshold takes at most
``MOST_BANDS`` bands (0.8: 10 bands of 3 rows, recall 0.9992).

A bucket of forms that collide in a band is never paired with itself. Bands are sorted by range partitions, so a bucket of any size
spreads over tasks that stream it; the leaders of a bucket's parts are compared with each other. First every form is compared with the
leader of its part, one row per form and bucket, drawn anew in each bucket; the verified links give components. In buckets where components
still meet, every form is compared with the bucket's hub, the form that shares most of itself. Then only forms of one bucket in *different*
components are compared, and of these only those whose sizes, unshared shingles and parities leave a similarity possible (``_possible``).
What is left out could not change a component, so the result is that of all colliding pairs, while a large family of
variants costs a few comparisons each.

Of each component the occurrence with the least ``(doc_id, line)`` is kept; all others are removals.

**Passages.** A repeated passage inside longer, unlike lines makes no similar paragraphs. So texts are also cut into *pieces* of ``PIECE`` words,
wherever lines end: of the pieces that start in a stretch of ``PASSAGE`` words, the one of the least hash is taken (all, if several). What is taken depends on
the words of the stretch only, so a passage of ``PASSAGE`` words or more that stands in two places gives both the same piece: none is missed. Equal
pieces (128 bits) are a cluster. Its first place outside removed paragraphs is kept, or its first one; pieces within a removed paragraph are
gone with it. A removal that meets the kept place is left out. Removals of one text that overlap and have their kept places in one text are one row.

Defined cases: null and empty texts have no paragraphs; null ids sort last; paragraphs repeated within a text are occurrences
like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.llm.components import components
from sparkrules.llm.tables import body, pieces
from sparkrules.storage import stored

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 10
RECALL, MOST_BANDS, SEED = 0.999, 10, 42
SIZE_STEP = 1.02  # ratio of the sizes of a step within which forms meet
PARITIES = 512  # bits of a form, each the parity of its shingles of one hash value
KEPT = 400_000  # word hashes that a task keeps
DOCS = 64  # texts that are hashed together
PASSAGE, PIECE = 50, 25  # words of the shortest passage that is always found, and of what is compared
PIECES = "h long, c long, doc_id long, line int, last int, start int, end int"
FORMS = "doc_id long, line int, start int, end int, form binary, bands array<bigint>"


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands reach the recall at the threshold within ``most`` bands."""
    for rows in range(16, 0, -1):
        missed = 1 - similarity**rows
        bands = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if bands <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def lines(text: str, least: int = LEAST_WORDS) -> list[tuple[int, int, int, list[bytes]]]:
    """``(line, start, end, words)`` of every paragraph; offsets are code points."""
    out, at = [], 0
    for number, line in enumerate(text.split("\n")):
        words = line.encode().lower().split()
        if len(words) >= least:
            out.append((number, at, at + len(line), words))
        at += len(line) + 1
    return out


class Signer:
    """MinHash bands of paragraphs."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.factors = draw.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = draw.integers(0, 1 << 63, (bands * rows, 1), np.uint64)
        self.mixes = draw.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = [np.uint64(x) for x in (draw.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1))]
        self.kept: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out

    def words(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """The hashes of all words."""
        kept = self.kept
        return np.array([kept.get(w) or self._word(w) for p in paragraphs for w in p], np.uint64)

    def shingles(self, paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all shingles, repeats included, and where those of each paragraph start (each of ``SHINGLE`` words or more)."""
        sizes, words = np.array([len(p) for p in paragraphs]), self.words(paragraphs)
        n = len(words) - SHINGLE + 1
        hashes = sum((words[i : i + n] * step for i, step in enumerate(self.steps)), np.zeros(n, np.uint64))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * self.steps[0]
        hashes ^= hashes >> np.uint64(29)
        ends = np.cumsum(sizes)
        inside = np.ones(len(words), bool)
        for k in range(1, SHINGLE):
            inside[ends - k] = False  # a shingle that would run into the next paragraph
        hashes = hashes[inside[:n]]
        return hashes, np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])

    def __call__(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """One row of band hashes per paragraph."""
        hashes, starts = self.shingles(paragraphs)
        least = np.stack([np.minimum.reduceat(hashes * f + o, starts) for f, o in zip(self.factors, self.offsets)])
        least = least.reshape(self.bands, self.rows, len(paragraphs))
        keys = (least * self.mixes[None, :, None]).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(32))) * self.steps[1] + np.arange(self.bands, dtype=np.uint64)[:, None] * self.steps[2]
        return keys.T.copy().view(np.int64)


def forms(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per paragraph: its place, the 128-bit name of its form, and its band hashes."""
    bands, rows = tuned(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                found = [(name, *p) for name, text in zip(part.column(0).to_pylist(), part.column(1)) for p in lines(text.as_py(), least)]
                if not found:
                    continue
                names = [hashlib.md5(b" ".join(p[4])).digest() for p in found]
                keys = signer([p[4] for p in found])
                offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
                columns = [pa.array([p[i] for p in found], pa.int64() if i == 0 else pa.int32()) for i in range(4)]
                columns += [pa.array(names, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "start", "end", "form", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, FORMS)


def _texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``form, words`` of the wanted ``(doc_id, line, form)``, each from one place that holds it."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list("line").alias("lines")).withColumnRenamed("doc_id", "_d")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    # nearly every text is wanted, so this side grows with the table and is never sent to all executors
    rows = rows.join(per_doc.hint("merge"), rows["doc_id"].eqNullSafe(F.col("_d"))).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1)):
                own = set(own.as_py())
                found = {hashlib.md5(n := b" ".join(w)).digest(): n for number, _, _, w in lines(text.as_py(), least) if number in own}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([*map(bytes.decode, found.values())], pa.string())], ["form", "words"])

    # rows that repeat a doc_id may bring a form twice, or a line of another text; neither does harm
    return rows.mapInArrow(run, "form binary, words string").dropDuplicates(["form"])


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` whose shingle sets are similar enough."""
    left = texts.select(F.col("form").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("form").alias("b"), F.col("words").alias("y"))

    def shingles(words: str) -> set[tuple[str, ...]]:
        w = words.split(" ")
        return set(zip(*(w[i:] for i in range(SHINGLE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, one = [], None, set()
            for x, y in zip(batch.column(2), batch.column(3)):
                if x.as_py() != last:
                    last = x.as_py()
                    one = shingles(last)
                other = shingles(y.as_py())
                both = len(one & other)
                keep.append(both >= similarity * (len(one) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over ``(bucket, f)`` in order: every ``f`` with the first one of its bucket; the first and last bucket of the partition as edges."""

    def rows(bucket: np.ndarray, a: np.ndarray, f: np.ndarray, edge: bool) -> pa.RecordBatch:
        arrays = [pa.array(bucket), pa.array(a), pa.array(f), pa.array(np.full(len(f), edge))]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "a", "f", "edge"])

    last: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, f = (c.to_numpy() for c in batch.columns)
        starts = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        leaders = f[np.maximum.accumulate(np.where(starts, np.arange(len(f)), 0))]
        if last is None:
            yield rows(bucket[:1], f[:1], f[:1], True)
        elif last[0] == bucket[0]:
            leaders[: np.argmax(np.append(bucket != bucket[0], True))] = last[1]
        follows = leaders != f
        yield rows(bucket[follows], leaders[follows], f[follows], False)
        last = (int(bucket[-1]), int(leaders[-1]))
    if last is not None:
        yield rows(np.array([last[0]]), np.array([last[1]]), np.array([last[1]]), True)


def _members(reps: DataFrame) -> DataFrame:
    """``(bucket, a, f)``: the forms that share a bucket, each with a leader of it; leaders are linked to each other."""
    # another order in every bucket, so a family that meets in many buckets is compared with as many different leaders
    order = ["bucket", F.xxhash64("f", "bucket")]
    ranged = reps.select(F.explode("bands").alias("bucket"), "f").repartitionByRange(*order).sortWithinPartitions(*order)
    led = stored(ranged.mapInArrow(_led, "bucket long, a long, f long, edge boolean"))
    edges = led.filter("edge").select("bucket", "a").distinct()  # two rows per partition
    first = edges.groupBy("bucket").agg(F.min("a").alias("m"), F.max("a").alias("z")).filter("m <> z").select("bucket", "m")
    between = edges.join(first, "bucket").filter("a <> m").select("bucket", F.col("m").alias("a"), F.col("a").alias("f"))
    return led.filter("not edge").select("bucket", "a", "f").union(between)


def _shingled(texts: DataFrame) -> DataFrame:
    """``form, n, u, odd``: the distinct shingles of each of these texts, how many of them stand in no other of the texts, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(1, 1)
        for names, words in pieces(batches, DOCS):
            split = [w.encode().split(b" ") for w in words.to_pylist()]
            keep = [len(w) >= SHINGLE for w in split]
            if not any(keep):
                continue
            hashes, starts = signer.shingles([w for w, k in zip(split, keep) if k])
            sets = [np.unique(x) for x in np.split(hashes.view(np.int64), starts[1:])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))
            odd = [np.packbits(np.bincount(x & (PARITIES - 1), minlength=PARITIES) & 1).view(np.int64) for x in sets]
            words_of = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (PARITIES // 64), pa.int32()), pa.array(np.concatenate(odd)))
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(keep)), lists, words_of], ["form", "h", "odd"])

    each = texts.select("form", "words").mapInArrow(run, "form binary, h array<long>, odd array<long>")
    each = stored(each)
    single = each.select("form", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("form").alias("form")).filter("c = 1")
    own = single.groupBy("form").agg(F.count(F.lit(1)).alias("u"))
    return each.select("form", F.size("h").cast("long").alias("n"), "odd").join(own, "form", "left").withColumn("u", F.coalesce("u", F.lit(0)))


def _possible(rest: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` of one bucket in different components that may be similar enough, by the numbers of their shingles.

    Of the ``n`` shingles of a form, ``u`` stand in no other form at hand. So it shares ``n - u`` with another at most; a similarity of t takes
    ``t / (1 + t) * (n + m)`` common ones, which bounds the size m of the other. Nothing similar is left out. Forms are met by steps of size
    within their bounds, so an edited copy that has grown too unlike any text of its own size meets none of its family.

    Every parity in which two forms differ takes a shingle that one of them has and the other has not, and a similarity of t leaves
    ``(1 - t) / (1 + t) * (n + m)`` of those at most. This is looked at inside the join, so the texts of other pairs are never fetched.
    """
    t, tiny = similarity, 1e-9
    most = F.floor((F.col("n") - F.col("u")) * ((1 + t) / t) + tiny) - F.col("n")
    bounds = sizes.select(
        "form", "n", F.ceil(F.col("n") * t - tiny).alias("low"), F.least(F.floor(F.col("n") / t + tiny), most).alias("high"), "odd"
    ).filter("low <= high")
    step = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / math.log(SIZE_STEP)).cast("int")
    sized = rest.join(bounds, "form")
    left = sized.select("bucket", F.col("form").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), "low", "high", F.col("odd").alias("ox"), F.explode(F.sequence(step("low"), step("high"))).alias("step"))
    right = sized.select("bucket", F.col("form").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("odd").alias("oy"), step("n").alias("step"))
    met = left.join(right, ["bucket", "step"]).filter("rx < ry and ny between low and high and nx between low_y and high_y")
    unlike = sum((F.bit_count(F.col("ox")[i].bitwiseXOR(F.col("oy")[i])) for i in range(PARITIES // 64)), F.lit(0))
    met = met.filter(unlike <= F.floor((F.col("nx") + F.col("ny")) * ((1 - t) / (1 + t)) + tiny))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(found: DataFrame, place: tuple[str, ...], texts_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``(form, root)`` of the forms of ``found(form, bands, *place)`` that are linked; ``texts_of`` gives ``form, words`` of places."""
    # forms travel as 64 bits in buckets only; the joins that end there bring every form of these bits
    short = F.conv(F.substring(F.hex("form"), 1, 16), 16, -10).cast("long").alias("f")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *place)).alias("at")
    distinct = stored(found.groupBy("form").agg(F.min("bands").alias("bands"), first).select(short, "form", "bands", *[f"at.{name}" for name in place]))
    stars = stored(_members(distinct.select("bands", "f")))
    inside = stars.select("bucket", "f").union(stars.select("bucket", F.col("a").alias("f"))).distinct()
    reps = stored(distinct.drop("bands").join(inside.select("f").distinct(), "f", "left_semi"))
    texts = stored(texts_of(reps.select(*place)).join(reps.select("form"), "form", "left_semi"))
    one, two = reps.select(F.col("f").alias("a"), F.col("form").alias("x")), reps.select("f", F.col("form").alias("y"))
    same_bits = one.join(two, one["a"] == two["f"]).filter("x < y").select("x", "y")
    tried = stars.select("a", "f").distinct().join(one, "a").join(two, "f").select("x", "y").union(same_bits)
    tried = stored(tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = stored(components(stored(_verified(tried, texts, similarity))).withColumnRenamed("node", "form"))

    def meeting(parts: DataFrame) -> DataFrame:
        """``bucket, form, root`` of the buckets in which components meet; one that lies within a component is done."""
        mixed = parts.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("q")).filter("r <> q").select("bucket")
        return stored(parts.join(mixed, "bucket"))

    def joined(pairs: DataFrame) -> DataFrame | None:
        """The roots with the links among new pairs, if there are any; components of before go in as their stars."""
        more = stored(_verified(pairs.join(tried, ["a", "b"], "left_anti"), texts, similarity))
        if more.isEmpty():
            return None
        stars = roots.filter("form <> root").select(F.col("form").alias("a"), F.col("root").alias("b"))
        new = components(stars.union(more)).withColumnRenamed("node", "form")
        return stored(new)

    rooted = lambda parts: parts.join(roots, "form", "left").select("bucket", "form", F.coalesce("root", "form").alias("root"))
    rest = meeting(stored(rooted(inside.join(reps.select("f", "form"), "f").select("bucket", "form"))))
    if rest.isEmpty():
        return roots
    sizes = stored(_shingled(texts.join(rest.select("form").distinct(), "form", "left_semi")))
    # every form of such a bucket against its hub, the form that has least to itself: a family gathers around its origin
    rank = F.struct((F.col("u") / F.col("n")).alias("own"), "form")
    hubs = rest.join(sizes, "form").groupBy("bucket").agg(F.min(rank)["form"].alias("hub"))
    spokes = rest.join(hubs, "bucket").filter("form <> hub").select(F.least("form", "hub").alias("a"), F.greatest("form", "hub").alias("b")).distinct()
    found_more = joined(spokes)
    if found_more is not None:
        roots = found_more
        rest = meeting(stored(rooted(rest.select("bucket", "form"))))
    tried = tried.union(spokes)
    found_more = joined(_possible(rest, sizes, similarity))
    return roots if found_more is None else found_more


def clusters(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """Every paragraph that has another equal or similar one: its place, its cluster's kept place, and ``kept``."""
    found = stored(forms(docs, similarity, least))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")
    roots = linked(found, ("doc_id", "line"), lambda wanted: _texts(docs, wanted, least), similarity)
    named = found.drop("bands").join(roots, "form", "left").withColumn("root", F.coalesce("root", "form"))
    groups = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("k")).filter("size > 1")
    out = named.join(groups, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("line") == F.col("k.line"))
    return out.select(
        "doc_id", "line", "start", "end", F.col("k.doc_id").alias("cluster_doc_id"), F.col("k.line").alias("cluster_line"), kept.alias("kept")
    )


def _slid(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = of(x[:-span], x[span:]), 2 * span
    rest = width - span
    return of(x[:-rest], x[rest:]) if rest else x


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """Which hashes are the least of any ``width`` neighbours."""
    least = _slid(hashes, width, np.minimum)
    edge = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(_slid(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)


def cut(docs: DataFrame) -> DataFrame:
    """The taken pieces of every text: their 128 bits, their place, and the lines in which they start and end."""
    draw = np.random.default_rng(SEED + 1)
    steps = draw.integers(0, 1 << 63, (2, PIECE), np.uint64) * np.uint64(2) + np.uint64(1)

    def hashed(words: np.ndarray, own: np.ndarray) -> np.ndarray:
        n = len(words) - PIECE + 1
        out = np.zeros(n, np.uint64)
        for i, step in enumerate(own):
            out += words[i : i + n] * step
        out = (out ^ (out >> np.uint64(32))) * own[0]
        return out ^ (out >> np.uint64(29))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(1, 1)
        for names, texts in pieces(batches, DOCS):
            found = [(name, t, w) for name, t in zip(names.to_pylist(), texts.to_pylist()) if len(w := t.encode().lower().split()) >= PASSAGE]
            if not found:
                continue
            words = signer.words([w for _, _, w in found])
            h, c = (hashed(words, own) for own in steps)
            columns, at = [], 0
            for name, text, w in found:
                n = len(w) - PIECE + 1
                take = chosen(h[at : at + n], PASSAGE - PIECE + 1)
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
                edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))  # starts and ends of words in turn
                start, end = edges[::2][take], edges[1::2][take + PIECE - 1]
                ahead = np.cumsum(codes == 10)
                columns.append((h[at + take], c[at + take], [name] * len(take), ahead[start], ahead[end - 1], start, end))
                at += len(w)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            arrays = [[x for part in columns for x in part[2]] if i == 2 else np.concatenate([part[i] for part in columns]) for i in range(7)]
            arrays = [pa.array(x.view(np.int64) if i < 2 else x, kinds[i]) for i, x in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "c", "doc_id", "line", "last", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, PIECES)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of ``h, c``: those that have an equal neighbour. Only the last row of a batch is held back."""
    held, same = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            (batch,) = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()
        h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        equal = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        keep = np.concatenate([[same], equal])
        same = bool(keep[-1])
        keep[:-1] |= equal
        held = batch.slice(batch.num_rows - 1)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
    if same:
        yield held


def passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The removals of repeated passages, beside those of paragraphs ``gone(doc_id, line)``: their place, and the kept place of their first piece."""
    found = stored(cut(docs).repartition("h").sortWithinPartitions("h", "c").mapInArrow(_repeated, PIECES))
    lost = gone.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("line").alias("lost"))
    lines = F.sequence("line", "last")
    rows = found.join(lost, found["doc_id"].eqNullSafe(F.col("_d")), "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
    rows = rows.filter((F.col("line") < F.col("last")) | ~F.array_contains("lost", F.col("line")))
    rows = stored(rows.select(*found.columns, F.arrays_overlap("lost", lines).alias("broken")))
    place = F.struct("broken", F.col("doc_id").isNull().alias("none"), "doc_id", "start", "end", "line")
    groups = rows.groupBy("h", "c").agg(F.min(place).alias("k"), F.max(place).alias("z")).filter("k <> z").drop("z")
    meets = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("start") < F.col("k.end")) & (F.col("end") > F.col("k.start"))
    rows = rows.join(groups, ["h", "c"]).filter(~meets)
    rows = rows.select("doc_id", "line", "start", "end", F.col("k.doc_id").alias("cluster_doc_id"), F.col("k.line").alias("cluster_line")).distinct()
    one = Window.partitionBy("doc_id", "cluster_doc_id").orderBy("start", "end", "cluster_line")
    reach = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(one))
    first = F.min(F.struct("start", "line", "cluster_line")).alias("at")
    runs = rows.groupBy("doc_id", "cluster_doc_id", "run").agg(first, F.max("end").alias("end"))
    return runs.select("doc_id", "at.line", "at.start", "end", "cluster_doc_id", "at.cluster_line")


def removals(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """Every place of a paragraph or passage that goes, with the place that is kept for it."""
    gone = stored(clusters(docs, similarity, least).filter("not kept").drop("kept"))
    return gone.unionByName(passages(docs, gone))

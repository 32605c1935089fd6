"""Token files as wavelet matrices, one per shard.

Texts are sorted by ``doc_id`` over range partitions; each partition encodes its texts in order and closes a shard
whenever it holds ``SHARD_TOKENS`` ids or more, so a task keeps one shard in memory. A shard's file holds one bit-plane per bit of an id, the
highest first. Each plane lists its bits in the order that the planes above produce (ids with a 0 before ids with
a 1, both in their old order), cut into blocks of ``BITS`` bits, each a zstd frame of its own. Tables beside them hold where each
frame starts and how many ones stand before each block. So one file answers which id stands at a place, how often
an id occurs before a place, and where its occurrences are, and unpacks only the blocks that the answer touches.

A shard is one row of a Parquet table: its file, its documents' ids and lengths, and its place in the order. Offsets of whole
partitions and shards come from their totals alone.

Defined cases: a null or empty text holds the end id only; null ids sort first; rows that repeat an id follow in the order of their text
digests; a document longer than a shard makes a longer shard; an empty table makes no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.llm.bpe import ROWS, codec
from sparkrules.llm.tables import body

SHARD_TOKENS = 1 << 20
SHIFT = 16
BITS = 1 << SHIFT  # of a plane per block
MAGIC = b"WMX2"
SHARDS = "part int, seq int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, file binary"


class Plane:
    """Bits in packed blocks, with rank and select by the numbers of ones before each block."""

    def __init__(self, zeros: int, before: np.ndarray, frames: list[bytes | memoryview]):
        self.zeros, self.before, self.frames = zeros, before, frames
        self.unpacked = 0  # blocks so far

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        raw = np.zeros((len(bits) // BITS + 1) * (BITS // 8), np.uint8)  # one place past the end can be asked for
        raw[: len(packed)] = packed
        blocks = raw.reshape(-1, BITS // 8)
        ones = np.bitwise_count(blocks.view("<u8")).sum(axis=1, dtype=np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        return cls(len(bits) - int(ones.sum()), np.cumsum(ones) - ones, [pack(block) for block in blocks])

    def block(self, number: int) -> np.ndarray:
        self.unpacked += 1
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[number]), "<u8")

    def whole(self, n: int) -> np.ndarray:
        words = np.concatenate([self.block(i) for i in range(len(self.frames))])
        return np.unpackbits(words.view(np.uint8), count=n, bitorder="little").view(bool)

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place and the number of ones before it."""
        bits, ones = np.empty_like(at), np.empty_like(at)
        for number, rows in _by_block(at >> SHIFT):
            words, inner = self.block(number), at[rows] & (BITS - 1)
            counts = np.bitwise_count(words).astype(np.int64)
            word, shift = words[inner >> 6], (inner & 63).astype(np.uint64)
            bits[rows] = word >> shift & np.uint64(1)
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            ones[rows] = self.before[number] + (np.cumsum(counts) - counts)[inner >> 6] + below
        return bits, ones

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """The places of the bits of that value with the given ranks (from 0)."""
        before = self.before if bit else np.arange(len(self.before), dtype=np.int64) * BITS - self.before
        at = np.empty_like(ranks)
        for number, rows in _by_block(np.searchsorted(before, ranks, "right") - 1):
            bits = np.unpackbits(self.block(number).view(np.uint8), bitorder="little")
            at[rows] = number * BITS + np.flatnonzero(bits == bit)[ranks[rows] - before[number]]
        return at


def _by_block(blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each block with the rows that lie in it."""
    order = np.argsort(blocks, kind="stable")
    numbers, starts = np.unique(blocks[order], return_index=True)
    for number, rows in zip(numbers.tolist(), np.split(order, starts[1:])):
        yield number, rows


class WaveletMatrix:
    """A sequence of ids with access, rank and select."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        now = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
        levels = levels or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        planes = []
        for shift in range(levels - 1, -1, -1):
            bits = (now >> shift & 1).astype(bool)
            planes.append(Plane.build(bits))
            now = np.concatenate([now[~bits], now[bits]])
        return cls(len(ids), planes)

    def to_bytes(self) -> bytes:
        frames = [f for p in self.planes for f in p.frames]
        tables = [np.array([p.zeros for p in self.planes]), *[p.before for p in self.planes], np.cumsum([0, *map(len, frames)])]
        return struct.pack("<4sQI", MAGIC, self.n, len(self.planes)) + b"".join(t.astype("<i8").tobytes() for t in tables) + b"".join(frames)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        """The matrix of a file, nothing of which is unpacked yet."""
        magic, n, levels = struct.unpack_from("<4sQI", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        blocks = n // BITS + 1
        table = np.frombuffer(raw, "<i8", levels + 2 * levels * blocks + 1, struct.calcsize("<4sQI"))
        zeros, before, ends = np.split(table, [levels, levels + levels * blocks])
        body_of = memoryview(raw)[struct.calcsize("<4sQI") + table.nbytes :]
        frames = [body_of[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return cls(n, [Plane(int(zeros[i]), before[i * blocks : (i + 1) * blocks], frames[i * blocks : (i + 1) * blocks]) for i in range(levels)])

    def ids(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's order is undone."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bits = plane.whole(self.n)
            before = np.empty_like(now)
            before[~bits] = now[: plane.zeros]
            before[bits] = now[plane.zeros :] | now.dtype.type(1 << shift)
            now = before
        return now

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places ``0 <= at < n``."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.look(at)
            at = np.where(bit == 1, plane.zeros + ones, at - ones)
            out = out << 1 | bit
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """The places below the last plane of the token's occurrences in ``[low, high)``."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        ends = np.array([low, high], np.int64)
        for shift, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            ones = plane.look(ends)[1]
            ends = plane.zeros + ones if token >> shift & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the token occurs in ``[low, high)``."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the token's ``k``-th occurrence, from 0."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(f"token {token} occurs {end - start} times")
        return int(self._up(token, np.array([start + k], np.int64))[0])

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """From places below the last plane to places in the sequence."""
        for shift, plane in enumerate(reversed(self.planes)):
            at = plane.select(1, at - plane.zeros) if token >> shift & 1 else plane.select(0, at)
        return at

    def locate(self, token: int) -> np.ndarray:
        """All places of the token, ascending."""
        return self._up(token, np.arange(*self._range(token, 0, self.n), dtype=np.int64))


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode the texts, append ``end_id`` to each, and write the shards to the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = codec(vocabulary), TaskContext.get().partitionId()
        end, seq = np.array([end_id], "<u4"), 0
        names, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            columns = [[part], [seq], [len(tokens)], [names], [[len(x) for x in ids]], [WaveletMatrix.build(tokens).to_bytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "seq", "n_tokens", "doc_ids", "lengths", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part_names, texts = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for name, coded in zip(part_names, coder.encode_many(texts)):
                    names.append(name)
                    ids.append(np.concatenate([coded, end]))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield shard()
                        names, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with ``start``, the number of ids in all shards before."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("_part") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"))
    return shards.join(starts, ["part", "seq"])


def documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, lengths, file, start = (batch.column(c)[row].as_py() for c in range(4))
                tokens = WaveletMatrix.from_bytes(file).ids().astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(tokens[b - n : b]) for b, n in zip(ends.tolist(), lengths)]
                columns = [names, (start + ends - lengths).tolist(), lengths, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.select("doc_ids", "lengths", "file", "start").mapInArrow(run, schema)


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``place``: where the token stands in the whole order, by rank and select in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0), batch.column(1)):
                places = WaveletMatrix.from_bytes(file.as_py()).locate(token) + start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], ["place"])

    return shards.select("file", "start").mapInArrow(run, "place bigint")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of the given ids occurs, by rank in each file."""
    wanted = list(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                matrix = WaveletMatrix.from_bytes(file.as_py())
                counts = [matrix.count(t) for t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(counts, pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))

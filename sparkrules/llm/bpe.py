"""Byte-level BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur inside no vocabulary token are never merged, so a cut between them is certain: fragments
are encoded each on its own and concatenated. The tokenizer also cuts a text by a pattern before it merges; that pattern sees
more than two bytes, so a cut is used only where the pattern cuts as well, whatever surrounds it: between a character
that is no white space and a white space, and between ASCII letters, digits and other signs (but for an apostrophe before a
letter, which may start a contraction). Non-ASCII characters count as the left side only in two-byte forms from U+00C0,
none of which is white space. Text of an added token holds its own byte pairs, so it is never cut.

Fragments repeat, so a worker process keeps ``KEPT`` of those it has encoded at most, which bounds memory and changes no result. A tokenizer whose pattern is another one gets no cuts and encodes whole texts.

Defined cases: a null or empty text has no ids and decodes to an empty text; a very long text is many fragments; columns of any
name pass through.
"""

from __future__ import annotations

import json
import struct
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkrules.llm.tables import body, packed, with_fields

KEPT = 1_200_000  # some 200 MB
ROWS = 256  # per batch that a task returns
SPACES = b"\t\n\x0b\x0c\r "


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Encoded fragments; a new one is encoded when it is asked for.

    Two generations of ``KEPT`` / 2 fragments at most: what was asked for since the last turn survives the next.
    """

    def __init__(self, ids: Callable[[bytes], list[int]]):
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, fragment: bytes) -> bytes:
        if len(self) >= KEPT // 2:
            self.older = dict(self)
            self.clear()
        out = self.older.get(fragment)
        if out is None:
            out = struct.pack(f"<{len(ids := self.ids(fragment))}I", *ids)
        self[fragment] = out
        return out


def codec(path: str) -> Codec:
    """The codec of this worker process, made by its first task."""
    kept = sys.modules.setdefault("_sparkrules_codecs", types.ModuleType("_sparkrules_codecs")).__dict__
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


class Codec:
    """One task's tokenizer: ``encode`` and ``decode`` of whole texts by certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        stand_in = byte_alphabet()
        to_byte = {ord(c): b for c, b in stand_in.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = token.translate(to_byte).encode("latin-1")
        for token in spec["added_tokens"]:
            self.pieces[token["id"]] = token["content"].encode()
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and normal is None and plain
        self.certain = self._certain() if known else None
        self.kept = _Kept(self._ids)
        self.model, self.stand_in = self.tokenizer.model, {b: c for c, b in stand_in.items()}

    def _certain(self) -> np.ndarray:
        """By first and second byte: whether a cut between them is certain."""
        inside = np.zeros((256, 256), bool)
        codes = np.frombuffer(b"".join(self.pieces), np.uint8)
        neighbours = np.ones(len(codes), bool)
        neighbours[np.cumsum([len(p) for p in self.pieces if p]) - 1] = False  # the last byte of a piece has none
        at = np.flatnonzero(neighbours)
        inside[codes[at], codes[at + 1]] = True
        kind = np.full(256, 4)  # no ASCII: never the right side of a cut
        kind[:128] = 3
        for b in range(128):
            kind[b] = 0 if b in SPACES else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
        kind[0x1C:0x20] = 4  # separators that some patterns take for white space
        left, right = kind[:, None], kind[None, :]
        cut = (left != 0) & (right == 0) & (left != 4) | (left != right) & (left > 0) & (left < 4) & (right > 0) & (right < 4)
        cut[0x80:0xC0] = kind[None, :] == 0  # the end of a two-byte character, checked by ``encode``
        cut[ord("'"), [b for b in range(128) if kind[b] == 1]] = False
        return (cut & ~inside).reshape(-1)

    def fragments(self, raw: bytes) -> list[bytes]:
        if self.certain is None or len(raw) < 2:
            return [raw] if raw else []
        codes = np.frombuffer(raw, np.uint8)
        cut = self.certain[(codes[:-1].astype(np.uint16) << 8) | codes[1:]]
        high = np.flatnonzero(cut & (codes[:-1] >= 0x80))
        if len(high):
            lead = codes[high - 1]
            cut[high[~((lead >= 0xC3) & (lead <= 0xDF))]] = False
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, fragment: bytes) -> list[int]:
        """A fragment of letters only or of ASCII digits only, with a blank before it or none, is one piece to the pattern too, so
        the library's merges can be asked for it directly; any other goes through the whole tokenizer."""
        text = fragment.decode()
        blank = text[0] == " "
        plain = text[1:] if blank else text
        if self.certain is None or not (plain.isalpha() or plain.isdigit()):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if plain.isascii():  # printable bytes stand for themselves
            return [t.id for t in self.model.tokenize(self.stand_in[32] + plain if blank else plain)]
        if plain.isalpha() and max(plain) < "\u0250":
            return [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.stand_in))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        ids = self.kept.__getitem__
        return [np.frombuffer(b"".join(map(ids, self.fragments(t.encode()))), "<u4") for t in texts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, *carry: str) -> DataFrame:
    """The ``carry`` columns and ``ids``, the token ids of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, texts = batch.slice(at, ROWS).columns
                yield pa.RecordBatch.from_arrays([rows, _lists(coder.encode_many(texts.to_pylist()))], ["_row", "ids"])

    df = docs.select(packed(carry), body().alias("_text"))
    return df.mapInArrow(run, with_fields(df, "ids array<int>")).select("_row.*", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``; special tokens are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, lists = batch.slice(at, ROWS).columns
                texts = [coder.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in lists]
                yield pa.RecordBatch.from_arrays([rows, lists, pa.array(texts, pa.string())], ["_row", "ids", "decoded"])

    df = encoded.select(packed(c for c in encoded.columns if c != "ids"), "ids")
    return df.mapInArrow(run, with_fields(df, "ids array<int>, decoded string")).select("_row.*", "ids", "decoded")


def round_trip(docs: DataFrame, path: str, *carry: str) -> DataFrame:
    """The ``carry`` columns, ``ids`` and ``decoded``, in one pass: one worker and one tokenizer per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, texts = batch.slice(at, ROWS).columns
                ids = coder.encode_many(texts.to_pylist())
                decoded = pa.array(map(coder.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([rows, _lists(ids), decoded], ["_row", "ids", "decoded"])

    df = docs.select(packed(carry), body().alias("_text"))
    return df.mapInArrow(run, with_fields(df, "ids array<int>, decoded string")).select("_row.*", "ids", "decoded")


def digests(coded: DataFrame, *carry: str) -> DataFrame:
    """``n_tokens`` and the digests of the ids and the decoded text."""
    return coded.select(
        *carry,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

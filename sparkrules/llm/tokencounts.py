"""Token counts by a digest cache.

The cache is a table in the shared folder, one folder per tokenizer version: the SHA-256 of a content and its number of tokens. A tokenizer
version is the SHA-256 of the vocabulary file's bytes with the library's name and release, so a count is never read for another tokenizer. A
content is what the tokenizer sees of a text: the text itself, or for a tokenizer with a normalizer the normalised text, so that texts it
cannot tell apart share one entry. (Where a special string stands in the text or arises in its normalised form, the text itself is the
content, since such strings are looked for in both.) A count

1. names the content of every row and takes one row per content,
2. drops the contents that the cache of this tokenizer version holds,
3. encodes the texts of these misses only, each once, and appends their counts to the cache,
4. joins the counts back to every row.

Copies are encoded once however many rows hold them. The hot content of step 4 is one key of an ordinary left join on slim rows, whose skew
AQE splits; no text is grouped. Appended files are whole or absent, so a run that was broken off repeats only its own misses; should two runs
append the same content, equal counts collapse on reading.

Defined cases: a null text is an empty one and has no tokens; repeated rows are returned each; null ids are ids; a very long text is one
value; an empty table gives no rows and appends none; columns that are not carried are not read.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import sys
import types
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrules.llm.bpe import codec
from sparkrules.llm.tables import body, pieces
from sparkrules.storage import scratch_path, stored

CACHE = "version string, content string, n_tokens long"
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece"}


def version(vocabulary: str) -> str:
    """The digest of a tokenizer: its file's bytes, its library and that library's release."""
    library = LIBRARIES[Path(vocabulary).suffix]
    seal = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    seal.update(Path(vocabulary).read_bytes())
    return seal.hexdigest()


class Counter:
    """One worker's tokenizer: ``content`` of a text and ``count`` of its tokens."""

    def __init__(self, vocabulary: str):
        self.marks: list[str] = []
        if vocabulary.endswith(".model"):
            import sentencepiece

            pieces_of = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            self.normalizer = None  # its normalisation is part of the encoding
            self.count: Callable[[str], int] = lambda text: len(pieces_of.encode(text, add_bos=False, add_eos=False))
            return
        own = codec(vocabulary)
        self.normalizer = own.tokenizer.normalizer
        self.marks = [t.content for t in own.tokenizer.get_added_tokens_decoder().values()]
        self.count = lambda text: len(own.encode(text))

    def content(self, text: str) -> str:
        """What the tokenizer sees of a text, marked as normalised or not."""
        if self.normalizer is None:
            return text
        seen = self.normalizer.normalize_str(text)
        return f"0{text}" if any(m in text or m in seen for m in self.marks) else f"1{seen}"


def counter(vocabulary: str) -> Counter:
    """The counter of this worker process, made by its first task."""
    kept = sys.modules.setdefault("_sparkrules_counters", types.ModuleType("_sparkrules_counters")).__dict__
    if vocabulary not in kept:
        kept[vocabulary] = Counter(vocabulary)
    return kept[vocabulary]


def start_cache(spark: SparkSession) -> str:
    """The path of a new, empty cache in the shared folder."""
    path = scratch_path(spark)
    spark.createDataFrame([], CACHE).write.partitionBy("version").parquet(path)
    return path


def read_cache(spark: SparkSession, cache: str, vocabulary: str) -> DataFrame:
    """``content, n_tokens`` of one tokenizer version; only its folder is read."""
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version(vocabulary))
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def contents(docs: DataFrame, vocabulary: str, *carry: str | Column) -> DataFrame:
    """The carried columns and ``content``, the digest of what the tokenizer sees of ``text``."""
    if counter(vocabulary).normalizer is None:
        return docs.select(*carry, F.sha2(body(), 256).alias("content"))
    df = docs.select(F.struct(*carry).alias("_row"), body().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for rows, texts in pieces(batches):
            named = [hashlib.sha256(own.content(t.as_py()).encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([rows, pa.array(named, pa.string())], ["_row", "content"])

    return df.mapInArrow(run, df.select("_row", F.lit("").alias("content")).schema).select("_row.*", "content")


def misses(named: DataFrame, known: DataFrame) -> DataFrame:
    """``content, key``: the contents of ``named(key, content)`` that are not known, and one row that holds each."""
    return named.groupBy("content").agg(F.min("key").alias("key")).join(known.select("content"), "content", "left_anti")


def update(docs: DataFrame, cache: str, vocabulary: str, key: str = "doc_id", named: DataFrame | None = None) -> DataFrame:
    """Encode the contents that the cache lacks and append their counts. Returns these misses.

    ``named`` may hold ``key, content`` of the same rows, where a caller has them already.
    """
    spark = docs.sparkSession
    if named is None:
        named = contents(docs, vocabulary, F.col(key).alias("key"))
    todo = stored(misses(named, read_cache(spark, cache, vocabulary)))
    texts = contents(docs, vocabulary, F.col(key).alias("key"), body().alias("text"))
    # no broadcast by hand: AQE sends a small rest of misses to the texts, and a first run is a plain shuffle
    picked = texts.join(todo, (texts["content"] == todo["content"]) & texts["key"].eqNullSafe(todo["key"])).select(texts["content"], "text")
    seal = version(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for names, held in pieces(batches):
            counts = [own.count(t.as_py()) for t in held]
            yield pa.RecordBatch.from_arrays([pa.array([seal] * len(names)), names, pa.array(counts, pa.int64())], ["version", "content", "n_tokens"])

    picked.mapInArrow(run, CACHE).write.mode("append").partitionBy("version").parquet(cache)
    return todo.select("content")


def counts(docs: DataFrame, cache: str, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """Bring the cache up to date with ``docs`` and return ``key, n_bytes, content, n_tokens`` of every row."""
    named = stored(contents(docs, vocabulary, F.col(key).alias("key"), F.octet_length(body()).cast("long").alias("n_bytes")))
    update(docs, cache, vocabulary, key, named)
    known = read_cache(docs.sparkSession, cache, vocabulary)
    out = named.join(known, "content", "left")
    return out.select(F.col("key").alias(key), "n_bytes", "content", F.col("n_tokens"))

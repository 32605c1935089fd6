import random
import shutil

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkrules.llm import tokencounts as t

TEXTS = ["The cat sat.", "", None, "the CAT  sat.", "<|endoftext|> and <|ENDOFTEXT|>", "é" * 3000 + " x", "日本語 🙂 text\n\n\tx", "word " * 5000, "it's 12345 don't"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text or ""))
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tables, name):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, "other"), (None, TEXTS[0]), (None, None), (77, TEXTS[0])]
    count = library(name)
    got = t.counts(tables(rows), t.start_cache(spark), public_tokenizers.path(name))
    want = [(i, len((text or "").encode()), count(text)) for i, text in rows]
    assert sorted(map(str, got.select("doc_id", "n_bytes", "n_tokens").collect())) == sorted(f"Row(doc_id={i}, n_bytes={b}, n_tokens={n})" for i, b, n in want)


def test_only_misses_are_encoded(spark, tables, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = t.start_cache(spark)
    first = tables([(1, "a b"), (2, "c"), (3, "a b"), (4, None), (5, "")])
    assert t.update(first, cache, path).count() == 3
    assert t.update(first, cache, path).count() == 0
    assert t.update(tables([(9, "c"), (9, "new")]), cache, path).count() == 1
    assert t.read_cache(spark, cache, path).count() == 4
    # a count that stands in the cache is taken, not computed
    row = spark.createDataFrame([(t.version(path), t.contents(tables([(1, "stored")]), path).first()[0], 7)], t.CACHE)
    row.write.mode("append").partitionBy("version").parquet(cache)
    assert [r.n_tokens for r in t.counts(tables([(1, "stored")]), cache, path).collect()] == [7]
    # another vocabulary file is another version
    other = str(tmp_path / "vocabulary.json")
    shutil.copyfile(path, other)
    with open(other, "a") as file:
        file.write("\n")
    assert t.version(other) != t.version(path) and t.read_cache(spark, cache, other).count() == 0
    assert t.update(first, cache, other).count() == 3


def test_texts_that_a_normalizer_makes_equal_share_an_entry(spark, tables):
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = t.start_cache(spark)
    docs = tables([(1, "The cat"), (2, "the  CAT"), (3, "<|endoftext|>"), (4, "<|ENDOFTEXT|>")])
    got = {r.doc_id: (r.content, r.n_tokens) for r in t.counts(docs, cache, path).collect()}
    assert got[1] == got[2] and got[3][0] != got[4][0]
    assert t.read_cache(spark, cache, path).count() == 3


def test_empty_table_and_a_hot_copy(spark, tables):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = t.start_cache(spark)
    assert t.counts(tables([]), cache, path).collect() == []
    words = random.Random(1).choices("ab cd ef".split(), k=300)
    rows = [(i, "hot copy" if i % 3 else f"{words[i]} {i}") for i in range(300)]
    assert t.update(tables(rows), cache, path).count() == 101
    assert t.counts(tables(rows), cache, path).filter("n_tokens is null").count() == 0

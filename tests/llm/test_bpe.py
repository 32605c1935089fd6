import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkrules.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", "\n\n\nfoo  bar\n \n x", "it's we're I'll 'tis 's 'S !!'s a's<|endoftext|>b <|endoftext|> c <|endof", "é à     x　y 日本 z",
    "12ab34,5;6 a1b2 \t\tq\r\n", "😀😀 x😀y", "x" * 5000 + " " + "'" * 50 + "ll", "a \x1c b\x1d\x1e\x1fc \x85 d᠎ e​ f", "0x1F 3.14e-5 foo_bar's 'll",
]


def test_equals_the_library_on_any_text():
    library, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    random.seed(1)
    texts = ODD + ["".join(random.choices("ab'sltre. \n\t é😀1,<|>　 \x0b\x1cÀß\xa0\x85", k=random.randint(1, 60))) for _ in range(20_000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        mine = codec.encode(text)
        assert mine.tolist() == ids, text
        assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)
    assert len(codec.fragments(b"one two, three")) > 3  # it does cut
    assert codec.decode(np.array([220, 5, 161], "<u4")) == library.decode([220, 5, 161], skip_special_tokens=False)


def test_other_vocabularies_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), None
    try:
        codec = bpe.Codec(path)
    except KeyError:
        return  # its pieces are not bytes
    assert codec.certain is None
    assert codec.encode("Some Words here").tolist() == library.encode("Some Words here", add_special_tokens=False).ids


def test_tables(spark, tables):
    rows = [*enumerate(ODD), (1, "a"), (None, None), (50, "word " * 40_000)]
    out = bpe.round_trip(tables(rows), PATH, "doc_id", "_text", "text.x").collect()
    library = Tokenizer.from_file(PATH)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=str)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
    assert bpe.round_trip(tables([]), PATH, "doc_id").collect() == []


def test_half_a_million_fragments_are_encoded_once():
    asked = []
    kept = bpe._Kept(lambda fragment: asked.append(fragment) or [1])
    names = [b"%d" % i for i in range(500_000)]
    for _ in range(2):
        for name in names:
            kept[name]
    assert len(asked) == len(names)

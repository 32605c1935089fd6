import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkrules.llm import wavelet as w
from sparkrules.storage import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (63, 3), (64, 50257), (65, 2), (5000, 300), (100_000, 50257), (1000, 1 << 20), (1 << 16, 7), ((1 << 17) + 1, 40)])
def test_access_rank_and_select(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    matrix = w.WaveletMatrix.from_bytes(w.WaveletMatrix.build(ids).to_bytes())
    assert (matrix.ids() == ids).all()
    if not n:
        return
    at = np.random.default_rng(1).integers(0, n, 50)
    assert (matrix.access(at) == ids[at]).all()
    for token in {*ids[:5].tolist(), top + 7}:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places) and matrix.locate(token).tolist() == places.tolist()
        assert matrix.count(token, n // 3, n - 1) == ((places >= n // 3) & (places < n - 1)).sum()
        assert [matrix.select(token, k) for k in range(min(4, len(places)))] == places[:4].tolist()
        with pytest.raises(IndexError):
            matrix.select(token, len(places))


def test_answers_unpack_only_the_blocks_they_touch():
    ids = np.random.default_rng(3).integers(0, 50257, 20 * w.BITS)
    ids[7 * w.BITS + 11] = 60_000
    raw = w.WaveletMatrix.build(ids).to_bytes()
    levels = 16

    def unpacked(ask):
        matrix = w.WaveletMatrix.from_bytes(raw)
        return ask(matrix), sum(p.unpacked for p in matrix.planes), sum(len(p.frames) for p in matrix.planes)

    at = 13 * w.BITS + 5
    assert unpacked(lambda m: m.access(np.array([at])).tolist()) == ([ids[at]], levels, 21 * levels)
    counted, blocks, _ = unpacked(lambda m: m.count(60_000, 0, at))
    assert counted == 1 and blocks <= 2 * levels  # both ends of the range, which soon meet in one block
    assert unpacked(lambda m: m.locate(60_000).tolist())[0] == [7 * w.BITS + 11]
    assert unpacked(lambda m: m.select(60_000, 0))[1] <= 3 * levels


def test_files_hold_all_documents(spark, tables):
    rows = [(5, "some words here"), (2, None), (9, ""), (5, "another text"), (-1, "x " * 9000), (None, "null id"), (2**40, "last")]
    path = scratch_path(spark)
    w.write_shards(tables(rows), path, PATH, 2, shard_tokens=1000)
    shards = w.read_shards(spark, path)
    got = sorted((tuple(r) for r in w.documents(shards).collect()), key=lambda r: r[1])
    library = Tokenizer.from_file(PATH)
    coded = {(i, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert [r[0] for r in got] == [None, -1, 2, 5, 5, 9, 2**40]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    assert sorted((r[2:] for r in got)) == sorted((len(x), zlib.crc32(x)) for x in coded.values())
    assert {r.token: r.n for r in w.token_counts(shards, [2, 2124]).collect()} == {t: sum(int((x == t).sum()) for x in coded.values()) for t in (2, 2124)}
    assert sorted(r.place for r in w.occurrences(shards, 2).collect()) == [r[1] + r[2] - 1 for r in got]


def test_an_empty_table_has_no_documents(spark, tables):
    path = scratch_path(spark)
    w.write_shards(tables([]), path, PATH, 2)
    assert w.documents(w.read_shards(spark, path)).collect() == []

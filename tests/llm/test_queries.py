"""The registered queries over whole small tables: SQL twins, brute force, and the pipeline against its parts."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
from check_oracles import compare, connect
from test_decontaminate import brute as hits_of
from test_nearcopies import brute as one_of_each
from test_periodic import brute as repeating
from test_periodic import planted
from test_pii import brute as private
from test_quality import brute as statistics
from test_quality import verdicts
from test_secrets import brute as secret
from test_simhash import brute as fingerprint
from test_simhash import roots
from test_suffixes import brute as repeats
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from sparkrules.llm import pii
from sparkrules.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def digest(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rows(spark, sf_dir, name):
    out = registry.queries()[name](spark, sf_dir).collect()
    assert out
    return out


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(connect(sf_dir), registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])[0] == "ok"


def test_op2(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows(spark, sf_dir, "op2_secrets")}
    for i, r in docs.items():
        spans = secret(r.text)
        counts = Counter(k for k, _, _ in spans)
        assert got[i] == (counts["assign"], counts["access"], counts["hex"], digest(listed(spans)))


def test_op4(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows(spark, sf_dir, "op4_pii")}
    for i, r in docs.items():
        spans = private(r.text)
        counts = Counter(k for k, _, _ in spans)
        assert got[i] == (*(counts[k] for k in pii.KINDS), digest(listed(spans)))


def test_op5(spark, sf_dir, docs):
    prints = {i: fingerprint(r.text) for i, r in docs.items()}
    pairs = [(i, k) for i in prints for k in prints if k < i and (prints[i] ^ prints[k]).bit_count() <= 2]
    want = roots(prints, pairs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf_dir, "op5_simhash")} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_op6(spark, sf_dir, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, sf_dir, "op6_bpe"):
        ids = library.encode(docs[r.doc_id].text, add_special_tokens=False).ids
        want = len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op8(spark, sf_dir, docs):
    want = dict(zip(docs, verdicts([(r.text, r.lang, r.source) for r in docs.values()])))
    for r in rows(spark, sf_dir, "op8_quality"):
        assert tuple(r[1:7]) == statistics(docs[r.doc_id].text)
        distance, kept = want[r.doc_id]
        assert r.kept == kept and abs(r.distance - distance) <= 1e-6 * (1 + distance)


def test_op9(spark, sf_dir, docs):
    found = sorted(rows(spark, sf_dir, "op9_wavelet"))
    assert [r.doc_id for r in found] == sorted(docs)
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in found:
        ids = [*library.encode(docs[r.doc_id].text, add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc)
        at += len(ids)


def test_op10(spark, sf_dir, docs):
    order = sorted(docs)
    want = {i: (n, sum(b - a for a, b in spans), len(spans), digest(kept)) for i, (n, spans, kept) in zip(order, repeats([docs[i].text for i in order], 400))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf_dir, "op10_suffixes")} == want


def test_op12(spark, sf_dir, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, sf_dir, "op12_tokencounts"):
        n = len(library.encode(docs[r.doc_id].text, add_special_tokens=False).ids)
        assert tuple(r) == (r.doc_id, len(docs[r.doc_id].text.encode()), n, n > 1024)


def test_op13(spark, sf_dir, docs):
    found = rows(spark, sf_dir, "op13_periodic")
    assert {r.doc_id for r in found} == set(docs) and sum(r.n_runs > 0 for r in found) > 10
    for r in found:
        runs, collapsed = repeating(planted(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text), r.doc_id))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(r) == (r.doc_id, len(runs), *best, milli, digest(listed), digest(collapsed))


def test_pipeline_against_brute_force(spark, sf_dir, docs):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = verdicts([(r.text, r.lang, r.source) for r in docs.values()])
    kept = {i: r for (i, r), (_, keep) in zip(docs.items(), judged) if keep}
    kept = {i: kept[i] for i in one_of_each([(i, r.text) for i, r in kept.items()])}
    kept = {i: r for i, r in kept.items() if not hits_of(r.text, bench)[1]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in rows(spark, sf_dir, "pipeline")}
    assert got.keys() == kept.keys() and 4 <= len(corpus_pipeline.STAGES) <= 5
    for i, r in got.items():
        text = pii.masked(kept[i].text)
        assert (r.decoded, r.source, r.lang) == (text, kept[i].source, kept[i].lang)
        assert r.ids == library.encode(text, add_special_tokens=False).ids
    assert any("[EMAIL]" in r.decoded for r in got.values())

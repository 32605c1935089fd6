"""One registered query per operator, over whole tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrules.llm import bpe, decontaminate, paragraphs, periodic, pii, prefixtrie, quality, secrets, simhash, suffixes, tokencounts, urlrules, wavelet
from sparkrules.storage import scratch_path


VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (SELECT DISTINCT id AS item_id, least(len(words), 10) AS n, array_to_string(list_slice(words, s + 1, s + least(len(words), 10)), ' ') AS gram
  FROM (SELECT *, unnest(range(greatest(len(words) - 9, 1))) AS s FROM w WHERE kind = 'i' AND len(words) > 0)),
t AS (SELECT id AS doc_id, n, s, array_to_string(list_slice(words, s + 1, s + n), ' ') AS gram
  FROM (SELECT id, words, n, unnest(range(len(words) - n + 1)) AS s FROM w, (SELECT DISTINCT n FROM g) WHERE kind = 'd' AND len(words) >= n)),
h AS (SELECT doc_id, s, t.n, item_id FROM t JOIN g USING (gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT w.id AS doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.id LEFT JOIN i ON i.doc_id = w.id WHERE w.kind = 'd'"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), secrets.start_ledger(spark))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *map(count, secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        "blob",
    )


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(v, length(h || r.p)) AS verdict FROM p, r
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"), "doc_id")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.joined("spans", True), 256).alias("base_sha256"), pii.joined("spans", False).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), "doc_id")
    return bpe.digests(coded, "doc_id")


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removals: every place of a cluster of paragraphs or passages but the one that is kept, which stands beside it."""
    return paragraphs.removals(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.report(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "distance")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    wavelet.write_shards(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), end_id=2)
    return wavelet.documents(wavelet.read_shards(spark, path))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.removed(_table(spark, sf_dir, "documents"), "doc_id")
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("conv_id")
    found = prefixtrie.trie(_table(spark, sf_dir, "conversations"), base=own - own % 5, head=F.crc32(own.cast("string")) % 9)
    digests = prefixtrie.ends_digests(found.ends)
    none = F.sha2(F.lit(""), 256)
    return found.nodes.join(digests, ["conv_id", "depth"], "left").select(*found.nodes.columns, F.coalesce("ends_sha256", none).alias("ends_sha256"))


OP11_SQL = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)), xor(a, b)), 4294967295::BIGINT)) % 9 AS h FROM n),
r AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(b.n, 0)) + pos - h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h LEFT JOIN n b ON b.conv_id = base),
s AS (SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY d) FILTER (d IS NOT NULL), []) AS q FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, len(q) AS n, depth, list_slice(q, 1, depth) AS path FROM (SELECT *, unnest(range(len(q) + 1)) AS depth FROM s)),
v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(path[depth].t) ELSE 0 END AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY path, depth),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
u AS (SELECT list_slice(path, 1, i) AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS i FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN u ON u.path = f.path LEFT JOIN f p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1)"""


def op12_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencounts.counts(_table(spark, sf_dir, "documents"), tokencounts.start_cache(spark), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in one text of ten the words from ``a`` on repeat those from ``a`` to ``a + p``, by a checksum of the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    df = df.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    first = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    rest = (F.col("n") - F.col("a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(first, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return df.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(_periodic_tails(_table(spark, sf_dir, "documents")), "doc_id")
    digests = F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", *digests)


QUERIES = {
    "op1_decontaminate": (op1_decontaminate, OP1_SQL),
    "op2_secrets": (op2_secrets, None),
    "op3_urlrules": (op3_urlrules, OP3_SQL),
    "op4_pii": (op4_pii, None),
    "op5_simhash": (op5_simhash, None),
    "op6_bpe": (op6_bpe, None),
    "op7_paragraphs": (op7_paragraphs, None),
    "op8_quality": (op8_quality, None),
    "op9_wavelet": (op9_wavelet, None),
    "op10_suffixes": (op10_suffixes, None),
    "op11_prefixtrie": (op11_prefixtrie, OP11_SQL),
    "op12_tokencounts": (op12_tokencounts, None),
    "op13_periodic": (op13_periodic, None),
}

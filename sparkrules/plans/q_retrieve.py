"""Registered queries over retrieval, packing and prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.operators import retrieve
from sparkrules.operators.curate import stack
from sparkrules.plans.inputs import dealt, load, with_inputs

BUDGET = 4060
K = 45
ALL = 10**9  # the twin ranks every row and packs
SEED = 5
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _words_sql(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(trim({column}, {_WS}), '\s+'), lambda x: x <> '')"


def _grams_sql(n: int) -> str:
    """Distinct n-grams of questions (q) and exemplars (d)."""
    if n == 1:
        body = "unnest(list_distinct(w))"
    else:
        body = "unnest(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]))"
    return f"""q AS MATERIALIZED (SELECT query_id, {body} AS g FROM (SELECT query_id, {_words_sql('text')} AS w FROM questions)),
    d AS MATERIALIZED (SELECT row_id, {body} AS g FROM (SELECT row_id, {_words_sql('text')} AS w FROM exemplars)),
    o AS MATERIALIZED (SELECT query_id, row_id, count(*) AS overlap FROM q JOIN d USING (g) GROUP BY ALL)"""


def _topk_sql(n: int, k: int) -> str:
    return f"""{_grams_sql(n)}, a AS (SELECT query_id, row_id, coalesce(overlap, 0) AS overlap FROM (SELECT query_id, row_id FROM questions, exemplars)
        LEFT JOIN o USING (query_id, row_id)),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, row_id) AS rank FROM a QUALIFY rank <= {k})"""


def _inputs(spark, sf):
    return load(spark, sf, "questions"), dealt(load(spark, sf, "exemplars"))


def ngram_overlap(spark, sf):
    return retrieve.ngram_overlap(*_inputs(spark, sf), 2)


def _topk(n, k):
    def query(spark, sf):
        return retrieve.ngram_topk(*_inputs(spark, sf), n, k)

    return query


def diverse_exemplars(spark, sf):
    return retrieve.diverse_exemplars(*_inputs(spark, sf), 10, SEED)


def _diverse_sql(k: int) -> str:
    """One row a step: the best eligible row of the pass, or, where there is none, the next pass."""
    second = _grams_sql(2).replace("q AS", "q2 AS").replace("d AS", "d2 AS").replace("o AS", "o2 AS").replace("FROM q JOIN d", "FROM q2 JOIN d2")
    body = f""", {_grams_sql(1)}, {second},
    w AS MATERIALIZED (SELECT row_id, text, list_distinct({_words_sql('text')}) AS w FROM exemplars),
    p AS (SELECT query_id, step, 1 + CAST(floor(CAST('0x' || substr(md5(concat_ws(':', query_id, step, {SEED})), 1, 8) AS BIGINT) / 4294967296.0 * 2) AS INT) AS n
      FROM questions, (SELECT unnest(range(1, {k + 2})) AS step)),
    s AS (SELECT query_id, 1 AS step, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS now, CAST([] AS VARCHAR[]) AS met, CAST([] AS VARCHAR[]) AS past,
        CAST(0 AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS row_id FROM questions
      UNION ALL SELECT query_id, CASE WHEN best IS NULL THEN step + 1 ELSE step END, CASE WHEN best IS NULL THEN [] ELSE list_distinct(list_concat(used, w)) END,
        CASE WHEN best IS NULL THEN [] ELSE list_append(now, best) END, CASE WHEN best IS NULL THEN [] ELSE list_append(met, text) END,
        CASE WHEN best IS NULL THEN list_concat(past, met) ELSE past END, CASE WHEN best IS NULL THEN pick ELSE pick + 1 END, best
      FROM (SELECT s.*, w.row_id AS best, w.w, w.text FROM s JOIN p USING (query_id, step) LEFT JOIN w
            ON NOT list_has_any(w.w, s.used) AND NOT list_contains(s.now, w.row_id) AND NOT list_contains(s.past, w.text)
          LEFT JOIN o ON n = 1 AND o.query_id = s.query_id AND o.row_id = w.row_id LEFT JOIN o2 ON n = 2 AND o2.query_id = s.query_id AND o2.row_id = w.row_id
          WHERE s.pick < {k} QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY coalesce(o.overlap, o2.overlap, 0) DESC, w.row_id) = 1)
      WHERE best IS NOT NULL OR len(now) > 0)
    SELECT query_id, pick, row_id FROM s WHERE row_id IS NOT NULL"""
    return with_inputs(body, "questions", "exemplars", recursive=True)


def _vector_hits(spark, sf, k):
    vectors = load(spark, sf, "vectors")
    return retrieve.vector_topk(vectors.withColumnRenamed("row_id", "query_id"), vectors, k)


def vector_topk(spark, sf):
    return _vector_hits(spark, sf, 45)


VECTOR_SQL = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS row_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s
    FROM embeddings q, embeddings e)
  SELECT query_id, row_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM s"""


def hit_union(spark, sf):
    """First hits of every question text among the exemplars, and of every vector."""
    questions, exemplars = _inputs(spark, sf)
    texts = retrieve.hit_union(retrieve.ngram_topk(questions, exemplars, 1, 1)).withColumn("kind", F.lit("text"))
    vectors = retrieve.hit_union(_vector_hits(spark, sf, 1)).withColumn("kind", F.lit("vector"))
    return stack([texts, vectors])


def _packed(spark, sf):
    questions, exemplars = _inputs(spark, sf)
    return retrieve.pack_exemplars(questions, exemplars, budget=BUDGET)


def pack_budget(spark, sf):
    return _packed(spark, sf).select("query_id", "rank", "row_id", "n_tokens", "packed_tokens")


_BLOCK = "'Source: ' || code || ' ' || text || chr(10) || 'Target: ' || rule"
_QUESTION = "'Source: ' || code || ' ' || text || chr(10) || 'Target: '"
PACKED_SQL = f"""{_topk_sql(1, ALL)},
  b AS MATERIALIZED (SELECT row_id, {_BLOCK} AS block, len({_words_sql(_BLOCK)}) AS n_tokens FROM exemplars),
  m AS (SELECT max(len({_words_sql(_QUESTION)})) AS longest FROM questions),
  p AS MATERIALIZED (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS packed_tokens FROM r JOIN b USING (row_id)),
  k AS MATERIALIZED (SELECT p.* FROM p, m WHERE packed_tokens <= {BUDGET} - longest)"""


def max_pair_tokens(spark, sf):
    _, exemplars = _inputs(spark, sf)
    return retrieve.max_pair_tokens(exemplars, retrieve.block_text(F.col("code"), F.col("text"), F.col("rule")))


def exemplar_prompts(spark, sf):
    questions, exemplars = _inputs(spark, sf)
    return retrieve.exemplar_prompts(questions, exemplars, budget=BUDGET)


def exemplar_prompts_reversed(spark, sf):
    questions, exemplars = _inputs(spark, sf)
    return retrieve.exemplar_prompts(questions, exemplars, budget=BUDGET, context="Read each clause. ", nearest_last=True)


def _prompts_sql(order: str, context: str) -> str:
    sql = PACKED_SQL
    if context:
        sql = sql.replace(f"{BUDGET} - longest", f"{BUDGET} - longest - {len(context.split())}")
    return with_inputs(
        f""", {sql}, g AS (SELECT query_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY rank {order}) AS t FROM k GROUP BY query_id)
        SELECT query_id, coalesce(n, 0) AS n_exemplars, '{context}' || coalesce(t, '') || chr(10) || chr(10) || {_QUESTION} AS prompt
        FROM questions LEFT JOIN g USING (query_id)""",
        "questions",
        "exemplars",
    )


CONTEXT, CLOSING = "Read each clause. ", "One worked answer follows."


def given_prompts(spark, sf):
    """The same exemplars for every question: documents in order of their id."""
    questions, exemplars = _inputs(spark, sf)
    return retrieve.given_prompts(exemplars, questions, budget=BUDGET, context=CONTEXT, nearest_last=True)


def reasoning_prompts(spark, sf):
    """Given exemplars ahead of the context, a closing text, and a query that asks for steps."""
    questions, exemplars = _inputs(spark, sf)
    asked = retrieve.reasoning_text(F.col("code"), F.col("text"), step_by_step=True)
    layout = ("exemplars", "context", "closing")
    return retrieve.given_prompts(exemplars, questions, budget=BUDGET, context=CONTEXT, closing=CLOSING, layout=layout, query=asked)


def _given_sql(order: str, texts: str, prompt: str) -> str:
    """Prompts from one prefix of the exemplars; ``prompt`` puts the parts around their text ``t`` together."""
    return with_inputs(
        f""", b AS (SELECT row_id, {_BLOCK} AS block, len({_words_sql(_BLOCK)}) AS n_tokens FROM exemplars),
        m AS (SELECT max(len({_words_sql(_QUESTION)})) AS longest FROM questions),
        p AS (SELECT *, sum(n_tokens) OVER (ORDER BY row_id) AS packed FROM b),
        g AS (SELECT count(*) AS n, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY row_id {order}), '') AS t FROM p, m WHERE packed <= {BUDGET} - longest - {len(texts.split())})
        SELECT query_id, n AS n_exemplars, {prompt} AS prompt FROM questions, g""",
        "questions",
        "exemplars",
    )


def exemplar_counts(spark, sf):
    packed = _packed(spark, sf).withColumn("run", F.lit("unigram_4060"))
    return retrieve.exemplar_counts(packed).withColumn("mean_exemplars", F.round("mean_exemplars", 6))


def reflection_prompts(spark, sf):
    candidates = load(spark, sf, "candidates")
    rows = candidates.filter("cand_id = 0").select("row_id", "code", "text", "rule")
    return retrieve.reflection_variants(candidates, rows, ("choose", "options", "improve"), SEED)


REFLECTION_SQL = with_inputs(
    f""", o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY md5(concat_ws(':', row_id, cand_id, {SEED})), cand_id) - 1 AS pos FROM candidates),
    g AS (SELECT row_id, any_value(code) AS code, any_value(text) AS text, any_value(rule) AS rule, string_agg(pred, chr(10) ORDER BY pos) AS plain,
        string_agg('Option ' || pos || ': ' || pred, chr(10) ORDER BY pos) AS opts, arg_max(pred, score * 1000 + cand_id) AS best, arg_max(pos, score * 1000 + cand_id) AS best_pos
      FROM o GROUP BY row_id),
    m AS (SELECT unnest(['choose', 'options', 'improve']) AS mode), w AS (SELECT unnest([false, true]) AS with_answer)
    SELECT row_id, mode, with_answer, 'Source: ' || code || ' ' || text || chr(10) || CASE mode WHEN 'options' THEN opts ELSE plain END || chr(10) || 'Target: ' ||
      CASE WHEN NOT with_answer THEN '' WHEN mode = 'choose' THEN best WHEN mode = 'options' THEN 'Option ' || best_pos ELSE rule END AS prompt FROM g, m, w""",
    "candidates",
)

QUERIES = {
    "ngram_overlap": (
        ngram_overlap,
        with_inputs(f", {_grams_sql(2)} SELECT query_id, row_id, overlap FROM o", "questions", "exemplars"),
    ),
    "ngram_topk": (
        _topk(1, K),
        with_inputs(f", {_topk_sql(1, K)} SELECT query_id, row_id, overlap, rank FROM r", "questions", "exemplars"),
    ),
    "bigram_topk": (
        _topk(2, 10),
        with_inputs(f", {_topk_sql(2, 10)} SELECT query_id, row_id, overlap, rank FROM r", "questions", "exemplars"),
    ),
    "diverse_exemplars": (diverse_exemplars, _diverse_sql(10)),
    "vector_topk": (vector_topk, VECTOR_SQL + " QUALIFY rank <= 45"),
    "hit_union": (
        hit_union,
        with_inputs(
            f""", {_topk_sql(1, 1)}, v AS (SELECT row_id FROM ({VECTOR_SQL}) WHERE rank = 1)
            SELECT DISTINCT row_id, 'text' AS kind FROM r UNION ALL SELECT DISTINCT row_id, 'vector' FROM v""",
            "questions",
            "exemplars",
        ),
    ),
    "pack_budget": (
        pack_budget,
        with_inputs(f", {PACKED_SQL} SELECT query_id, rank, row_id, n_tokens, packed_tokens FROM k", "questions", "exemplars"),
    ),
    "max_pair_tokens": (
        max_pair_tokens,
        with_inputs(f"SELECT max(len({_words_sql(_BLOCK)})) AS max_pair_tokens FROM exemplars", "exemplars"),
    ),
    "exemplar_prompts": (exemplar_prompts, _prompts_sql("ASC", "")),
    "exemplar_prompts_reversed": (exemplar_prompts_reversed, _prompts_sql("DESC", "Read each clause. ")),
    "given_prompts": (given_prompts, _given_sql("DESC", CONTEXT, f"'{CONTEXT}' || t || chr(10) || chr(10) || {_QUESTION}")),
    "reasoning_prompts": (
        reasoning_prompts,
        _given_sql(
            "ASC",
            f"{CONTEXT} {CLOSING}",
            f"t || chr(10) || chr(10) || '{CONTEXT}{CLOSING}' || chr(10) || chr(10) || 'Source: ' || code || ' ' || text || chr(10) || 'Let''s think step by step:' || chr(10)",
        ),
    ),
    "exemplar_counts": (
        exemplar_counts,
        with_inputs(
            f""", {PACKED_SQL}, c AS (SELECT query_id, count(*) AS n FROM k GROUP BY query_id)
            SELECT 'unigram_4060' AS run, count(*) AS n_queries, round(avg(n), 6) AS mean_exemplars, min(n) AS min_exemplars, max(n) AS max_exemplars FROM c""",
            "questions",
            "exemplars",
        ),
    ),
    "reflection_prompts": (reflection_prompts, REFLECTION_SQL),
}

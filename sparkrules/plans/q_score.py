"""Registered queries over scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import text as T
from sparkrules.operators import score
from sparkrules.plans.inputs import dealt, load, with_inputs
from sparkrules.plans.q_nodes import link_sql
from sparkrules.plans.q_retrieve import _words_sql

SEED = 9


def bag_overlap(spark, sf):
    return score.bag_overlap(load(spark, sf, "text_pairs"), "pred", "ref")


BAG_SQL = f"""b AS (SELECT row_id, sum(least(a, c)) AS overlap FROM
    (SELECT row_id, w, count(*) AS a FROM (SELECT row_id, unnest({_words_sql('pred')}) AS w FROM text_pairs) GROUP BY ALL)
    JOIN (SELECT row_id, w, count(*) AS c FROM (SELECT row_id, unnest({_words_sql('ref')}) AS w FROM text_pairs) GROUP BY ALL) USING (row_id, w) GROUP BY row_id),
  o AS (SELECT row_id, conv_id, pred, ref, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap FROM text_pairs LEFT JOIN b USING (row_id))"""


def rule_elements(spark, sf):
    found = score.rule_elements(dealt(load(spark, sf, "rule_pairs")), "pred")
    return found.select(
        "row_id", F.col("position").cast("bigint").alias("position"), "relation", F.array_join("words", "|").alias("words"), "is_entity"
    )


def _elements_sql(src: str, col: str, out: str) -> str:
    """Element table of a rule column; a 'then(' starts a new top level, so bracket sums restart there."""
    return rf"""{out}_t AS (SELECT row_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (
        SELECT row_id, regexp_extract_all({col}, '(?:[^''(),]|''[^'']*(?:''|$))+|[(),]') AS t FROM {src})),
    {out}_l AS (SELECT *, lag(x) OVER w AS prev, lead(x) OVER w AS nxt FROM {out}_t WINDOW w AS (PARTITION BY row_id ORDER BY i)),
    {out}_h AS (SELECT *, sum(CASE WHEN trim(x) = 'then' AND nxt = '(' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS seg FROM {out}_l),
    {out}_s AS (SELECT *, sum(CASE WHEN x = '(' AND prev IS DISTINCT FROM '(' THEN 1 WHEN x = ')' THEN -1 ELSE 0 END)
        OVER (PARTITION BY row_id, seg ORDER BY i) AS s FROM {out}_h),
    {out}_d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY row_id, seg ORDER BY i)) AS d FROM {out}_s),
    {out}_n AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS node_id, CAST(d AS INTEGER) AS depth,
        x AS name, coalesce(nxt = '(', false) AS is_term FROM {out}_d WHERE x NOT IN ('(', ')', ',') AND NOT (nxt IS NULL AND d > 0)),
    {link_sql(out + '_n', out + '_k')},
    {out}_a AS (SELECT row_id, node_id, replace(lower(regexp_replace(replace(replace(trim(name), '_', ' _ '), ',', ' , '), '([a-z0-9])([A-Z%])', '\1 \2', 'g')), '  ', ' ') AS t
        FROM {out}_k WHERE NOT is_term),
    {out}_b AS (SELECT row_id, node_id, replace(replace(regexp_replace(t, '([0-9])([a-z])', '\1 \2', 'g'), '  ', ' '), ' k n ', ' kn ') AS t FROM {out}_a),
    {out}_c AS MATERIALIZED (SELECT row_id, node_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM (SELECT row_id, node_id,
        string_split(replace(regexp_replace(regexp_replace(t, '([a-z])\.([a-z])', '\1 \2', 'g'), '([a-z])\.([a-z])', '\1 \2', 'g'), ' _ ', ' '), ' ') AS w FROM {out}_b)),
    {out}_w AS MATERIALIZED (SELECT n.row_id, n.node_id, list(c.w ORDER BY c.node_id, c.k) AS words FROM {out}_k n JOIN {out}_c c ON c.row_id = n.row_id
        AND c.node_id > n.node_id AND c.node_id <= n.last_id AND c.w <> '' WHERE n.is_term GROUP BY ALL),
    {out}_i AS (SELECT DISTINCT row_id, parent_id AS node_id FROM {out}_k WHERE is_term),
    {out} AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY is_entity, node_id) - 1 AS position, relation, words, is_entity FROM (
        SELECT n.row_id, n.node_id, trim(n.name) AS relation, coalesce(words, []) AS words, false AS is_entity FROM {out}_k n LEFT JOIN {out}_w w USING (row_id, node_id) WHERE is_term
        UNION ALL SELECT n.row_id, n.node_id, '', coalesce(words, []), true FROM {out}_k n LEFT JOIN {out}_w w USING (row_id, node_id)
          ANTI JOIN {out}_i i ON i.row_id = n.row_id AND i.node_id = n.node_id WHERE is_term))"""


_CLUE = "CASE WHEN strpos({c}, ':') BETWEEN 1 AND 30 THEN substr({c}, strpos({c}, ':') + 2) ELSE {c} END"


def _scores_sql(src: str) -> str:
    """Greedy matching as a recursion over the left elements with the list of used right ones."""
    return f"""cl AS MATERIALIZED (SELECT row_id, {_CLUE.format(c='pred')} AS pred, {_CLUE.format(c='ref')} AS ref FROM {src}),
    {_elements_sql('cl', 'pred', 'p')}, {_elements_sql('cl', 'ref', 'r')},
    el AS MATERIALIZED (SELECT 'p' AS side, * FROM p WHERE NOT (relation = '' AND len(words) = 0) UNION ALL SELECT 'r', * FROM r),
    wc AS MATERIALIZED (SELECT side, row_id, position, relation, is_entity, len(words) AS n, w, count(*) AS c FROM (SELECT *, unnest(words) AS w FROM el) GROUP BY ALL),
    ov AS MATERIALIZED (SELECT a.side, a.row_id, a.position AS i, b.position AS j, sum(least(a.c, b.c)) AS overlap,
        sum(least(a.c, b.c)) / any_value(a.n) * any_value(CASE WHEN b.is_entity THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS gain
      FROM wc a JOIN wc b ON b.row_id = a.row_id AND b.side <> a.side AND b.relation = a.relation AND b.w = a.w GROUP BY ALL),
    ct AS (SELECT side, row_id, max(position) + 1 AS n, count(*) + count(*) FILTER (WHERE is_entity) AS total FROM el GROUP BY ALL),
    st AS (SELECT side, row_id, 0::BIGINT AS i, n, CAST([] AS BIGINT[]) AS used, 0.0::DOUBLE AS score FROM ct
      UNION ALL SELECT side, row_id, i + 1, n, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, score + coalesce(best.gain, 0) FROM (
        SELECT s.side, s.row_id, s.i, s.n, s.used, s.score, arg_max({{'j': o.j, 'gain': o.gain}}, o.overlap * 100000 - o.j) FILTER (WHERE NOT list_contains(s.used, o.j)) AS best
        FROM st s LEFT JOIN ov o ON o.side = s.side AND o.row_id = s.row_id AND o.i = s.i WHERE s.i < s.n GROUP BY s.side, s.row_id, s.i, s.n, s.used, s.score)),
    fin AS (SELECT side, row_id, score / total AS share FROM st JOIN ct USING (side, row_id, n) WHERE i = n),
    sc AS (SELECT c.row_id, coalesce(a.share, 0) AS precision, coalesce(b.share, 0) AS recall FROM cl c LEFT JOIN fin a ON a.row_id = c.row_id AND a.side = 'p'
      LEFT JOIN fin b ON b.row_id = c.row_id AND b.side = 'r')"""


def structure_score(spark, sf):
    scored = score.structure_score(dealt(load(spark, sf, "rule_pairs")))
    return scored.select("row_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def structure_f1(spark, sf):
    """Corpus score of damaged rules against the originals, after cleaning both sides."""
    refs = dealt(load(spark, sf, "rules")).select("row_id", F.col("rule").alias("ref"))
    pairs = dealt(load(spark, sf, "damaged")).select("row_id", F.col("rule").alias("pred")).join(refs, "row_id")
    scores = score.structure_f1(score.structure_score(pairs, post_process=T.clean_prediction))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


_CLEAN = "replace(translate(CASE WHEN contains(trim({c}), 'if(') THEN substr(trim({c}), strpos(trim({c}), 'if(')) ELSE trim({c}) END, '[]{{}}', '()()'), ').', ')')"


def corpus_bleu(spark, sf):
    """BLEU of the assistant turns against the user turns: overall, and per six groups of conversations."""
    pairs = load(spark, sf, "text_pairs").withColumn("variant", F.pmod("conv_id", F.lit(6)))
    counts = score.bleu_counts(pairs, ["variant"])
    sums = [F.sum(c).alias(c) for c in counts.columns if c != "variant"]
    counts = counts.rollup("variant").agg(*sums).na.fill(-1, ["variant"])
    both = score.bleu_scores(counts, ["variant"])
    return both.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in both.dtypes])


BLEU_SQL = with_inputs(
    f""", v AS (SELECT *, conv_id % 6 AS variant FROM text_pairs UNION ALL SELECT *, -1 FROM text_pairs),
    w AS (SELECT variant, row_id, 'p' AS side, {_words_sql('pred')} AS w FROM v UNION ALL SELECT variant, row_id, 'r', {_words_sql('ref')} FROM v),
    g AS (SELECT variant, row_id, side, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
        SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS n))),
    c AS (SELECT variant, row_id, n, gram, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'r') AS r FROM g GROUP BY ALL),
    s AS (SELECT variant, n, sum(least(p, r)) AS m, sum(p) AS t, sum(r) AS rt FROM c GROUP BY ALL),
    x AS (SELECT variant, max(CASE WHEN n = 1 THEN m / nullif(t, 0) END) AS p1, max(CASE WHEN n = 2 THEN m / nullif(t, 0) END) AS p2, max(CASE WHEN n = 3 THEN m / nullif(t, 0) END) AS p3,
        max(CASE WHEN n = 4 THEN m / nullif(t, 0) END) AS p4, max(CASE WHEN n = 1 THEN t END) AS tl, max(CASE WHEN n = 1 THEN rt END) AS rl FROM s GROUP BY variant),
    y AS (SELECT *, tl / rl AS ratio, CASE WHEN tl = 0 THEN 0.0 WHEN tl > rl THEN 1.0 ELSE exp(1 - rl / tl) END AS bp FROM x)
    SELECT variant, round(coalesce(p1, 0), 6) AS precision_1, round(coalesce(p2, 0), 6) AS precision_2, round(coalesce(p3, 0), 6) AS precision_3,
      round(coalesce(p4, 0), 6) AS precision_4, CAST(tl AS BIGINT) AS translation_length, CAST(rl AS BIGINT) AS reference_length, round(ratio, 6) AS length_ratio,
      round(CAST(bp AS DOUBLE), 6) AS brevity_penalty, round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN CAST(bp AS DOUBLE) * pow(p1 * p2 * p3 * p4, 0.25) ELSE 0.0::DOUBLE END, 6) AS bleu FROM y""",
    "text_pairs",
)


def agreement_ratio(spark, sf):
    return score.agreement_ratio(dealt(load(spark, sf, "rule_pairs")), "pred", "ref").select(F.round("agreement", 6).alias("agreement"))


def extremes(spark, sf):
    pairs = load(spark, sf, "text_pairs").select("row_id", "pred", "ref")
    scored = pairs.join(score.bag_overlap(pairs, "pred", "ref"), "row_id")
    return score.extremes(scored, "overlap")


def best_candidate(spark, sf):
    best = score.best_candidate(load(spark, sf, "candidates"), SEED)
    return best.select("row_id", "cand_id", "score", "pred", F.col("position").cast("bigint").alias("position"))


def trim_padding(spark, sf):
    return score.trim_padding(load(spark, sf, "padded"), "row_id")


QUERIES = {
    "bag_overlap": (bag_overlap, with_inputs(f", {BAG_SQL} SELECT row_id, overlap FROM o", "text_pairs")),
    "rule_elements": (
        rule_elements,
        with_inputs(
            f""", {_elements_sql('rule_pairs', 'pred', 'e')}
            SELECT row_id, position, relation, array_to_string(words, '|') AS words, is_entity FROM e""",
            "rule_pairs",
        ),
    ),
    "structure_score": (
        structure_score,
        with_inputs(
            f", {_scores_sql('rule_pairs')} SELECT row_id, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sc",
            "rule_pairs",
            recursive=True,
        ),
    ),
    "structure_f1": (
        structure_f1,
        with_inputs(
            f""", z AS (SELECT row_id, {_CLEAN.format(c='d.rule')} AS pred, {_CLEAN.format(c='r.rule')} AS ref FROM damaged d JOIN rules r USING (row_id)),
            {_scores_sql('z')}, m AS (SELECT avg(precision) AS p, avg(recall) AS r FROM sc)
            SELECT round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (p + r) * 100 END, 6) AS f_score, round(r * 100, 6) AS recall, round(p * 100, 6) AS precision FROM m""",
            "damaged",
            recursive=True,
        ),
    ),
    "corpus_bleu": (corpus_bleu, BLEU_SQL),
    "agreement_ratio": (
        agreement_ratio,
        with_inputs("SELECT round(count(*) FILTER (WHERE pred = ref) / count(*), 6) AS agreement FROM rule_pairs", "rule_pairs"),
    ),
    "extremes": (
        extremes,
        with_inputs(
            f""", {BAG_SQL} (SELECT 'best' AS which, row_id, pred, ref, overlap FROM o ORDER BY overlap DESC, row_id LIMIT 1)
            UNION ALL (SELECT 'worst', row_id, pred, ref, overlap FROM o ORDER BY overlap, row_id LIMIT 1)""",
            "text_pairs",
        ),
    ),
    "best_candidate": (
        best_candidate,
        with_inputs(
            f""", c AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cand_id DESC) AS rn,
              row_number() OVER (PARTITION BY row_id ORDER BY md5(concat_ws(':', row_id, cand_id, {SEED})), cand_id) - 1 AS position FROM candidates)
            SELECT row_id, cand_id, score, pred, position FROM c WHERE rn = 1""",
            "candidates",
        ),
    ),
    "trim_padding": (
        trim_padding,
        with_inputs(
            "SELECT * FROM padded WHERE row_id <= (SELECT max(row_id) FROM padded WHERE NOT (pred = '' AND ref = ''))", "padded"
        ),
    ),
}

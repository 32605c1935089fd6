"""Registered queries over filters, flags, variants, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import fixed, names
from sparkrules.functions import text as T
from sparkrules.operators import curate
from sparkrules.operators.ranking import top_n
from sparkrules.operators.sample import sample_n
from sparkrules.plans.inputs import load, with_inputs

HELD_OUT = ["src3", "src7", "src11"]
TASK = "parse English to rules: "


def select_split(spark, sf):
    vectors = load(spark, sf, "vectors").select("row_id", "cluster")
    one = curate.select_split(vectors, "cluster", 3).withColumn("code", F.lit(3))
    every = curate.select_split(vectors, "cluster", 0).withColumn("code", F.lit(0))
    return curate.stack([one, every])


def holdout_split(spark, sf):
    corpus = load(spark, sf, "corpus")
    plain = curate.holdout_split(corpus, HELD_OUT).withColumn("variant", F.lit("all"))
    capped = curate.holdout_split(corpus, HELD_OUT, length_of="text", caps={"train": 2000, "valid": 372})
    both = curate.stack([plain, capped.withColumn("variant", F.lit("short"))])
    return both.select("row_id", "file", "split", "variant")


HOLDOUT_SQL = with_inputs(
    """, s AS (SELECT row_id, file, length(text) AS n, CASE WHEN regexp_matches(file, 'src3|src7|src11') THEN 'valid' ELSE 'train' END AS split FROM corpus)
    SELECT row_id, file, split, 'all' AS variant FROM s
    UNION ALL SELECT row_id, file, split, 'short' FROM s WHERE (split = 'train' AND n < 2000) OR (split = 'valid' AND n < 372)""",
    "corpus",
)


def tag_flags(spark, sf):
    flagged = curate.tag_flags(load(spark, sf, "annotated"))
    return flagged.select("row_id", *[f"has_{g}" for g in fixed.TAG_GROUPS])


def _tag_sql(group: str) -> str:
    tests = " OR ".join(f"contains(comments, '{t}')" for t in fixed.TAG_GROUPS[group])
    return f"(comments IS NOT NULL AND ({tests}))"


def is_added(spark, sf):
    annotated = load(spark, sf, "annotated")
    return annotated.select("row_id", curate.is_added("text_old", "text", "comments").alias("is_added"))


ADDED_SQL = "(coalesce(contains(comments, 'TACIT-'), false) OR strpos(text, substr(replace(text_old, ';', ''), 1, 20)) > 3)"
CONDITIONS_SQL = f"""c AS (SELECT row_id, text, file, rule, {_tag_sql('medium')} AS is_medium, {_tag_sql('coarse')} AS is_coarse,
      NOT ({_tag_sql('medium')} OR {_tag_sql('coarse')}) AS is_fine, {_tag_sql('tacit')} AND NOT {ADDED_SQL} AS is_implicit,
      {_tag_sql('ignore')} AS is_ignore, contains(rule, 'function( define)') AS is_define, contains(rule, 'rulestatement(') AS is_rulestatement,
      contains(rule, 'relation( key') AS is_key FROM annotated)"""


def condition_label(spark, sf):
    conditioned = curate.with_conditions(load(spark, sf, "annotated"))
    flags = [c for c in conditioned.columns if c.startswith("is_")]
    return conditioned.select("row_id", *flags, curate.condition_label().alias("granularity"))


def condition_variants(spark, sf):
    conditioned = curate.with_conditions(load(spark, sf, "annotated"))
    variants = curate.condition_variants(conditioned, TASK, T.doc_title("file", "docs/XX-"))
    return curate.holdout_split(variants, HELD_OUT).select("row_id", "dataset", "split", "input")


CONDITION_VARIANTS_SQL = with_inputs(
    f""", {CONDITIONS_SQL},
    v AS (
      SELECT row_id, file, text, 'document' AS dataset, string_split(lower(replace(file, 'docs/XX-', '')), '#')[1] AS label FROM c
      UNION ALL SELECT row_id, file, text, 'define', CASE WHEN is_define THEN 'define' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'rulestatement', CASE WHEN is_rulestatement THEN 'rulestatement' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'key', CASE WHEN is_key THEN 'key' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'granularity', CASE WHEN is_fine THEN 'fine-grained' ELSE
        CASE WHEN is_medium THEN 'medium-grained' ELSE '' END || CASE WHEN is_coarse THEN 'coarse-grained' ELSE '' END END FROM c
      UNION ALL SELECT row_id, file, text, 'implicit', CASE WHEN is_implicit THEN 'implicit' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'ignore', CASE WHEN is_ignore THEN 'ignore' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'medium', CASE WHEN is_medium THEN 'medium-grained' ELSE '' END FROM c
      UNION ALL SELECT row_id, file, text, 'coarse', CASE WHEN is_coarse THEN 'coarse-grained' ELSE '' END FROM c)
    SELECT row_id, dataset, CASE WHEN regexp_matches(file, 'src3|src7|src11') THEN 'valid' ELSE 'train' END AS split,
      concat('{TASK}', text, '</s>', label) AS input FROM v""",
    "annotated",
)
ABLATIONS = ["medium", "coarse", "rulestatement", "define", "key", "implicit", "ignore"]


def ablation_variants(spark, sf):
    conditioned = curate.holdout_split(curate.with_conditions(load(spark, sf, "annotated")), HELD_OUT)
    variants = curate.ablation_variants(conditioned, {f"remove_{a}": F.col(f"is_{a}") for a in ABLATIONS})
    return variants.select("dataset", "row_id", "split", T.build_input(TASK, "text").alias("input"))


def filter_runs(spark, sf):
    runs = names.parse_run_name(load(spark, sf, "run_results"))
    kept = curate.filter_runs(runs, F.col("learning_rate") == 0.0001, F.col("batch_size") == 4)
    return kept.select("event_id", "name", "learning_rate", "batch_size")


def pick_attempt(spark, sf):
    responses = load(spark, sf, "responses")
    checks = {"rule": curate.has_rule, "target": curate.has_target, "option": curate.has_option}
    picked = [curate.pick_attempt(responses, c).withColumn("check_name", F.lit(n)) for n, c in checks.items()]
    return curate.stack(picked)


PICK_SQL = with_inputs(
    """, c AS (SELECT row_id, attempt, response, 'rule' AS check_name, contains(response, 'if(') AS ok FROM responses
      UNION ALL SELECT row_id, attempt, response, 'target', contains(lower(response), 'target:') FROM responses
      UNION ALL SELECT row_id, attempt, response, 'option', regexp_matches(response, 'Option [0-9]+') FROM responses),
    r AS (SELECT *, row_number() OVER (PARTITION BY check_name, row_id ORDER BY ok DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS rn FROM c)
    SELECT row_id, check_name, attempt, CAST([0.0, 0.0, 0.4, 0.8, 1.2, 1.6, 2.0][attempt + 1] AS DOUBLE) AS temperature, response, NOT ok AS is_error
    FROM r WHERE rn = 1""",
    "responses",
)
SAMPLED = "SELECT text FROM corpus ORDER BY md5(concat_ws(':', row_id, 42)), row_id LIMIT 518"


def remainder(spark, sf):
    corpus = load(spark, sf, "corpus")
    rest = curate.remainder(corpus, sample_n(corpus, 518, 42), "text")
    return rest.select("row_id", "text")


def exclude_used(spark, sf):
    corpus = load(spark, sf, "corpus")
    used = corpus.join(load(spark, sf, "labels").select(F.col("doc_id").alias("row_id")), "row_id", "left_semi")
    return curate.exclude_used(corpus, used).select("row_id", "file")


def overlay(spark, sf):
    corpus = load(spark, sf, "corpus").select("row_id", "text")
    updates = load(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("row_id"), "text")
    return curate.overlay(corpus, updates, "text", T.normalise_text("text"))


def align_by_position(spark, sf):
    turns = load(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), F.col("text").alias("pred"))
    corpus = load(spark, sf, "corpus").select("row_id", "file")
    return curate.align_by_position(turns, corpus, ["turn_id"], ["row_id"])


def apply_corrections(spark, sf):
    corpus = load(spark, sf, "corpus").select("row_id", "text")
    labelled = load(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality", "toxic")
    patch = lambda seq, find, put: F.struct(
        F.lit(seq).alias("seq"), F.lit(find).alias("find"), put.cast("string").alias("put")
    )
    patches = labelled.select(
        "row_id",
        F.inline(
            F.array(
                patch(3, "the", F.concat(F.lit("T"), "toxic")),
                patch(1, " an", F.concat(F.lit(" the"), "quality")),
                patch(2, "e.", F.lit("the.")),
            )
        ),
    )
    return curate.apply_corrections(corpus, patches, "text")


def candidate_table(spark, sf):
    turns = load(spark, sf, "conversations")
    refs = turns.filter("turn = 0").select(F.col("conv_id").alias("row_id"), F.col("text").alias("ref"))
    runs = {
        role: turns.filter(F.col("role") == role).select(F.col("conv_id").alias("row_id"), F.col("text").alias("pred"))
        for role in ("user", "assistant", "system")
    }
    return curate.candidate_table(refs, runs)


def param_grid(spark, sf):
    axes = {
        "priority": load(spark, sf, "orders").select("o_orderpriority"),
        "flag": load(spark, sf, "lineitem").select("l_returnflag"),
        "region": load(spark, sf, "region").select("r_name"),
        "event": load(spark, sf, "events").select("event_type"),
    }
    return curate.param_grid(axes, skip=7)


def stack(spark, sf):
    annotated = load(spark, sf, "annotated").select("row_id", "text", "text_old", F.col("rule").alias("label"))
    both = curate.stack_columns(annotated, ["text", "text_old"], "model_input")
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("html").alias("model_input"))
    return curate.stack([both, pages], allow_missing=True)


SPLIT_CODE = "CASE WHEN row_id % 10 < 7 THEN 1 WHEN row_id % 10 = 7 THEN 2 ELSE 3 END"


def variant_views(spark, sf):
    rows = load(spark, sf, "annotated").withColumns(
        {"code": T.doc_code("file"), "random_split": F.expr(SPLIT_CODE), "label": F.col("rule")}
    )
    prepared = curate.first_pass_inputs(rows, TASK, oracle=F.col("rule"), prediction=T.space_terms("rule"))
    prepared = prepared.withColumn("input", T.build_input("extract: ", "text", "code"))
    views = [curate.variant_views(prepared, m, "random_split").withColumn("mode", F.lit(m)) for m in curate.MODE_INPUTS]
    return curate.stack(views)


VARIANT_SQL = with_inputs(
    f""", b AS (SELECT row_id, rule AS label, {SPLIT_CODE} AS code, concat('{TASK}', regexp_extract(file, '-([^#-]*)', 1), ' ', text) AS base,
        concat('extract: ', regexp_extract(file, '-([^#-]*)', 1), ' ', text) AS input, rule,
        replace(regexp_replace(replace(replace(replace(lower(regexp_replace(rule, '([a-z0-9])([A-Z%])', '\\1_\\2', 'g')), '_', ' '), '(', '( '), ',', ', '), ' +', ' ', 'g'), ' ,', ',') AS p
      FROM annotated),
    c AS (SELECT row_id, label, code, input, base AS input_no_sep, base || '<sep>' || p AS input_pred, base || '<sep>' || rule AS input_oracle FROM b),
    w(mode, split, code, variant) AS (VALUES
      ('ir','train',1,'input'),('ir','valid',2,'input'),('ir','test',3,'input'),('ir','all',0,'input'),
      ('train-pred','train',1,'input_pred'),('train-pred','valid',2,'input_pred'),('train-pred','test',3,'input_pred'),
      ('train-pred','test_oracle',3,'input_oracle'),('train-pred','test_no_sep',3,'input_no_sep'),
      ('train-oracle','train',1,'input_oracle'),('train-oracle','valid',2,'input_pred'),('train-oracle','test',3,'input_pred'),
      ('train-oracle','test_oracle',3,'input_oracle'),('train-oracle','test_no_sep',3,'input_no_sep'),
      ('train-oracle-pred','train',1,'input_pred'),('train-oracle-pred','train',1,'input_oracle'),('train-oracle-pred','valid',2,'input_pred'),
      ('train-oracle-pred','test',3,'input_pred'),('train-oracle-pred','test_oracle',3,'input_oracle'),('train-oracle-pred','test_no_sep',3,'input_no_sep'))
    SELECT row_id, label, mode, split, variant, CASE variant WHEN 'input' THEN input WHEN 'input_pred' THEN input_pred
      WHEN 'input_oracle' THEN input_oracle ELSE input_no_sep END AS model_input
    FROM c JOIN w ON w.code = 0 OR w.code = c.code""",
    "annotated",
)


def distinct_texts(spark, sf):
    return curate.distinct_in_order(load(spark, sf, "corpus"), "text", "row_id")


def top_lengths(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return top_n(docs, [F.col("n_chars").desc(), F.col("doc_id")], 30)


QUERIES = {
    "select_split": (
        select_split,
        "SELECT vec_id AS row_id, label AS cluster, 3 AS code FROM embeddings WHERE label = 3 "
        "UNION ALL SELECT vec_id, label, 0 FROM embeddings",
    ),
    "holdout_split": (holdout_split, HOLDOUT_SQL),
    "tag_flags": (
        tag_flags,
        with_inputs(
            "SELECT row_id, " + ", ".join(f"{_tag_sql(g)} AS has_{g}" for g in fixed.TAG_GROUPS) + " FROM annotated", "annotated"
        ),
    ),
    "is_added": (is_added, with_inputs(f"SELECT row_id, {ADDED_SQL} AS is_added FROM annotated", "annotated")),
    "condition_label": (
        condition_label,
        with_inputs(
            f""", {CONDITIONS_SQL} SELECT row_id, is_medium, is_coarse, is_fine, is_implicit, is_ignore, is_define, is_rulestatement, is_key,
            CASE WHEN is_medium THEN 'medium-grained' ELSE '' END || CASE WHEN is_coarse THEN 'coarse-grained' ELSE '' END ||
            CASE WHEN is_fine THEN 'fine-grained' ELSE '' END AS granularity FROM c""",
            "annotated",
        ),
    ),
    "condition_variants": (condition_variants, CONDITION_VARIANTS_SQL),
    "ablation_variants": (
        ablation_variants,
        with_inputs(
            f", {CONDITIONS_SQL} "
            + " UNION ALL ".join(
                f"""SELECT 'remove_{a}' AS dataset, row_id, CASE WHEN regexp_matches(file, 'src3|src7|src11') THEN 'valid' ELSE 'train' END AS split,
                '{TASK}' || text AS input FROM c WHERE NOT is_{a}"""
                for a in ABLATIONS
            ),
            "annotated",
        ),
    ),
    "filter_runs": (
        filter_runs,
        with_inputs(
            r""", p AS (SELECT event_id, name, CAST(regexp_extract(name, '_([0-9.e-]+)_beam', 1) AS DOUBLE) AS learning_rate,
              CAST(regexp_extract(name, 'b(\d+)_', 1) AS INTEGER) AS batch_size FROM run_results)
            SELECT * FROM p WHERE learning_rate <> 0.0001 OR batch_size <> 4""",
            "run_results",
        ),
    ),
    "pick_attempt": (pick_attempt, PICK_SQL),
    "remainder": (
        remainder,
        with_inputs(f"SELECT row_id, text FROM corpus WHERE text NOT IN ({SAMPLED})", "corpus"),
    ),
    "exclude_used": (
        exclude_used,
        with_inputs(
            """SELECT row_id, file FROM corpus WHERE NOT EXISTS (
            SELECT 1 FROM corpus u JOIN labels ON u.row_id = doc_id WHERE u.text = corpus.text)""",
            "corpus",
        ),
    ),
    "overlay": (
        overlay,
        with_inputs(
            """, n AS (SELECT row_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t FROM corpus)
            SELECT row_id, CASE WHEN c.conv_id IS NOT NULL THEN c.text WHEN t = '' OR right(t, 1) = '.' THEN t ELSE t || '.' END AS text
            FROM n LEFT JOIN conversations c ON c.conv_id = n.row_id AND c.turn = 0""",
            "corpus",
        ),
    ),
    "align_by_position": (
        align_by_position,
        with_inputs(
            """SELECT * FROM (SELECT conv_id * 100 + turn AS turn_id, text AS pred, row_number() OVER (ORDER BY conv_id * 100 + turn) AS position FROM conversations)
            FULL JOIN (SELECT row_id, file, row_number() OVER (ORDER BY row_id) AS position FROM corpus) USING (position)""",
            "corpus",
        ),
    ),
    "apply_corrections": (
        apply_corrections,
        with_inputs(
            """SELECT row_id, CASE WHEN doc_id IS NULL THEN text ELSE
              replace(replace(replace(text, ' an', concat(' the', quality)), 'e.', 'the.'), 'the', concat('T', toxic)) END AS text
            FROM corpus LEFT JOIN labels ON row_id = doc_id""",
            "corpus",
        ),
    ),
    "candidate_table": (
        candidate_table,
        """SELECT r.conv_id AS row_id, r.text AS ref, CASE p.role WHEN 'user' THEN 0::BIGINT WHEN 'assistant' THEN 1 ELSE 2 END AS cand_id,
        p.role AS run, p.text AS pred FROM conversations r JOIN conversations p USING (conv_id) WHERE r.turn = 0""",
    ),
    "param_grid": (
        param_grid,
        """, g AS (SELECT *, row_number() OVER (ORDER BY priority, flag, region, event) - 1 AS config_id FROM
          (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT DISTINCT l_returnflag AS flag FROM lineitem),
          (SELECT DISTINCT r_name AS region FROM region), (SELECT DISTINCT event_type AS event FROM events))
        SELECT config_id, priority, flag, region, event FROM g WHERE config_id >= 7""".replace(", g AS", "WITH g AS", 1),
    ),
    "stack": (
        stack,
        with_inputs(
            """SELECT row_id, rule AS label, 'text' AS origin, text AS model_input FROM annotated
            UNION ALL SELECT row_id, rule, 'text_old', text_old FROM annotated UNION ALL SELECT page_id, NULL, NULL, html FROM pages""",
            "annotated",
        ),
    ),
    "variant_views": (variant_views, VARIANT_SQL),
    "distinct_texts": (
        distinct_texts,
        "SELECT text, min(doc_id) AS first_position FROM documents GROUP BY text",
    ),
    "top_lengths": (
        top_lengths,
        "SELECT doc_id, n_chars, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30",
    ),
}

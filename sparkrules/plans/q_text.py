"""Registered queries over the row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import fixed, names, quantity
from sparkrules.functions import text as T
from sparkrules.plans.inputs import dealt, load, with_inputs

PREFIX = "translate English to rules: "
REPAIR_PREFIX = "fix rules: "
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _nested_replace(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {_quote(old)}, {_quote(new)})"
    return column


def doc_code(spark, sf):
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("file"))
    files = load(spark, sf, "corpus").select("row_id", "file").unionByName(pages)
    return files.select(
        "row_id", "file", T.doc_code("file").alias("code"), T.doc_title("file", "docs/XX-").alias("title")
    )


DOC_CODE_SQL = with_inputs(
    r""", files AS (SELECT row_id, file FROM corpus UNION ALL SELECT page_id, url FROM pages)
    SELECT row_id, file, coalesce(string_split(coalesce(string_split(file, '-')[2], ''), '#')[1], '') AS code,
      string_split(lower(replace(file, 'docs/XX-', '')), '#')[1] AS title FROM files""",
    "corpus",
)


def build_input(spark, sf):
    corpus = load(spark, sf, "corpus")
    return corpus.select("row_id", T.build_input(PREFIX, "text", T.doc_code("file")).alias("model_input"))


def fallback_text(spark, sf):
    annotated = load(spark, sf, "annotated")
    return annotated.select("row_id", T.fallback("comments", "rule").alias("chosen"))


def normalise_text(spark, sf):
    return load(spark, sf, "corpus").select("row_id", T.normalise_text("text").alias("normalised"))


def apply_replacements(spark, sf):
    rules = dealt(load(spark, sf, "rules").select("row_id", F.col("rule").alias("before")))
    corpus = dealt(load(spark, sf, "corpus").select("row_id", F.col("text").alias("before")))
    return rules.unionByName(corpus).select("row_id", "before", T.apply_replacements("before").alias("replaced"))


def space_terms(spark, sf):
    rules = load(spark, sf, "rules")
    return rules.select(
        "row_id",
        T.space_terms("rule").alias("spaced"),
        T.split_leaf(F.regexp_extract("rule", r"then\((.*)", 1)).alias("leaf"),
    )


SPACE_TERMS_SQL = with_inputs(
    r"""SELECT row_id, replace(regexp_replace(replace(replace(replace(lower(
        regexp_replace(rule, '([a-z0-9])([A-Z%])', '\1_\2', 'g')), '_', ' '), '(', '( '), ',', ', '), ' +', ' ', 'g'), ' ,', ',') AS spaced,
      CASE WHEN contains(tail, ' ') THEN replace(tail, '_', ' ') ELSE
        regexp_replace(regexp_replace(replace(lower(regexp_replace(tail, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' '),
          '([a-z])\.([a-z])', '\1. \2', 'g'), '([a-z])\.([a-z])', '\1. \2', 'g') END AS leaf
    FROM (SELECT row_id, rule, regexp_extract(rule, 'then\((.*)', 1) AS tail FROM rules)""",
    "rules",
)


def rename_terms(spark, sf):
    annotated = load(spark, sf, "annotated")
    short = annotated.select("row_id", T.rename_terms("rule", reverse=True).alias("short"))
    return short.withColumn("long", T.rename_terms("short"))


def score_words(spark, sf):
    rules = dealt(load(spark, sf, "rules").select("row_id", F.col("rule").alias("t")))
    corpus = dealt(load(spark, sf, "corpus").select("row_id", F.col("text").alias("t")))
    units = dealt(load(spark, sf, "quantities"), "l_orderkey").select(
        F.col("l_orderkey").alias("row_id"), F.concat(F.lit("pipe.maxLoad_of "), "quantity", F.lit(" steelPipe.width")).alias("t")
    )
    found = rules.unionByName(corpus).unionByName(units).withColumn("w", T.score_words("t"))
    return found.select("row_id", F.size("w").cast("bigint").alias("n_words"), F.array_join("w", "|").alias("words"))


SCORE_WORDS_SQL = with_inputs(
    r""", t AS (SELECT row_id, rule AS t FROM rules UNION ALL SELECT row_id, text FROM corpus
      UNION ALL SELECT l_orderkey, concat('pipe.maxLoad_of ', quantity, ' steelPipe.width') FROM quantities),
    a AS (SELECT row_id, replace(lower(regexp_replace(replace(replace(t, '_', ' _ '), ',', ' , '), '([a-z0-9])([A-Z%])', '\1 \2', 'g')), '  ', ' ') AS t FROM t),
    b AS (SELECT row_id, replace(replace(regexp_replace(t, '([0-9])([a-z])', '\1 \2', 'g'), '  ', ' '), ' k n ', ' kn ') AS t FROM a),
    c AS (SELECT row_id, string_split(replace(regexp_replace(regexp_replace(t, '([a-z])\.([a-z])', '\1 \2', 'g'), '([a-z])\.([a-z])', '\1 \2', 'g'), ' _ ', ' '), ' ') AS w FROM b)
    SELECT row_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '|') AS words FROM c""",
    "rules",
    "corpus",
    "quantities",
)


def qualify_refs(spark, sf):
    rules = load(spark, sf, "rules")
    title = F.concat(F.lit("doc_"), T.doc_title("file", "rules/XX-"), F.lit("_"))
    out = rules.select("row_id", title.alias("title"), T.qualify_refs("rule", title).alias("qualified"))
    return out.withColumn("stripped", T.strip_refs("qualified", "title"))


QUALIFY_REFS_SQL = with_inputs(
    r""", r AS (SELECT row_id, rule, concat('doc_', lower(regexp_extract(file, 'rules/XX-([^#]*)', 1)), '_') AS title,
        list_concat(regexp_extract_all(rule, '\(([tf]\d.*?)\)', 1), regexp_extract_all(rule, '\((\d+\.\d+\..*?)\)', 1)) AS refs,
        regexp_extract_all(rule, 'fun\(define\),.*?,data\((\w+)\)', 1) AS defined FROM rules),
    e AS (SELECT row_id, unnest(list_distinct(refs)) AS ref FROM r
      WHERE NOT contains(rule, 'rel(key)') AND NOT list_contains(defined, refs[1])),
    g AS (SELECT row_id, string_agg(ref, '~' ORDER BY ref) AS refs FROM e GROUP BY row_id)
    SELECT r.row_id, r.title, q AS qualified, replace(q, r.title, '') AS stripped FROM (
      SELECT r.*, CASE WHEN g.refs IS NULL THEN rule ELSE
        list_reduce(string_split(g.refs, '~'), lambda acc, x: replace(acc, concat('(', x, ')'), concat('(', r.title, x, ')')), rule) END AS q
      FROM r LEFT JOIN g ON r.row_id = g.row_id) r""",
    "rules",
)


def clean_prediction(spark, sf):
    damaged = load(spark, sf, "damaged")
    return damaged.select(
        "row_id", T.clean_prediction("rule").alias("cleaned"), T.clean_prediction("rule", cut=False).alias("uncut")
    )


CLEAN_PREDICTION_SQL = with_inputs(
    rf"""SELECT row_id, replace(translate(CASE WHEN contains(t, 'if(') THEN substr(t, strpos(t, 'if(')) ELSE t END, '[]{{}}', '()()'), ').', ')') AS cleaned,
      replace(translate(t, '[]{{}}', '()()'), ').', ')') AS uncut
    FROM (SELECT row_id, trim(rule, {WS}) AS t FROM damaged)""",
    "damaged",
)


def answer_after(spark, sf):
    responses = load(spark, sf, "responses")
    return responses.select(
        "row_id", "attempt", T.answer_after("response").alias("answer"), T.option_number("response").alias("option")
    )


ANSWER_AFTER_SQL = with_inputs(
    rf"""SELECT row_id, attempt, CASE WHEN contains(response, 'Target:') THEN trim(string_split(response, 'Target:')[2], {WS}) ELSE response END AS answer,
      coalesce(TRY_CAST(nullif(regexp_extract(response, 'Option (\d+)', 1), '') AS BIGINT), 0) AS option FROM responses""",
    "responses",
)


def parse_quantity(spark, sf):
    parsed = dealt(load(spark, sf, "quantities"), "l_orderkey").withColumn("q", quantity.parse_quantity("quantity"))
    return parsed.select(
        "l_orderkey",
        "l_linenumber",
        "quantity",
        F.col("q.value").alias("value"),
        F.col("q.first.prefix").alias("prefix"),
        F.col("q.first.kind").alias("kind"),
        F.col("q.first.exponent").alias("exponent"),
        F.col("q.operator").alias("operator"),
        F.col("q.second.prefix").alias("second_prefix"),
        F.col("q.second.kind").alias("second_kind"),
        F.col("q.second.exponent").alias("second_exponent"),
        quantity.format_quantity(F.col("q")).alias("formatted"),
    )


# The twin looks units up in a table of every base unit text instead of taking them apart.
def _unit_rows() -> str:
    rows = []
    for prefix, p in [("", ""), *fixed.UNIT_PREFIXES]:
        for kind, k in [("", ""), *fixed.UNIT_KINDS]:
            for e in ["", *"0123456789"]:
                if p + k + e and not (p == "m" and not k):
                    rows.append(f"('{p + k + e}', '{prefix}', '{kind}', '{e + '.0' if e else ''}')")
    return ", ".join(rows)


PARSE_QUANTITY_SQL = with_inputs(
    rf""", unit(txt, prefix, kind, exponent) AS (VALUES {_unit_rows()}),
    s AS (SELECT *, string_split(quantity, ' ')[1] AS number, string_split(quantity, ' ')[2] AS u FROM quantities),
    o AS (SELECT *, CASE WHEN contains(u, '*') THEN '*' WHEN contains(u, '/') THEN '/' END AS sign FROM s),
    j AS (SELECT o.*, a.txt AS a_txt, nullif(a.prefix, '') AS prefix, nullif(a.kind, '') AS kind, nullif(a.exponent, '') AS exponent,
        nullif(b.prefix, '') AS second_prefix, nullif(b.kind, '') AS second_kind, nullif(b.exponent, '') AS second_exponent
      FROM o LEFT JOIN unit a ON a.txt = CASE WHEN sign IS NULL THEN u ELSE string_split(u, sign)[1] END
             LEFT JOIN unit b ON b.txt = CASE WHEN sign IS NOT NULL THEN string_split(u, sign)[2] END)
    SELECT l_orderkey, l_linenumber, quantity, CASE WHEN a_txt IS NULL THEN NULL WHEN contains(number, '.') THEN number ELSE number || '.0' END AS value,
      prefix, kind, exponent, CASE sign WHEN '*' THEN 'multiplication' WHEN '/' THEN 'division' END AS operator,
      second_prefix, second_kind, second_exponent,
      CASE WHEN a_txt IS NOT NULL THEN replace(number, '.0', '') || ' ' || u END AS formatted FROM j""",
    "quantities",
)


def parse_run_name(spark, sf):
    parsed = names.parse_run_name(load(spark, sf, "run_results").select("event_id", "name"))
    return parsed.select("event_id", "name", "model_name", "batch_size", "learning_rate", "beam_size")


def run_group(spark, sf):
    runs = load(spark, sf, "run_results")
    group = names.drop_parts("name", 3)
    return runs.select(
        "event_id",
        names.run_family("name").alias("exp_num"),
        group.alias("run_group"),
        names.part_from_end(group, 2).alias("split_name"),
        names.drop_parts(group, 2).alias("run"),
    )


RUN_GROUP_SQL = with_inputs(
    """SELECT event_id, CASE WHEN contains(name, 'no-clause') THEN 1 WHEN contains(name, 'calc-loss') THEN 2 ELSE 0 END AS exp_num,
      array_to_string(p[1:-4], '_') AS run_group, p[-5] AS split_name, array_to_string(p[1:-6], '_') AS run
    FROM (SELECT *, string_split(name, '_') AS p FROM run_results)""",
    "run_results",
)


def format_metrics(spark, sf):
    runs = load(spark, sf, "run_results")
    ids = runs.select("event_id", F.col("test_bleu"), F.col("test_f1"), F.col("runtime"), F.lit(0.0).alias("runtime_MAX"))
    return names.format_metrics(
        ids, rename={"test_f1": "F1-Score", "test_bleu": "BLEU"}, keep=["event_id", "test", "runtime"], drop_suffixes=["MIN", "MAX"]
    )


def truncate_tokens(spark, sf):
    tokens = T.truncate_tokens("text", 128)
    corpus = load(spark, sf, "corpus")
    return corpus.select("row_id", F.array_join(tokens, " ").alias("kept"), F.size(tokens).cast("bigint").alias("n_kept"))


def second_pass_input(spark, sf):
    pairs = load(spark, sf, "text_pairs")
    first = F.concat(F.lit(PREFIX), "ref", F.lit(fixed.SEPARATOR), F.lit("oracle"))
    return pairs.select(
        "row_id",
        T.second_pass_input(first, "pred", PREFIX, REPAIR_PREFIX).alias("full"),
        T.second_pass_input(first, "pred", PREFIX, REPAIR_PREFIX, keep_input=False).alias("output_only"),
        T.second_pass_input(first, "pred", PREFIX, REPAIR_PREFIX, keep_output=False).alias("input_only"),
    )


def mask_tokens(spark, sf):
    corpus = dealt(load(spark, sf, "corpus"))
    masked = T.mask_tokens(T.words("text"), "row_id", 0.15, 7)
    return corpus.select("row_id", F.array_join(masked, " ").alias("masked"))


MASK_TOKENS_SQL = with_inputs(
    rf""", w AS (SELECT row_id, list_filter(regexp_split_to_array(trim(text, {WS}), '\s+'), lambda x: x <> '') AS w FROM corpus),
    e AS (SELECT row_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos FROM w)
    SELECT w.row_id, coalesce(m.masked, '') AS masked FROM w LEFT JOIN (
      SELECT row_id, string_agg(CASE WHEN ('0x' || substr(md5(concat_ws(':', row_id, pos, 7)), 1, 8))::BIGINT / 4294967296.0 < 0.15
        THEN '<mask>' ELSE tok END, ' ' ORDER BY pos) AS masked FROM e GROUP BY row_id) m ON w.row_id = m.row_id""",
    "corpus",
)


def unmask(spark, sf):
    docs = load(spark, sf, "documents")
    labels = F.transform(
        F.sequence(F.lit(0), (F.col("doc_id") % 40).cast("int")),
        lambda i: F.when((i + F.col("doc_id")) % 3 == 0, F.lit(-100)).otherwise(i + F.length("text")),
    )
    return docs.select("doc_id", F.array_join(T.unmask(labels, 0).cast("array<string>"), " ").alias("label_ids"))


def distinct_words(spark, sf):
    corpus = load(spark, sf, "corpus")
    return corpus.select("row_id", F.array_join(T.distinct_in_order(T.words("text")), " ").alias("vocabulary"))


QUERIES = {
    "doc_code": (doc_code, DOC_CODE_SQL),
    "build_input": (
        build_input,
        with_inputs(
            f"""SELECT row_id, '{PREFIX}' || regexp_extract(file, '-([^#-]*)', 1) || ' ' || text AS model_input FROM corpus""",
            "corpus",
        ),
    ),
    "fallback_text": (
        fallback_text,
        with_inputs("SELECT row_id, CASE WHEN comments IS NULL THEN rule ELSE comments END AS chosen FROM annotated", "annotated"),
    ),
    "normalise_text": (
        normalise_text,
        with_inputs(
            f"""SELECT row_id, CASE WHEN t = '' OR right(t, 1) = '.' THEN t ELSE t || '.' END AS normalised
            FROM (SELECT row_id, trim(text, {WS}) AS t FROM corpus)""",
            "corpus",
        ),
    ),
    "apply_replacements": (
        apply_replacements,
        with_inputs(
            f""", t AS (SELECT row_id, rule AS before FROM rules UNION ALL SELECT row_id, text FROM corpus)
            SELECT row_id, before, {_nested_replace('before', fixed.REPLACEMENTS)} AS replaced FROM t""",
            "rules",
            "corpus",
        ),
    ),
    "space_terms": (space_terms, SPACE_TERMS_SQL),
    "rename_terms": (
        rename_terms,
        with_inputs(
            f"""SELECT row_id, short, {_nested_replace('short', fixed.SCHEMA_TERMS)} AS long FROM (SELECT row_id,
            {_nested_replace('rule', [(b, a) for a, b in fixed.SCHEMA_TERMS_BACK])} AS short FROM annotated)""",
            "annotated",
        ),
    ),
    "score_words": (score_words, SCORE_WORDS_SQL),
    "qualify_refs": (qualify_refs, QUALIFY_REFS_SQL),
    "clean_prediction": (clean_prediction, CLEAN_PREDICTION_SQL),
    "answer_after": (answer_after, ANSWER_AFTER_SQL),
    "parse_quantity": (parse_quantity, PARSE_QUANTITY_SQL),
    "parse_run_name": (
        parse_run_name,
        with_inputs(
            r"""SELECT event_id, name, regexp_extract(name, '^([^-]+-[^-]+)', 1) AS model_name,
            CAST(regexp_extract(name, 'b(\d+)_', 1) AS INTEGER) AS batch_size,
            CAST(regexp_extract(name, '_([0-9.e-]+)_beam', 1) AS DOUBLE) AS learning_rate,
            CAST(regexp_extract(name, 'beam(\d+)_hyper', 1) AS INTEGER) AS beam_size FROM run_results""",
            "run_results",
        ),
    ),
    "run_group": (run_group, RUN_GROUP_SQL),
    "format_metrics": (
        format_metrics,
        with_inputs(
            """SELECT event_id, round_even(test_bleu * 100 * 10, 0) / 10 AS "BLEU", round_even(test_f1 * 100 * 10, 0) / 10 AS "F1-Score",
            round_even(runtime * 10, 0) / 10 AS runtime FROM run_results""",
            "run_results",
        ),
    ),
    "truncate_tokens": (
        truncate_tokens,
        with_inputs(
            rf"""SELECT row_id, array_to_string(w[1:128], ' ') AS kept, CAST(len(w[1:128]) AS BIGINT) AS n_kept FROM (
            SELECT row_id, list_filter(regexp_split_to_array(trim(text, {WS}), '\s+'), lambda x: x <> '') AS w FROM corpus)""",
            "corpus",
        ),
    ),
    "second_pass_input": (
        second_pass_input,
        with_inputs(
            f"""SELECT row_id, '{REPAIR_PREFIX}' || body || '<sep>' || pred AS full, '{REPAIR_PREFIX}' || pred AS output_only,
            '{REPAIR_PREFIX}' || body || '<sep>' AS input_only
            FROM (SELECT *, string_split(ref, '<sep>')[1] AS body FROM text_pairs)""",
            "text_pairs",
        ),
    ),
    "mask_tokens": (mask_tokens, MASK_TOKENS_SQL),
    "unmask": (
        unmask,
        """SELECT doc_id, array_to_string([CASE WHEN (i + doc_id) % 3 = 0 THEN 0 ELSE i + length(text) END
        FOR i IN range(0, doc_id % 40 + 1)], ' ') AS label_ids FROM documents""",
    ),
    "distinct_words": (
        distinct_words,
        with_inputs(
            rf""", w AS (SELECT row_id, list_filter(regexp_split_to_array(trim(text, {WS}), '\s+'), lambda x: x <> '') AS w FROM corpus),
            e AS (SELECT row_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM w),
            f AS (SELECT row_id, tok, min(pos) AS pos FROM e GROUP BY row_id, tok)
            SELECT w.row_id, coalesce(v, '') AS vocabulary FROM w LEFT JOIN (
              SELECT row_id, string_agg(tok, ' ' ORDER BY pos) AS v FROM f GROUP BY row_id) g ON w.row_id = g.row_id""",
            "corpus",
        ),
    ),
}

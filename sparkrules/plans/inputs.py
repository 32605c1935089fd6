"""Inputs of the registered queries, derived from the test tables.

Each input is one SELECT that Spark SQL and DuckDB read alike, over whole tables. ``{name}`` stands
for a test table or for another input. Varying rule shapes and damage by a remainder of the key
only varies the content. No row is left out, but for what a pair cannot hold: ``text_pairs`` are the
answers of an assistant with the user turn before them, so system turns and unanswered turns have no pair.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_Q = "chr(39)"
_S = "o_orderstatus"
_P = f"concat({_Q}, o_orderpriority, {_Q})"
_N = "CAST(CAST(floor(o_totalprice) AS BIGINT) % 997 AS STRING)"
_UNIT = "CASE o_orderkey % 4 WHEN 0 THEN 'mm' WHEN 1 THEN 'kg' WHEN 2 THEN 'm2' ELSE 'kg/m3' END"
_OBL = f"concat('obligation(lessThan(order.total,', {_N}, ' ', {_UNIT}, '))')"

_RULE = f"""CASE o_orderkey % 8
  WHEN 0 THEN concat('if(and(is(order.status,', {_S}, '),is(order.priority,', {_P}, '),has(order,part))),then(', {_OBL}, ')')
  WHEN 1 THEN concat('if(and(and(is(order.status,', {_S}, '),has(order,part)),or(or(is(order.priority,', {_P},
    '),not(has(order,customer))),has(order,lateSupplier)))),then(', {_OBL}, ')')
  WHEN 2 THEN concat('if(is(order.status,or(', {_S}, ',X,Y))),then(', {_OBL}, ')')
  WHEN 3 THEN concat('if(is(order.status,', {_S}, ')),then(and(', {_OBL}, ',', {_OBL}, ',permission(has(order,part))))')
  WHEN 4 THEN concat('if(and(is(order.status,', {_S}, '),has(order,part),then(', {_OBL}, ')))')
  WHEN 5 THEN concat('if(and(is(order.status,', {_S}, '),is(order.status,X),is(order.priority,', {_P},
    '),is(order.priority,high))),then(', {_OBL}, ')')
  WHEN 6 THEN concat('if(and(define(order.kind,openOrder),define(lateOrder,_new),is(openOrder.type,lateOpenOrder),has(lateOrder,openOrder),',
    'complies(order,table(t1.', {_N}, ')),use(order,3.', {_N}, '.1))),then(', {_OBL}, ')')
  ELSE concat('if(not(is(order.note,', {_Q}, 'see t1.2, (Figure 3)', {_Q}, '))),then(expr(expr(', {_OBL},
    ')),loop(forEach(part),has(part,order_line)))')
END"""

INPUTS: dict[str, str] = {
    "corpus": (
        "SELECT doc_id AS row_id, text, concat('docs/XX-', source, '#', CAST(doc_id AS STRING)) AS file, "
        "source, lang FROM {documents}"
    ),
    "annotated": """SELECT d.doc_id AS row_id, d.text,
        CASE WHEN d.doc_id % 4 = 0 THEN substr(d.text, 10) ELSE d.text END AS text_old,
        concat('docs/XX-', d.source, '#', CAST(d.doc_id AS STRING)) AS file,
        CASE WHEN l.doc_id IS NULL THEN NULL ELSE concat(
          CASE WHEN l.quality = 1 AND d.doc_id % 3 = 0 THEN 'MediumData; ' ELSE '' END,
          CASE WHEN l.quality = 0 THEN 'LongEntities; ' ELSE '' END,
          CASE WHEN l.toxic = 1 THEN 'Ignore; ' ELSE '' END,
          CASE WHEN d.doc_id % 5 = 0 THEN 'Tacit; ' ELSE '' END,
          CASE WHEN d.doc_id % 7 = 0 THEN 'TACIT-1' ELSE '' END) END AS comments,
        CASE d.doc_id % 4 WHEN 0 THEN 'if( expression( function( define), data( x0)))'
          WHEN 1 THEN 'if( rulestatement( expression( function( is))))'
          WHEN 2 THEN 'if( atom( relation( key), variable( y)))' ELSE 'if( expression( function( is)))' END AS rule
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "rules": (
        "SELECT o_orderkey AS row_id, concat('rules/XX-', o_orderstatus, CAST(o_custkey % 10 AS STRING), '#', "
        f"CAST(o_orderkey AS STRING)) AS file, {_RULE} AS rule FROM {{orders}}"
    ),
    "damaged": """SELECT row_id, file, CASE row_id % 10
        WHEN 1 THEN substr(rule, 1, length(rule) - 1)
        WHEN 2 THEN replace(rule, 'has(', 'has((')
        WHEN 3 THEN ''
        WHEN 4 THEN replace(rule, '))', ')))')
        WHEN 5 THEN concat('  Sure. ', replace(replace(rule, '(', '['), ')', chr(125)), '. ')
        WHEN 6 THEN replace(rule, ',then(', ',noThen(')
        WHEN 7 THEN replace(rule, 'has(order,part)', 'has()')
        ELSE rule END AS rule FROM {rules}""",
    "rule_pairs": """SELECT row_id, rule AS ref, CASE row_id % 7
        WHEN 1 THEN ''
        WHEN 2 THEN replace(rule, 'order.status', 'order.state')
        WHEN 3 THEN substr(rule, 1, length(rule) - 12)
        WHEN 4 THEN concat('Target: ', rule)
        WHEN 5 THEN replace(replace(rule, 'is(', 'has('), 'part', 'spare part')
        WHEN 6 THEN replace(rule, ')),then(', ',then(')
        ELSE rule END AS pred FROM {rules}""",
    "text_pairs": """SELECT a.conv_id AS conv_id, a.turn AS turn, a.conv_id * 100 + a.turn AS row_id,
        CASE a.conv_id % 6 WHEN 0 THEN u.text WHEN 1 THEN concat(substr(u.text, 1, 60), a.text)
          WHEN 2 THEN '' ELSE a.text END AS pred, u.text AS ref
        FROM {conversations} a JOIN {conversations} u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE a.role = 'assistant' AND u.role = 'user'""",
    "responses": """SELECT conv_id AS row_id, turn AS attempt, CASE (conv_id + turn) % 4
        WHEN 0 THEN concat('Let me think.', chr(10), 'Target: if(', text, ')')
        WHEN 1 THEN concat('Option ', CAST(turn AS STRING), ': ', text)
        WHEN 2 THEN concat('The target: Option x ', text, ' Target: second')
        ELSE text END AS response FROM {conversations}""",
    "metric_log": "SELECT user_id AS run, event_id AS step, value, event_type FROM {events}",
    "padded": """SELECT row_id, CASE WHEN late THEN '' ELSE pred END AS pred, CASE WHEN late THEN '' ELSE ref END AS ref FROM (
        SELECT row_id, pred, ref, conv_id * 10 > 9 * (SELECT max(conv_id) FROM {conversations}) AS late FROM {text_pairs})""",
    "run_results": """SELECT concat('t5-base-b', CAST(4 * (user_id % 3 + 1) AS STRING), '_0.000', CAST(user_id % 6 + 1 AS STRING),
        '_beam', CAST(2 * (user_id % 3) + 1 AS STRING), '_hyper_', CASE user_id % 4 WHEN 0 THEN 'no-clause' WHEN 1 THEN 'calc-loss' ELSE 'base' END,
        '_', CASE event_type WHEN 'click' THEN 'doc' ELSE 'random' END, '_split_esp20_e20_', CAST(43 + user_id % 3 AS STRING)) AS name,
        user_id, event_type, value / 500 AS test_bleu, value / 600 AS test_f1, value AS runtime, event_id
        FROM {events}""",
    "quantities": """SELECT l_orderkey, l_linenumber, concat(CAST(CAST(l_quantity AS BIGINT) AS STRING),
        CASE l_linenumber % 3 WHEN 0 THEN '.5' WHEN 1 THEN '.0' ELSE '' END, ' ',
        CASE (l_linenumber + l_partkey) % 12 WHEN 0 THEN 'mm' WHEN 1 THEN 'kg' WHEN 2 THEN 'm2' WHEN 3 THEN 'kg/m3'
          WHEN 4 THEN 'm' WHEN 5 THEN 'kN*m' WHEN 6 THEN 'MPa' WHEN 7 THEN 'degC' WHEN 8 THEN 'apples'
          WHEN 9 THEN 'm10' WHEN 10 THEN 'ha' ELSE 'N/mm2' END) AS quantity FROM {lineitem}""",
    "vectors": "SELECT vec_id AS row_id, embedding, label AS cluster FROM {embeddings}",
    "questions": "SELECT item_id AS query_id, 'bench' AS code, text FROM {benchmark}",
    "exemplars": """SELECT doc_id AS row_id, source AS code, text, concat('if(is(document.source,', source,
        ')),then(obligation(is(document.lang,', lang, ')))') AS rule FROM {documents}""",
    "candidates": """SELECT c.conv_id AS row_id, c.turn AS cand_id, c.text AS pred, f.text AS text, concat('c', CAST(c.conv_id AS STRING)) AS code,
        CAST(length(c.text) % 17 AS DOUBLE) / 16 AS score, f.text AS rule
        FROM {conversations} c JOIN {conversations} f ON c.conv_id = f.conv_id AND f.turn = 0""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(name for _, name, _, _ in string.Formatter().parse(sql) if name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a derived input as a lazy DataFrame."""
    if name not in INPUTS:
        return table(spark, sf_dir, name)
    sql = INPUTS[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _needs(sql)})


def dealt(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows dealt by their key ahead of work that is heavy per row; joins and groups on the key then need no shuffle."""
    return df.repartition(key)


def with_inputs(body: str, *names: str, recursive: bool = False) -> str:
    """The SQL twin of ``load``: ``WITH <inputs and what they need> <body>``.

    A body that brings its own common table expressions starts with a comma.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in INPUTS and name not in ordered:
            for needed in _needs(INPUTS[name]):
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    views = {t: t for t in [*TABLES, *INPUTS]}
    parts = [f"{n} AS ({INPUTS[n].format(**views)})" for n in ordered]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"

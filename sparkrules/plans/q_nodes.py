"""Registered queries over rule trees.

The SQL twins work relationally on token and node tables (running sums, range self joins), while the
Spark side folds each rule inside its row, so the two share no method.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrules.functions import fixed, tree
from sparkrules.operators import nodes
from sparkrules.plans.inputs import dealt, load, with_inputs

SEED = 11
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


LOGIC, KEYS = _in(tree.LOGIC_WORDS), _in(fixed.KEYWORDS)


# --- SQL building blocks ----------------------------------------------------------------------------


def parse_sql(src: str, out: str, col: str = "rule") -> str:
    """Node table of a rule column: running bracket sum, clamped at 0; '((' counts once."""
    return rf"""{out}_t AS (SELECT row_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (
        SELECT row_id, regexp_extract_all({col}, '(?:[^''(),]|''[^'']*(?:''|$))+|[(),]') AS t FROM {src})),
    {out}_l AS (SELECT *, lag(x) OVER w AS prev, lead(x) OVER w AS nxt FROM {out}_t WINDOW w AS (PARTITION BY row_id ORDER BY i)),
    {out}_s AS (SELECT *, sum(CASE WHEN x = '(' AND prev IS DISTINCT FROM '(' THEN 1 WHEN x = ')' THEN -1 ELSE 0 END)
        OVER (PARTITION BY row_id ORDER BY i) AS s FROM {out}_l),
    {out}_d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY row_id ORDER BY i)) AS d FROM {out}_s),
    {out} AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS node_id, CAST(d AS INTEGER) AS depth,
        x AS name, coalesce(nxt = '(', false) AS is_term FROM {out}_d WHERE x NOT IN ('(', ')', ',') AND NOT (nxt IS NULL AND d > 0))"""


def link_sql(src: str, out: str) -> str:
    """Add parent, end of the subtree, leaf flag and parent name, by range joins on the pre-order."""
    return f"""{out}_p AS (SELECT n.row_id, n.node_id, coalesce(max(p.node_id), -1) AS parent_id FROM {src} n
        LEFT JOIN {src} p ON p.row_id = n.row_id AND p.depth = n.depth - 1 AND p.node_id < n.node_id GROUP BY ALL),
    {out}_m AS (SELECT row_id, max(node_id) AS top FROM {src} GROUP BY row_id),
    {out}_e AS (SELECT n.row_id, n.node_id, min(q.node_id) - 1 AS last_id FROM {src} n
        LEFT JOIN {src} q ON q.row_id = n.row_id AND q.depth <= n.depth AND q.node_id > n.node_id GROUP BY ALL),
    {out} AS MATERIALIZED (SELECT n.*, trim(n.name) AS word, parent_id, coalesce(last_id, top) AS last_id,
        coalesce(lead(n.depth) OVER (PARTITION BY n.row_id ORDER BY n.node_id), -1) <= n.depth AS is_leaf,
        lead(n.depth) OVER (PARTITION BY n.row_id ORDER BY n.node_id) AS next_depth,
        coalesce(trim(p.name), '') AS parent FROM {src} n JOIN {out}_p USING (row_id, node_id) JOIN {out}_e USING (row_id, node_id)
        JOIN {out}_m USING (row_id) LEFT JOIN {src} p ON p.row_id = n.row_id AND p.node_id = parent_id)"""


def render_sql(src: str, rows: str, out: str = "rule") -> str:
    """Rule strings of a node table (row_id, node_id, depth, name); rows without nodes are empty."""
    return f"""SELECT r.row_id, coalesce(s, '') AS {out} FROM {rows} r LEFT JOIN (SELECT row_id, string_agg(
        name || CASE WHEN nd > depth THEN '(' ELSE repeat(')', depth - coalesce(nd, 0)) || CASE WHEN nd IS NULL THEN '' ELSE ',' END END,
        '' ORDER BY node_id) AS s FROM (SELECT *, lead(depth) OVER (PARTITION BY row_id ORDER BY node_id) AS nd FROM {src}) GROUP BY row_id) g
      ON g.row_id = r.row_id"""


def subtrees_sql(linked: str, out: str, where: str = "true") -> str:
    """Rendered subtree of every node that meets ``where``."""
    return f"""{out} AS MATERIALIZED (SELECT n.row_id, n.node_id, string_agg(m.name || CASE WHEN m.node_id = n.last_id THEN repeat(')', m.depth - n.depth)
        WHEN m.next_depth > m.depth THEN '(' ELSE repeat(')', m.depth - m.next_depth) || ',' END, '' ORDER BY m.node_id) AS txt
      FROM {linked} n JOIN {linked} m ON m.row_id = n.row_id AND m.node_id BETWEEN n.node_id AND n.last_id WHERE {where} GROUP BY ALL)"""


def collapse_sql(linked: str, out: str) -> str:
    return f"""{out}_c AS (SELECT row_id, parent_id, count(*) AS k FROM {linked} GROUP BY ALL),
    {out}_f AS MATERIALIZED (SELECT l.row_id, l.node_id, l.last_id FROM {linked} l JOIN {out}_c c ON c.row_id = l.row_id AND c.parent_id = l.parent_id
        WHERE l.word = l.parent AND (l.word IN ('and', 'or') OR (l.word IN ('expr', 'expression') AND k = 1))),
    {out} AS MATERIALIZED (SELECT l.row_id, l.node_id, CAST(l.depth - (SELECT count(*) FROM {out}_f f WHERE f.row_id = l.row_id AND f.node_id < l.node_id
        AND f.last_id >= l.node_id) AS INTEGER) AS depth, l.name FROM {linked} l ANTI JOIN {out}_f f ON f.row_id = l.row_id AND f.node_id = l.node_id)"""


def repair_sql(linked: str, out: str) -> str:
    return f"""{out}_o AS (SELECT row_id, count(*) FILTER (WHERE depth = 0) AS tops, min(node_id) FILTER (WHERE word = 'then') AS t FROM {linked} GROUP BY row_id),
    {out} AS MATERIALIZED (SELECT l.row_id, row_number() OVER (PARTITION BY l.row_id ORDER BY CASE WHEN th.node_id IS NULL THEN 0 ELSE 1 END, l.node_id) - 1 AS node_id,
        l.depth - coalesce(th.depth, 0) AS depth, l.name FROM {linked} l LEFT JOIN {out}_o o ON o.row_id = l.row_id AND o.tops = 1 AND o.t IS NOT NULL
        LEFT JOIN {linked} th ON th.row_id = o.row_id AND th.node_id = o.t AND l.node_id BETWEEN th.node_id AND th.last_id)"""


def dedupe_sql(linked: str, out: str, name: str) -> str:
    return f"""{out}_b AS MATERIALIZED (SELECT n.row_id, n.node_id, n.last_id, n.parent_id, string_agg(m.name, '~' ORDER BY m.node_id) AS leaves
        FROM {linked} n JOIN {linked} m ON m.row_id = n.row_id AND m.node_id BETWEEN n.node_id AND n.last_id AND m.is_leaf WHERE n.word = '{name}' GROUP BY ALL),
    {out}_g AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, parent_id, leaves ORDER BY node_id) AS rn FROM {out}_b) WHERE rn > 1),
    {out} AS MATERIALIZED (SELECT l.row_id, l.node_id, l.depth, l.name FROM {linked} l
        ANTI JOIN {out}_g g ON g.row_id = l.row_id AND l.node_id BETWEEN g.node_id AND g.last_id)"""


_CAMEL_LEAF = r"""CASE WHEN contains(name, ' ') THEN replace(name, '_', ' ') ELSE regexp_replace(regexp_replace(
    replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' '), '([a-z])\.([a-z])', '\1. \2', 'g'), '([a-z])\.([a-z])', '\1. \2', 'g') END"""
_SPACED = rf"""' ' || CASE WHEN is_leaf THEN {_CAMEL_LEAF} ELSE lower(regexp_replace(CASE name WHEN 'fun' THEN 'function' WHEN 'var' THEN 'variable'
    WHEN 'rel' THEN 'relation' WHEN 'expr' THEN 'expression' ELSE name END, '([a-z0-9])([A-Z])', '\1 \2', 'g')) END"""


def spaced_sql(linked: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT * REPLACE ({_SPACED} AS name) FROM {linked})"


def facts_sql(linked: str, out: str) -> str:
    """Relation nodes: no non-keyword ancestor is left through anything but its first argument."""
    return rf"""{out}_x AS (SELECT DISTINCT c.row_id, n.node_id FROM {linked} a JOIN {linked} c ON c.row_id = a.row_id AND c.parent_id = a.node_id
          AND c.node_id <> a.node_id + 1 JOIN {linked} n ON n.row_id = c.row_id AND n.node_id BETWEEN c.node_id AND c.last_id WHERE a.word NOT IN {LOGIC}),
    {out}_r AS MATERIALIZED (SELECT l.* FROM (SELECT *, row_number() OVER (PARTITION BY row_id, parent_id ORDER BY node_id) - 1 AS sibling FROM {linked}) l
          ANTI JOIN {out}_x x ON x.row_id = l.row_id AND x.node_id = l.node_id WHERE NOT is_leaf AND word NOT IN {LOGIC}),
    {subtrees_sql(linked, out + '_t')},
    {out}_a AS (SELECT *, row_number() OVER (PARTITION BY row_id, parent_id ORDER BY node_id) AS arg FROM {linked}),
    {out}_v AS (SELECT c.row_id, c.parent_id AS node_id, list(trim(t.txt) ORDER BY c.node_id) AS alts FROM {linked} c JOIN {out}_t t USING (row_id, node_id) GROUP BY ALL),
    {out} AS MATERIALIZED (SELECT r.row_id, r.node_id, r.parent_id, r.sibling, r.parent, r.word AS relation,
          CASE WHEN a.is_leaf THEN regexp_extract(trim(a.name), '^(.*?)(?:\.[a-z].*)?$', 1) ELSE trim(ta.txt) END AS subject,
          CASE WHEN a.is_leaf THEN nullif(regexp_extract(trim(a.name), '^.*?\.([a-z].*?)(?:\.[a-z].*)?$', 1), '') END AS property,
          trim(tb.txt) AS object, CASE WHEN b.word IN ('and', 'or') AND NOT b.is_leaf THEN b.word END AS connector,
          CASE WHEN b.word IN ('and', 'or') AND NOT b.is_leaf THEN v.alts WHEN b.node_id IS NOT NULL THEN [trim(tb.txt)] END AS vals
        FROM {out}_r r JOIN {out}_a a ON a.row_id = r.row_id AND a.parent_id = r.node_id AND a.arg = 1 JOIN {out}_t ta ON ta.row_id = r.row_id AND ta.node_id = a.node_id
        LEFT JOIN {out}_a b ON b.row_id = r.row_id AND b.parent_id = r.node_id AND b.arg = 2 LEFT JOIN {out}_t tb ON tb.row_id = r.row_id AND tb.node_id = b.node_id
        LEFT JOIN {out}_v v ON v.row_id = r.row_id AND v.node_id = b.node_id)"""


def _on(body: str, source: str) -> str:
    return with_inputs(f", {parse_sql(source, 'n')}, {link_sql('n', 'l')}{body}", source)


# --- Spark queries ------------------------------------------------------------------------------------


def node_table(spark, sf):
    both = dealt(load(spark, sf, "damaged"))
    return nodes.node_table(both).select(
        "row_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("parent_id").cast("bigint").alias("parent_id"), "depth", "name", "is_term"
    )


def render_rules(spark, sf):
    damaged = dealt(load(spark, sf, "damaged"))
    rendered = nodes.render_rules(nodes.node_table(damaged))
    return damaged.select("row_id").join(rendered, "row_id", "left").na.fill("", ["rule"])


def node_facts(spark, sf):
    found = nodes.node_facts(dealt(load(spark, sf, "rules")))
    ids = ["node_id", "parent_id", "n_children", "sibling"]
    return found.select("row_id", *[F.col(c).cast("bigint").alias(c) for c in ids], "depth", "name", "is_leaf", "path")


NODE_FACTS_SQL = _on(
    """, k AS (SELECT row_id, parent_id AS node_id, count(*) AS n_children FROM l GROUP BY ALL),
    p AS (SELECT n.row_id, n.node_id, '/' || string_agg(a.name, '/' ORDER BY a.node_id) AS path FROM l n JOIN l a ON a.row_id = n.row_id
      AND n.node_id BETWEEN a.node_id AND a.last_id GROUP BY ALL)
    SELECT l.row_id, l.node_id, l.parent_id, l.depth, l.name, l.is_leaf, coalesce(n_children, 0) AS n_children,
      row_number() OVER (PARTITION BY l.row_id, l.parent_id ORDER BY l.node_id) - 1 AS sibling, path
    FROM l LEFT JOIN k USING (row_id, node_id) JOIN p USING (row_id, node_id)""",
    "rules",
)


def _rewritten(step: str, source: str = "rules"):
    def query(spark, sf):
        return nodes.rewrite_rules(dealt(load(spark, sf, source)), [step]).select("row_id", "rule")

    return query


def predicate_facts(spark, sf):
    facts = nodes.predicate_facts(dealt(load(spark, sf, "rules")))
    return facts.select(
        "row_id",
        F.col("node_id").cast("bigint").alias("node_id"),
        F.col("sibling").cast("bigint").alias("sibling"),
        "parent", "relation", "subject", "property", "object", "connector", F.array_join("values", "|").alias("options"),
    )


def expand_alternatives(spark, sf):
    expanded = nodes.expand_alternatives(nodes.predicate_facts(dealt(load(spark, sf, "rules"))))
    return expanded.select(
        "row_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("alternative").cast("bigint").alias("alternative"),
        "relation", "subject", "property", "connector", "object",
    )


def factor_alternatives(spark, sf):
    factored = nodes.factor_alternatives(nodes.predicate_facts(dealt(load(spark, sf, "rules"))))
    return factored.select(
        "row_id", F.col("node_id").cast("bigint").alias("node_id"), "relation", "subject", "property", "connector",
        F.array_join("values", "|").alias("options"),
    )


FACTOR_SQL = _on(
    f""", {facts_sql('l', 'f')},
    g AS (SELECT *, CASE WHEN parent IN ('and', 'or') AND object IS NOT NULL AND lag(parent_id) OVER w = parent_id AND lag(sibling) OVER w + 1 = sibling
        AND lag(relation) OVER w = relation AND lag(subject) OVER w = subject AND lag(property) OVER w IS NOT DISTINCT FROM property THEN 0 ELSE 1 END AS starts
      FROM f WINDOW w AS (PARTITION BY row_id ORDER BY node_id)),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY row_id ORDER BY node_id) AS island FROM g)
    SELECT row_id, min(node_id) AS node_id, relation, subject, property, CASE WHEN count(object) > 1 THEN any_value(parent) END AS connector,
      coalesce(string_agg(object, '|' ORDER BY node_id), '') AS options FROM i GROUP BY row_id, island, relation, subject, property""",
    "rules",
)


def rule_entities(spark, sf):
    return nodes.rule_entities(dealt(load(spark, sf, "rules"))).select("row_id", "entities")


ENTITIES_SQL = _on(
    rf""", e AS (SELECT row_id, node_id, unnest(parts) AS name, generate_subscripts(parts, 1) AS k FROM (
        SELECT row_id, node_id, string_split(regexp_replace(name, '\.([a-z])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM l WHERE is_leaf)),
    s AS (SELECT row_id, node_id, k, {_CAMEL_LEAF} AS word FROM e WHERE NOT regexp_matches(name, '^x\d+')),
    d AS (SELECT row_id, word, min(node_id * 1000 + k) AS pos FROM s GROUP BY ALL)
    SELECT r.row_id, coalesce(string_agg(word, ', ' ORDER BY pos), '') AS entities FROM rules r LEFT JOIN d ON d.row_id = r.row_id GROUP BY r.row_id""",
    "rules",
)


def rule_expressions(spark, sf):
    return nodes.rule_expressions(dealt(load(spark, sf, "rules"))).select("row_id", "expressions")


EXPRESSIONS_SQL = _on(
    f""", {spaced_sql('l', 's')}, {subtrees_sql('s', 't', f"n.word NOT IN {KEYS} AND n.parent IN {KEYS}")}
    SELECT r.row_id, trim(coalesce(string_agg(txt, ',' ORDER BY node_id), ''), {_WS}) AS expressions FROM rules r LEFT JOIN t ON t.row_id = r.row_id GROUP BY r.row_id""",
    "rules",
)


def _completion(midword: bool):
    def query(spark, sf):
        pairs = nodes.completion_pairs(dealt(load(spark, sf, "rules")), 2, SEED, midword=midword)
        return pairs.select("row_id", "pick", F.col("node_id").cast("bigint").alias("node_id"), "given", "wanted")

    return query


def _completion_sql(midword: bool) -> str:
    u = f"(('0x' || substr(md5(concat_ws(':', row_id, pick, 'cut', {SEED})), 1, 8))::BIGINT / 4294967296.0 * (length(name) + dbl))"
    cut = f"CASE WHEN {u} < 1 THEN 0 WHEN {u} < 1 + 2 * dbl THEN 1 + floor(({u} - 1) / 2) ELSE floor({u} - dbl) END"
    tail = f" || substr(name, 1, CAST({cut} AS INTEGER))" if midword else ""
    return _on(
        f""", {subtrees_sql('l', 't')},
        c AS (SELECT row_id, count(*) AS n FROM l GROUP BY row_id),
        k AS (SELECT row_id, pick, CAST(floor(('0x' || substr(md5(concat_ws(':', row_id, pick, {SEED})), 1, 8))::BIGINT / 4294967296.0 * n) AS BIGINT) AS node_id
          FROM c, (SELECT unnest([1, 2])::INTEGER AS pick)),
        b AS (SELECT k.row_id, k.pick, k.node_id, coalesce(string_agg(m.name || CASE WHEN m.next_depth > m.depth THEN '(' ELSE repeat(')', m.depth - m.next_depth) || ',' END,
          '' ORDER BY m.node_id), '') AS pre FROM k LEFT JOIN l m ON m.row_id = k.row_id AND m.node_id < k.node_id GROUP BY ALL),
        j AS (SELECT b.*, l.name, t.txt, least(4, length(l.name)) - 1 AS dbl FROM b JOIN l USING (row_id, node_id) JOIN t USING (row_id, node_id)),
        w AS ({render_sql('n', 'rules')})
        SELECT row_id, pick, node_id, pre{tail} AS given, txt AS wanted FROM j
        UNION ALL SELECT row_id, 0, -1, '', rule FROM w""",
        "rules",
    )


def rule_lint(spark, sf):
    return nodes.rule_lint(dealt(load(spark, sf, "damaged")))


LINT_SQL = _on(
    rf""", x AS (SELECT DISTINCT n.row_id, n.node_id FROM l a JOIN l n ON n.row_id = a.row_id AND n.node_id > a.node_id AND n.node_id <= a.last_id WHERE a.word NOT IN {LOGIC}),
    f AS (SELECT e.row_id, e.node_id, count(*) FILTER (WHERE c.word IN ('fun', 'function')) AS k, arg_min(c.word, c.node_id) AS head FROM l e
      LEFT JOIN l c ON c.row_id = e.row_id AND c.parent_id = e.node_id WHERE e.word IN ('expr', 'expression') GROUP BY ALL)
    SELECT row_id, 'empty rule' AS issue FROM damaged WHERE trim(rule) = ''
    UNION ALL SELECT row_id, 'unbalanced brackets' FROM n_t GROUP BY row_id HAVING count(*) FILTER (WHERE x = '(') <> count(*) FILTER (WHERE x = ')')
    UNION ALL SELECT DISTINCT l.row_id, 'predicate without arguments' FROM l ANTI JOIN x ON x.row_id = l.row_id AND x.node_id = l.node_id
      WHERE is_leaf AND depth > 0 AND word NOT IN {LOGIC}
    UNION ALL SELECT DISTINCT row_id, 'expression without one function' FROM f WHERE k <> 1 AND head IS DISTINCT FROM 'rulestatement'
    UNION ALL SELECT d.row_id, 'missing then' FROM damaged d LEFT JOIN l ON l.row_id = d.row_id AND l.word = 'then' WHERE l.row_id IS NULL
    UNION ALL SELECT DISTINCT row_id, 'unknown unit' FROM l WHERE is_leaf AND regexp_matches(word, '^[0-9]+\.?[0-9]*\s([a-zA-Z0-9/*+-]+)$')
      AND NOT regexp_matches(word, ' (mm|kg|m2|kg/m3)$')""",
    "damaged",
)
REWRITE_STEPS = ["clean", "repair_then", "collapse_nested", "drop_duplicate_obligations", "spaced_notation"]


def rewrite_rules(spark, sf):
    return nodes.rewrite_rules(dealt(load(spark, sf, "damaged")), REWRITE_STEPS).select("row_id", "rule")


REWRITE_SQL = with_inputs(
    f""", z AS (SELECT row_id, replace(translate(CASE WHEN contains(t, 'if(') THEN substr(t, strpos(t, 'if(')) ELSE t END, '[]{{}}', '()()'), ').', ')') AS rule
      FROM (SELECT row_id, trim(rule, {_WS}) AS t FROM damaged)),
    {parse_sql('z', 'n')}, {link_sql('n', 'l')}, {repair_sql('l', 'a')}, {link_sql('a', 'al')}, {collapse_sql('al', 'b')},
    b2 AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY node_id) - 1 AS node_id, depth, name FROM b),
    {link_sql('b2', 'bl')}, {dedupe_sql('bl', 'c', 'obligation')},
    c2 AS MATERIALIZED (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY node_id) - 1 AS node_id, depth, name FROM c),
    {link_sql('c2', 'cl')}, {spaced_sql('cl', 's')} SELECT row_id, trim(rule) AS rule FROM ({render_sql('s', 'z')})""",
    "damaged",
)
CANONICAL_SQL = _on(
    r""", d AS (SELECT n.row_id, n.node_id, list(c.word ORDER BY c.node_id) AS args FROM l n JOIN l c ON c.row_id = n.row_id AND c.parent_id = n.node_id
        WHERE n.word = 'define' GROUP BY ALL),
    v AS (SELECT row_id, list(CASE WHEN args[2] = '_new' THEN args[1] ELSE args[2] END ORDER BY node_id) AS vars FROM d GROUP BY row_id),
    s AS (SELECT l.row_id, l.node_id, l.depth, CASE WHEN v.row_id IS NULL THEN name ELSE regexp_replace(regexp_replace(name,
        '\b' || vars[1] || '\b', 'x0', 'g'), '\b' || coalesce(vars[2], vars[1]) || '\b', 'x1', 'g') END AS name FROM l LEFT JOIN v ON v.row_id = l.row_id) """
    + render_sql("s", "rules"),
    "rules",
)
TYPE_WORD_SQL = _on(
    r""", a AS (SELECT *, row_number() OVER (PARTITION BY row_id, parent_id ORDER BY node_id) AS arg FROM l),
    h AS (SELECT o.row_id, o.node_id, left(o.name, length(o.name) - length(s.word) + 5) AS short FROM a o JOIN a s ON s.row_id = o.row_id AND s.parent_id = o.parent_id
      WHERE o.arg = 2 AND s.arg = 1 AND o.parent = 'is' AND o.is_leaf AND s.word LIKE '%.type' AND length(o.name) > length(s.word) - 5
        AND ends_with(lower(o.name), lower(left(s.word, length(s.word) - 5)))),
    s AS (SELECT l.row_id, l.node_id, l.depth, coalesce(short, l.name) AS name FROM l LEFT JOIN h ON h.row_id = l.row_id AND h.node_id = l.node_id) """
    + render_sql("s", "rules"),
    "rules",
)

QUERIES = {
    "node_table": (node_table, _on(" SELECT row_id, node_id, parent_id, depth, name, is_term FROM l", "damaged")),
    "render_rules": (render_rules, _on(f" {render_sql('n', 'damaged')}", "damaged")),
    "node_facts": (node_facts, NODE_FACTS_SQL),
    "collapse_nested": (_rewritten("collapse_nested"), _on(f", {collapse_sql('l', 'c')} {render_sql('c', 'rules')}", "rules")),
    "drop_duplicate_branches": (
        _rewritten("drop_duplicate_obligations"),
        _on(f", {dedupe_sql('l', 'c', 'obligation')} {render_sql('c', 'rules')}", "rules"),
    ),
    "repair_then": (_rewritten("repair_then"), _on(f", {repair_sql('l', 'c')} {render_sql('c', 'rules')}", "rules")),
    "canonical_vars": (_rewritten("canonical_vars"), CANONICAL_SQL),
    "dedupe_type_word": (_rewritten("dedupe_type_word"), TYPE_WORD_SQL),
    "predicate_facts": (
        predicate_facts,
        _on(
            f""", {facts_sql('l', 'f')} SELECT row_id, node_id, sibling, parent, relation, subject, property, object, connector,
            array_to_string(vals, '|') AS options FROM f""",
            "rules",
        ),
    ),
    "expand_alternatives": (
        expand_alternatives,
        _on(
            f""", {facts_sql('l', 'f')} SELECT row_id, node_id, CASE WHEN vals IS NULL THEN NULL ELSE k - 1 END AS alternative, relation, subject, property, connector,
            vals[k] AS object FROM (SELECT *, unnest(range(1, greatest(coalesce(len(vals), 0), 1) + 1)) AS k FROM f)""",
            "rules",
        ),
    ),
    "factor_alternatives": (factor_alternatives, FACTOR_SQL),
    "rule_entities": (rule_entities, ENTITIES_SQL),
    "rule_expressions": (rule_expressions, EXPRESSIONS_SQL),
    "completion_pairs": (_completion(False), _completion_sql(False)),
    "completion_midword": (_completion(True), _completion_sql(True)),
    "rule_lint": (rule_lint, LINT_SQL),
    "rewrite_rules": (rewrite_rules, REWRITE_SQL),
    "spaced_notation": (
        _rewritten("spaced_notation"),
        _on(f", {spaced_sql('l', 's')} SELECT row_id, trim(rule, {_WS}) AS rule FROM ({render_sql('s', 'rules')})", "rules"),
    ),
}

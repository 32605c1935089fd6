"""Rule strings as trees held in one column.

A rule is one value of one row, so its tree never needs a shuffle: parsing, rewriting and rendering
are native array expressions. A *linked* tree is the pre-order list of nodes with ``node_id`` (the
index), ``parent_id`` (-1 at the top) and ``ancestors`` (ids from the top down); the first child of
node i is node i + 1. A *flat* tree keeps only ``(depth, name, is_term)``, which in order is enough
to render it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed, quantity
from sparkrules.functions import text as T
from sparkrules.operators.ranking import hash_fraction, seed_hash

# A word, in which quotes protect separators and an open quote runs to the end; and what separates it.
WORD = r"((?:[^'(),]++|'[^']*+(?:'|\z))++)([(),]*+)"
QUOTED = r"'[^']*+(?:'|\z)"
EXPRESSION_WORDS = ["expr", "expression", "appliedstatement", "rulestatement"]
LOGIC_WORDS = [*fixed.KEYWORDS, *EXPRESSION_WORDS]
LINKED = "array<struct<node_id:int,parent_id:int,depth:int,name:string,is_term:boolean,ancestors:array<int>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def parse(rule: Column, *, then_at_top: bool = False) -> Column:
    """Rule string to linked tree, in one pass over its words.

    A bracket opens the latest node; closing brackets beyond the top are ignored; a last word that is
    not closed is kept only at the top level. ``then_at_top`` closes everything before a ``then(``.

    The separators after a word decide the next depth in closed form: if any of them opens, only the
    closings after the last opening count.
    """

    def step(acc: Column, x: Column) -> Column:
        depth = acc["depth"]
        if then_at_top:
            depth = F.when((F.trim(x["word"]) == "then") & x["opens"], 0).otherwise(depth)
        return _grown(acc, depth, x, ~x["unclosed"] | (depth == 0))

    def word(w: Column, after: Column) -> Column:
        closing = F.substring_index(after, "(", -1)
        closed = F.length(closing) - F.length(F.replace(closing, F.lit(")"), F.lit("")))
        return F.struct(
            w.alias("word"),
            after.startswith("(").alias("opens"),
            (F.when(after.contains("("), 1).otherwise(0) - closed).alias("change"),
            (after == "").alias("unclosed"),
        )

    found = lambda group: F.regexp_extract_all(rule, F.lit(WORD), F.lit(group))
    return F.aggregate(F.zip_with(found(1), found(2), word), _start(), step, lambda acc: acc["nodes"])


def _start() -> Column:
    return F.struct(F.lit(0).alias("depth"), _empty("array<int>").alias("stack"), _empty(LINKED).alias("nodes"))


def _grown(acc: Column, depth: Column, x: Column, kept: Column) -> Column:
    """A tree under construction with the word ``x`` at a depth; ``stack`` holds the open nodes."""
    above = F.slice(acc["stack"], F.lit(1), depth)
    here = F.size(acc["nodes"])
    node = F.struct(
        here.alias("node_id"),
        F.coalesce(F.get(above, depth - 1), F.lit(-1)).alias("parent_id"),
        depth.alias("depth"),
        x["word"].alias("name"),
        x["opens"].alias("is_term"),
        above.alias("ancestors"),
    )
    return F.struct(
        F.greatest(depth + x["change"], F.lit(0)).alias("depth"),
        F.concat(above, F.array(here)).alias("stack"),
        F.when(kept, F.concat(acc["nodes"], F.array(node))).otherwise(acc["nodes"]).alias("nodes"),
    )


def relink(flat: Column) -> Column:
    """A flat tree as a linked one: what parsing its rendered rule gives, without the string between."""

    def body(ns: Column) -> Column:
        def word(n: Column, i: Column) -> Column:
            following = F.coalesce(F.get(ns, i + 1)["depth"], F.get(ns, F.lit(0))["depth"])
            change = F.least(following - n["depth"], F.lit(1))
            return F.struct(n["name"].alias("word"), (following > n["depth"]).alias("opens"), change.alias("change"))

        step = lambda acc, x: _grown(acc, acc["depth"], x, x["word"] != "")
        return F.aggregate(F.transform(ns, word), _start(), step, lambda acc: acc["nodes"])

    return let(flat, body)


def flatten(linked: Column) -> Column:
    return F.transform(linked, lambda n: _flat(n["depth"], n["name"], n["is_term"]))


def _flat(depth: Column, name: Column, is_term: Column) -> Column:
    return F.struct(depth.alias("depth"), name.alias("name"), is_term.alias("is_term"))


def _pieces(nodes: Column) -> Column:
    """Each name with the brackets and comma that follow it."""

    def piece(n: Column, i: Column) -> Column:
        following = F.get(nodes, i + 1)["depth"]
        down = F.repeat(F.lit(")"), n["depth"] - F.coalesce(following, F.get(nodes, F.lit(0))["depth"]))
        return F.concat(
            n["name"],
            F.when(following > n["depth"], F.lit("(")).otherwise(
                F.concat(down, F.when(following.isNull(), F.lit("")).otherwise(F.lit(",")))
            ),
        )

    return F.transform(nodes, piece)


def render(nodes: Column) -> Column:
    """A flat or linked tree (or subtree) as a rule string; no nodes give an empty string."""
    return let(nodes, lambda ns: F.array_join(_pieces(ns), ""))


def before(nodes: Column, node_id: Column) -> Column:
    """The rule string up to, and without, a node."""
    return F.array_join(F.slice(_pieces(nodes), F.lit(1), node_id), "")


def subtree(linked: Column, node_id: Column) -> Column:
    return F.filter(linked, lambda n: (n["node_id"] == node_id) | F.array_contains(n["ancestors"], node_id))


def is_leaf(linked: Column, n: Column) -> Column:
    return F.coalesce(F.get(linked, n["node_id"] + 1)["parent_id"], F.lit(-1)) != n["node_id"]


def leaf_names(linked: Column) -> Column:
    """Names of the leaves of a whole linked tree, in order."""
    return F.transform(F.filter(linked, lambda n: is_leaf(linked, n)), lambda n: n["name"])


def subtree_leaves(linked: Column, node_id: Column) -> Column:
    inside = F.filter(
        linked,
        lambda n: is_leaf(linked, n) & ((n["node_id"] == node_id) | F.array_contains(n["ancestors"], node_id)),
    )
    return F.transform(inside, lambda n: n["name"])


def parent_name(linked: Column, n: Column) -> Column:
    return F.coalesce(F.trim(F.get(linked, n["parent_id"])["name"]), F.lit(""))


def children(linked: Column, node_id: Column) -> Column:
    return F.filter(linked, lambda n: n["parent_id"] == node_id)


# --- rewrites: linked tree in, flat tree out ------------------------------------------------------


def collapse_nested(linked: Column) -> Column:
    """Merge an ``and`` under an ``and`` (``or`` likewise) and an expression that is an only child of one.

    Whether a node goes depends only on its own parent, so one pass reaches the fixpoint.
    """

    def body(linked: Column) -> Column:
        def merged(n: Column) -> Column:
            name = F.trim(n["name"])
            alone = F.size(children(linked, n["parent_id"])) == 1
            same = parent_name(linked, n) == name
            return same & (name.isin(fixed.CONNECTORS) | (name.isin("expr", "expression") & alone))

        def rebuild(gone: Column) -> Column:
            kept = F.filter(linked, lambda n: ~F.array_contains(gone, n["node_id"]))
            return F.transform(
                kept, lambda n: _flat(n["depth"] - F.size(F.array_intersect(n["ancestors"], gone)), n["name"], n["is_term"])
            )

        return let(F.transform(F.filter(linked, merged), lambda n: n["node_id"]), rebuild)

    return let(linked, body)


def drop_duplicate_branches(linked: Column, name: str) -> Column:
    """Drop a branch called ``name`` when an earlier sibling of that name has the same leaves."""

    def body(linked: Column) -> Column:
        named = F.transform(
            F.filter(linked, lambda n: F.trim(n["name"]) == name),
            lambda n: F.struct(
                n["node_id"].alias("id"), n["parent_id"].alias("parent"), subtree_leaves(linked, n["node_id"]).alias("leaves")
            ),
        )

        def rebuild(branches: Column) -> Column:
            twin = lambda b: F.exists(
                branches, lambda a: (a["id"] < b["id"]) & (a["parent"] == b["parent"]) & (a["leaves"] == b["leaves"])
            )
            gone = F.transform(F.filter(branches, twin), lambda b: b["id"])
            return let(
                gone,
                lambda g: flatten(
                    F.filter(
                        linked, lambda n: ~F.array_contains(g, n["node_id"]) & ~F.arrays_overlap(n["ancestors"], g)
                    )
                ),
            )

        return let(named, rebuild)

    return let(linked, body)


def repair_then(linked: Column) -> Column:
    """Move the first ``then`` to the end of the top level when there is a single top node."""

    def body(linked: Column) -> Column:
        thens = F.filter(linked, lambda n: F.trim(n["name"]) == "then")
        tops = F.size(F.filter(linked, lambda n: n["depth"] == 0))

        def move(then: Column) -> Column:
            inside = lambda n: (n["node_id"] == then["node_id"]) | F.array_contains(n["ancestors"], then["node_id"])
            moved = F.transform(
                F.filter(linked, inside), lambda n: _flat(n["depth"] - then["depth"], n["name"], n["is_term"])
            )
            return F.concat(flatten(F.filter(linked, lambda n: ~inside(n))), moved)

        return F.when((tops == 1) & (F.size(thens) > 0), let(F.get(thens, F.lit(0)), move)).otherwise(flatten(linked))

    return let(linked, body)


def rename(linked: Column, new_name: Callable[[Column, Column], Column]) -> Column:
    """Rename nodes by a function of (name, is_leaf)."""
    return let(
        linked,
        lambda ns: F.transform(
            ns,
            lambda n, i: _flat(
                n["depth"], new_name(n["name"], F.coalesce(F.get(ns, i + 1)["depth"], F.lit(-1)) <= n["depth"]), n["is_term"]
            ),
        ),
    )


def canonical_vars(linked: Column) -> Column:
    """Names introduced by ``define`` become x0, x1, ... wherever they are a whole word of the rule.

    ``define(a.b, name)`` introduces ``name``; ``define(name, _new)`` introduces ``name``.
    """

    def body(linked: Column) -> Column:
        def introduced(n: Column) -> Column:
            args = children(linked, n["node_id"])
            first, second = F.get(args, F.lit(0))["name"], F.get(args, F.lit(1))["name"]
            return F.when(F.trim(second) == "_new", F.trim(first)).otherwise(F.trim(second))

        defines = F.filter(linked, lambda n: F.trim(n["name"]) == "define")
        names = F.array_distinct(F.filter(F.transform(defines, introduced), lambda v: v.rlike(r"^\w+$")))

        def rewrite(found: Column) -> Column:
            # a name is cut at its word boundaries and put together again, each word looked up
            word = lambda w: F.coalesce(F.concat(F.lit("x"), F.nullif(F.array_position(found, w), F.lit(0)) - 1), w)
            cut = lambda name: F.regexp_extract_all(name, F.lit(r"(\w+|\W+)"), F.lit(1))
            renamed = lambda name: F.when(F.size(found) > 0, F.array_join(F.transform(cut(name), word), "")).otherwise(name)
            return F.transform(linked, lambda n: _flat(n["depth"], renamed(n["name"]), n["is_term"]))

        return let(names, rewrite)

    return let(linked, body)


def dedupe_type_word(linked: Column) -> Column:
    """``is(pipe.type, wastePipe)`` becomes ``is(pipe.type, waste)``; letter case does not matter."""

    def body(linked: Column) -> Column:
        def renamed(n: Column) -> Column:
            first = F.get(linked, n["parent_id"] + 1)
            subject = F.lower(F.regexp_extract(F.trim(first["name"]), r"^(\w+)\.type$", 1))
            is_second = (
                (parent_name(linked, n) == "is")
                & (first["node_id"] != n["node_id"])
                & is_leaf(linked, n)
                & (F.size(F.filter(linked, lambda m: (m["parent_id"] == n["parent_id"]) & (m["node_id"] < n["node_id"]))) == 1)
            )
            hit = is_second & (subject != "") & F.lower(n["name"]).endswith(subject) & (F.length(n["name"]) > F.length(subject))
            short = F.substr(n["name"], F.lit(1), F.length(n["name"]) - F.length(subject))
            return F.when(F.coalesce(hit, F.lit(False)), short).otherwise(n["name"])

        return F.transform(linked, lambda n: _flat(n["depth"], renamed(n), n["is_term"]))

    return let(linked, body)


# --- fixed values: short schema terms as whole node names ------------------------------------------
LONG_NAMES = {"fun": "function", "var": "variable", "rel": "relation", "expr": "expression"}


def spaced_notation(rule: Column) -> Column:
    """The rule for a tokeniser: inner names long and in words, leaf names in words, blanks before names."""

    def new_name(name: Column, leaf: Column) -> Column:
        longer = name
        for short, long in LONG_NAMES.items():
            longer = F.when(name == short, F.lit(long)).otherwise(longer)
        return F.concat(F.lit(" "), F.when(leaf, T.split_leaf(name)).otherwise(T.split_inner(longer)))

    return T.strip(render(rename(parse(rule), new_name)))


def tidy_quantities(linked: Column) -> Column:
    """Leaf quantities in their short form: ``50.0 mm`` becomes ``50 mm``."""

    def new_name(name: Column, leaf: Column) -> Column:
        short = quantity.format_quantity(quantity.parse_quantity(name))
        return F.when(leaf, F.coalesce(short, name)).otherwise(name)

    return rename(linked, new_name)


# --- readings -------------------------------------------------------------------------------------


def is_relation(linked: Column, n: Column) -> Column:
    """An inner, non-keyword node reached through keywords and first arguments only."""
    path = F.concat(n["ancestors"], F.array(n["node_id"]))
    steps = F.transform(
        n["ancestors"],
        lambda a, k: F.trim(F.get(linked, a)["name"]).isin(LOGIC_WORDS) | (F.get(path, k + 1) == a + 1),
    )
    return ~F.trim(n["name"]).isin(LOGIC_WORDS) & ~is_leaf(linked, n) & F.forall(steps, lambda s: s)


def facts(linked: Column) -> Column:
    """Every relation node as (relation, subject, property, object), with alternatives in ``values``."""

    def fact(n: Column) -> Column:
        def with_args(args: Column) -> Column:
            first, second = F.get(args, F.lit(0)), F.get(args, F.lit(1))
            subject = F.trim(render(subtree(linked, first["node_id"])))
            parts = F.split(subject, r"\.(?=[a-z])")
            simple = is_leaf(linked, first)
            value = F.trim(render(subtree(linked, second["node_id"])))
            choice = F.trim(second["name"]).isin(fixed.CONNECTORS) & ~is_leaf(linked, second)
            options = F.transform(
                children(linked, second["node_id"]), lambda c: F.trim(render(subtree(linked, c["node_id"])))
            )
            return F.struct(
                n["node_id"].alias("node_id"),
                n["parent_id"].alias("parent_id"),
                F.size(F.filter(children(linked, n["parent_id"]), lambda s: s["node_id"] < n["node_id"])).alias("sibling"),
                parent_name(linked, n).alias("parent"),
                F.trim(n["name"]).alias("relation"),
                F.when(simple, F.get(parts, F.lit(0))).otherwise(subject).alias("subject"),
                F.when(simple, F.get(parts, F.lit(1))).alias("property"),
                F.when(second.isNotNull(), value).alias("object"),
                F.when(choice, F.trim(second["name"])).alias("connector"),
                F.when(choice, options).when(second.isNotNull(), F.array(value)).alias("values"),
            )

        return let(children(linked, n["node_id"]), with_args)

    return F.transform(F.filter(linked, lambda n: is_relation(linked, n)), fact)


def entities(linked: Column) -> Column:
    """Leaf words: names split at dots, numbered variables dropped, first-seen distinct."""
    parts = F.flatten(F.transform(leaf_names(linked), lambda v: F.split(v, r"\.(?=[a-z])")))
    named = F.filter(parts, lambda v: ~v.rlike(r"^x\d+"))
    return F.array_join(F.array_distinct(F.transform(named, T.split_leaf)), ", ")


def expressions(linked: Column) -> Column:
    """The non-keyword nodes right under a keyword, rendered and joined."""
    found = F.filter(
        linked, lambda n: ~F.trim(n["name"]).isin(fixed.KEYWORDS) & parent_name(linked, n).isin(fixed.KEYWORDS)
    )
    return T.strip(F.array_join(F.transform(found, lambda n: render(subtree(linked, n["node_id"]))), ","))


def completion(linked: Column, key: Column, pick: Column, seed: int, midword: bool) -> Column:
    """A seeded node: the rule text before it (optionally with a part of its name) and its subtree."""
    at = F.floor(hash_fraction(seed_hash(seed, key, pick)) * F.size(linked)).cast("int")

    def pair(chosen: Column) -> Column:
        prefix = before(linked, chosen)
        if midword:
            name = F.get(linked, chosen)["name"]
            # letters 1 to 3 weigh double: closed form of the inverse cumulative weights
            double = F.least(F.lit(4), F.length(name)) - 1
            u = hash_fraction(seed_hash(seed, key, pick, F.lit("cut"))) * (F.length(name) + double)
            cut = F.when(u < 1, F.lit(0)).when(u < 1 + 2 * double, 1 + F.floor((u - 1) / 2)).otherwise(F.floor(u - double))
            prefix = F.concat(prefix, F.substr(name, F.lit(1), cut.cast("int")))
        return F.struct(
            pick.cast("int").alias("pick"),
            chosen.alias("node_id"),
            prefix.alias("given"),
            render(subtree(linked, chosen)).alias("wanted"),
        )

    return let(at, pair)


def lint(rule: Column, linked: Column) -> Column:
    """The structural problems of a rule, as an array of issue names."""
    bare_text = F.regexp_replace(rule, QUOTED, "")
    count = lambda sign: F.length(bare_text) - F.length(F.replace(bare_text, F.lit(sign), F.lit("")))
    names = F.transform(linked, lambda n: F.trim(n["name"]))
    bare = F.exists(
        linked,
        lambda n: is_leaf(linked, n)
        & (n["depth"] > 0)
        & ~F.trim(n["name"]).isin(LOGIC_WORDS)
        & F.forall(n["ancestors"], lambda a: F.trim(F.get(linked, a)["name"]).isin(LOGIC_WORDS)),
    )

    def odd_expression(n: Column) -> Column:
        inside = F.transform(children(linked, n["node_id"]), lambda c: F.trim(c["name"]))
        functions = F.size(F.filter(inside, lambda v: v.isin("fun", "function")))
        exempt = F.coalesce(F.get(inside, F.lit(0)) == "rulestatement", F.lit(False))
        return F.trim(n["name"]).isin("expr", "expression") & (functions != 1) & ~exempt

    unit = F.exists(
        leaf_names(linked), lambda v: F.trim(v).rlike(quantity.QUANTITY) & quantity.parse_quantity(F.trim(v)).isNull()
    )
    checks = {
        "empty rule": T.strip(rule) == "",
        "unbalanced brackets": count("(") != count(")"),
        "predicate without arguments": bare,
        "expression without one function": F.exists(linked, odd_expression),
        "missing then": ~F.array_contains(names, "then"),
        "unknown unit": unit,
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]))


#: Steps that read a linked tree and give a flat one.
TREE_STEPS: dict[str, Callable[[Column], Column]] = {
    "repair_then": repair_then,
    "collapse_nested": collapse_nested,
    "drop_duplicate_obligations": lambda linked: drop_duplicate_branches(linked, "obligation"),
    "drop_duplicate_expressions": lambda linked: drop_duplicate_branches(linked, "expression"),
    "canonical_vars": canonical_vars,
    "dedupe_type_word": dedupe_type_word,
    "tidy_quantities": tidy_quantities,
}

#: Steps that read and give a rule string.
TEXT_STEPS: dict[str, Callable[[Column], Column]] = {
    "clean": T.clean_prediction,
    "replacements": T.apply_replacements,
    "long_terms": T.rename_terms,
    "short_terms": lambda r: T.rename_terms(r, reverse=True),
    "space_terms": T.space_terms,
    "spaced_notation": spaced_notation,
}

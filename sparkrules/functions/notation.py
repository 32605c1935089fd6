"""Reversible steps between the long notation of rules and shorter ones, and the notation levels.

Five steps, each with a way back, as native array expressions on a linked tree (see ``functions.tree``):

=========== ============================================== ==========================
step        long                                           short
=========== ============================================== ==========================
units       data(baseunit(..),value(50.0))                 data(50 mm)
values      or(f(..data(a)),f(..data(b)))                  f(..data(or(a,b)))
atoms       atom(relation(p),variable(x))                  atom(x.p)
expressions expression(function(f),atom(x),data(y))        f(x,y)
loops       expression(rulestatement(a),appliedstatement(b)) loop(a,b)
=========== ============================================== ==========================

A step maps every node to the nodes that stand for it, so one pass rewrites the tree, and what a step does
not recognise stays as it is. Names that a step adds take the blank before the node they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed, quantity
from sparkrules.functions import tree as t

FLAT = "array<struct<depth:int,name:string,is_term:boolean>>"
EXPRESSIONS = ["expr", "expression"]
OUTER = ["not", *EXPRESSIONS, *fixed.DEONTICS]


def _name(n: Column) -> Column:
    return F.trim(n["name"])


def _like(n: Column, word: Column | str) -> Column:
    """A new name with the blanks that stand before ``n``."""
    return F.concat(F.regexp_extract(n["name"], r"^\s*", 0), F.lit(word) if isinstance(word, str) else word)


def _node(depth: Column, name: Column, inner: bool) -> Column:
    return F.struct(depth.cast("int").alias("depth"), name.alias("name"), F.lit(inner).alias("is_term"))


def _kept(n: Column, shift: Column | int = 0) -> Column:
    return F.struct((n["depth"] + shift).cast("int").alias("depth"), n["name"].alias("name"), n["is_term"].alias("is_term"))


def _none() -> Column:
    return F.array().cast(FLAT)


def _flat_map(linked: Column, emit: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(linked, emit))


def _ids(linked: Column, test: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(linked, test), lambda n: n["node_id"])


def _under(n: Column, ids: Column) -> Column:
    return F.arrays_overlap(n["ancestors"], ids)


def _levels_in(n: Column, ids: Column) -> Column:
    return F.size(F.array_intersect(n["ancestors"], ids))


def _has(ids: Column, n: Column) -> Column:
    return F.array_contains(ids, n["node_id"])


def _kid(linked: Column, n: Column, i: int) -> Column:
    return F.get(t.children(linked, n["node_id"]), F.lit(i))


def _n_kids(linked: Column, n: Column) -> Column:
    return F.size(t.children(linked, n["node_id"]))


def _first_leaf(linked: Column, n: Column) -> Column:
    return F.trim(F.get(t.subtree_leaves(linked, n["node_id"]), F.lit(0)))


# --- atoms ----------------------------------------------------------------------------------------


def atoms_short(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        def named(n: Column) -> Column:
            one, two = _kid(ns, n, 0), _kid(ns, n, 1)
            pair = (_n_kids(ns, n) == 2) & _name(one).isin("rel", "relation") & _name(two).isin("var", "variable")
            lone = (_n_kids(ns, n) == 1) & _name(one).isin("var", "variable")
            inner = ~t.is_leaf(ns, one)
            text = F.when(pair & inner & ~t.is_leaf(ns, two), F.concat(_first_leaf(ns, two), F.lit("."), _first_leaf(ns, one)))
            return text.when(lone & inner, _first_leaf(ns, one))

        def rebuild(atoms: Column) -> Column:
            def emit(n: Column) -> Column:
                leaf = _node(n["depth"] + 1, _like(n, named(n)), False)
                return F.when(_has(atoms, n), F.array(_kept(n), leaf)).when(_under(n, atoms), _none()).otherwise(F.array(_kept(n)))

            return _flat_map(ns, emit)

        return t.let(_ids(ns, lambda n: (_name(n) == "atom") & named(n).isNotNull()), rebuild)

    return t.let(linked, body)


def atoms_long(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        def rebuild(atoms: Column) -> Column:
            def emit(n: Column) -> Column:
                parts = F.split(_name(_kid(ns, n, 0)), r"\.(?=[a-z])")
                one = lambda word, part: [_node(n["depth"] + 1, _like(n, word), True), _node(n["depth"] + 2, _like(n, part), False)]
                variable = one("variable", F.get(parts, F.lit(0)))
                relation = F.when(F.size(parts) > 1, F.array(*one("relation", F.get(parts, F.lit(1))))).otherwise(_none())
                whole = F.concat(F.array(_kept(n)), relation, F.array(*variable))
                return F.when(_has(atoms, n), whole).when(_under(n, atoms), _none()).otherwise(F.array(_kept(n)))

            return _flat_map(ns, emit)

        return t.let(_ids(ns, lambda n: (_name(n) == "atom") & (_n_kids(ns, n) == 1) & t.is_leaf(ns, _kid(ns, n, 0))), rebuild)

    return t.let(linked, body)


# --- loops ----------------------------------------------------------------------------------------


def loops_short(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        def loop(n: Column) -> Column:
            wrapped = (_name(_kid(ns, n, 0)) == "rulestatement") & (_name(_kid(ns, n, 1)) == "appliedstatement")
            return _name(n).isin(EXPRESSIONS) & (_n_kids(ns, n) == 2) & wrapped

        def rebuild(loops: Column) -> Column:
            def with_wrappers(wrappers: Column) -> Column:
                def emit(n: Column) -> Column:
                    depth = n["depth"] - _levels_in(n, wrappers)
                    renamed = F.array(_node(depth, _like(n, "loop"), True))
                    other = F.array(_kept(n, -_levels_in(n, wrappers)))
                    return F.when(_has(wrappers, n), _none()).when(_has(loops, n), renamed).otherwise(other)

                return _flat_map(ns, emit)

            return t.let(_ids(ns, lambda n: F.array_contains(loops, n["parent_id"])), with_wrappers)

        return t.let(_ids(ns, loop), rebuild)

    return t.let(linked, body)


def loops_long(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        def rebuild(loops: Column) -> Column:
            def wrapped(n: Column) -> Column:
                earlier = F.size(F.filter(t.children(ns, n["parent_id"]), lambda s: s["node_id"] < n["node_id"]))
                return F.array_contains(loops, n["parent_id"]) & (earlier < 2)

            def with_wrapped(inside: Column) -> Column:
                def emit(n: Column) -> Column:
                    shift = _levels_in(n, inside)
                    first = n["node_id"] == n["parent_id"] + 1
                    wrapper = F.when(first, _like(n, "rulestatement")).otherwise(_like(n, "appliedstatement"))
                    both = F.array(_node(n["depth"] + shift, wrapper, True), _kept(n, shift + 1))
                    renamed = F.array(_node(n["depth"] + shift, _like(n, "expression"), True))
                    own = F.when(_has(loops, n), renamed).otherwise(F.array(_kept(n, shift)))
                    return F.when(_has(inside, n), both).otherwise(own)

                return _flat_map(ns, emit)

            return t.let(_ids(ns, wrapped), with_wrapped)

        return t.let(_ids(ns, lambda n: _name(n) == "loop"), rebuild)

    return t.let(linked, body)


# --- expressions ----------------------------------------------------------------------------------


def expressions_short(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        functions = lambda n: F.filter(
            t.children(ns, n["node_id"]), lambda c: _name(c).isin("fun", "function") & ~t.is_leaf(ns, c)
        )

        def rebuild(heads: Column) -> Column:
            def with_gone(gone: Column) -> Column:
                def wrapper(n: Column) -> Column:
                    lone = (_n_kids(ns, n) == 1) & ~_name(n).isin(EXPRESSIONS)
                    return F.array_contains(heads, n["parent_id"]) & lone & ~_has(gone, n)

                def with_wrappers(wrappers: Column) -> Column:
                    def emit(n: Column) -> Column:
                        shift = -_levels_in(n, wrappers)
                        called = _like(n, F.trim(F.get(ns, F.get(functions(n), F.lit(0))["node_id"] + 1)["name"]))
                        head = F.array(_node(n["depth"] + shift, called, True))
                        own = F.when(_has(heads, n), head).otherwise(F.array(_kept(n, shift)))
                        return F.when(_has(gone, n) | _under(n, gone) | _has(wrappers, n), _none()).otherwise(own)

                    return _flat_map(ns, emit)

                return t.let(_ids(ns, wrapper), with_wrappers)

            inside = lambda n: F.array_contains(heads, n["parent_id"]) & _name(n).isin("fun", "function")
            return t.let(_ids(ns, inside), with_gone)

        return t.let(_ids(ns, lambda n: _name(n).isin(EXPRESSIONS) & (F.size(functions(n)) == 1)), rebuild)

    return t.let(linked, body)


def expressions_long(linked: Column) -> Column:
    """Names reached through keywords, and first arguments that have arguments, become functions of expressions.

    The first argument, if it has none itself, becomes an atom; the second one data; further ones are dropped.
    """

    def body(ns: Column) -> Column:
        def head(n: Column) -> Column:
            path = F.concat(n["ancestors"], F.array(n["node_id"]))
            through = F.transform(
                n["ancestors"], lambda a, k: F.trim(F.get(ns, a)["name"]).isin(t.LOGIC_WORDS) | (F.get(path, k + 1) == a + 1)
            )
            by_keyword = F.coalesce(F.trim(F.get(ns, n["parent_id"])["name"]).isin(t.LOGIC_WORDS), F.lit(True))
            free = ~_name(n).isin([*t.LOGIC_WORDS, *fixed.STRUCTURE_WORDS])
            above = F.forall(n["ancestors"], lambda a: ~F.trim(F.get(ns, a)["name"]).isin("atom", "data", "fun", "function"))
            return free & above & F.forall(through, lambda x: x) & (by_keyword | ~t.is_leaf(ns, n))

        def rebuild(heads: Column) -> Column:
            def place(n: Column) -> Column:
                return F.size(F.filter(t.children(ns, n["parent_id"]), lambda s: s["node_id"] < n["node_id"]))

            argument = lambda n: F.array_contains(heads, n["parent_id"])
            atom = lambda n: argument(n) & (place(n) == 0) & t.is_leaf(ns, n)
            data = lambda n: argument(n) & (place(n) == 1) & (_name(n) != "data")

            def with_wrapped(wrapped: Column) -> Column:
                def with_dropped(dropped: Column) -> Column:
                    def emit(n: Column) -> Column:
                        depth = n["depth"] + _levels_in(n, wrapped)
                        word = F.when(n["node_id"] == n["parent_id"] + 1, _like(n, "atom")).otherwise(_like(n, "data"))
                        as_argument = F.array(_node(depth, word, True), _node(depth + 1, n["name"], False))
                        as_head = F.array(
                            _node(depth, _like(n, "expression"), True),
                            _node(depth + 1, _like(n, "function"), True),
                            _node(depth + 2, n["name"], False),
                        )
                        own = F.when(_has(heads, n), as_head).otherwise(F.array(_kept(n, _levels_in(n, wrapped))))
                        kept = F.when(_has(wrapped, n), as_argument).otherwise(own)
                        return F.when(_has(dropped, n) | _under(n, dropped), _none()).otherwise(kept)

                    return _flat_map(ns, emit)

                return t.let(_ids(ns, lambda n: argument(n) & (place(n) > 1)), with_dropped)

            return t.let(_ids(ns, lambda n: ~_has(heads, n) & (atom(n) | data(n))), with_wrapped)

        return t.let(_ids(ns, head), rebuild)

    return t.let(linked, body)


# --- units ----------------------------------------------------------------------------------------


def _short_number(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0$", "")


def units_short(linked: Column) -> Column:
    """Per data node with a unit and a value: its quantity, written once and looked up by node."""

    def body(ns: Column) -> Column:
        def base(unit: Column) -> Column:
            """A base unit from its parts, in any order: every part is a name with one leaf under it."""

            def written(parts: Column) -> Column:
                part = lambda name: F.trim(F.get(ns, F.get(F.filter(parts, lambda c: _name(c) == name), F.lit(0))["node_id"] + 1)["name"])
                prefix, kind = quantity.lookup(fixed.UNIT_PREFIXES, part("prefix")), quantity.lookup(fixed.UNIT_KINDS, part("kind"))
                return F.concat(*[F.coalesce(x, F.lit("")) for x in (prefix, kind, _short_number(part("exponent")))])

            return t.let(t.children(ns, unit["node_id"]), written)

        def derived(parts: Column) -> Column:
            bases = F.transform(F.filter(parts, lambda c: _name(c) == "baseunit"), base)
            signs = F.filter(parts, lambda c: _name(c) == "operator")
            sign = quantity.lookup(fixed.UNIT_OPERATORS, _first_leaf(ns, F.get(signs, F.lit(0))))
            return F.when(F.size(bases) == 2, F.concat(F.get(bases, F.lit(0)), sign, F.get(bases, F.lit(1))))

        def text(kids: Column) -> Column:
            unit, value = F.get(kids, F.lit(0)), F.get(kids, F.lit(1))
            written = F.when(_name(unit) == "baseunit", base(unit))
            written = written.when(_name(unit) == "derivedunit", t.let(t.children(ns, unit["node_id"]), derived))
            number = _short_number(F.trim(F.get(ns, value["node_id"] + 1)["name"]))
            whole = (F.size(kids) == 2) & (_name(value) == "value")
            return F.when(whole, t.let(written, lambda w: F.when(w != "", F.concat(number, F.lit(" "), w))))

        datas = F.filter(ns, lambda n: _name(n) == "data")
        read = F.transform(datas, lambda n: F.struct(n["node_id"].alias("at"), t.let(t.children(ns, n["node_id"]), text).alias("text")))

        def rebuild(found: Column) -> Column:
            def with_ids(ids: Column) -> Column:
                def emit(n: Column) -> Column:
                    own = F.get(F.filter(found, lambda x: x["at"] == n["node_id"]), F.lit(0))["text"]
                    leaf = _node(n["depth"] + 1, _like(n, own), False)
                    return F.when(_has(ids, n), F.array(_kept(n), leaf)).when(_under(n, ids), _none()).otherwise(F.array(_kept(n)))

                return _flat_map(ns, emit)

            return t.let(F.transform(found, lambda x: x["at"]), with_ids)

        return t.let(F.filter(read, lambda x: x["text"].isNotNull()), rebuild)

    return t.let(linked, body)


def units_long(linked: Column) -> Column:
    def body(ns: Column) -> Column:
        parsed = lambda n: quantity.parse_quantity(_name(_kid(ns, n, 0)))

        def rebuild(found: Column) -> Column:
            def emit(n: Column) -> Column:
                at = n["depth"] + 1
                inner = lambda shift, word: _node(at + shift, _like(n, word), True)

                def base(unit: Column, shift: int) -> Column:
                    def part(name: str) -> Column:
                        pair = F.array(inner(shift + 1, name), _node(at + shift + 2, _like(n, unit[name]), False))
                        return F.when(unit[name].isNotNull(), pair).otherwise(_none())

                    return F.concat(F.array(inner(shift, "baseunit")), *map(part, ("exponent", "prefix", "kind")))

                def whole(q: Column) -> Column:
                    operator = F.array(inner(1, "operator"), inner(2, "name"), _node(at + 3, _like(n, q["operator"]), False))
                    derived = F.concat(F.array(inner(0, "derivedunit")), base(q["first"], 1), operator, base(q["second"], 1))
                    unit = F.when(q["operator"].isNotNull(), derived).otherwise(base(q["first"], 0))
                    number = F.regexp_extract(_name(_kid(ns, n, 0)), quantity.QUANTITY, 1)
                    full = F.when(number.contains("."), number).otherwise(F.concat(number, F.lit(".0")))
                    value = F.array(inner(0, "value"), _node(at + 1, _like(n, full), False))
                    return F.concat(F.array(_kept(n)), unit, value)

                return F.when(_has(found, n), t.let(parsed(n), whole)).when(_under(n, found), _none()).otherwise(F.array(_kept(n)))

            return _flat_map(ns, emit)

        return t.let(_ids(ns, lambda n: (_name(n) == "data") & (_n_kids(ns, n) == 1) & parsed(n).isNotNull()), rebuild)

    return t.let(linked, body)


# --- values ---------------------------------------------------------------------------------------


def values_long(linked: Column) -> Column:
    """An expression over several values becomes one expression per value under the connector.

    Negations and obligations right around the expression are copied with it. Of several connectors in one
    expression the first is opened; the step can be applied again.
    """

    def body(ns: Column) -> Column:
        connector = lambda n: _name(n).isin(fixed.CONNECTORS) & (t.parent_name(ns, n) == "data") & ~t.is_leaf(ns, n)

        def top(n: Column) -> Column:
            """The outermost of the nodes around ``n`` that are copied together, from its nearest expression up."""
            outer = F.transform(n["ancestors"], lambda a: F.trim(F.get(ns, a)["name"]).isin(OUTER))

            def walk(acc: Column, k: Column) -> Column:
                hit = F.get(outer, k)
                on = F.when(acc["state"] == 0, F.when(hit, 1).otherwise(0)).when(acc["state"] == 1, F.when(hit, 1).otherwise(2)).otherwise(2)
                at = F.when(on == 1, F.get(n["ancestors"], k)).otherwise(acc["at"])
                return F.struct(on.alias("state"), at.alias("at"))

            back = F.when(F.size(outer) > 0, F.reverse(F.sequence(F.lit(0), F.size(outer) - 1))).otherwise(F.array().cast("array<int>"))
            start = F.struct(F.lit(0).alias("state"), F.lit(None).cast("int").alias("at"))
            return F.aggregate(back, start, walk, lambda acc: acc["at"])

        opened = F.transform(F.filter(ns, connector), lambda n: F.struct(top(n).alias("top"), n["node_id"].alias("at"), _name(n).alias("name")))

        def rebuild(all_found: Column) -> Column:
            first = F.filter(all_found, lambda x: x["top"].isNotNull() & ~F.exists(all_found, lambda y: (y["top"] == x["top"]) & (y["at"] < x["at"])))
            outermost = F.filter(first, lambda x: ~F.exists(first, lambda y: F.array_contains(F.get(ns, x["top"])["ancestors"], y["top"])))

            def with_found(found: Column) -> Column:
                tops = F.transform(found, lambda x: x["top"])

                def emit(n: Column) -> Column:
                    mine = F.get(F.filter(found, lambda x: x["top"] == n["node_id"]), F.lit(0))

                    def copies(x: Column) -> Column:
                        nested = t.parent_name(ns, n) == x["name"]
                        shift = F.when(nested, 0).otherwise(1)

                        def one(child: Column) -> Column:
                            inside = lambda m: (m["node_id"] == child["node_id"]) | F.array_contains(m["ancestors"], child["node_id"])
                            part = F.filter(t.subtree(ns, n["node_id"]), lambda m: inside(m) | ~((m["node_id"] == x["at"]) | F.array_contains(m["ancestors"], x["at"])))
                            return F.transform(part, lambda m: _kept(m, shift - F.when(inside(m), 1).otherwise(0)))

                        head = F.when(nested, _none()).otherwise(F.array(_node(n["depth"], _like(n, x["name"]), True)))
                        return F.concat(head, F.flatten(F.transform(t.children(ns, x["at"]), one)))

                    own = F.when(_under(n, tops), _none()).otherwise(F.array(_kept(n)))
                    return F.when(mine.isNotNull(), t.let(mine, copies)).otherwise(own)

                return _flat_map(ns, emit)

            return t.let(outermost, with_found)

        return t.let(opened, rebuild)

    return t.let(linked, body)


ISLANDS = "array<struct<sig:string,head:int,data:int,name:string,values:array<string>,members:array<int>>>"


def values_short(linked: Column) -> Column:
    """Neighbours under one connector that differ only in their one value become one expression over the values."""

    def body(ns: Column) -> Column:
        def member(k: Column, p: Column) -> Column:
            def over(part: Column) -> Column:
                datas = F.filter(part, lambda m: (_name(m) == "data") & (m["node_id"] != k["node_id"]))

                def with_data(data: Column) -> Column:
                    at = data["node_id"]
                    inside = F.filter(part, lambda m: F.array_contains(m["ancestors"], at))
                    single = (F.size(datas) == 1) & (F.size(inside) == 1) & _name(k).isin(OUTER)
                    rest = F.filter(part, lambda m: m["node_id"] != at + 1)
                    # a kid without exactly one value never joins a neighbour
                    sig = F.when(single, t.render(t.flatten(rest))).otherwise(F.concat(F.lit("#"), k["node_id"].cast("string")))
                    return F.struct(
                        sig.alias("sig"),
                        k["node_id"].alias("head"),
                        at.alias("data"),
                        p["name"].alias("name"),
                        F.array(F.get(ns, at + 1)["name"]).alias("values"),
                        F.array(k["node_id"]).alias("members"),
                    )

                return t.let(F.get(datas, F.lit(0)), with_data)

            return t.let(t.subtree(ns, k["node_id"]), over)

        def islands(p: Column) -> Column:
            def join(done: Column, x: Column) -> Column:
                last = F.get(done, F.size(done) - 1)
                longer = F.struct(
                    last["sig"].alias("sig"), last["head"].alias("head"), last["data"].alias("data"), last["name"].alias("name"),
                    F.concat(last["values"], x["values"]).alias("values"), F.concat(last["members"], x["members"]).alias("members"),
                )
                same = (F.size(done) > 0) & last["sig"].eqNullSafe(x["sig"])
                return F.when(same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

            kids = F.transform(t.children(ns, p["node_id"]), lambda k: member(k, p))
            return F.aggregate(kids, F.array().cast(ISLANDS), join)

        connectors = F.filter(ns, lambda n: _name(n).isin(fixed.CONNECTORS) & (t.parent_name(ns, n) != "data") & ~t.is_leaf(ns, n))
        per = F.transform(connectors, lambda p: F.struct(p["node_id"].alias("id"), islands(p).alias("all")))  # a few per rule

        def rebuild(groups: Column) -> Column:
            merged = F.filter(F.flatten(F.transform(groups, lambda g: g["all"])), lambda x: F.size(x["members"]) > 1)
            lone = F.transform(F.filter(groups, lambda g: (F.size(g["all"]) == 1) & (F.size(F.get(g["all"], F.lit(0))["members"]) > 1)), lambda g: g["id"])

            def with_merged(found: Column) -> Column:
                gone = F.flatten(F.transform(found, lambda x: F.slice(x["members"], 2, F.size(x["members"]))))
                datas = F.transform(found, lambda x: x["data"])

                def with_lone(alone: Column) -> Column:
                    def emit(n: Column) -> Column:
                        shift = -_levels_in(n, alone)
                        mine = F.get(F.filter(found, lambda x: x["data"] == n["node_id"]), F.lit(0))
                        values = F.transform(mine["values"], lambda v: _node(n["depth"] + 2 + shift, v, False))
                        several = F.concat(F.array(_kept(n, shift), _node(n["depth"] + 1 + shift, mine["name"], True)), values)
                        dropped = _has(gone, n) | _under(n, gone) | _has(alone, n) | F.array_contains(datas, n["parent_id"])
                        return F.when(dropped, _none()).when(mine.isNotNull(), several).otherwise(F.array(_kept(n, shift)))

                    return _flat_map(ns, emit)

                return t.let(lone, with_lone)

            return t.let(merged, with_merged)

        return t.let(per, rebuild)

    return t.let(linked, body)


SHORT = {"units": units_short, "values": values_short, "atoms": atoms_short, "expressions": expressions_short, "loops": loops_short}
LONG = {"units": units_long, "values": values_long, "atoms": atoms_long, "expressions": expressions_long, "loops": loops_long}
STEPS: dict[str, Callable[[Column], Column]] = {
    f"{name}_{way}": step for way, table in (("short", SHORT), ("long", LONG)) for name, step in table.items()
}


def _long_steps(short: Sequence[str]) -> list[str]:
    """The steps from the shortest notation to the one that is short in ``short`` only."""
    steps = [f"{name}_long" for name in ("loops", "expressions", "atoms") if name not in short]
    if "values" not in short:
        # values are opened on whole expressions
        steps += ["values_long"] if "expressions" not in short else ["expressions_long", "values_long", "expressions_short"]
    return steps + ([] if "units" in short else ["units_long"])


LEVELS: dict[str, list[str]] = {name: _long_steps(short) for name, short in fixed.NOTATION_LEVELS.items()}


"""What is read off rules, on all rules of an Arrow batch at once (see ``functions.forest``).

The readings are those that ``functions.tree`` describes row by row. A piece of a rule is written out once for each time that it is asked for,
so a reading costs in proportion to the nodes of a rule and to what it returns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed
from sparkrules.functions.forest import LOGIC_WORDS, ROWS, Forest, Words, spaced_leaf, spaced_notation
from sparkrules.operators.ranking import hash_fraction, seed_hash

PARTS = re.compile(r"\.(?=[a-z])")
NUMBERED = re.compile(r"x[0-9]+")
NODES = "array<struct<node_id:int,parent_id:int,depth:int,name:string,is_leaf:boolean,n_children:int,sibling:int,path:string>>"
FACTS = (
    "array<struct<node_id:int,parent_id:int,sibling:int,parent:string,relation:string,subject:string,property:string,object:string,"
    "connector:string,values:array<string>>>"
)
PAIRS = "array<struct<pick:int,node_id:int,given:string,wanted:string>>"


def _by_batch(kind: str, read: Callable[..., pa.Array], *columns: Column) -> Column:
    """``read`` on up to ``ROWS`` rows at a time."""

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        starts = range(0, len(columns[0]), ROWS)
        return pa.concat_arrays([read(*(c.slice(at, ROWS) for c in columns)) for at in starts] or [read(*columns)])

    return run(*columns)


def _parsed(rules: pa.Array) -> Forest:
    return Forest.parsed(rules.to_pylist(), Words())


def _texts(f: Forest, numbers: np.ndarray, unknown: np.ndarray | None = None) -> pa.Array:
    return pa.array(f.words.names, pa.string()).take(pa.array(numbers, mask=unknown))


def _int(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.astype(np.int32))


def _ids(f: Forest, nodes: np.ndarray, of: np.ndarray) -> pa.Array:
    """Node numbers within the rules of ``of``, -1 where there is no node."""
    return _int(np.where(nodes < 0, -1, nodes - f.starts[f.row[of]]))


def _lists(f: Forest, row: np.ndarray, items: pa.Array) -> pa.Array:
    """Items in the order of their rules as a list per rule."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(f.rows + 1)), pa.int32()), items)


def _struct(**fields: pa.Array | np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], [*fields])


def _node_facts(rules: pa.Array) -> pa.Array:
    f = _parsed(rules)
    names, paths = f.words.names, []
    for above, name in zip(f.parent.tolist(), f.name.tolist()):
        paths.append(f"{paths[above] if above >= 0 else ''}/{names[name]}")
    every = np.arange(len(f.row))
    found = _struct(
        node_id=_ids(f, every, every),
        parent_id=_ids(f, f.parent, every),
        depth=_int(f.depth),
        name=_texts(f, f.name),
        is_leaf=f.kids == 0,
        n_children=_int(f.kids),
        sibling=_int(f.place),
        path=pa.array(paths, pa.string()),
    )
    return _lists(f, f.row, found)


def node_facts(rule: Column) -> Column:
    """Every node with what it is among its kin, and the path of names that leads to it."""
    return _by_batch(NODES, _node_facts, rule)


def _before_part(text: str) -> str:
    return PARTS.split(text)[0]


def _second_part(text: str) -> str | None:
    return [*PARTS.split(text), None][1]


def _facts(rules: pa.Array) -> pa.Array:
    f = _parsed(rules)
    logic, top = f.named(*LOGIC_WORDS), f.parent < 0
    aside = ~top & ~f.of_parent(logic) & (f.place > 0)  # neither under a keyword nor a first argument
    at = np.flatnonzero(~logic & (f.kids > 0) & ~aside & (f.above(aside) == 0))
    two = f.kids[at] > 1
    first, second = at + 1, np.where(two, f.end[at + 1], -1)
    choice = two & np.append(f.named(*fixed.CONNECTORS) & (f.kids > 0), False)[second]
    # the texts that are asked for: subjects, objects, and the alternatives of a choice
    chosen = np.zeros(len(f.row), bool)
    chosen[second[choice]] = True
    options = np.flatnonzero(f.of_parent(chosen))
    wanted = np.unique(np.concatenate([first, second[two], options]))
    texts = [t.strip(" ") for t in f.subtrees(wanted).text().to_pylist()]
    text = dict(zip(wanted.tolist(), texts))
    by_choice: dict[int, list[str]] = {}
    for option, above in zip(options.tolist(), f.parent[options].tolist()):
        by_choice.setdefault(above, []).append(text[option])
    subject = [text[i] for i in first.tolist()]
    simple = (f.kids[first] == 0).tolist()
    value = [text[i] if i >= 0 else None for i in second.tolist()]
    trim, above = np.append(f.trim, f.words[""]), f.parent[at]
    found = _struct(
        node_id=_ids(f, at, at),
        parent_id=_ids(f, above, at),
        sibling=_int(f.place[at]),
        parent=_texts(f, trim[above]),
        relation=_texts(f, f.trim[at]),
        subject=pa.array([_before_part(s) if lone else s for s, lone in zip(subject, simple)], pa.string()),
        property=pa.array([_second_part(s) if lone else None for s, lone in zip(subject, simple)], pa.string()),
        object=pa.array(value, pa.string()),
        connector=_texts(f, trim[second], ~choice),
        values=pa.array([by_choice[s] if c else None if v is None else [v] for s, c, v in zip(second.tolist(), choice.tolist(), value)], pa.list_(pa.string())),
    )
    return _lists(f, f.row[at], found)


def facts(rule: Column) -> Column:
    """Every relation node as (relation, subject, property, object), with alternatives in ``values``."""
    return _by_batch(FACTS, _facts, rule)


def _words(name: str) -> list[str]:
    return [spaced_leaf(part) for part in PARTS.split(name) if not NUMBERED.match(part)]


def _entities(rules: pa.Array) -> pa.Array:
    f = _parsed(rules)
    names, leaves = f.words.names, f.kids == 0
    words = {n: _words(names[n]) for n in np.unique(f.name[leaves]).tolist()}
    found: list[dict[str, None]] = [{} for _ in range(f.rows)]
    for row, name in zip(f.row[leaves].tolist(), f.name[leaves].tolist()):
        found[row].update(dict.fromkeys(words[name]))
    return pa.array([", ".join(x) if r else None for r, x in zip(rules.is_valid().to_pylist(), found)], pa.string())


def entities(rule: Column) -> Column:
    """Leaf words: names split at dots, numbered variables dropped, first-seen distinct."""
    return _by_batch("string", _entities, rule)


def _expressions(rules: pa.Array) -> pa.Array:
    f = spaced_notation(_parsed(rules)).settled()
    keys = f.named(*fixed.KEYWORDS)
    at = np.flatnonzero(~keys & f.of_parent(keys))
    joined = pc.binary_join(_lists(f, f.row[at], f.subtrees(at).text()), ",").to_pylist()
    return pa.array([x.strip(fixed.WHITESPACE) if r else None for r, x in zip(rules.is_valid().to_pylist(), joined)], pa.string())


def expressions(rule: Column) -> Column:
    """The non-keyword nodes right under a keyword, in words, rendered and joined."""
    return _by_batch("string", _expressions, rule)


def _completions(rules: pa.Array, picks: pa.Array) -> pa.Array:
    f = _parsed(rules)
    sizes = np.diff(f.starts)
    drawn, counts = picks.flatten(), pc.list_value_length(picks).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(f.rows), counts)
    pick, at, cut = (drawn.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    node = np.floor(at * sizes[row]).astype(np.int64)
    held = sizes[row] > 0
    row, pick, node, cut = row[held], pick[held], node[held], cut[held]
    chosen = f.starts[row] + node
    given = f.before(chosen).to_pylist()
    names = f.words.names
    for k, (i, share) in enumerate(zip(f.name[chosen].tolist(), cut.tolist())):
        if share == share:  # no NaN, which stands for null
            given[k] += names[i][: _cut(len(names[i]), share)]
    wanted = f.subtrees(chosen).text()
    whole = np.arange(f.rows)
    order = np.lexsort((np.concatenate([whole * 0, np.arange(1, len(row) + 1)]), np.concatenate([whole, row])))
    texts = pc.if_else(rules.is_valid(), f.text(), pa.scalar(None, pa.string()))
    pairs = _struct(
        pick=_int(np.concatenate([whole * 0, pick])),
        node_id=_int(np.concatenate([whole * 0 - 1, node])),
        given=pa.array([""] * f.rows + given, pa.string()),
        wanted=pa.concat_arrays([texts, wanted]),
    )
    return _lists(f, np.concatenate([whole, row])[order], pairs.take(pa.array(order)))


def _cut(length: int, share: float) -> int:
    """How much of a name is given: letters 1 to 3 weigh double (closed form of the inverse cumulative weights)."""
    double = min(4, length) - 1
    u = share * (length + double)
    return 0 if u < 1 else 1 + int((u - 1) // 2) if u < 1 + 2 * double else int(u - double)


def completions(rule: Column, key: Column, k: int, seed: int, midword: bool) -> Column:
    """The whole rule as pick 0, then seeded nodes: the rule text before one (optionally with a part of its name) and its subtree."""

    def drawn(pick: Column) -> Column:
        cut = hash_fraction(seed_hash(seed, key, pick, F.lit("cut"))) if midword else F.lit(None).cast("double")
        return F.struct(pick.alias("pick"), hash_fraction(seed_hash(seed, key, pick)).alias("at"), cut.alias("cut"))

    return _by_batch(PAIRS, _completions, rule, F.transform(F.sequence(F.lit(1), F.lit(k)), drawn))

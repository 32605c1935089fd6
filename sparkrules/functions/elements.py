"""Scoring elements of a rule, and the greedy match between two element lists.

An element is ``(relation, words, is_entity)``: every bracket term with all words below it, then every term without
inner terms once more as an entity. The rules of an Arrow batch are read as one columnar tree (see ``functions.forest``), in
which the words below a term are a slice; a pair of rules is matched inside its row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed
from sparkrules.functions.forest import ROWS, Forest, Words

CLUE_LIMIT = 30  # a clue ends with a colon among the first characters
ELEMENTS = "array<struct<relation:string,words:array<string>,is_entity:boolean>>"
Element = tuple[str, list[str], bool]


def drop_clue(c: Column) -> Column:
    """Cut a leading clue and the blank after its colon; texts without an early colon stay whole."""
    at = F.instr(c, ":")
    return F.when((at > 0) & (at <= CLUE_LIMIT), F.substr(c, at + 2)).otherwise(c)


def _stripped(name: str) -> str:
    return name.strip(fixed.WHITESPACE)


def _words(name: str) -> list[str]:
    """As ``text.score_words``, without empty ones."""
    marked = _stripped(name).replace("_", " _ ").replace(",", " , ")
    camel = re.sub(r"(?<=[a-z0-9])(?=[A-Z%])", " ", marked).lower().replace("  ", " ")
    digits = re.sub(r"(?<=[0-9])(?=[a-z])", " ", camel).replace("  ", " ")
    dots = re.sub(r"(?<=[a-z])\.(?=[a-z])", " ", digits.replace(" k n ", " kn "))
    return [w for w in dots.replace(" _ ", " ").split(" ") if w]


def _listed(rules: Sequence[str | None]) -> list[list[Element]]:
    """The ordered element list of every rule; a null rule has none."""
    f = Forest.parsed(rules, Words(), then_at_top=True)
    names, inner = f.words.names, np.zeros(len(f.row) + 1, bool)
    inner[f.parent[f.is_term]] = True  # the last place takes those of the top
    leaves = f.name[~f.is_term]
    cut = {name: _words(names[name]) for name in np.unique(leaves).tolist()}  # each leaf is cut into words once, however many terms hold it
    words = [w for name in leaves.tolist() for w in cut[name]]
    sizes = np.zeros(len(f.row) + 1, np.int64)
    sizes[1:][~f.is_term] = [len(cut[name]) for name in leaves.tolist()]
    offsets = np.cumsum(sizes)
    at = np.flatnonzero(f.is_term)
    relations = f.words.table(_stripped)[f.name[at]].tolist()
    terms: list[list[Element]] = [[] for _ in rules]
    entities: list[list[Element]] = [[] for _ in rules]
    for row, name, low, high, lone in zip(f.row[at].tolist(), relations, offsets[at].tolist(), offsets[f.end[at]].tolist(), (~inner[at]).tolist()):
        below = words[low:high]
        terms[row].append((names[name], below, False))
        if lone:
            entities[row].append(("", below, True))
    return [t + e for t, e in zip(terms, entities)]


def elements(rule: Column) -> Column:
    """The ordered element list of a rule string."""

    @F.arrow_udf(ELEMENTS)
    def run(rules: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("relation", pa.string()), ("words", pa.list_(pa.string())), ("is_entity", pa.bool_())]))
        out = [pa.array([], kind)]
        for at in range(0, len(rules), ROWS):
            part = rules.slice(at, ROWS).to_pylist()
            named = [[dict(zip(("relation", "words", "is_entity"), e)) for e in found] for found in _listed(part)]
            out.append(pa.array([x if r is not None else None for x, r in zip(named, part)], kind))
        return pa.concat_arrays(out)

    return run(rule)


def _bag(words: list[str]) -> set:
    """Words numbered by occurrence, so that a multiset overlap is a plain one."""
    bag: set = set(words)
    if len(bag) < len(words):
        seen: dict[str, int] = defaultdict(int)
        for w in words:
            seen[w] += 1
            if seen[w] > 1:
                bag.add((w, seen[w]))
    return bag


def _matched(left: list[Element], right: list[Element], entity_weight: float) -> tuple[float, float]:
    """How much of ``left`` is found in ``right``, and of ``right`` in ``left``, each between 0 and 1.

    Each element of a side, in order, takes the unused element of the same relation on the other side with the largest
    word overlap (the first of equals) and scores its share of matched words; a match with an entity
    and every entity of the side count ``entity_weight`` times. Every overlap is counted once for both directions.
    """
    # by relation and word, the elements on the right that hold it: only pairs that share a word meet
    of: dict[str, dict] = defaultdict(lambda: defaultdict(list))
    for j, (relation, words, _) in enumerate(right):
        holders = of[relation]
        for w in _bag(words):
            holders[w].append(j)
    there: list[list[tuple[int, int]]] = [[] for _ in left]
    back: list[list[tuple[int, int]]] = [[] for _ in right]
    for i, (relation, words, _) in enumerate(left):
        if (holders := of.get(relation)) is None:
            continue
        counts: dict[int, int] = {}
        for w in _bag(words):
            for j in holders.get(w, ()):
                counts[j] = counts.get(j, 0) + 1
        there[i] = list(counts.items())
        for j, both in there[i]:
            back[j].append((i, both))

    def share(side: list[Element], others: list[Element], overlaps: list[list[tuple[int, int]]]) -> float:
        used, score, total = set(), 0.0, 0.0
        for (_, words, is_entity), found in zip(side, overlaps):
            total += entity_weight if is_entity else 1.0
            best, at = max(((n, -j) for j, n in found if j not in used), default=(0, 0))
            if best:
                used.add(-at)
                score += best / len(words) * (entity_weight if others[-at][2] else 1.0)
        return score / total if total > 0 else 0.0

    return share(left, right, there), share(right, left, back)


def match_shares(pred: Column, ref: Column, entity_weight: float) -> Column:
    """How much of one rule's elements is found in the other's, both ways, as struct(there, back).

    Elements of ``pred`` that have neither relation nor words don't count. A null rule has no elements.
    """

    @F.arrow_udf("there double, back double")
    def run(preds: pa.Array, refs: pa.Array) -> pa.Array:
        shares = []
        for at in range(0, len(preds), ROWS):
            left, right = (_listed(side.slice(at, ROWS).to_pylist()) for side in (preds, refs))
            shares += [_matched([e for e in x if e[0] or e[1]], y, entity_weight) for x, y in zip(left, right)]
        return pa.StructArray.from_arrays([pa.array([s[k] for s in shares], pa.float64()) for k in (0, 1)], ["there", "back"])

    return run(pred, ref)

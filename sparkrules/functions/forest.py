"""Rules of an Arrow batch as one columnar tree, and the steps between notations that read it.

All nodes of a batch lie in pre-order in flat arrays, their names as numbers (a number per distinct name). A step is a
few array operations over all rules of the batch: what lies under marked nodes is a running sum of where their subtrees
start and end, so no step looks at a pair of nodes, and a rule costs in proportion to its nodes. The steps
are those that ``functions.notation`` describes; what a step does not recognise stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import cached_property
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrules.functions import fixed

ROWS = 1024  # rules that are rewritten together
WORD = re.compile(r"((?:[^'(),]++|'[^']*+(?:'|\Z))++)([(),]*+)")
EXPRESSIONS = ["expr", "expression"]
FUNCTIONS = ["fun", "function"]
LOGIC_WORDS = [*fixed.KEYWORDS, *EXPRESSIONS, "appliedstatement", "rulestatement"]
OUTER = ["not", *EXPRESSIONS, *fixed.DEONTICS]
SPACES = " \t\n\x0b\f\r"
LINE_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
QUANTITY = re.compile(rf"([0-9]+\.?[0-9]*)[{SPACES}]([a-zA-Z0-9/*+-]+){LINE_END}")
BASE_UNIT = re.compile(rf"({'|'.join(a for _, a in fixed.UNIT_PREFIXES)})??({'|'.join(a for _, a in reversed(fixed.UNIT_KINDS))})?([0-9])?\Z")

IDENTIFIER = re.compile(rf"\w+{LINE_END}", re.ASCII)
WORDS = re.compile(r"\w+|\W+", re.ASCII)
TYPE = re.compile(rf"(\w+)\.type{LINE_END}", re.ASCII)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
LONG_NAMES = {"fun": "function", "var": "variable", "rel": "relation", "expr": "expression"}


class Words(dict):
    """A number for every distinct name, in order of appearance."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self._tables: dict[Callable[[str], object], list] = {}

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number

    def codes(self, words: Iterable[str]) -> np.ndarray:
        return np.array([self[w] for w in words], np.int64)

    def table(self, of: Callable[[str], str]) -> np.ndarray:
        """By name, the number of ``of(name)``."""
        known = self._tables.setdefault(of, [])
        while len(known) < len(self.names):  # what is found may be new names
            known += [self[of(name)] for name in self.names[len(known) :]]
        return np.array(known, np.int64)

    def changed(self, numbers: np.ndarray, of: Callable[[str], str]) -> np.ndarray:
        """The numbers of ``of(name)``; other than with ``table``, what is found may change again."""
        distinct, which = np.unique(numbers, return_inverse=True)
        return self.codes([of(self.names[n]) for n in distinct.tolist()])[which]


def _trimmed(name: str) -> str:
    return name.strip(" ")


def _blanks(name: str) -> str:
    return name[: len(name) - len(name.lstrip(SPACES))]


def _depths(first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Depths that start at 0 where ``first`` is set, change from node to node and never fall below 0."""
    if not len(change):
        return change
    before = np.concatenate([[0], np.cumsum(change)[:-1]])
    part = np.cumsum(first) - 1
    before -= before[np.flatnonzero(first)][part]
    apart = part * (2 * int(np.abs(before).max()) + 1)  # parts lie below each other, so a running least stays within its part
    return before - (np.minimum.accumulate(before - apart) + apart)


class Forest:
    """``row``, ``depth`` and ``name`` of all nodes in pre-order; ``rows`` is the number of rules."""

    def __init__(self, words: Words, rows: int, row: np.ndarray, depth: np.ndarray, name: np.ndarray):
        self.words, self.rows, self.row, self.depth, self.name = words, rows, row, depth, name

    @staticmethod
    def parsed(rules: Sequence[str | None], words: Words, then_at_top: bool = False) -> Forest:
        """As ``tree.parse`` reads them."""
        found = [WORD.findall(r) if r else [] for r in rules]
        sizes = [len(x) for x in found]
        row = np.repeat(np.arange(len(found)), sizes)
        name = np.fromiter(map(words.__getitem__, map(itemgetter(0), chain.from_iterable(found))), np.int64, len(row))
        marks = Words()
        mark = np.fromiter(map(marks.__getitem__, map(itemgetter(1), chain.from_iterable(found))), np.int64, len(row))
        change = np.array([("(" in m) - m[m.rfind("(") + 1 :].count(")") for m in marks.names], np.int64)
        first = np.diff(row, prepend=-1) != 0
        if then_at_top:
            opens = np.array([m.startswith("(") for m in marks.names], bool)
            first |= (words.table(_trimmed)[name] == words["then"]) & opens[mark]
        depth = _depths(first, change[mark] if len(row) else row)
        kept = (mark != marks[""]) | (depth == 0)
        forest = Forest(words, len(found), row[kept], depth[kept], name[kept])
        forest.is_term = np.array([m.startswith("(") for m in marks.names], bool)[mark][kept]
        return forest

    @cached_property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def settled(self) -> Forest:
        """The tree with names that vanished left out and depths that grow by one at most (see ``tree.relink``)."""
        f = self
        for _ in range(2):
            first = np.diff(f.row, prepend=-1) != 0
            depth = _depths(first, np.minimum(np.diff(f.depth, append=0), 1))
            kept = f.name != f.words[""]
            f = Forest(f.words, f.rows, f.row[kept], depth[kept], f.name[kept])
            if kept.all():
                break
        return f

    def text(self) -> pa.Array:
        """The rule strings."""
        n, starts = len(self.row), self.starts
        last = np.zeros(n, bool)
        last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
        top = self.depth[starts[:-1][self.row]] if n else self.depth
        following = np.where(last, top, np.append(self.depth[1:], 0))
        return self._joined(starts, np.arange(n), following, last)

    def before(self, at: np.ndarray) -> pa.Array:
        """The rule strings up to, and without, the nodes ``at``."""
        start = self.starts[self.row[at]]
        sizes = at - start
        source = _ranges(start, sizes)
        following = self.depth[source + 1]
        return self._joined(np.concatenate([[0], np.cumsum(sizes)]), source, following, np.zeros(len(source), bool))

    def _joined(self, starts: np.ndarray, at: np.ndarray, following: np.ndarray, last: np.ndarray) -> pa.Array:
        """Names, each with the brackets and comma that follow it: strings of the nodes ``at``, cut at ``starts``."""
        n, depth = len(at), self.depth[at]
        down = np.maximum(depth - following, 0)
        # a mark is an opening bracket, or some closing ones, and a comma if anything follows
        deepest = int(down.max()) if n else 0
        marks = ["(", *(")" * k for k in range(deepest + 1)), *(")" * k + "," for k in range(deepest + 1))]
        mark = np.where(last, 1 + down, np.where(following > depth, 0, 2 + deepest + down))
        both = np.empty(2 * n, np.int64)
        both[::2], both[1::2] = self.name[at], len(self.words.names) + mark
        strings = pa.array([*self.words.names, *marks], pa.string()).take(pa.array(both))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(2 * starts, pa.int32()), strings), "")

    # --- places, one per node; what depends on no step is found once -----------------------------

    @cached_property
    def parent(self) -> np.ndarray:
        """-1 at the top."""
        n = len(self.row)
        key = self.depth * n + np.arange(n)
        ordered = np.sort(key)
        above = ordered[np.searchsorted(ordered, key - n) - 1] % n if n else key
        return np.where(self.depth > 0, above, -1)

    @cached_property
    def end(self) -> np.ndarray:
        """Where the subtree of a node ends."""
        size = np.ones(len(self.row), np.int64)
        order = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 2))
        for low, high in zip(bounds[-2::-1], bounds[:0:-1]):
            at = order[low:high]
            np.add.at(size, self.parent[at], size[at])
        return np.arange(len(size)) + size

    @cached_property
    def kids(self) -> np.ndarray:
        """How many children a node has."""
        return np.bincount(self.parent[self.parent >= 0], minlength=len(self.row))

    @cached_property
    def place(self) -> np.ndarray:
        """How many siblings stand before a node; the top nodes of a rule are siblings."""
        above = np.where(self.parent < 0, -1 - self.row, self.parent)
        order = np.argsort(above, kind="stable")
        parents = above[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(parents, parents)
        return place

    @cached_property
    def trim(self) -> np.ndarray:
        return self.words.table(_trimmed)[self.name]

    def named(self, *words: str) -> np.ndarray:
        return np.isin(self.trim, self.words.codes(words))

    def of_parent(self, marked: np.ndarray) -> np.ndarray:
        """Whether a node's parent is marked."""
        return np.append(marked, False)[self.parent]

    def above(self, marked: np.ndarray) -> np.ndarray:
        """How many nodes above a node are marked."""
        steps = np.zeros(len(self.row) + 2, np.int64)
        at = np.flatnonzero(marked)
        np.add.at(steps, at + 1, 1)
        np.subtract.at(steps, self.end[at], 1)
        return np.cumsum(steps)[: len(self.row)]

    def first_leaf(self, at: np.ndarray) -> np.ndarray:
        leaves = np.flatnonzero(self.kids == 0)
        return leaves[np.searchsorted(leaves, at)] if len(at) else at

    def subtrees(self, at: np.ndarray, without: np.ndarray | None = None) -> Forest:
        """The subtrees of the nodes ``at`` as rules of their own; ``without`` marks nodes that are left out."""
        sizes = self.end[at] - at
        source, row = _ranges(at, sizes), np.repeat(np.arange(len(at)), sizes)
        if without is not None:
            source, row = source[~without[source]], row[~without[source]]
        return Forest(self.words, len(at), row, self.depth[source], self.name[source])

    # --- new trees --------------------------------------------------------------------------------

    def like(self, at: np.ndarray, name: str | np.ndarray) -> np.ndarray:
        """New names with the blanks that stand before the nodes ``at``."""
        new = np.full(len(at), self.words[name]) if isinstance(name, str) else name.copy()
        blanks = self.words.table(_blanks)[self.name[at]]
        names = self.words.names
        for i in np.flatnonzero(blanks != self.words[""]):
            new[i] = self.words[names[blanks[i]] + names[new[i]]]
        return new

    def made(self, *pieces: tuple[np.ndarray, int | np.ndarray, np.ndarray, np.ndarray]) -> Forest:
        """The flat tree of ``(at, slot, depth, name)``: nodes in the order of where they come from, then by slot."""
        at = np.concatenate([p[0] for p in pieces])
        slot = np.concatenate([np.broadcast_to(p[1], len(p[0])) for p in pieces])
        order = np.lexsort((slot, at))
        depth, name = (np.concatenate([p[k] for p in pieces])[order] for k in (2, 3))
        return Forest(self.words, self.rows, self.row[at[order]], depth, name)

    def kept(self, at: np.ndarray, shift: np.ndarray | None = None) -> tuple:
        return at, 0, self.depth[at] + (0 if shift is None else shift[at]), self.name[at]


def _replaced(f: Forest, found: np.ndarray) -> np.ndarray:
    """The nodes that stay when all below the found ones is replaced; a found one below another stays."""
    return np.flatnonzero(found | (f.above(found) == 0))


def _second(f: Forest, at: np.ndarray) -> np.ndarray:
    """The second child of nodes with two."""
    return f.end[at + 1]


def atoms_short(f: Forest) -> Forest:
    inner, relation, variable = f.kids > 0, f.named("rel", "relation"), f.named("var", "variable")
    atoms = f.named("atom")
    two, one = np.flatnonzero(atoms & (f.kids == 2)), np.flatnonzero(atoms & (f.kids == 1))
    second = _second(f, two)
    fits = relation[two + 1] & inner[two + 1] & variable[second] & inner[second]
    two, second = two[fits], second[fits]
    one = one[variable[one + 1] & inner[one + 1]]
    names = f.words.names
    leaf = lambda at: f.trim[f.first_leaf(at)]
    pairs = f.words.codes([f"{names[v]}.{names[r]}" for v, r in zip(leaf(second), leaf(two + 1))])
    at, text = np.concatenate([two, one]), np.concatenate([pairs, leaf(one + 1)])
    found = np.zeros(len(f.row), bool)
    found[at] = True
    return f.made(f.kept(_replaced(f, found)), (at, 1, f.depth[at] + 1, f.like(at, text)))


def _variable(name: str) -> str:
    return re.split(r"\.(?=[a-z])", name)[0]


def _relation(name: str) -> str:
    return [*re.split(r"\.(?=[a-z])", name), ""][1]


def atoms_long(f: Forest) -> Forest:
    leaf = np.append(f.kids == 0, False)
    found = f.named("atom") & (f.kids == 1) & leaf[1:]
    at = np.flatnonzero(found)
    name = f.trim[at + 1]
    variable, relation = f.words.table(_variable)[name], f.words.table(_relation)[name]
    of = at[related := relation != f.words[""]]
    return f.made(
        f.kept(_replaced(f, found)),
        (of, 1, f.depth[of] + 1, f.like(of, "relation")),
        (of, 2, f.depth[of] + 2, f.like(of, relation[related])),
        (at, 3, f.depth[at] + 1, f.like(at, "variable")),
        (at, 4, f.depth[at] + 2, f.like(at, variable)),
    )


def loops_short(f: Forest) -> Forest:
    two = np.flatnonzero(f.named(*EXPRESSIONS) & (f.kids == 2))
    two = two[f.named("rulestatement")[two + 1] & f.named("appliedstatement")[_second(f, two)]]
    loops = np.zeros(len(f.row), bool)
    loops[two] = True
    wrappers = f.of_parent(loops)
    shift = -f.above(wrappers)
    at = np.flatnonzero(loops & ~wrappers)
    return f.made(f.kept(np.flatnonzero(~loops & ~wrappers), shift), (at, 0, (f.depth + shift)[at], f.like(at, "loop")))


def loops_long(f: Forest) -> Forest:
    loops = f.named("loop")
    wrapped = f.of_parent(loops) & (f.place < 2)
    shift = f.above(wrapped)
    at, own = np.flatnonzero(wrapped), np.flatnonzero(loops & ~wrapped)
    word = np.where(f.place[at] == 0, f.like(at, "rulestatement"), f.like(at, "appliedstatement"))
    return f.made(
        f.kept(np.flatnonzero(~loops & ~wrapped), shift),
        (own, 0, (f.depth + shift)[own], f.like(own, "expression")),
        (at, 0, (f.depth + shift)[at], word),
        (at, 1, (f.depth + shift)[at] + 1, f.name[at]),
    )


def expressions_short(f: Forest) -> Forest:
    function = f.named(*FUNCTIONS) & (f.parent >= 0)
    inner = np.flatnonzero(function & (f.kids > 0))
    heads = f.named(*EXPRESSIONS) & (np.bincount(f.parent[inner], minlength=len(f.row)) == 1)
    called = np.zeros(len(f.row), np.int64)
    called[f.parent[inner]] = f.trim[inner + 1]
    argument = f.of_parent(heads)
    gone = argument & function
    wrappers = argument & (f.kids == 1) & ~f.named(*EXPRESSIONS) & ~gone
    shift, stays = -f.above(wrappers), ~gone & (f.above(gone) == 0) & ~wrappers
    at = np.flatnonzero(heads & stays)
    return f.made(f.kept(np.flatnonzero(stays & ~heads), shift), (at, 0, (f.depth + shift)[at], f.like(at, called[at])))


def expressions_long(f: Forest) -> Forest:
    logic = f.named(*LOGIC_WORDS)
    keyword = f.of_parent(logic)
    aside = (f.parent >= 0) & ~keyword & (f.place > 0)  # neither under a keyword nor a first argument
    reached = ~aside & (f.above(aside) == 0) & (f.above(f.named("atom", "data", *FUNCTIONS)) == 0)
    heads = reached & ~logic & ~f.named(*fixed.STRUCTURE_WORDS) & (keyword | (f.parent < 0) | (f.kids > 0))
    argument = f.of_parent(heads)
    wrapped = ~heads & argument & (((f.place == 0) & (f.kids == 0)) | ((f.place == 1) & ~f.named("data")))
    dropped = argument & (f.place > 1)
    depth, stays = f.depth + f.above(wrapped), ~dropped & (f.above(dropped) == 0)
    rest, at, head = (np.flatnonzero(x & stays) for x in (~wrapped & ~heads, wrapped, heads))
    return f.made(
        (rest, 0, depth[rest], f.name[rest]),
        (at, 0, depth[at], np.where(f.place[at] == 0, f.like(at, "atom"), f.like(at, "data"))),
        (at, 1, depth[at] + 1, f.name[at]),
        (head, 0, depth[head], f.like(head, "expression")),
        (head, 1, depth[head] + 1, f.like(head, "function")),
        (head, 2, depth[head] + 2, f.name[head]),
    )


def _base_unit(unit: str) -> tuple | None:
    """(exponent, prefix, kind), or None when the text is no base unit."""
    found = BASE_UNIT.match(unit) if unit else None
    if not found:
        return None
    long = lambda pairs, short: next((a for a, b in pairs if b == short), None)
    prefix, kind, exponent = found.groups()
    return exponent and exponent + ".0", long(fixed.UNIT_PREFIXES, prefix), long(fixed.UNIT_KINDS, kind)


def _quantity(name: str) -> list[tuple[int, str]]:
    """The long notation of a quantity, as steps in depth and names; none when the text is no quantity (see ``quantity``)."""
    found = QUANTITY.match(name)
    if not found:
        return []
    number, unit = found.groups()

    def base(parts: tuple, at: int) -> list[tuple[int, str]]:
        named = [(word, part) for word, part in zip(("exponent", "prefix", "kind"), parts) if part]
        return [(at, "baseunit"), *(x for word, part in named for x in ((at + 1, word), (at + 2, part)))]

    value = [(0, "value"), (1, number if "." in number else number + ".0")]
    word, sign = next(((w, s) for w, s in fixed.UNIT_OPERATORS if unit.count(s) == 1), (None, None))
    left, right = map(_base_unit, unit.split(sign)) if sign else (None, None)
    if left and right:
        return [(0, "derivedunit"), *base(left, 1), (1, "operator"), (2, "name"), (3, word), *base(right, 1), *value]
    whole = _base_unit(unit)
    return [*base(whole, 0), *value] if whole else []


def units_long(f: Forest) -> Forest:
    at = np.flatnonzero(f.named("data") & (f.kids == 1))
    distinct, which = np.unique(f.trim[at + 1], return_inverse=True)
    written = [_quantity(f.words.names[name]) for name in distinct]
    sizes = np.array([len(w) for w in written], np.int64)[which] if len(at) else at
    found = np.zeros(len(f.row), bool)
    found[at[sizes > 0]] = True
    of = np.repeat(at, sizes)
    lines = [line for w in written for line in w]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in written])]).astype(np.int64)
    slot = _ranges(np.zeros(len(at), np.int64), sizes)
    line = np.repeat(offsets[which], sizes) + slot
    deeper, names = np.array([d for d, _ in lines], np.int64), f.words.codes(n for _, n in lines)
    return f.made(f.kept(_replaced(f, found)), (of, slot + 1, f.depth[of] + 1 + deeper[line], f.like(of, names[line])))


def _plain(number: str) -> str:
    """A number without a zero after its point."""
    return re.sub(rf"\.0{LINE_END}", "", number)


def units_short(f: Forest) -> Forest:
    """Data nodes with a unit and a value; the parts of a unit may stand in any order."""
    names, trim, end = f.words.names, f.trim, f.end
    two = np.flatnonzero(f.named("data") & (f.kids == 2))
    second = _second(f, two)
    two = two[f.named("baseunit", "derivedunit")[two + 1] & f.named("value")[second]]
    parts = {f.words[w]: w for w in ("baseunit", "derivedunit", "operator", "prefix", "kind", "exponent")}

    def children(at: int) -> Iterable[tuple[str | None, int]]:
        child = at + 1
        while child < end[at]:
            yield parts.get(trim[child]), child
            child = end[child]

    def after(at: int, stop: int) -> str | None:
        """The name that follows a node in its rule."""
        return names[trim[at + 1]] if at + 1 < stop else None

    def base(unit: int, stop: int) -> str:
        found: dict[str | None, int] = {}
        for part, child in children(unit):
            found.setdefault(part, child)
        prefix, kind, exponent = (after(found[w], stop) if w in found else None for w in ("prefix", "kind", "exponent"))
        return dict(fixed.UNIT_PREFIXES).get(prefix, "") + dict(fixed.UNIT_KINDS).get(kind, "") + _plain(exponent or "")

    def written(unit: int, stop: int) -> str:
        if parts[trim[unit]] == "baseunit":
            return base(unit, stop)
        kids = list(children(unit))
        bases, signs = ([c for part, c in kids if part == w] for w in ("baseunit", "operator"))
        sign = dict(fixed.UNIT_OPERATORS).get(names[trim[f.first_leaf(np.array(signs[:1]))[0]]]) if signs else None
        return base(bases[0], stop) + sign + base(bases[1], stop) if len(bases) == 2 and sign else ""

    texts = []
    for at, stop in zip(two.tolist(), f.starts[1:][f.row[two]].tolist()):
        number, unit = after(int(end[at + 1]), stop), written(at + 1, stop)
        texts.append(f"{_plain(number)} {unit}" if number is not None and unit else "")
    found = np.zeros(len(f.row), bool)
    fits = np.array([t != "" for t in texts], bool)
    at = two[fits]
    found[at] = True
    text = f.words.codes(t for t in texts if t)
    return f.made(f.kept(_replaced(f, found)), (at, 1, f.depth[at] + 1, f.like(at, text)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``sizes`` from each of ``starts`` on."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def values_long(f: Forest) -> Forest:
    outer, parent = f.named(*OUTER), f.parent
    at = np.flatnonzero(f.named(*fixed.CONNECTORS) & f.of_parent(f.named("data")) & (f.kids > 0))
    top = parent[at]
    while (walk := (top >= 0) & ~outer[top]).any():  # up to the nearest expression
        top[walk] = parent[top[walk]]
    while (walk := (top >= 0) & np.append(outer, False)[parent[top]]).any():  # and on while they touch
        top[walk] = parent[top[walk]]
    none = np.full(f.rows, len(f.row))  # a connector outside any expression keeps the later ones of its rule shut
    np.minimum.at(none, f.row[at[top < 0]], at[top < 0])
    opened = at < none[f.row[at]]
    at, top = at[opened], top[opened]
    top, first = np.unique(top, return_index=True)
    at = at[first]
    tops = np.zeros(len(f.row), bool)
    tops[top] = True
    outermost = f.above(tops)[top] == 0
    at, top = at[outermost], top[outermost]
    tops[:] = False
    tops[top] = True
    nested = np.append(f.trim, -1)[parent[top]] == f.trim[at]
    # a copy per value: what stands before the connector, the value, what stands after it
    of = np.full(len(f.row), -1)
    of[at] = np.arange(len(at))
    child = np.flatnonzero(f.of_parent(of >= 0))
    group = of[parent[child]]
    a, t = at[group], top[group]
    starts, ends = np.stack([t, child, f.end[a]], 1).reshape(-1), np.stack([a, f.end[child], f.end[t]], 1).reshape(-1)
    sizes = ends - starts
    source = _ranges(starts, sizes)
    shift = np.where(nested[group], 0, 1)
    shift = np.repeat(np.stack([shift, shift - 1, shift], 1).reshape(-1), sizes)
    own = top[~nested]
    return f.made(
        f.kept(np.flatnonzero(~tops & (f.above(tops) == 0))),
        (own, 0, f.depth[own], f.like(own, f.trim[at[~nested]])),
        (np.repeat(np.repeat(t, 3), sizes), 1 + np.arange(len(source)), f.depth[source] + shift, f.name[source]),
    )


def values_short(f: Forest) -> Forest:
    """Runs of neighbours that are equal but for their one value; only kids beside another such kid are written out."""
    datas = f.named("data")
    connectors = f.named(*fixed.CONNECTORS) & (f.kids > 0) & ~f.of_parent(datas)
    kids = np.flatnonzero(f.of_parent(connectors) & f.named(*OUTER))
    before = np.concatenate([[0], np.cumsum(datas)])
    kids = kids[before[f.end[kids]] - before[kids] == 1]
    data = np.flatnonzero(datas)[before[kids]]
    lone = f.end[data] - data == 2
    kids, data = kids[lone], data[lone]
    order = np.lexsort((kids, f.parent[kids]))  # siblings side by side
    kids, data = kids[order], data[order]
    pair = (f.end[kids[:-1]] == kids[1:]) & (f.parent[kids[:-1]] == f.parent[kids[1:]])
    beside = np.append(pair, False) | np.append([False], pair) if len(kids) else np.zeros(0, bool)
    values = np.zeros(len(f.row), bool)
    values[data + 1] = True
    texts = f.subtrees(kids[beside], values).text().to_pylist()
    same = np.zeros(len(kids), bool)  # as the neighbour before
    which = np.flatnonzero(beside)
    for k in range(1, len(which)):
        same[which[k]] = pair[which[k] - 1] and texts[k] == texts[k - 1]
    joined = np.append(same[1:], False) if len(kids) else same  # the next one is equal
    heads = joined & ~same
    run = np.cumsum(heads) - 1
    of, value = run[heads | same], data[heads | same] + 1
    head, at = kids[heads], data[heads]
    members = np.bincount(of, minlength=len(head))
    top = f.parent[head]
    alone, gone, opened = (np.zeros(len(f.row), bool) for _ in range(3))
    alone[top[members == f.kids[top]]] = True
    gone[kids[same]] = True
    opened[at] = True
    shift = -f.above(alone)
    stays = ~(gone | (f.above(gone) > 0) | alone | f.of_parent(opened))
    deeper = f.depth + shift
    return f.made(
        f.kept(np.flatnonzero(stays), shift),
        (at, 1, deeper[at] + 1, f.name[top]),
        (at[of], 2 + np.arange(len(of)), deeper[at[of]] + 2, f.name[value]),
    )


def repair_then(f: Forest) -> Forest:
    then = f.trim == f.words["then"]
    at = np.flatnonzero(then)
    at = at[np.bincount(f.row[f.depth == 0], minlength=f.rows)[f.row[at]] == 1]
    at = at[np.diff(f.row[at], prepend=-1) != 0]  # the first of a rule
    moves = np.zeros(len(f.row), bool)
    moves[at] = True
    moves |= f.above(moves) > 0
    lift = np.zeros(f.rows, np.int64)
    lift[f.row[at]] = f.depth[at]
    order = np.lexsort((moves, f.row))
    depth = f.depth - np.where(moves, lift[f.row], 0)
    return Forest(f.words, f.rows, f.row, depth[order], f.name[order])


def collapse_nested(f: Forest) -> Forest:
    same = (f.parent >= 0) & (np.append(f.trim, -1)[f.parent] == f.trim)
    alone = np.append(f.kids, 0)[f.parent] == 1
    gone = same & (f.named(*fixed.CONNECTORS) | (f.named(*EXPRESSIONS) & alone))
    return f.made(f.kept(np.flatnonzero(~gone), -f.above(gone)))


def _without_twins(f: Forest, name: str) -> Forest:
    """Branches of this name go when an earlier sibling of the name has the same leaves."""
    at = np.flatnonzero(f.named(name))
    leaves = np.flatnonzero(f.kids == 0)
    names = f.name[leaves]
    low, high = np.searchsorted(leaves, at), np.searchsorted(leaves, f.end[at])
    # siblings with as many leaves of the same sums are compared leaf by leaf
    once = np.concatenate([[0], np.cumsum(names * names)])
    plain = np.concatenate([[0], np.cumsum(names)])
    by_place = np.concatenate([[0], np.cumsum(names * np.arange(len(names)))])
    once, by_place = once[high] - once[low], by_place[high] - by_place[low] - low * (plain[high] - plain[low])
    above = np.where(f.parent[at] < 0, -1 - f.row[at], f.parent[at])
    keys = zip(above.tolist(), (high - low).tolist(), once.tolist(), by_place.tolist())
    seen: dict[tuple, list[tuple[int, int]]] = {}
    gone = np.zeros(len(f.row), bool)
    for b, key, x, y in zip(at.tolist(), keys, low.tolist(), high.tolist()):
        earlier = seen.setdefault(key, [])
        if any(np.array_equal(names[x:y], names[u:v]) for u, v in earlier):
            gone[b] = True
        else:
            earlier.append((x, y))
    return f.made(f.kept(np.flatnonzero(~gone & (f.above(gone) == 0))))


def drop_duplicate_obligations(f: Forest) -> Forest:
    return _without_twins(f, "obligation")


def drop_duplicate_expressions(f: Forest) -> Forest:
    return _without_twins(f, "expression")


def canonical_vars(f: Forest) -> Forest:
    names, of = f.words.names, f.trim
    at = np.flatnonzero((f.trim == f.words["define"]) & (f.kids > 1))
    found: dict[int, dict[str, str]] = {}
    for row, first, second in zip(f.row[at].tolist(), of[at + 1].tolist(), of[_second(f, at)].tolist()):
        word = names[first if names[second] == "_new" else second]
        if IDENTIFIER.match(word):
            known = found.setdefault(row, {})
            known.setdefault(word, f"x{len(known)}")
    name = f.name.copy()
    for row, known in found.items():
        for i in range(f.starts[row], f.starts[row + 1]):
            name[i] = f.words["".join([known.get(w, w) for w in WORDS.findall(names[f.name[i]])])]
    return Forest(f.words, f.rows, f.row, f.depth, name)


def _typed(name: str) -> str:
    """What a name that ends in ``.type`` is a type of, in lower case."""
    found = TYPE.match(name)
    return found[1].lower() if found else ""


def dedupe_type_word(f: Forest) -> Forest:
    names = f.words.names
    at = np.flatnonzero(f.of_parent(f.trim == f.words["is"]) & (f.kids == 0) & (f.place == 1))
    subjects = f.words.table(_typed)[f.trim[f.parent[at] + 1]]
    new = f.name.copy()
    for i, subject in zip(at.tolist(), subjects.tolist()):
        word, name = names[subject], names[f.name[i]]
        if word and name.lower().endswith(word) and len(name) > len(word):
            new[i] = f.words[name[: len(name) - len(word)]]
    return Forest(f.words, f.rows, f.row, f.depth, new)


def _tidy(name: str) -> str:
    """A quantity in its short form; any other name as it is."""
    if not _quantity(name):
        return name
    number, unit = QUANTITY.match(name).groups()
    return f"{number.removesuffix('.0')} {unit}"


def tidy_quantities(f: Forest) -> Forest:
    return Forest(f.words, f.rows, f.row, f.depth, np.where(f.kids == 0, f.words.table(_tidy)[f.name], f.name))


def spaced_leaf(name: str) -> str:
    """As ``text.split_leaf``."""
    if " " in name:
        return name.replace("_", " ")
    return re.sub(r"(?<=[a-z])\.(?=[a-z])", ". ", CAMEL.sub(" ", name).lower().replace("_", " "))


def _spaced_leaf(name: str) -> str:
    return " " + spaced_leaf(name)


def _spaced_inner(name: str) -> str:
    return " " + CAMEL.sub(" ", LONG_NAMES.get(name, name)).lower()


def spaced_notation(f: Forest) -> Forest:
    """Names in words (see ``tree.spaced_notation``), without the blanks at both ends of the rule."""
    name, leaf = f.name.copy(), f.kids == 0
    name[leaf], name[~leaf] = f.words.changed(name[leaf], _spaced_leaf), f.words.changed(name[~leaf], _spaced_inner)
    held = np.flatnonzero(np.diff(f.starts))
    first, last = f.starts[held], f.starts[held + 1] - 1
    name[first] = f.words.changed(name[first], _left_bare)
    last = last[f.depth[last] <= f.depth[first]]  # others end in a bracket
    name[last] = f.words.changed(name[last], _right_bare)
    return Forest(f.words, f.rows, f.row, f.depth, name)


def _left_bare(name: str) -> str:
    return name.lstrip(fixed.WHITESPACE)


def _right_bare(name: str) -> str:
    return name.rstrip(fixed.WHITESPACE)


#: Steps between notations, as in ``notation.STEPS``.
STEPS: dict[str, Callable[[Forest], Forest]] = {
    "values_short": values_short,
    "atoms_short": atoms_short,
    "atoms_long": atoms_long,
    "loops_short": loops_short,
    "loops_long": loops_long,
    "expressions_short": expressions_short,
    "expressions_long": expressions_long,
    "units_short": units_short,
    "units_long": units_long,
    "values_long": values_long,
}

#: Steps within a notation, as in ``tree.TREE_STEPS`` and ``tree.spaced_notation``.
RULE_STEPS: dict[str, Callable[[Forest], Forest]] = {
    "repair_then": repair_then,
    "collapse_nested": collapse_nested,
    "drop_duplicate_obligations": drop_duplicate_obligations,
    "drop_duplicate_expressions": drop_duplicate_expressions,
    "canonical_vars": canonical_vars,
    "dedupe_type_word": dedupe_type_word,
    "tidy_quantities": tidy_quantities,
    "spaced_notation": spaced_notation,
}


def rewritten(rule: Column, steps: Sequence[str]) -> Column:
    """The rules after these steps, one after the other: parsed once, rendered once."""
    steps = list(steps)

    @F.arrow_udf("string")
    def run(rules: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(rules), ROWS):
            part = rules.slice(at, ROWS)
            f = Forest.parsed(part.to_pylist(), Words())
            for k, step in enumerate(steps):
                f = {**STEPS, **RULE_STEPS}[step](f.settled() if k else f)
            out.append(pc.if_else(part.is_valid(), f.text(), pa.scalar(None, pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run(rule)

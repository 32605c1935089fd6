"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words that repeats itself at a distance: with smallest period ``q`` it is at least ``max(LEAST, TIMES * q)`` words long
and no neighbouring word extends it. Every word of a run stands in it at least ``TIMES`` times, so

1. a word that occurs more rarely within its segment is in no run of it, and the segment is split there. Splitting makes other words rare;
   pieces are split again until nothing changes, and pieces below ``LEAST`` words go. Most texts end here.
2. A surviving segment is scanned lag by lag. A run of period ``q`` holds a square (two equal stretches of ``q`` words) that begins at a
   multiple of ``q``, so lag ``q`` looks at every ``q``-th place only, m/q of the m words: about m log m places for all lags. Equal
   stretches are found by prefix hashes and extended by bisection, for all places of a block of lags at once.
3. Every run is then compared word by word with itself; should a hash ever have deceived, the segment is scanned anew without hashes.

A period that divides a longer one of the same stretch is the smaller and stays. ``collapse`` keeps a run's first period.

Each text is one value of one row; nothing is shuffled. Defined cases: a null or empty text has no words and no runs; words are split at ASCII
white space and compared byte by byte; a very long text is scanned in blocks of lags of bounded size; repeated rows are returned each; an
empty table gives no rows; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrules.llm.tables import body, packed, pieces, with_fields

LEAST, TIMES = 24, 3
BLOCK = 1 << 20  # places that are looked at together
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers never vanish


def survivors(ids: np.ndarray) -> list[tuple[int, int]]:
    """The segments in which every word occurs ``TIMES`` times or more."""
    done, open_ = [], [(0, len(ids))]
    while open_:
        a, b = open_.pop()
        if b - a < LEAST:
            continue
        _, place, often = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(often[place] < TIMES)
        if not len(rare):
            done.append((a, b))
            continue
        edges = np.concatenate(([-1], rare, [b - a]))
        long = np.flatnonzero(np.diff(edges) > LEAST)
        open_ += [(a + int(edges[i]) + 1, a + int(edges[i + 1])) for i in long]
    return sorted(done)


def _plain(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal stretch, by comparing all words at every lag."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // TIMES + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False])).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e + q - s >= max(LEAST, TIMES * q):
                found.setdefault((s, e + q), q)
    return [(s, e - s, q) for (s, e), q in found.items()]


class _Hashed:
    """Prefix hashes of a segment: equality of two stretches in a step, for many pairs at once."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        self.n, self.powers = n, np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1])))

    def equal(self, a: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``a`` and from ``a + lag`` are the same."""
        left = (self.sums[a + length] - self.sums[a]) * self.powers[lag]
        return left == self.sums[a + lag + length] - self.sums[a + lag]

    def reach(self, a: np.ndarray, lag: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``a`` on (or before ``a``) equal those at the lag."""
        low = np.zeros_like(a)
        high = self.n - lag - a if forward else a.copy()
        while len(open_ := np.flatnonzero(low < high)):
            at, q = a[open_], lag[open_]
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(at if forward else at - middle, q, middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low


def _blocks(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(lags, places)``: all multiples of each lag at which a square may begin, some ``BLOCK`` together at most."""
    lags = np.arange(1, n // TIMES + 1)
    many = (n - 2 * lags) // lags + 1
    ends = np.cumsum(many)
    start = 0
    while start < len(lags):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK, "right")))
        lag = np.repeat(lags[start:stop], many[start:stop])
        first = np.repeat(ends[start:stop] - many[start:stop], many[start:stop])
        order = np.arange(len(lag)) + (ends[start - 1] if start else 0) - first
        yield lag, order * lag
        start = stop


def _scanned(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a segment as ``(start, length, period)``, by its squares at multiples of every lag."""
    hashed = _Hashed(ids)
    found: dict[tuple[int, int], int] = {}
    for lag, place in _blocks(len(ids)):
        square = hashed.equal(place, lag, lag)
        # of neighbouring squares of one lag the first speaks for all: they are parts of one stretch
        follows = square[1:] & square[:-1] & (lag[1:] == lag[:-1])
        square[1:] &= ~follows
        lag, place = lag[square], place[square]
        start = place - hashed.reach(place, lag, False)
        end = place + lag + hashed.reach(place, lag, True)
        long = end - start >= np.maximum(LEAST, TIMES * lag)
        for q, s, e in zip(lag[long].tolist(), start[long].tolist(), end[long].tolist()):
            found[s, e] = min(q, found.get((s, e), q))
    for (s, e), q in found.items():
        same = np.array_equal(ids[s : e - q], ids[s + q : e])
        if not same or s and ids[s - 1] == ids[s - 1 + q] or e < len(ids) and ids[e] == ids[e - q]:
            return _plain(ids)
    return [(s, e - s, q) for (s, e), q in found.items()]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period. Equal words have equal ids."""
    return sorted(((a + s, n, q) for a, b in survivors(ids) for s, n, q in _scanned(ids[a:b])), key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """By word: False where a run holds it after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def best_run(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties by start, then period."""
    best = None
    for run in found:  # by start, then period, so a tie stays with the first
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _analysed(docs: DataFrame, carry: tuple[str, ...], added: str, of_text) -> DataFrame:
    """The carried columns and ``added``, from ``of_text(words, runs)`` of every text."""
    names = [part.split()[0] for part in added.split(", ")]
    df = docs.select(packed(carry), body().alias("_text"))
    schema = with_fields(df, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for rows, texts in pieces(batches):
            words = [t.as_py().encode().split() for t in texts]
            ids = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            out, at = [], 0
            for ws in words:
                out.append(of_text(ws, find_runs(ids[at : at + len(ws)])))
                at += len(ws)
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                types = [to_arrow_schema(schema).field(n).type for n in names]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([rows, *columns], ["_row", *names])

    return df.mapInArrow(run, schema).select("_row.*", *names)


def runs(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns, ``n_words`` and ``runs``, every run as (start, length, period) by start, then period."""

    def of_text(words, found):
        return len(words), [dict(zip(("start", "length", "period"), r)) for r in found]

    return _analysed(docs, carry, "n_words long, runs array<struct<start:long,length:long,period:long>>", of_text)


def collapse(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns and

    * ``n_runs``, and of the run with the greatest length / period ``start, length, period, exponent_milli`` (null without runs),
    * ``listed``: every run as ``start,length,period`` and a line feed,
    * ``collapsed``: the words that no run holds after its first period, joined by one space.
    """

    def of_text(words, found):
        best = best_run(found)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        if found:
            words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
        values = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return len(found), *values, listed, b" ".join(words).decode()

    added = "n_runs long, start long, length long, period long, exponent_milli long, listed string, collapsed string"
    return _analysed(docs, carry, added, of_text)

"""Small helpers that the operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

#: Rows, and bytes of their values as text, of a side that is sent to every executor, at most.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 40_000_000


def body(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` is the quick way where a text is plain ASCII."""
    plain = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(plain)


def packed(names: Iterable[str]) -> Column:
    """The named columns as one struct ``_row``: functions in tasks then see no names but their own."""
    return F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row")


def with_fields(df: DataFrame, added: str) -> st.StructType:
    """The schema of ``df._row`` and of the added columns, given as DDL."""
    return st.StructType([df.schema["_row"], *st.StructType.fromDDL(added).fields])


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[list[pa.Array]]:
    """The columns of a few rows at a time, so that a task turns only these into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).columns


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows of at most ``size`` bytes in all, else as it is, for a shuffled join.

    It counts, so ``df`` should be a stored table. Values are measured as JSON, so long texts and lists count in full.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    taken = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if taken <= size else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality on columns of one name on both sides, nulls equal."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out

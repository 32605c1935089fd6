"""Orders, ranks and running totals that never put one group into one task.

A plain ``row_number`` over an unpartitioned window (or over a key holding a third of the rows)
sorts everything in a single task. The helpers here split every group into ordered buckets,
total each bucket with a map-side combined aggregate, carry the totals of earlier buckets
forward, and only then run a window inside one bucket. Results equal the plain window, at every size
by the same plan: only the number of buckets follows the number of rows, without a limit.

Two kinds of order are supported:

* seeded order - by an md5 of (id, seed). Its leading hex digits are the bucket: uniform by
  construction, the same on every engine and after a lost executor.
* key order - by unique columns of any ordered type. The buckets are range partitions, written once to the shared
  folder with their numbers, so every branch of the plan agrees. Null keys sort first.

Null ``by`` values are a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrules.storage import stored

ROWS_PER_BUCKET = 100_000


def seed_hash(seed: int | str, *ids: str | Column) -> Column:
    """The seeded sort key: ``md5('id:...:seed')``."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))


def hash_fraction(key: Column) -> Column:
    """A seeded hash as a number in [0, 1), from its first 8 hex digits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Equality of the ``names`` with their prefixed namesakes on the right, nulls equal."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[f"{prefix}{name}"])
    return out


def hash_digits(df: DataFrame) -> int:
    """How many hex digits make buckets of some 100,000 rows."""
    rows, digits = df.count(), 1
    while rows > ROWS_PER_BUCKET << 4 * digits:
        digits += 1
    return digits


def segments(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], buckets: int | None = None) -> DataFrame:
    """The rows with ``_bucket``, the number of the range partition by group and order that holds them. Written once."""
    by = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*([buckets] if buckets else []), *by, *order)
    return stored(ranged.withColumn("_bucket", F.spark_partition_id()))


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    totals: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = (),
    *,
    hashed: bool = False,
    inclusive: bool = True,
    keep_below: tuple[str, int | Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add running aggregates ``{name: (fn, column)}`` in ``order`` within ``by``.

    ``fn`` is ``count``, ``sum`` or ``max``. ``order`` must be unique within ``by``; with ``hashed=True`` it
    starts with a seeded hash. ``keep_below=(name, n)`` drops whole buckets whose carried total already reached ``n``, for
    callers that only need the head of each group.
    """
    by = list(by)
    staged = df.withColumns({f"_in_{name}": column for name, (_, column) in totals.items()})
    if hashed:
        first = F.col(order[0]) if isinstance(order[0], str) else order[0]
        staged = staged.withColumn("_bucket", F.substring(first, 1, hash_digits(df)))
    else:
        staged = segments(staged, by, order, buckets)
    fns = {"count": F.count, "sum": F.sum, "max": F.max}
    per_bucket = staged.groupBy(*by, "_bucket").agg(
        *[fns[fn](f"_in_{name}").alias(f"_part_{name}") for name, (fn, _) in totals.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": F.sum, "sum": F.sum, "max": F.max}
    carry = per_bucket.select(
        *by,
        "_bucket",
        *[merge[fn](f"_part_{name}").over(earlier).alias(f"_carry_{name}") for name, (fn, _) in totals.items()],
    )
    if keep_below is not None:
        name, n = keep_below
        carry = carry.filter(F.coalesce(F.col(f"_carry_{name}"), F.lit(0)) < n)
    carry = carry.withColumnsRenamed({c: f"_at_{c}" for c in [*by, "_bucket"]})
    joined = staged.join(carry, null_safe(staged, carry, [*by, "_bucket"], "_at_"))
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    for name, (fn, _) in totals.items():
        here = fns[fn](f"_in_{name}").over(inside)
        before = F.col(f"_carry_{name}")
        if fn == "max":
            value = F.greatest(here, before)
        else:
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        joined = joined.withColumn(name, value)
    internal = ["_bucket", *[f"_at_{c}" for c in [*by, "_bucket"]]] + [f"{p}{name}" for name in totals for p in ("_in_", "_carry_")]
    return joined.drop(*internal)


def rank_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    *,
    name: str = "rank",
    hashed: bool = False,
    at_most: int | Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``row_number`` as BIGINT, for groups of any size; optionally only ranks ``<= at_most``."""
    out = running(
        df,
        order,
        {name: ("count", F.lit(1))},
        by,
        hashed=hashed,
        keep_below=None if at_most is None else (name, at_most),
        buckets=buckets,
    )
    return out if at_most is None else out.filter(F.col(name) <= at_most)


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``row_number`` over ``by``, for groups of known small size, or followed by ``rank <= k``.

    With a filter on the rank Catalyst plans a WindowGroupLimit, so a hot key is cut to k rows
    per task before the shuffle. ``order`` must end in a unique column.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint"))


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``: a top-n per task, then one merge of those heads."""
    return df.orderBy(*order).limit(n)

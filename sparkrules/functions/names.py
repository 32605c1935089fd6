"""Run names and metric tables: typed columns from names, groups of runs, report formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the run-name parts and their types ------------------------------------------
RUN_PATTERNS = {
    "model_name": (r"^([^-]+-[^-]+)", "string"),
    "batch_size": (r"b(\d+)_", "int"),
    "learning_rate": (r"_([0-9.e-]+)_beam", "double"),
    "beam_size": (r"beam(\d+)_hyper", "int"),
}
# --- fixed values: run families, first match wins ----------------------------------------------
RUN_FAMILIES = [("no-clause", 1), ("calc-loss", 2)]
PERCENT_COLUMNS = ("bleu", "f1")


def parse_run_name(df: DataFrame, col: str = "name", patterns: Mapping[str, tuple[str, str]] = RUN_PATTERNS):
    """One typed column per pattern; a part that is absent becomes null."""
    parts = {}
    for name, (pattern, kind) in patterns.items():
        found = F.regexp_extract(F.col(col), pattern, 1)
        parts[name] = F.when(found != "", found).try_cast(kind)
    return df.withColumns(parts)


def run_family(col: str | Column, families: Sequence[tuple[str, int]] = tuple(RUN_FAMILIES), default: int = 0):
    name = F.col(col) if isinstance(col, str) else col
    out = F.lit(default)
    for word, value in reversed(families):
        out = F.when(name.contains(word), F.lit(value)).otherwise(out)
    return out


def drop_parts(col: str | Column, k: int) -> Column:
    """The name without its last ``k`` parts between underscores."""
    parts = F.split(F.col(col) if isinstance(col, str) else col, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0))), "_")


def part_from_end(col: str | Column, k: int) -> Column:
    parts = F.split(F.col(col) if isinstance(col, str) else col, "_")
    return F.coalesce(F.get(parts, F.size(parts) - k), F.lit(""))


def half_even(value: Column, digits: int) -> Column:
    """Round the binary value half-even, as numeric array libraries do (``round`` is half-up)."""
    return F.rint(value * 10**digits) / 10**digits


def format_metrics(
    df: DataFrame,
    *,
    digits: int = 1,
    percent: Sequence[str] = PERCENT_COLUMNS,
    rename: Mapping[str, str] | None = None,
    keep: Sequence[str] | None = None,
    drop_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Percent columns times 100, doubles rounded half-even, columns chosen and renamed by pattern."""
    rename = rename or {}
    columns = []
    for name, kind in df.dtypes:
        if any(name.endswith(s) for s in drop_suffixes):
            continue
        if keep is not None and not any(k in name for k in keep):
            continue
        column = F.col(f"`{name}`")
        if kind == "double":
            scaled = column * 100 if any(p in name for p in percent) else column
            column = half_even(scaled, digits)
        columns.append(column.alias(rename.get(name, name)))
    return df.select(*columns)

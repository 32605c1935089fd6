"""Compare every registered query with its SQL twin: ``python tests/check_oracles.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from sparkrules.plans.inputs import TABLES  # noqa: E402
from sparkrules.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {
    "tinyint": "INT8", "smallint": "INT16", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def compare(con, spark_df, sql: str) -> tuple[str, int]:
    columns = sorted(spark_df.columns)
    kinds = dict(spark_df.dtypes)
    mine = sorted(tuple(_plain(r[c]) for c in columns) for r in spark_df.select(*columns).collect())
    relation = con.sql(sql)
    theirs_kinds = dict(zip(relation.columns, map(str, relation.types)))
    if columns != sorted(theirs_kinds):
        return f"columns differ: {columns} / {sorted(theirs_kinds)}", len(mine)
    wrong = {c: (kinds[c], theirs_kinds[c]) for c in columns if KINDS.get(kinds[c], kinds[c]) != theirs_kinds[c]}
    if wrong:
        return f"types differ: {wrong}", len(mine)
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in relation.fetchall())
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}", len(mine)
    for a, b in zip(mine, theirs):
        if a != b:
            short = [(c, x[:300], y[:300]) for c, x, y in zip(columns, a, b) if x != y]
            return f"values differ: {short}", len(mine)
    return "ok" if mine else "EMPTY", len(mine)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = registry.queries(), registry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                result, rows = compare(con, query(spark, sf_dir), oracles[name])
            else:
                rows = query(spark, sf_dir).count()
                result = "rows only"
        except Exception as error:  # report and go on with the next query
            result, rows = f"{type(error).__name__}: {str(error)[:700]}", 0
        failed += result not in ("ok", "rows only")
        print(f"{name:32s} {rows:8d} rows {time.time() - start:6.1f}s  {result}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

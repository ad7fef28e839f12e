"""Run registered queries against their SQL twins: ``python -m checks.compare [names]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

import checks
from passagemill.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([_cell(v) for v in value])
    return repr(value)


def differences(spark, db, name: str, folder: str) -> str | None:
    """What differs between a query and its twin, or nothing."""
    frame = checks.QUERIES[name](spark, folder)
    rows = [r.asDict() for r in frame.collect()]
    columns = sorted(frame.columns)
    if name not in checks.ORACLES:
        return None if rows else "no rows"
    result = db.execute(checks.ORACLES[name])
    names = [d[0] for d in result.description]
    twin = [dict(zip(names, r)) for r in result.fetchall()]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    if not rows:
        return "no rows"
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    types = {c: t for c, t in frame.dtypes if t != kinds[c]}
    if types:
        return f"types {types} and { {c: kinds[c] for c in types} }"
    mine = sorted(tuple(_cell(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(_cell(r[c]) for c in columns) for r in twin)
    if mine == theirs:
        return None
    here, there = Counter(mine), Counter(theirs)
    extra, missing = list((here - there))[:2], list((there - here))[:2]
    return f"{len(mine)} and {len(theirs)} rows\n   only here {str(extra)[:700]}\n   only there {str(missing)[:700]}"


def main(names: list[str], folder: str) -> int:
    checks.load_all()
    spark, db = local_session(), database(folder)
    bad = 0
    for name in names or list(checks.QUERIES):
        start = time.time()
        try:
            problem = differences(spark, db, name, folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        state = "ok" if problem is None else f"DIFFERS: {problem}"
        kind = "sql" if name in checks.ORACLES else "rows"
        print(f"{name:28} {kind:4} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(args, where) else 0)

"""Runs registered queries against their DuckDB oracles: ``python -m tabsight.check [sf_dir] [names…]``."""

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return str(bool(v))
    if isinstance(v, (float, Decimal)):
        return repr(float(f"{float(v):.12g}") + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """'' when rows, names and values agree, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows vs {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def connect(sf_dir):
    import duckdb
    from pathlib import Path
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def main(argv):
    from .plans.queries import ORACLES, QUERIES
    from .plans.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - reported per query
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if name in ORACLES else ' (rows only)'} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

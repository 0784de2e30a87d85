"""Run registered queries against their SQL counterparts and report differences.

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when equal, otherwise what differs."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    mine = Counter(tuple(r[n] for n in names) for r in frame.collect())
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    if sorted(columns) != names:
        return f"columns {names} / {sorted(columns)}"
    at = [columns.index(n) for n in names]
    theirs = Counter(tuple(r[i] for i in at) for r in done.fetchall())
    if mine == theirs:
        return ""
    return f"rows {sum(mine.values())} / {sum(theirs.values())}; only here {list((mine - theirs).items())[:2]}; only SQL {list((theirs - mine).items())[:2]}"


def main() -> int:
    import __spark_entry__ as entry
    from spendloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, sf_dir, query, sqls[name])
            else:
                verdict = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - reported, and counted as a failure
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(verdict)
        print(f"{'ok  ' if not verdict else 'BAD '} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())

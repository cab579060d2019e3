"""Compares every query with its SQL in DuckDB: row count, column types and values as a bag of rows.

usage: python tools/check.py [--hot] [folder] [name ...]

``--hot`` lowers every size limit so far that ordinary groups count as too large for one task.
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from candex.catalog import ORACLES, QUERIES  # noqa: E402
from candex.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}

HOT = {"checkBytes": "0", "groupRows": "12", "foldRows": "4", "broadcastRows": "1000"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    """``ok``, ``rows only`` or what differs."""
    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLES:
        return f"rows only ({len(got)})"
    cur = con.execute(ORACLES[name])
    names, kinds = [c[0] for c in cur.description], [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    theirs = dict(zip(names, kinds))
    types = {c: (t, theirs[c]) for c, t in df.dtypes if KINDS.get(t) != theirs[c]}
    a, b = bag(got, df.columns), bag(want, names)
    if a != b:
        return f"values: {len(got)} / {len(want)} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    if types:
        return f"types {types}"
    return f"ok ({len(got)})" if got else "EMPTY"


def main() -> int:
    args = [a for a in sys.argv[1:] if a != "--hot"]
    folder = args[0] if args else "/root/testdata/sf0.01"
    chosen = args[1:] or list(QUERIES)
    spark = local_session(8)
    if "--hot" in sys.argv:
        for name, value in HOT.items():
            spark.conf.set(f"spark.candex.{name}", value)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            result = compare(spark, con, folder, name)
        except Exception as e:  # one broken query must not hide the others
            result = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        good = result.startswith(("ok", "rows only"))
        bad += not good
        print(f"{'' if good else '** '}{name} {time.time() - start:.2f}s {result}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main())

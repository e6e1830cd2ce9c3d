"""Run registered queries beside their SQL in DuckDB and compare whole results.

usage: python tests/oracle.py [-k NAME_PART ...] [--sf sf0.01]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


TYPES = {
    "BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "bool", "DATE": "date32[day]", "TIMESTAMP": "timestamp[us]",
}


def compare(spark_df, con, sql):
    left = spark_df.toArrow()
    kinds = {r[0]: TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = list(kinds)
    fetched = con.execute(sql).fetchall()
    cols = sorted(left.column_names)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    notes = []
    for c in cols:
        a = str(left.schema.field(c).type).replace("large_", "")
        if a != kinds[c]:
            notes.append(f"type of {c}: {a} vs {kinds[c]}")
    data = [left.column(c).to_pylist() for c in cols]
    at = [names.index(c) for c in cols]
    rows = [
        sorted((tuple(plain(v) for v in r) for r in zip(*data)), key=repr),
        sorted((tuple(plain(r[i]) for i in at) for r in fetched), key=repr),
    ]
    if len(rows[0]) != len(rows[1]):
        notes.append(f"rows {len(rows[0])} vs {len(rows[1])}")
    if not rows[0]:
        notes.append("no rows")
    if rows[0] != rows[1]:
        diff = [(a, b) for a, b in zip(*rows) if a != b]
        notes.append(f"{len(diff)} differing, first {str(diff[:1])[:900]}")
    return "; ".join(notes) or None, len(rows[0])


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("-k", nargs="*", default=[])
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from textloom.scale import release_all
    from textloom.session import local_session

    folder = f"/root/testdata/{args.sf}"
    spark = local_session()
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.k and not any(k in name for k in args.k):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if args.explain:
                df.explain("formatted")
            if name in oracles:
                out = compare(df, con, oracles[name])
            else:
                n = df.count()
                df.limit(3).collect()
                out = (None if n else "no rows", n)
        except Exception as e:
            out = f"{type(e).__name__}: {str(e)[:700]}"
            if args.k:
                traceback.print_exc(limit=-4)
        if isinstance(out, str):
            out = (out, 0)
        took = time.time() - start
        release_all(spark)
        tag = "ok  " if out[0] is None else "FAIL"
        bad += out[0] is not None
        print(f"{tag} {name} {took:.1f}s rows={out[1]}{'' if name in oracles else ' (rows only)'} {out[0] or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

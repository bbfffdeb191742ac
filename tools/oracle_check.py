"""Run registered Spark queries next to their DuckDB oracles and compare results.

Usage: python tools/oracle_check.py [--sf DIR] [name ...]
Compares row count, column names and an order-insensitive multiset of normalised
rows (floats rounded to 6 decimals). Exit status 1 when any query differs.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd

        if v is pd.NaT or v is pd.NA:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)) and getattr(v, "shape", None) == ():
        return norm(v.item())
    if isinstance(v, (dt.datetime, dt.date)):
        if hasattr(v, "to_pydatetime"):
            v = v.to_pydatetime()
        # DuckDB hands DATE to pandas as a midnight timestamp; compare both as a date.
        if isinstance(v, dt.datetime) and v.time() == dt.time(0):
            return v.date().isoformat()
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def spark_type(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type(t[6:-1]) + "[]"
    if t.startswith("decimal"):
        return t.upper().replace(" ", "")
    return SPARK_TO_DUCK.get(t, t.upper())


def type_diffs(sdf_schema, duck_rel):
    st = {f.name: spark_type(f.dataType.simpleString()) for f in sdf_schema.fields}
    dt = {n: str(t).replace(" ", "") if str(t).startswith("DECIMAL") else str(t) for n, t in zip(duck_rel.columns, duck_rel.types)}
    return {n: (st.get(n), dt.get(n)) for n in sorted(set(st) | set(dt)) if st.get(n) != dt.get(n)}


def frame_rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    import duckdb

    from tidemark.plans.registry import ORACLES, QUERIES, load_all
    from tidemark.session import local_session

    load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    names = args.names or sorted(QUERIES)
    bad = []
    for name in names:
        t0 = time.time()
        try:
            sframe = QUERIES[name](spark, args.sf)
            sschema = sframe.schema
            sdf = sframe.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARKERR {name}: {str(e)[:800]}")
            bad.append(name)
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"NOORACLE {name}: rows={len(sdf)} ({ts:.1f}s)")
            continue
        try:
            ddf = con.execute(ORACLES[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"DUCKERR {name}: {str(e)[:800]}")
            bad.append(name)
            continue
        tdiff = type_diffs(sschema, con.sql(ORACLES[name]))
        if tdiff:
            print(f"TYPES {name}: {tdiff}")
        scols, srows = frame_rows(sdf)
        dcols, drows = frame_rows(ddf)
        if scols != dcols:
            print(f"COLS {name}: spark={scols} duck={dcols}")
            bad.append(name)
            continue
        if srows != drows:
            sset, dset = set(srows), set(drows)
            print(f"DIFF {name}: spark={len(srows)} duck={len(drows)} cols={scols}")
            print("   only spark:", [r for r in srows if r not in dset][:3])
            print("   only duck :", [r for r in drows if r not in sset][:3])
            bad.append(name)
            continue
        print(f"OK {name}: rows={len(srows)} ({ts:.1f}s)")
    print(f"\n{len(names) - len(bad)}/{len(names)} ok; failing: {bad}")
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()

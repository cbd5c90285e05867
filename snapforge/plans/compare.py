"""Local parity check: run a registered query on Spark and its oracle on DuckDB, compare.

Usage: ``python -m snapforge.plans.compare [sf_dir] [name ...]``.
Comparison is order-insensitive: column names and types, row count, and values after
normalisation (timestamps as text; floats rounded to 6 decimals, or exact with
SNAPFORGE_COMPARE_EXACT=1).
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


EXACT = os.environ.get("SNAPFORGE_COMPARE_EXACT") == "1"  # floats compared bit for bit


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Spark simple type -> DuckDB type name, for the schema check
TYPE_MAP = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR",
    "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def _norm(v):
    import datetime as dt
    import decimal

    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np

        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except ImportError:
        pass
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True):
    from snapforge.plans.catalog import oracle_sql, queries

    qs, os_ = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = list(sdf.columns)
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        if name not in os_:
            results[name] = f"rows-only ({len(srows)} rows)"
            if verbose:
                print(f"{name}: {results[name]} {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(os_[name])
            dcols = list(rel.columns)
            dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = f"DUCK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        type_diff = [
            (c, t, dtypes.get(c)) for c, t in sdf.dtypes if TYPE_MAP.get(t, t) != dtypes.get(c)
        ] if sorted(scols) == sorted(dcols) else []
        if sorted(scols) != sorted(dcols):
            results[name] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        elif type_diff:
            results[name] = f"TYPES {type_diff}"
        elif len(srows) != len(drows):
            results[name] = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        else:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a == b:
                results[name] = f"OK ({len(srows)} rows)"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                results[name] = f"VALUES differ, e.g. {diff}"
        if verbose:
            print(f"{name}: {results[name]} {time.time() - t0:.1f}s", flush=True)
    return results


def main(argv):
    from snapforge.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or None
    spark = build_session()
    res = compare(spark, sf_dir, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"\n{len(res) - len(bad)}/{len(res)} passed")
    for k, v in bad.items():
        print("FAIL", k, v)


if __name__ == "__main__":
    main(sys.argv)

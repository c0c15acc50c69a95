"""Compare registered queries with their DuckDB twins (row count, columns, values).

Usage: python tests/oracle_check.py SF_DIR [name ...]
"""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def spark_type(t) -> str:
    """DuckDB spelling of a Spark type (for the schema comparison)."""
    from pyspark.sql import types as T
    if isinstance(t, T.ArrayType):
        return spark_type(t.elementType) + "[]"
    return {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
            T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN"}.get(type(t), t.simpleString())


def compare(spark, sf_dir: str, names=None, verbose=True):
    sys.path.insert(0, ".")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        cols = sorted(sdf.columns)
        srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name:28s} rows-only  n={len(srows)}  spark={ts:.1f}s", flush=True)
            continue
        t1 = time.time()
        rel = con.sql(sqls[name])
        dcols = rel.columns
        stypes = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
        dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes) if stypes.get(c) != dtypes.get(c)}
        drows_raw = rel.fetchall()
        idx = {c: i for i, c in enumerate(dcols)}
        ok_cols = sorted(dcols) == cols
        drows = sorted((tuple(norm(r[idx[c]]) for c in cols) for r in drows_raw), key=repr) if ok_cols else []
        td = time.time() - t1
        same = ok_cols and srows == drows and not type_diff
        results[name] = ("ok" if same else "DIFF", len(srows), len(drows_raw))
        if verbose:
            print(f"{name:28s} {'ok ' if same else 'DIFF'} spark_n={len(srows)} duck_n={len(drows_raw)} spark={ts:.1f}s duck={td:.1f}s", flush=True)
            if type_diff:
                print("   types:", type_diff)
            if not ok_cols:
                print("   columns:", cols, sorted(dcols))
            elif not same:
                sset, dset = set(srows), set(drows)
                print("   only spark:", sorted(sset - dset, key=repr)[:3])
                print("   only duck :", sorted(dset - sset, key=repr)[:3])
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from rankframe.session import local_session

    spark = local_session()
    args = sys.argv[1:]
    if "--exact" in args:  # compare floats bit for bit (no rounding in the harness)
        args.remove("--exact")
        EXACT = True
    compare(spark, args[0], args[1:] or None)

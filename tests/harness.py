"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, folder):
    """Empty string when both agree, else what differs."""
    df = query(spark, folder)
    sc, sr = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    dc, dr = normal(names, cur.fetchall())
    if sc != dc:
        return f"columns differ: {sc} vs {dc}"
    problems = []
    for f in df.schema.fields:
        t, want = types[f.name], f.dataType.simpleString()
        ok = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
        if ok.get(want) != t:
            problems.append(f"type {f.name}: {want} vs {t}")
    if len(sr) != len(dr):
        problems.append(f"rows {len(sr)} vs {len(dr)}")
    if sr != dr:
        a, b = set(map(repr, sr)), set(map(repr, dr))
        only_a, only_b = sorted(a - b)[:3], sorted(b - a)[:3]
        problems.append(f"{len(a - b)} rows differ\n   spark {[x[:600] for x in only_a]}\n   duck  {[x[:600] for x in only_b]}")
    return "\n  ".join(problems)


def main(argv):
    from callweave.plans import registry
    from callweave.session import local_session

    sf = os.environ.get("SF", "0.01")
    folder = f"/root/testdata/sf{sf}"
    mods = [a[1:] for a in argv if a.startswith("@")]
    if mods:
        import importlib

        for m in mods:
            importlib.import_module(f"callweave.plans.{m}")
    else:
        registry.load()
    picks = [a for a in argv if not a.startswith("@")]
    spark = local_session()
    con = duck(folder)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if picks and not any(p in name for p in picks):
            continue
        t = time.time()
        sql = registry.ORACLES.get(name)
        try:
            if sql is None:
                n = fn(spark, folder).count()
                res, note = ("" if n else "no rows"), f"rows-only {n}"
            else:
                res = compare(spark, con, name, fn, sql, folder)
                n = con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
                note = f"{n} rows"
        except Exception as e:  # noqa: BLE001
            res, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += bool(res)
        print(f"{'FAIL' if res else 'ok  '} {name} {note} {time.time() - t:.1f}s {res}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

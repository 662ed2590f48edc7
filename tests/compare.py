"""Run registered queries next to their SQL and compare rows (also as a script)."""

import datetime
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, (bool, int)):
        return ("b" if isinstance(v, bool) else "i", v)
    if isinstance(v, datetime.datetime):
        return ("t", v.isoformat())
    return ("n", "") if v is None else ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {str(g)[:600]}\n   expected {str(w)[:600]}"
    return None


if __name__ == "__main__":
    from answerloom.plans.catalog import ORACLES, QUERIES
    from answerloom.session import build_session

    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in names:
        t = time.time()
        try:
            diff = compare(QUERIES[name](spark, sf), con, ORACLES[name])
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")

"""Compare registered queries with their oracle SQL on DuckDB."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, con, fn, sql, sf_dir) -> str:
    """Empty text when rows agree, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_norm(v) for v in r) for r in df.select(*names).collect()), key=repr)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    order = [cols.index(n) for n in names]
    want = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {names}: {bad[0][0]} vs {bad[0][1]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from heliopath.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = oracle_sql()
    good = 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                text = compare(spark, con, fn, sqls[name], sf)
            else:
                text = f"rows only: {fn(spark, sf).count()}"
        except Exception as e:
            text = "ERROR " + str(e)[:1500]
        good += not text
        print(f"{'ok' if not text else text} :: {name} {time.time() - t:.1f}s", flush=True)
    print("agree:", good)

"""Runs queries beside their SQL: python tests/compare.py [folder] [name...]"""

import glob
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(at):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{at}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def key(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def differ(df, c, sql):
    """What differs between a DataFrame and the SQL's rows, or ''."""
    names = sorted(df.columns)
    got = sorted(tuple(key(x) for x in r) for r in df.select(*names).collect())
    q = c.execute(sql)
    own = [d[0] for d in q.description]
    if sorted(own) != names:
        return f"columns {names} {sorted(own)}"
    order = [own.index(n) for n in names]
    want = sorted(tuple(key(r[i]) for i in order) for r in q.fetchall())
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} {len(want)} rows; {len(a)} {len(b)} differ: {sorted(a)[:2]} {sorted(b)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from alidade.plans import catalogue

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    at = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    c = connect(at)
    for name in sys.argv[2:] or catalogue.QUERIES:
        t = time.time()
        try:
            df = catalogue.QUERIES[name](spark, at)
            said = differ(df, c, catalogue.SQL[name]) if name in catalogue.SQL else f"{df.count()} rows only"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)

"""Compares a query with its SQL in DuckDB, rows in any order."""

import datetime as dt
import decimal
import glob
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return x


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def same(spark, sf_dir, query, sql):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted([tuple(_plain(x) for x in r) for r in df.select(*cols).collect()])
    out = c.execute(sql)
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    order = [names.index(x) for x in cols]
    want = _sorted([tuple(_plain(r[i]) for i in order) for r in out.fetchall()])
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (a, b)
    return len(got)

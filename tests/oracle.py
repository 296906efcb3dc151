"""Rows of a query and of its SQL, in a form that can be compared."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def sql_rows(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=lambda r: tuple(map(str, r)))

"""Compare a Spark result with DuckDB's, by name and value, without order."""

import glob
import math

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = [columns.index(n) for n in sorted(columns)]
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)

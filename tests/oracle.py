"""Results of Spark and of DuckDB as sorted rows of text."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    return str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(text(v) for v in row) for row in df.select(*columns).collect())


def duck_rows(con, sql):
    result = con.sql(sql)
    columns = list(result.columns)
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted(tuple(text(row[i]) for i in order) for row in result.fetchall())

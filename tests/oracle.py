"""Runs a query and its SQL side by side."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


def by_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=repr)


def by_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in row) for row in df.select(*names).collect()), key=repr)

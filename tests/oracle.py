"""Compare a query's rows with those of its SQL in DuckDB."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "DATE": "date"}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return int(v) if isinstance(v, decimal.Decimal) and v == int(v) else v


def check(df, con, sql):
    cursor = con.execute(sql)
    names, kinds = [c[0] for c in cursor.description], [str(c[1]) for c in cursor.description]
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    assert got == want
    assert want, "an empty result shows nothing"
    types = dict(df.dtypes)
    assert {n: KINDS.get(k.upper(), k) for n, k in zip(names, kinds, strict=True)} == {n: types[n] for n in names}

"""Compares a Spark result with DuckDB's for the same tables."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i].lower() for i in order], sorted(found, key=lambda r: [(x is None, str(x)) for x in r])


def kinds(con, sql):
    """DuckDB's column types in Spark's words, by name."""
    names = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "HUGEINT": "huge", "FLOAT": "float"}
    return {r[0].lower(): names.get(r[1], r[1].lower()) for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def compare(df, con, sql):
    """None if both agree, else what differs."""
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        only = [x for x in ours[1] if x not in set(theirs[1])][:3], [x for x in theirs[1] if x not in set(ours[1])][:3]
        return f"{len(ours[1])} and {len(theirs[1])} rows; only ours {only[0]}, only theirs {only[1]}"
    types, other = {k.lower(): v for k, v in df.dtypes}, kinds(con, sql)
    if types != other:
        return "types " + str({k: (types[k], other[k]) for k in types if types[k] != other[k]})
    return None

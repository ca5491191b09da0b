"""Compare a query with its SQL the way the contract describes it."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def mismatch(df, con, sql):
    """None when both sides agree, else a description."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    types = {column[0]: str(column[1]).lower() for column in result.description}
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    same = {"bigint": "bigint", "string": "varchar", "double": "double", "boolean": "boolean"}
    for name, kind in df.dtypes:
        if same.get(kind) != types[name] and not types[name] == "number":
            return f"type of {name}: {kind} and {types[name]}"
    order = [names.index(name) for name in sorted(names)]
    ours = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=_key)
    theirs = sorted((tuple(r[i] for i in order) for r in theirs), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    if not ours:
        return "no rows"
    for left, right in zip(ours, theirs):
        for a, b in zip(left, right):
            if a != b and not (isinstance(a, float) and math.isclose(a, b, rel_tol=0, abs_tol=0)):
                return f"{left} and {right}"
    return None

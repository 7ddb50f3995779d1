"""Compare a Spark query with DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v) if not isinstance(v, (int, bool)) else v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark_df, con, sql: str, show: int = 5) -> dict:
    srows = [tuple(r) for r in spark_df.collect()]
    scols = list(spark_df.columns)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
              for f in spark_df.schema.fields}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    rel = con.sql(sql)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    drows = res.fetchall()
    out = {"spark_rows": len(srows), "duck_rows": len(drows), "cols_ok": sorted(scols) == sorted(dcols)}
    bad = {c: (stypes.get(c), dtypes.get(c)) for c in scols if stypes.get(c) != dtypes.get(c)}
    out["types_ok"] = not bad
    if bad:
        out["type_diff"] = bad
    if not out["cols_ok"]:
        out["spark_cols"], out["duck_cols"] = scols, dcols
        return out
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in srows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    out["values_ok"] = sc == dc
    if not out["values_ok"]:
        out["only_spark"] = list((sc - dc).elements())[:show]
        out["only_duck"] = list((dc - sc).elements())[:show]
        out["cols"] = order
    return out

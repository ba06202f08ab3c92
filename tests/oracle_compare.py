"""Compare a registered Spark query with its DuckDB oracle (rows, schema, values).

Usable from pytest and as a script:
    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SPARK_KIND = {
    "IntegerType": "int32", "LongType": "int64", "DoubleType": "float64", "StringType": "string",
    "DateType": "date", "BooleanType": "bool", "TimestampType": "timestamp", "TimestampNTZType": "timestamp",
    "ShortType": "int16", "ByteType": "int8", "FloatType": "float32",
}
_DUCK_KIND = {
    "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float32",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name: str, query, sql: str) -> dict:
    sdf = query(spark, con._sf_dir) if hasattr(con, "_sf_dir") else query
    s_cols = sdf.columns
    s_kinds = {f.name: _SPARK_KIND.get(type(f.dataType).__name__, str(f.dataType)) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_kinds = {c: _DUCK_KIND.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    res = {"name": name, "rows_spark": len(s_rows), "rows_oracle": len(d_rows)}
    res["columns_match"] = sorted(s_cols) == sorted(d_cols)
    res["types_match"] = res["columns_match"] and all(s_kinds[c] == d_kinds[c] for c in s_cols)
    if not res["columns_match"]:
        res["detail"] = f"spark {sorted(s_cols)} vs oracle {sorted(d_cols)}"
        res["values_match"] = False
        return res
    if not res["types_match"]:
        res["detail"] = {c: (s_kinds[c], d_kinds[c]) for c in s_cols if s_kinds[c] != d_kinds[c]}
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    res["values_match"] = a == b
    if not res["values_match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["detail"] = {"columns": order, "first_diffs": diff}
    res["ok"] = res["values_match"] and res["types_match"] and len(s_rows) == len(d_rows)
    return res


def main(argv: list[str]) -> int:
    import json
    import time

    from __spark_entry__ import oracle_sql, queries
    from adpulse.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    con = duck_connection(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(json.dumps({"name": name, "oracle": "none"}))
            continue
        t = time.time()
        try:
            r = compare(spark, con, name, qs[name](spark, sf_dir), sqls[name])
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        r["sec"] = round(time.time() - t, 2)
        bad += not r.get("ok")
        print(json.dumps(r, default=str))
    print(f"FAILED: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

"""Run registered queries and compare them with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from foldwise.sources.tables import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if v % 1 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql: str):
    """None when equal, otherwise a short description."""
    cols = sorted(df.columns)
    got = sorted([tuple(str(plain(r[c])) for c in cols) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    for n, t in df.dtypes:
        if t in TYPES and TYPES[t] != types[n]:
            return f"type of {n}: {t} vs {types[n]}"
    idx = [names.index(c) for c in cols]
    want = sorted([tuple(str(plain(r[i])) for i in idx) for r in raw])
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; e.g. {sorted(set(got) ^ set(want))[:4]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return None if not bad else f"{len(bad)} of {len(got)} rows differ in {cols}; e.g. {sorted(set(got) - set(want))[:3]} vs {sorted(set(want) - set(got))[:3]}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("foldwise")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.extraJavaOptions", "-Xss8m").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e
    spark, con = session(), connect(f"/root/testdata/{sf}")
    qs, sqls, bad = e.queries(), e.oracle_sql(), 0
    for n in names or qs:
        t0 = time.time()
        try:
            df = qs[n](spark, f"/root/testdata/{sf}")
            if n in sqls:
                res = compare(df, con, sqls[n])
                res = f"ok ({df.count()} rows)" if res is None and "-v" in sys.argv else ("ok" if res is None else "DIFF " + res)
            else:
                res = f"rows-only {df.count()}"
        except Exception as x:  # noqa: BLE001
            res = "ERROR " + str(x)[:1500]
        spark.catalog.clearCache()
        from foldwise.operators.lookup import release; release()
        bad += res.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - t0:6.1f}s {n}: {res}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    main(sys.argv[1], [a for a in sys.argv[2:] if a != "-v"])

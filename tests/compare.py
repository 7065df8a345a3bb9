"""Run registered queries and their SQL side by side and report differences."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.reindex(sorted(pdf.columns), axis=1)
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]")
        elif out[c].dtype.kind == "f":
            out[c] = out[c] + 0.0
    return out.sort_values(list(out.columns), na_position="last").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} cells of {c}, first {a[c][i]!r} vs {b[c][i]!r}"
    return ""


def main() -> None:
    from tidecast.session import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    settings = {"spark.sql.shuffle.partitions": "8"}
    settings |= dict(kv.split("=") for kv in os.environ.get("COMPARE_CONF", "").split(",") if kv)
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            got = run(spark, folder).toPandas()
            spent = time.time() - started
            text = difference(got, con.sql(sql[name]).df()) if name in sql else "(rows only)"
        except Exception as problem:  # noqa: BLE001
            spent, text, got = time.time() - started, f"ERROR {str(problem)[:600]}", []
        bad += bool(text) and text != "(rows only)"
        print(f"{name:28s} {spent:6.2f}s {len(got):8d} rows  {text or 'same'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()

"""Holds registered queries against their oracle SQL: python tests/verify.py sf0.01 [name...]"""

import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).parent.parent))


def compare(spark, d, query, sql) -> str:
    """Empty, or the difference."""
    import pandas as pd

    con = duckdb.connect()
    for f in Path(d).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}{'/*' if f.is_dir() else ''}')")
    want = con.execute(sql).df()
    got = query(spark, d).toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)

    def text(df):
        out = pd.DataFrame()
        for c in cols:
            s = df[c]
            if s.dtype.kind == "f" or (s.dtype == object and s.map(lambda x: hasattr(x, "as_tuple")).any()):
                s = s.astype(float)
                out[c] = s.map(lambda x: "-" if np.isnan(x) else f"{x:.9g}" if abs(x) > 1e-12 else "0")
            elif s.dtype.kind in "iub":
                out[c] = s.astype(object).map(lambda x: "-" if pd.isna(x) else f"{float(x):.9g}" if abs(float(x)) < 1e15 else str(int(x)))
            elif s.dtype.kind == "M":
                out[c] = s.astype("datetime64[us]").astype(str).where(s.notna(), "-")
            else:
                out[c] = s.map(lambda x: "-" if x is None or (isinstance(x, float) and np.isnan(x)) or x is pd.NA or x is pd.NaT else str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x))
        return out.sort_values(cols).reset_index(drop=True)

    a, b = text(got), text(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        return f"{bad.sum()} rows differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from tessella.session import session

    spark = session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or qs:
        t = time.time()
        try:
            why = compare(spark, f"/root/testdata/{sys.argv[1]}", qs[n], sqls[n]) if n in sqls else f"(rows only: {qs[n](spark, f'/root/testdata/{sys.argv[1]}').count()})"
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why) and why[0] != "("
        print(f"{n}: {why or 'ok'} {time.time() - t:.1f}s", flush=True)
        spark.catalog.clearCache()
    print("bad", bad)

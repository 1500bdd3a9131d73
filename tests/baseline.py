"""Seconds of DuckDB for the benchmark's oracle SQL on the same tables, beside which ours can be read:
python tests/baseline.py [folder]. The median of three runs after one that warms up (fewer where they take long); results
are fetched, as a benchmark that writes nowhere still has to make every row."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))


def main() -> None:
    import __spark_entry__
    from bench import HEADLINE

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = duckdb.connect(config={"threads": int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))})
    for f in Path(d).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    sql, took = __spark_entry__.oracle_sql(), {}
    for name in [n for n in HEADLINE if n in sql]:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            con.execute(sql[name]).df()
            runs.append(time.perf_counter() - t)
            if sum(runs) > 10:
                break
        took[name] = round(statistics.median(runs[1:] or runs), 3)
        print(json.dumps({name: took[name]}), flush=True)


if __name__ == "__main__":
    main()

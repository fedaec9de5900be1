"""Run every registered query against its SQL at one scale: ``python tests/check_all.py [sf] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from checking import compare, connect  # noqa: E402
from graticule.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=8, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            said = compare(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {said or 'ok'}", flush=True)
        if said and not said.startswith("rows only"):
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()

"""Run every query against its SQL: python tests/check_all.py [folder] [name ...]."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

import __spark_entry__ as entry  # noqa: E402
from basketlab.session import build  # noqa: E402
from compare import connect, differences  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    spark = build(master="local[8]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(folder), entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                note = differences(df, con, sql[name]) or "ok"
            else:
                note = f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        good = note == "ok" or note.startswith("rows only")
        bad += not good
        print(f"{'  ' if good else '!!'} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad, "without SQL:", sorted(set(entry.queries()) - set(sql)))


if __name__ == "__main__":
    main()

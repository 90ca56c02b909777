"""Run registered queries against their SQL: python tests/run_checks.py DIR [name-substring ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    directory, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(directory), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, directory)
            if name in sql:
                problem = difference(df, con, sql[name])
            else:
                problem = None if df.collect() is not None else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {time.time() - start:6.2f}s {name}{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{bad} differences")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())

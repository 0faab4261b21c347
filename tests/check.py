"""``python -m tests.check [name …]``: registered queries against their SQL."""

import os
import sys
import time
import traceback

from storyloom.session import build
from tests.compare import compare, connect


def main() -> int:
    import __spark_entry__ as entry

    root = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                 "spark.driver.memory": "12g", "spark.storyloom.textTasks": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = [a for a in sys.argv[1:]] or list(queries)
    names = [q for q in queries if any(q == w or (w.endswith("*") and q.startswith(w[:-1])) for w in wanted)]
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                problem, n = compare(spark, con, name, queries[name], oracle[name], root)
            else:
                problem, n = None, queries[name](spark, root).count()
        except Exception as error:  # noqa: BLE001
            problem, n = f"{name}: {type(error).__name__} {str(error)[:1500]}", -1
            if os.environ.get("TRACE"):
                traceback.print_exc()
        took = time.time() - start
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {n:8d} rows {'' if name in oracle else '(no sql) '}{name}", flush=True)
        if problem:
            failed.append(name)
            print(problem, flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} good; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())

"""python tests/check_queries.py FOLDER [NAME...]: compares all queries with their SQL."""

import pathlib
import sys
import time

sys.path[:0] = [str(pathlib.Path(__file__).parent), str(pathlib.Path(__file__).parents[1])]

from capledger.queries import QUERIES, SQL
from capledger.session import build_session
from compare import compare, connect


def main(folder, *names):
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names or QUERIES:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            diff = compare(df, con, SQL[name]) if name in SQL else f"rows only: {df.count()}"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(diff) and not diff.startswith("rows only")
        print(f"{time.time() - began:6.1f}s {name}: {diff or 'ok'}", flush=True)
    print("differences:", bad)


main(*sys.argv[1:])

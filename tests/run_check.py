"""Check some or all registered queries: ``python tests/run_check.py [sf] [name or module:...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from querytide.functions import ordered  # noqa: E402
from querytide.registry import load  # noqa: E402
from querytide.session import local_session  # noqa: E402
from tests.check import TESTDATA, check_connection, compare  # noqa: E402


def main() -> None:
    sf = f"{TESTDATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark_queries, _ = load()
    wanted = sys.argv[2:]
    names = [
        n for n, q in spark_queries.items()
        if not wanted or n in wanted or any(q.__module__.endswith("." + w) for w in wanted)
    ]
    spark, con = local_session(), check_connection(sf)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("QUERYTIDE_CHUNKED"):  # small input in several chunks too
        ordered.CHUNK_ROWS = int(os.environ["QUERYTIDE_CHUNKED"])
    bad = 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


main()

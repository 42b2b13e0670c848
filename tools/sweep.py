"""Extract-and-fit time for growing numbers of newest transactions (nothing is stored).

    python tools/sweep.py /root/testdata/sf0.1 1000 10000 100000
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from knownthen.operators.features import training_set  # noqa: E402
from knownthen.operators.model import train_window  # noqa: E402
from knownthen.sources.driver_tables import NOW, OUTCOME_DELAY, fact_logs  # noqa: E402
from knownthen.sources.shared import written  # noqa: E402


def main(sf, sizes):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    logs = fact_logs(spark, sf)
    for size in sizes:
        start = time.perf_counter()
        rows = written(training_set(logs, resolved_before=NOW - OUTCOME_DELAY, limit=size), "sweep")
        extracted = time.perf_counter()
        model = train_window(rows, f"sweep-{size}")
        print(json.dumps({
            "limit": size, "n": model.n_train, "n_fraud": model.n_fraud, "auc": model.auc,
            "extract_ms": round(1000 * (extracted - start)), "fit_ms": round(1000 * (time.perf_counter() - extracted))}),
            flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(n) for n in sys.argv[2:]] or [1_000, 10_000, 100_000])

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

NAMES = (
    "token_census", "elements_summary", "siblings_next_prev", "walk_nodes", "tokens_in_range", "token_at_offset", "covering_element", "dictionary", "dedup_stats",
    "map_ranges", "reuse_candidates", "find_bytes", "apply_edit", "calc_eval", "calc_fold", "ancestors_of_tokens", "descendants",
)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    from pyspark.sql import SparkSession

    from leafmill.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(NAMES[0])  # compile and touch memory
    took = {}
    for name in NAMES:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Headline queries at one scale; prints one JSON line.

The result of every query is written to Spark's ``noop`` sink, so all columns
of all rows are computed and none travels to the driver.
"""

import contextlib
import json
import os
import statistics
import sys
import time

from corpusloom.session import local_session
from corpusloom.suite import QUERIES

HEADLINE = [
    "a01_topic_label_summary",
    "a03_describe_lengths",
    "a15_box_stats",
    "w01_keep_first",
    "w02_first_n",
    "w06_shuffled",
    "g02_balanced_sample",
    "g03_stratified_split",
    "f06_repair",
    "f07_mask_entities",
    "p16_lexical_diversity",
    "l02_mtld",
    "l03_hdd",
    "s06_articles",
    "f14_token_ids",
    "m06_topic_terms",
    "m07_tfidf",
    "m08_logistic_regression",
    "x01_build_corpus",
    "x04_recipe_2",
    "x07_topic_leakage",
    "t02_capped_sample",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(os.environ.get("BENCH_CPUS", "8"), "corpusloom-bench")
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {}
        for name in names:
            took = []
            for _ in range(runs):
                started = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - started)
            seconds[name] = round(statistics.median(took), 3)
            print(name, [round(x, 2) for x in took], file=sys.stderr, flush=True)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the given tables, BENCH_CPUS the number of threads.
Every query is run once to warm up and once for the clock, its whole result written to
a sink that drops it.
"""

import json
import os
import time

from guestlens.checks.queries import QUERIES
from guestlens.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "hotel_ranking",
    "hash_dedup",
    "exact_dedup",
    "ingest_new_only",
    "per_hotel_cap",
    "csv_roundtrip",
    "prepare",
    "kpis",
    "sentiment_distribution",
    "monthly_sentiment",
    "monthly_volume",
    "word_terms_pos",
    "word_cloud_pos",
    "language_detect",
    "enrich",
    "sentiment_batches",
    "link_harvest",
    "work_plan",
    "hotel_name",
    "review_blocks",
    "ingest",
    "dashboard_overview",
    "stream_ingest",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    # The given tables are one small file each. A low broadcast limit makes their joins
    # shuffle, as they would at scale, which also spreads the texts over all threads.
    spark = local_session(CPUS, app="bench", **{"spark.sql.autoBroadcastJoinThreshold": "256KB"})
    seconds = {}
    for name in HEADLINE:
        run(spark, name)
        seconds[name] = round(run(spark, name), 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Each query
runs to completion into the no-op sink; the first run warms the JVM up and is
not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from parchmill.plans.queries import registered  # noqa: E402
from parchmill.session import build_session  # noqa: E402

HEADLINE = [
    "scan_pages", "normalize_url", "url_key", "clean_html", "tag_tokens", "containers", "drop_boilerplate",
    "main_content", "page_metadata", "convert_corpus", "documents", "truncate_markdown", "store_lookup",
    "store_misses", "batch_duplicates", "assemble_results", "store_upsert", "batch_stats", "batch_stats_by_host",
    "toon_records", "toon_table", "toon_quote", "markdown_document", "corpus_stats_by_host",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            # Call sites are recorded per Column call by default; that is for debugging.
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        first, second = run(name), run(name)
        times[name] = round(min(first, second), 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "documents" in times:
        line["documents_pages_per_sec"] = round(pages / times["documents"], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

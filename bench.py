"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is fully materialised with the ``noop`` sink (all rows computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sieveworks.session import build_session  # noqa: E402
from sieveworks.suite import QUERIES  # noqa: E402

HEADLINE = [
    "prepare_version", "trim_whitespace", "redact_emails", "redact_phone_numbers", "remove_html", "strip_accents",
    "remove_duplicates", "duplicate_count", "profile_columns", "recommend_cleanup_documents", "map_chat",
    "chat_context", "format_prompt_response", "tokenize_regex", "ngram_fit", "ngram_next", "ngram_generate",
    "centroid_classify", "tabular_feature_schema", "tabular_fit", "latest_per_key", "visible_items",
    "recent_distinct", "toggle_state", "split_train_validation", "weighted_merge", "save_version",
    "stream_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))
    # class loading, code generation and Python workers are not any query's own time
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("redact_emails", "strip_accents", "latest_per_key"):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

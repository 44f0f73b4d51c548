"""Print the formatted physical plan of suite queries (plan review tool)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sieveworks.session import build_session  # noqa: E402
from sieveworks.suite import QUERIES  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", shuffle_partitions=8)
    for name in sys.argv[1:]:
        print(f"===== {name}")
        QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()

"""Summarise the physical plan of every registered query (markdown table).

    python tests/plan_report.py [sf_dir] > PLANS_table.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FILE_BACKED = {"scan_vendor_csv", "scan_vendor_feeds", "as_of_hot", "append_series", "export_documents", "stream_ingest_series",
               "stream_latest_price", "as_of", "as_of_bitemporal"}

COUNT = {
    "scans": r"FileScan",
    "exchanges": r"Exchange hashpartitioning",
    "broadcast": r"BroadcastHashJoin",
    "sort-merge": r"SortMergeJoin",
    "windows": r"\bWindow \[",
    "group limits": r"WindowGroupLimit",
    "generate": r"\bGenerate\b",
}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from tickvault.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as E
    print("| query | " + " | ".join(COUNT) + " | pushed filters |")
    print("|---|" + "---|" * (len(COUNT) + 1))
    for name in sorted(E.queries()):
        if name in FILE_BACKED:
            continue
        plan = E.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for p in COUNT.values()]
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
        pushed_txt = "; ".join(p[:60] for p in pushed) or "-"
        print(f"| {name} | " + " | ".join(counts) + f" | {pushed_txt} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)

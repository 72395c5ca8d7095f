"""Summarise the physical plan of every registered query as a Markdown table.

Usage: python scripts/plan_report.py [data_dir] > docs/PLANS.md
Counts come from ``explain("formatted")`` of the initial adaptive plan (AQE
may still turn a sort-merge join into a broadcast join at runtime).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import tempfile  # noqa: E402

from sessionscope.plans.registry import QUERIES  # noqa: E402
from sessionscope.sources.tables import ShopTables  # noqa: E402
from sessionscope.plans.inspect import plan_text  # noqa: E402
from sessionscope.session import build_session  # noqa: E402


def summarise(text: str) -> dict[str, str]:
    tree = text.split("\n\n(")[0]
    main, _, subs = text.partition("===== Subqueries =====")
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)\s+(\w+)", tree)
    hashing = len(re.findall(r"Exchange \(\d+\)", tree)) - len(re.findall(r"BroadcastExchange \(\d+\)", tree))
    return {
        "shuffles": str(hashing),
        "broadcasts": str(len(re.findall(r"BroadcastExchange \(\d+\)", tree))),
        "joins": ", ".join(f"{k.replace('HashJoin', 'HJ').replace('SortMergeJoin', 'SMJ')} {t}" for k, t in joins) or "–",
        "aggregates": ", ".join(
            f"{n}×{k}" for k in ("HashAggregate", "SortAggregate", "ObjectHashAggregate")
            if (n := len(re.findall(rf"\b{k} \(\d+\)", tree)) // 1)
        ),
        "sort": "yes" if re.search(r"\bSort \(\d+\)", tree) and "rangepartitioning" in main else "–",
        "subqueries": str(len(set(re.findall(r"Subquery subquery#(\d+)", main)))),
        "expand/python": "yes" if re.search(r"Expand|EvalPython|InPandas", tree) else "no",
        "pushed": "; ".join(sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]+)\]", main))))[:90] or "–",
    }


def main() -> None:
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    warehouse = tempfile.mkdtemp(prefix="plan-report-warehouse-")
    spark = build_session(
        "local[8]", shuffle_partitions=8, extra_conf={"spark.sql.warehouse.dir": warehouse}
    )
    cols = ["shuffles", "broadcasts", "joins", "aggregates", "sort", "subqueries", "expand/python", "pushed"]
    print(f"# Physical plans of the registered queries\n\nGenerated by `scripts/plan_report.py {data_dir}`.")
    print("Initial adaptive plans; AQE may still turn a sort-merge join into a broadcast join at runtime.\n")
    print("## Over the tables derived from `events`\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- " * (len(cols) + 1) + "|")
    for name, fn in QUERIES.items():
        s = summarise(plan_text(fn(spark, data_dir)))
        print(f"| {name} | " + " | ".join(s[c] for c in cols) + " |")

    # the same queries over the catalog layout: day partitions, 8 buckets by session
    ShopTables.from_events(spark, data_dir).save_as_tables("plan_report", buckets=8, mode="overwrite")
    shop = ShopTables.from_tables(spark, "plan_report")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the large-data join shape
    print("\n## Over day-partitioned tables bucketed by session id (broadcast off)\n")
    print("| query | shuffles | joins | aggregates |")
    print("| --- | --- | --- | --- |")
    for name, spec in QUERIES.items():
        s = summarise(plan_text(spec.on(shop)))
        print(f"| {name} | {s['shuffles']} | {s['joins']} | {s['aggregates']} |")

    # the day-partitioned layout: windows on sessions prune the pageviews by their session's day
    root = tempfile.mkdtemp(prefix="plan-report-shop-")
    ShopTables.from_events(spark, data_dir).write(os.path.join(root, "shop"))
    stored = ShopTables.from_directory(spark, os.path.join(root, "shop"))
    print("\n## Over the day-partitioned layout (broadcast off)\n")
    print("| query | shuffles | joins | partition filters of the pageview scans |")
    print("| --- | --- | --- | --- |")
    for name, spec in QUERIES.items():
        if "s" in spec.tables and "p" in spec.tables:
            text = plan_text(spec.on(stored))
            scans = [x for x in text.split("\n\n") if "Scan parquet" in x and "website_pageviews" in x]
            filters = sorted({m for x in scans for m in re.findall(r"PartitionFilters: \[([^\]]+)\]", x)})
            s = summarise(text)
            print(f"| {name} | {s['shuffles']} | {s['joins']} | {re.sub('#[0-9]+', '', '; '.join(filters)).replace('|', ' ')} |")
    tree = plan_text(QUERIES["funnel_counts"].on(stored)).split("\n\n(")[0]
    print(f"\n`funnel_counts`: the cohort is read once and meets its pageviews in one grouping.\n\n```\n{tree.strip()}\n```")
    spark.stop()


if __name__ == "__main__":
    main()

"""Physical-plan summary of every registered query (markdown table), taken
from the final adaptive plan after execution (reused exchanges and runtime
broadcasts included; shuffles counts shuffle exchanges, not reuses).

    python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def formatted(df) -> str:
    """The formatted explain: every physical node listed once as '(n) Name'."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _tree(plan: str) -> str:
    """The final plan tree (a finished adaptive plan also prints the initial
    plan and a per-node detail list; both are dropped)."""
    tree = plan.split("+- == Initial Plan ==")[0]
    return tree.split("\n\n")[0]


def _nodes(tree: str, name: str) -> int:
    return len(set(re.findall(r"(?<![A-Za-z])" + name + r" \((\d+)\)", tree)))


def summarize(plan: str) -> dict:
    tree = _tree(plan)
    return {
        "shuffles": _nodes(tree, "Exchange"),
        "reused": _nodes(tree, "ReusedExchange"),
        "broadcasts": _nodes(tree, "BroadcastExchange"),
        "python": sum(_nodes(tree, n) for n in ("ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                                                  "BatchEvalPython")),
        "windows": _nodes(tree, "Window") + _nodes(tree, "WindowGroupLimit"),
        "sort_aggs": _nodes(tree, "SortAggregate"),
        "cartesian": _nodes(tree, "CartesianProduct") + _nodes(tree, "BroadcastNestedLoopJoin"),
        "read_schema": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


def main():
    from docsift.session import local_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("plan-report")
    qs, sqls = E.queries(), E.oracle_sql()
    print("| query | oracle | shuffles | reused | broadcasts | python nodes | windows | sort aggs | cartesian | columns read |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in qs.items():
        df = fn(spark, sf)
        df.collect()   # runs this query execution: its plan becomes the final adaptive plan
        plan = formatted(df)
        s = summarize(plan)
        cols = "; ".join(x.replace("struct<", "").replace(">", "") for x in s["read_schema"])
        print(f"| {name} | {'E' if name in sqls else 'R'} | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | {s['python']} | "
              f"{s['windows']} | {s['sort_aggs']} | {s['cartesian']} | {cols[:160]} |")


if __name__ == "__main__":
    main()

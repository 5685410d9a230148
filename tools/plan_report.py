"""Plan counts per query after execution: scans, exchanges, reuse, joins.

usage: python tools/plan_report.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import pathlib
import re
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from hailgrid.plans import catalog  # noqa: E402
from hailgrid.session import local_session  # noqa: E402

NODES = (
    "Scan parquet", "Exchange", "ReusedExchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
    "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Python",
)


def plan_text(df, final: bool = True) -> str:
    """The formatted plan; with ``final`` only the executed parts of adaptive plans."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    text = out.getvalue()
    if not final:
        return text
    kept, skip = [], False
    for line in text.splitlines():
        if "== Initial Plan ==" in line:
            skip = True
        elif line == "" or "Final Plan" in line:
            skip = False
        if not skip:
            kept.append(line)
    return "\n".join(kept)


def trees(text: str) -> str:
    """Only the operator trees of the plan."""
    return "\n".join(line for line in text.splitlines() if re.match(r"^[\s:+|*-]*[+:]-|^[A-Z]\w+.*\(\d+\)$", line))


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.1")
    parser.add_argument("--tree", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("plans", "8")
    for name, fn in catalog.queries().items():
        if args.names and name not in args.names:
            continue
        df = fn(spark, args.sf)
        df.collect()
        tree = trees(plan_text(df))
        counted = {node: len(re.findall(rf"(?<![A-Za-z]){node}(?![A-Za-z])", tree)) for node in NODES}
        print(f"{name:26s}", {k: v for k, v in counted.items() if v}, flush=True)
        if args.tree:
            print(tree)


if __name__ == "__main__":
    main()

"""Print the formatted physical plan of registered queries.

    python tools/explain_plans.py [sf_dir] name [name ...]

Shows scans (ReadSchema / PushedFilters), exchanges, join strategies and
window / aggregate operators of each plan; use it to review a plan after a
change.  Queries that fit a model run that fit first (plans are built after).
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from countframe.plans.catalog import QUERIES, load_all
    from countframe.session import local_session

    load_all()
    spark = local_session(8, 8)
    for name in names or ["qc_by_batch"]:
        print(f"===== {name}")
        QUERIES[name](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()

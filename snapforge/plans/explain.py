"""Print the formatted physical plan of registered queries.

Usage: ``python -m snapforge.plans.explain [sf_dir] name [name ...]``. The plan is printed
after the query has run, so adaptive execution shows its final plan.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> None:
    from snapforge.plans.catalog import queries
    from snapforge.session import build_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session()
    qs = queries()
    for name in names:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"==== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main(sys.argv)

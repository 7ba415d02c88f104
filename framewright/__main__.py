"""python -m framewright list | show NAME SF_DIR | run NAME SF_DIR OUT: names, a look at a query's first rows, or its result as Parquet."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    from . import plans  # noqa: F401
    from .catalog import QUERIES
    from .session import local_session

    p = argparse.ArgumentParser(prog="framewright", description=__doc__)
    p.add_argument("what", choices=("list", "show", "run"))
    p.add_argument("name", nargs="?")
    p.add_argument("sf_dir", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("-n", type=int, default=20, help="rows to show")
    a = p.parse_args(args)
    if a.what == "list":
        for name, f in sorted(QUERIES.items()):
            print(f"{name}: {(f.__doc__ or '').splitlines()[0]}")
        return
    if a.name not in QUERIES or not a.sf_dir or (a.what == "run" and not a.out):
        p.error("a known name, a folder of tables and, to run, a folder for the result are needed")
    df = QUERIES[a.name](local_session(), a.sf_dir)
    if a.what == "show":
        df.show(a.n, truncate=80)
    else:
        df.write.parquet(a.out)


if __name__ == "__main__":
    main()

"""Commands: ``python -m tallyspan list``, ``show QUERY FOLDER``, ``write QUERY FOLDER OUT`` and ``explain QUERY FOLDER``."""

from __future__ import annotations

import argparse
import importlib

from tallyspan.session import get_session

MODULES = ["tallyspan.plans.problems", "tallyspan.plans.relational", "tallyspan.plans.features", "tallyspan.plans.streams"]


def queries(extra: list[str]) -> dict:
    return {n: q for m in [*MODULES, *extra] for n, q in importlib.import_module(m).QUERIES.items()}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallyspan")
    p.add_argument("command", choices=["list", "show", "write", "explain"])
    p.add_argument("query", nargs="?")
    p.add_argument("folder", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--master")
    p.add_argument("--module", action="append", default=[], help="further module with QUERIES")
    a = p.parse_args(argv)
    q = queries(a.module)
    if a.command == "list":
        print("\n".join(sorted(q)))
        return
    df = q[a.query](get_session(master=a.master), a.folder)
    if a.command == "show":
        df.show(50, truncate=False)
    elif a.command == "explain":
        df.explain("formatted")
    else:
        df.write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()

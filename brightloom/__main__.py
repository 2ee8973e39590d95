"""Command line: ``python -m brightloom summary FILE`` and ``convert IN OUT``."""

from __future__ import annotations

import argparse

from .plans.command import evaluate, summary
from .session import get_session
from .sources import files


def _read(spark, path: str):
    if path.endswith((".feather", ".arrow")):
        return files.read_feather(spark, path)
    if path.endswith(".json"):
        return files.read_json(spark, path)
    return spark.read.parquet(path) if path.endswith(".parquet") else files.read_csv(spark, path)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brightloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("summary", help="profile of a dataset")
    one.add_argument("path")
    two = verbs.add_parser("convert", help="CSV, JSON, Parquet or Arrow to another")
    two.add_argument("source")
    two.add_argument("target")
    three = verbs.add_parser("run", help="a command on a dataset")
    three.add_argument("path")
    three.add_argument("command")
    found = parser.parse_args(args)
    spark = get_session(master="local[*]")
    if found.verb == "summary":
        print(summary(_read(spark, found.path)))
    elif found.verb == "run":
        evaluate(_read(spark, found.path), found.command).show(20, truncate=False)
    else:
        df = _read(spark, found.source)
        if found.target.endswith((".feather", ".arrow")):
            files.write_feather(df, found.target)
        elif found.target.endswith(".parquet"):
            df.write.mode("overwrite").parquet(found.target)
        else:
            files.write_csv(df, found.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: prepare, search, summarize, all."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import fields

from pyspark.sql import SparkSession

from peptrail.plans.run import Inputs, Run
from peptrail.settings import Settings

FILES = {
    "prepare": ("relative_abundance", "sample_metadata", "host_genomes_info", "uhgg_metadata"),
    "search": ("uhgg_metadata", "uhgp_faa", "uhgp_membership"),
    "summarize": (),
}
FILES["all"] = tuple(dict.fromkeys(FILES["prepare"] + FILES["search"]))
EXPECTED = ("conservative_grantham_max", "broad_breadth")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="peptrail", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name, files in FILES.items():
        p = commands.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        p.add_argument("--peptides", required=True)
        p.add_argument("--outdir", default="results")
        p.add_argument("--reuse", action="store_true", help="take over finished stages whose inputs are the same")
        for f in files:
            p.add_argument("--" + f.replace("_", "-"), required=True)
        for f in fields(Settings):
            checked = name == "summarize" and f.name in EXPECTED
            p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=None if checked else f.default)
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    settings = Settings(**{f.name: args[f.name] for f in fields(Settings) if args[f.name] is not None})
    inputs = Inputs(**{f.name: args[f.name] for f in fields(Inputs) if f.name in args})
    spark = SparkSession.builder.appName("peptrail").getOrCreate()
    run, began = Run(spark, inputs, args["outdir"], settings, args["reuse"]), time.monotonic()
    if args["command"] == "summarize":
        warnings = run.summarize({k: args[k] for k in EXPECTED})
    else:
        warnings = getattr(run, args["command"])() or []
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(f"{args['command']}: {time.monotonic() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

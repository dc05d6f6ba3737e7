"""Command line: ``python -m cartolith.cli -osmpath in.osm -ttlpath out/graph``."""

from __future__ import annotations

import argparse
import logging
import os
import sys


class Option(argparse.Action):
    """Keeps the values of an option; an option may be given once."""

    def __call__(self, parser, namespace, values, option_string=None):  # noqa: ANN001
        if getattr(namespace, self.dest, None) is not None:
            parser.error(f"{option_string} is given twice")
        setattr(namespace, self.dest, values)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cartolith", add_help=False, allow_abbrev=False, description="Converts a map extract to an enriched Turtle graph.")
    p.add_argument("-osmpath", "--osmpath", action=Option, type=str, help="the map extract (.osm, .osm.gz, .osm.bz2 or .pbf)")
    p.add_argument("-ttlpath", "--ttlpath", action=Option, type=str, help="the folder to write; its parent exists")
    p.add_argument("-profile", "--profile", default="default", choices=["default", "golden"])
    p.add_argument("-onlystats", "--onlystats", action="store_true", help="count, but write nothing")
    p.add_argument("-help", "--help", action="help")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """The checked options; ends the program with a message where one is missing or wrong."""
    p = parser()
    args = p.parse_args(argv)
    if not args.osmpath:
        p.error("the input file is missing: -osmpath")
    if not args.ttlpath:
        p.error("the output path is missing: -ttlpath")
    folder, mark, _ = args.ttlpath.rpartition("/")
    if not mark:
        p.error("the output path has no folder")
    # Paths with a scheme are on a store that Spark reaches; it tells itself what it can't find there.
    if "://" not in args.osmpath and not os.path.exists(args.osmpath):
        p.error("cannot find the input file")
    if "://" not in args.ttlpath and folder and not os.path.isdir(folder):
        p.error("cannot find the output folder")
    return args


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(message)s")
    logging.getLogger("cartolith").setLevel(logging.INFO)
    from cartolith.plans.convert import convert
    from cartolith.session import session

    counts = convert(session(), args.osmpath, args.ttlpath, args.profile, args.onlystats)
    for k, v in counts.items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

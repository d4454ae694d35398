"""``python -m geoloom.cli --root DIR list [FOLDER] [-r] [-l] | count ID [-v]``"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .sources.catalog import Catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="geoloom")
    parser.add_argument("--root", required=True, help="the catalog's folder")
    sub = parser.add_subparsers(dest="command", required=True)
    ls = sub.add_parser("list", help="print the ids of data sets")
    ls.add_argument("folder", nargs="?", default="")
    ls.add_argument("-r", "--recursive", action="store_true")
    ls.add_argument("-l", "--long", action="store_true", help="with type, geometry, rows and clusters")
    count = sub.add_parser("count", help="count a data set's rows by reading it")
    count.add_argument("id")
    count.add_argument("-v", "--verbose", action="store_true", help="with the time it took")
    args = parser.parse_args(argv)
    catalog = Catalog(SparkSession.builder.appName("geoloom").getOrCreate(), args.root)
    if args.command == "list":
        for d in catalog.in_dir(args.folder, args.recursive):
            geom = f"{d.info.geom}({d.info.srid})" if d.info.geom else "-"
            print(f"{d.id} {d.info.type} {geom} rows={d.count} clustered={d.has_spatial_index}" if args.long else d.id)
        return 0
    began = time.time()
    n = catalog.get(args.id).read().count()
    print(f"{n} ({time.time() - began:.2f} s)" if args.verbose else n)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

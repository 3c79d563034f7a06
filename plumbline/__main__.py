"""python -m plumbline convert SRC DST | carve SPEC | stats SRC | translate SRC DST [JSON]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from plumbline.operators import aggregates as agg
from plumbline.plans import kernels
from plumbline.plans.pipeline import ConvertOptions, PointFrame, convert


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--scale", type=float, default=0.001)
    c.add_argument("--no-sidecar", action="store_true")
    b = sub.add_parser("carve")
    b.add_argument("spec")
    b.add_argument("--suffix", default="_carved")
    s = sub.add_parser("stats")
    s.add_argument("source")
    t = sub.add_parser("translate")
    t.add_argument("source")
    t.add_argument("target")
    t.add_argument("filters", nargs="?", default="")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "convert":
        result = convert(spark, args.source, args.target, ConvertOptions(coordinate_scale=args.scale), stats=not args.no_sidecar)
        if not args.no_sidecar:
            frame = PointFrame.read(spark, args.source)
            with open(f"{args.target.rstrip('/')}.json", "w") as f:
                f.write(agg.sidecar_text(frame.stac()))
        print(result.point_count)
        return 0
    if args.command == "carve":
        with open(args.spec) as f:
            spec = json.load(f)
        failed = 0
        for cloud in spec["clouds"]:
            try:
                print(json.dumps(kernels.carve_clouds(spark, {"clouds": [cloud]}, args.suffix)))
            except Exception as e:  # the other clouds are still carved
                print(f"{cloud.get('name')}: {e}", file=sys.stderr)
                failed += 1
        return 1 if failed else 0
    if args.command == "stats":
        print(agg.sidecar_text(PointFrame.read(spark, args.source).stac()))
        return 0
    kernels.translate(spark, args.source, args.target, args.filters)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""``python -m pointmill.cli inspect|doctor|convert|optimize|snapshot``: reports as text or, with --json, as one document."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointmill")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("inspect")
    a.add_argument("target")
    a.add_argument("--deep", action="store_true")
    a = sub.add_parser("doctor")
    a.add_argument("target")
    a.add_argument("--origin", default="https://example.com")
    a.add_argument("--timeout", type=float, default=30.0)
    a = sub.add_parser("serve")
    a.add_argument("root", nargs="?", default=".")
    a.add_argument("-p", "--port", type=int, default=8080)
    a.add_argument("--host", default="127.0.0.1")
    a = sub.add_parser("convert")
    a.add_argument("inputs", nargs="+")
    a.add_argument("-o", "--out", required=True)
    a.add_argument("-f", "--format", default="potree")
    a.add_argument("--span", type=int, default=128)
    a.add_argument("--leaf", type=int, default=50_000)
    a.add_argument("--scale", type=float, nargs=3)
    a.add_argument("--force", action="store_true")
    a.add_argument("--memory", type=int, default=1024, help="MiB of records beyond which the build goes by chunks")
    a = sub.add_parser("optimize")
    a.add_argument("input")
    a.add_argument("-o", "--out", required=True)
    a.add_argument("-e", "--encoding", default="BROTLI", choices=["BROTLI", "DEFAULT"])
    a.add_argument("--drop", default="")
    a = sub.add_parser("snapshot")
    a.add_argument("input")
    a.add_argument("-o", "--out", required=True)
    a.add_argument("--size", type=int, default=640)
    a.add_argument("--points", type=int, default=1_500_000)
    a.add_argument("--azimuth", type=float, default=225.0)
    a.add_argument("--elevation", type=float, default=35.0)
    return p


def run(spark, args: argparse.Namespace) -> tuple[dict, int]:
    from pointmill.plans import commands
    from pointmill.sources import potree

    if args.command == "inspect":
        info, levels = commands.inspect(spark, args.target, args.deep)
        return info.first().asDict(True) | ({"levels": [r.asDict() for r in levels.orderBy("level").collect()]} if levels is not None else {}), 0
    if args.command == "doctor":
        found, code = commands.doctor(spark, args.target, args.origin, args.timeout)
        return {"findings": [{"level": r.level, "code": r.code} for r in found.collect()]}, code
    if args.command == "convert":
        return commands.convert(spark, args.inputs, args.out, args.format, args.span, args.leaf, args.scale, args.force, args.memory << 20), 0
    if args.command == "optimize":
        drop = tuple(n for n in args.drop.split(",") if n)
        return potree.optimize(spark, args.input, args.out, args.encoding, drop).first().asDict(), 0
    n = commands.save_snapshot(spark, args.input, args.out, args.size, points=args.points, azimuth=args.azimuth, elevation=args.elevation)
    return {"pixels": n, "out": args.out}, 0


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    if args.command == "serve":
        from pointmill.sources import serve

        serve.server(args.root, host=args.host, port=args.port).serve_forever()
        return 0
    spark = SparkSession.builder.appName("pointmill").getOrCreate()
    try:
        report, code = run(spark, args)
    except (ValueError, FileNotFoundError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    if not args.quiet:
        print(json.dumps(report, default=str) if args.json else "\n".join(f"{k}: {v}" for k, v in report.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())

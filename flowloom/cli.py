"""Command line: split, archive and extract."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from . import api
from .operators.archive import LISTING_HEAD, Archive, listing_lines
from .operators.strategies import NAMES, Strategy


def _normal(argv: list[str]) -> list[str]:
    """Single-dash long options of older tools, and ``-s seconds N``."""
    out: list[str] = []
    words = list(argv)
    while words:
        w = words.pop(0)
        name, eq, value = w.partition("=")
        if name in ("-ip", "-port", "-recursive"):
            w = "-" + name + eq + value
        if w == "-s" and words and words[0].lower() in ("seconds", "packets"):
            kind = words.pop(0)
            if not words:
                raise SystemExit(f"-s {kind} needs a number")
            out += ["-s", f"{kind}:{words.pop(0)}"]
        else:
            out.append(w)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowloom", description="Split captures into flows, or archive and extract them.")
    p.add_argument("-r", dest="input", help="capture file, directory, or - for standard input")
    p.add_argument("-o", dest="output", default=".", help="output directory or file")
    p.add_argument("-d", dest="clean", action="store_true", help="clean the output directory first")
    p.add_argument("-p", dest="max_sessions", type=int, default=10_000, help="accepted; state spills instead")
    p.add_argument("-b", dest="buffer_bytes", type=int, default=10_000, help="accepted")
    p.add_argument("-s", dest="strategy", default="session", help=f"{', '.join(NAMES)}; seconds N and packets N")
    p.add_argument("--ip", action="append", default=[], help="keep packets from or to the address")
    p.add_argument("--port", action="append", type=int, default=[], help="keep packets from or to the port")
    p.add_argument("-y", dest="output_type", default="pcap", type=str.lower, choices=("pcap", "l7"))
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--mode", default="split", type=str.lower, choices=("split", "archive", "extract"))
    p.add_argument("--archive", help="archive file or directory")
    p.add_argument("--list-flows", action="store_true")
    p.add_argument("--extract", type=int, metavar="FLOW_ID")
    p.add_argument("--filter-ip", action="append", default=[])
    p.add_argument("--filter-port", action="append", type=int, default=[])
    p.add_argument("--filter-proto")
    p.add_argument("--no-secondary-index", action="store_true")
    p.add_argument("--parquet", action="store_true", help="archive as a directory of Parquet tables")
    p.add_argument("--threads", type=int, help="accepted; Spark schedules")
    p.add_argument("--no-mmap", action="store_true", help="accepted")
    p.add_argument("--no-pipeline", action="store_true", help="accepted")
    p.add_argument("--pipe", action="store_true", help="all flows to standard output, length-prefixed")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(_normal(sys.argv[1:] if argv is None else argv))
    spark = spark or SparkSession.builder.appName("flowloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    strategy = Strategy.parse(args.strategy)
    if args.mode == "extract" or args.list_flows or args.pipe or args.extract is not None:
        return _extract(args, spark)
    if not args.input:
        raise SystemExit("-r is needed")
    with tempfile.TemporaryDirectory() as tmp:
        path = api.spool_stdin(tmp) if args.input == "-" else args.input
        how = {"strategy": strategy, "ip_filters": args.ip, "port_filters": args.port, "recursive": args.recursive}
        if args.mode == "archive":
            if not args.archive:
                raise SystemExit("--archive is needed")
            api.create_archive(spark, path, args.archive, single_file=not args.parquet, secondary_index=not args.no_secondary_index, **how)
        else:
            api.split(spark, path, args.output, output_type=args.output_type, clean=args.clean, **how)
        if args.verbose:
            _report(args, spark, path)
    return 0


def _report(args, spark: SparkSession, path: str) -> None:
    """Counters of a run on standard error."""
    from .operators.filters import PacketFilter

    pkts = api.packets(spark, path, recursive=args.recursive)
    c = PacketFilter(args.ip, args.port).counters(pkts).first()
    print(f"strategy {args.strategy}: {c.processed} packets, {c.passed} passed, {c.filtered} filtered out", file=sys.stderr)


def _extract(args, spark: SparkSession) -> int:
    if not args.archive:
        raise SystemExit("--archive is needed")
    a = Archive.open(spark, args.archive)
    if args.pipe:
        api.pipe_to(spark, args.archive, sys.stdout.buffer)
    elif args.list_flows:
        print(LISTING_HEAD)
        print("-" * 90)
        for r in listing_lines(a.table).orderBy("flow_id").toLocalIterator():
            print(r.line)
    elif args.extract is not None:
        a.extract(args.extract, args.output)
    else:
        try:
            a.extract_matching(args.output, ips=args.filter_ip, ports=args.filter_port, proto=args.filter_proto)
        except (ValueError, LookupError) as e:
            raise SystemExit(str(e)) from e
    return 0


if __name__ == "__main__":
    sys.exit(main())

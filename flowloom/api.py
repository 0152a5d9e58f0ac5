"""The engine's front door: read, split, archive and pipe captures."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.decode import decode, l7_data
from .functions.net import ts_micros
from .operators.archive import Archive
from .operators.filters import PacketFilter
from .operators.flows import flow_groups, flow_packets, flow_stats
from .operators.strategies import Strategy
from .sources.capture import read_captures
from .sources.sinks import write_pipe, write_split


def packets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decoded packets of a capture file or directory."""
    return decoded(read_captures(spark, path, **options))


def decoded(raw: DataFrame, **options) -> DataFrame:
    d = decode(raw, **options).withColumn("ts_us", ts_micros(F.col("ts_sec"), F.col("ts_usec")))
    return d.withColumn("l7", l7_data(F.col("data"), F.col("l7_offset")))


def _strategy(s: str | Strategy) -> Strategy:
    return s if isinstance(s, Strategy) else Strategy.parse(s)


def archive_of(pkts: DataFrame, strategy: str | Strategy = "session", where: PacketFilter | None = None) -> Archive:
    keyed = flow_groups(pkts, _strategy(strategy), where)
    flows = flow_stats(keyed)
    first = pkts.select("out_link_type").first()
    return Archive(flows, flow_packets(keyed, flows), first[0] if first else 1)


def read_flows(
    spark: SparkSession,
    path: str,
    strategy: str | Strategy = "session",
    max_sessions: int = 10_000,
    ip_filters: Sequence[str] = (),
    port_filters: Sequence[int] = (),
    **options,
) -> Archive:
    """Flows of a capture, without writing anything.  ``max_sessions`` is accepted and not needed: state spills."""
    return archive_of(packets(spark, path, **options), strategy, PacketFilter(ip_filters, port_filters))


def create_archive(spark: SparkSession, input_path: str, output_path: str, *, single_file: bool = True, secondary_index: bool = True, **how) -> None:
    """Write an archive: one file for exchange, or a directory of Parquet tables."""
    a = read_flows(spark, input_path, **how)
    if single_file:
        a.save_file(output_path, secondary_index)
    else:
        a.save(output_path)


def split(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    strategy: str | Strategy = "session",
    max_sessions: int = 10_000,
    buffer_bytes: int = 10_000,
    ip_filters: Sequence[str] = (),
    port_filters: Sequence[int] = (),
    output_type: str = "pcap",
    clean: bool = False,
    **options,
) -> None:
    """One file a group.  ``max_sessions`` and ``buffer_bytes`` are accepted and not needed."""
    if output_type.lower() not in ("pcap", "l7"):
        raise ValueError(f"unknown output type {output_type!r}")
    pkts = packets(spark, input_path, **options)
    keyed = flow_groups(pkts, _strategy(strategy), PacketFilter(ip_filters, port_filters))
    write_split(keyed, output_dir, output_type=output_type, clean=clean)


def pipe_archive(spark: SparkSession, path: str) -> Iterator[bytes]:
    """A standalone PCAP of each flow, in id order."""
    return Archive.open(spark, path).pipe()


def pipe_to(spark: SparkSession, path: str, out) -> int:
    return write_pipe(Archive.open(spark, path).members, out)


def spool_stdin(folder: str) -> str:
    """Standard input as a file named ``stdin``, so tasks can read it."""
    import shutil
    import sys

    path = os.path.join(folder, "stdin")
    with open(path, "wb") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    return path

"""Flow archives: a packets table and a flows table, and exchange with the single-file form.

As a directory an archive holds two Parquet tables, packets ranged and sorted
by flow, so a lookup reads few row groups.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_text, ip_text_full, protocol_name
from ..sources.archive_file import ArchiveFile, ArchiveWriter, Entry, FlowArchiveSource
from ..sources.sinks import pcap_blobs, pcap_frame, pcap_header
from . import filters

FLOW_COLUMNS = ("flow_id", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "packet_count", "total_bytes", "start_ts_us", "end_ts_us")


class Archive:
    """Flows and their packets, lazily; every method that finds flows returns a DataFrame."""

    def __init__(self, flows: DataFrame, members: DataFrame, link_type: int):
        self.table, self.members, self.link_type = flows, members, link_type

    # reading and writing

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive:
        """A directory of two tables, or a single-file archive."""
        if os.path.isfile(path):
            spark.dataSource.register(FlowArchiveSource)
            reader = lambda t: spark.read.format("flow_archive").option("table", t).load(path)
            packets = reader("packets").withColumnRenamed("n", "pkt_idx").withColumn("key_pos", F.lit(0))
            link = ArchiveFile(path).link_type
            return cls(reader("flows"), packets.withColumn("out_link_type", F.lit(link)), link)
        flows, members = spark.read.parquet(f"{path}/flows"), spark.read.parquet(f"{path}/packets")
        first = members.select("out_link_type").first()
        return cls(flows, members, first[0] if first else 1)

    def save(self, path: str, partitions: int | None = None) -> None:
        """Two Parquet tables; address and port lookups are pruned by statistics and bloom filters."""
        cols = ["flow_id", "pkt_idx", "key_pos", "ts_sec", "ts_usec", "cap_len", "orig_len", "out_link_type", "data"]
        members = self.members.select(*(c for c in cols if c in self.members.columns))
        ranged = members.repartitionByRange(partitions, "flow_id") if partitions else members.repartitionByRange("flow_id")
        ranged.sortWithinPartitions("flow_id", "pkt_idx", "key_pos").write.parquet(f"{path}/packets")
        out = self.table.repartitionByRange("flow_id").sortWithinPartitions("flow_id").write
        for c in ("src_ip", "dst_ip", "src_port", "dst_port"):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{path}/flows")

    def save_file(self, path: str, secondary_index: bool = True) -> None:
        """The single-file form: packets stream through the driver in capture order, a packet once for each key."""
        w = ArchiveWriter(path, self.link_type, secondary_index)
        rows = self.members.select("flow_id", "pkt_idx", "key_pos", "ts_sec", "ts_usec", "orig_len", "data")
        for r in rows.orderBy("pkt_idx", "key_pos").toLocalIterator():
            w.add(r.flow_id, r.ts_sec, r.ts_usec, r.orig_len, bytes(r.data))
        entries = (
            Entry(r.flow_id, r.protocol, bytes(r.src_ip), bytes(r.dst_ip), r.src_port, r.dst_port, r.packet_count, r.start_ts_us, r.end_ts_us, r.total_bytes)
            for r in self.table.select(*FLOW_COLUMNS).toLocalIterator()
        )
        w.finish(entries)

    # lookups

    def flows(self) -> DataFrame:
        return self.table.orderBy("flow_id")

    def __repr__(self) -> str:
        return f"Archive(flows={self.flow_count()}, link_type={self.link_type})"

    def flow_count(self) -> int:
        return self.table.count()

    def __len__(self) -> int:
        return self.flow_count()

    def get_flow(self, flow_id: int) -> DataFrame:
        return filters.by_id(self.table, flow_id)

    def find_by_ip(self, ip: str) -> DataFrame:
        return filters.by_ip(self.table, ip)

    def find_by_port(self, port: int) -> DataFrame:
        return filters.by_port(self.table, port)

    def find_by_protocol(self, proto: str | int) -> DataFrame:
        return filters.by_protocol(self.table, proto)

    def find(self, ips: Sequence[str] = (), ports: Sequence[int] = (), proto: str | int | None = None) -> DataFrame:
        return filters.by_all(self.table, ips, ports, proto)

    def packets(self, flows: DataFrame | int) -> DataFrame:
        """Packets of one flow or of a table of flows, in arrival order within a flow."""
        if isinstance(flows, int):
            return self.members.where(F.col("flow_id") == flows).orderBy("pkt_idx", "key_pos")
        return self.members.join(flows.select("flow_id"), "flow_id", "left_semi").orderBy("flow_id", "pkt_idx", "key_pos")

    # output

    def pcaps(self, flows: DataFrame | None = None) -> DataFrame:
        """(flow_id, pcap): a standalone PCAP of each flow."""
        m = self.members if flows is None else self.members.join(flows.select("flow_id"), "flow_id", "left_semi")
        return pcap_blobs(m)

    def pipe(self) -> Iterator[bytes]:
        for r in self.pcaps().orderBy("flow_id").toLocalIterator():
            yield bytes(r.pcap)

    def extract(self, flow_id: int, path: str) -> str:
        """Write one flow as PCAP; in a directory it is named ``flow_{id}.pcap``."""
        if not self.get_flow(flow_id).limit(1).count():
            raise KeyError(f"no flow {flow_id}")
        if os.path.isdir(path):
            path = os.path.join(path, f"flow_{flow_id}.pcap")
        with open(path + ".tmp", "wb") as f:
            f.write(pcap_header(self.link_type))
            for r in self.packets(flow_id).toLocalIterator():
                f.write(pcap_frame(r.ts_sec, r.ts_usec, r.orig_len, bytes(r.data)))
        os.replace(path + ".tmp", path)
        return path

    def extract_matching(self, path: str, **how) -> int:
        """One ``flow_{id}.pcap`` for each flow that meets all filters; raises ``LookupError`` if none does."""
        from ..sources.sinks import SplitSink

        found = self.find(**how)
        n = found.count()
        if not n:
            raise LookupError("no flow matches the filters")
        self.table.sparkSession.dataSource.register(SplitSink)
        os.makedirs(path, exist_ok=True)
        rows = self.members.join(found.select("flow_id"), "flow_id", "left_semi")
        rows = rows.withColumn("name", F.format_string("flow_%d.pcap", "flow_id"))
        rows = rows.repartition("name").sortWithinPartitions("name", "pkt_idx", "key_pos")
        rows = rows.select("name", "ts_sec", "ts_usec", "orig_len", "out_link_type", "data")
        rows.write.format("capture_split").mode("append").option("path", path).save()
        return n


def flow_repr(r) -> str:
    """A row of ``flow_properties`` as one line."""
    return f"Flow(id={r.id}, {r.proto_name} {r.src_addr}:{r.src_port} -> {r.dst_addr}:{r.dst_port}, {r.packet_count} pkts, {r.total_bytes} bytes)"


def packet_repr(r) -> str:
    """A packet row as one line."""
    return f"Packet(ts={r.ts_sec}.{r.ts_usec:06d}, length={len(r.data)}, orig_len={r.orig_len})"


def listing(flows: DataFrame) -> DataFrame:
    """The columns of a flow listing; times are whole seconds."""
    return flows.select(
        "flow_id", protocol_name("protocol").alias("proto"), ip_text("src_ip").alias("src_ip"), ip_text("dst_ip").alias("dst_ip"),
        "packet_count", "total_bytes", F.expr("start_ts_us div 1000000 AS start_s"),
    )


def listing_lines(flows: DataFrame) -> DataFrame:
    """(flow_id, line): the listing as fixed-width text."""
    cols = (("flow_id", 6), ("proto", 6), ("src_ip", 22), ("dst_ip", 22), ("packet_count", 8), ("total_bytes", 10), ("start_s", 12))
    parts = ", ".join(f"rpad({c}, greatest(length({c}), {n}), ' ')" for c, n in cols)
    return listing(flows).selectExpr("flow_id", f"concat_ws(' ', {parts}) AS line")


LISTING_HEAD = f"{'ID':<6} {'Proto':<6} {'Src IP':<22} {'Dst IP':<22} {'Packets':<8} {'Bytes':<10} {'Start Time':<12}"


def flow_properties(flows: DataFrame, full_v6: bool = False) -> DataFrame:
    """Flows as an API shows them: names, address texts and times in seconds."""
    text = ip_text_full if full_v6 else ip_text
    return flows.select(
        F.col("flow_id").alias("id"), F.col("protocol").alias("proto"), protocol_name("protocol", True).alias("proto_name"),
        text("src_ip").alias("src_addr"), text("dst_ip").alias("dst_addr"), "src_port", "dst_port",
        "packet_count", "total_bytes", F.expr("start_ts_us / 1e6D AS start_ts"), F.expr("end_ts_us / 1e6D AS end_ts"),
    )

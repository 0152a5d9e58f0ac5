"""Sinks: PCAP bytes, one file a group, and length-prefixed pipes."""

from __future__ import annotations

import os
import shutil
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.net import safe_name

SNAP_LENGTH = 65535


def pcap_header(link_type: int) -> bytes:
    """The 24-byte little-endian global header, version 2.4."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, SNAP_LENGTH, link_type)


def pcap_frame(ts_sec: int, ts_usec: int, orig_len: int, data: bytes) -> bytes:
    return struct.pack("<IIII", ts_sec, ts_usec, len(data), orig_len) + data


def le_bytes(number, width: int):
    """Little-endian bytes of a column, for frames built in the plan."""
    h = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 17 - 2 * (i + 1), 2) for i in range(width))))


def pcap_blobs(members: DataFrame) -> DataFrame:
    """(flow_id, pcap): a standalone PCAP of each flow, built in the plan; for flows under 2 GB.

    ``members`` are packets with flow_id, out_link_type, the times, orig_len and data.
    """
    frame = F.concat(*(le_bytes(c, 4) for c in (F.col("ts_sec"), F.col("ts_usec"), F.length("data"), F.col("orig_len"))), F.col("data"))
    g = members.groupBy("flow_id").agg(
        F.array_sort(F.collect_list(F.struct("pkt_idx", "key_pos", F.hex(frame).alias("h")))).alias("p"),
        F.first("out_link_type").alias("link"),
    )
    head = F.concat(F.lit(bytearray(pcap_header(0)[:20])), le_bytes(F.col("link"), 4))
    return g.select("flow_id", F.concat(head, F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), ""))).alias("pcap"))


def output_names(groups: DataFrame, extension: str = "pcap") -> DataFrame:
    """(file, key, name) of each group's output file.

    ``{stem}_{key}`` with unsafe characters replaced; names that would collide
    get a short hash of their file and key.
    """
    d = groups.select("file", "file_stem", "key").distinct()
    d = d.withColumn("base", F.concat_ws("_", "file_stem", safe_name(F.col("key"))))
    clash = d.groupBy("base").count().where("count > 1").select(F.col("base").alias("_c"))
    d = d.join(clash, F.col("base") == F.col("_c"), "left")
    tail = F.concat(F.lit("_"), F.substring(F.sha2(F.concat_ws("\n", "file", "key"), 256), 1, 8))
    name = F.concat("base", F.when(F.col("_c").isNotNull(), tail).otherwise(F.lit("")), F.lit(f".{extension}"))
    return d.select("file", "key", name.alias("name"))


@dataclass
class Written(WriterCommitMessage):
    temp: str
    names: list[str]


class SplitSink(DataSource):
    """``df.write.format("capture_split")``: rows (name, ts_sec, ts_usec, orig_len, out_link_type, data), sorted by name and arrival.

    Options: ``path``, ``type`` (``pcap`` or ``l7``).  Tasks write to hidden
    folders; the commit renames, so a failed job leaves no output.
    """

    @classmethod
    def name(cls) -> str:
        return "capture_split"

    def schema(self):
        return "name string, ts_sec bigint, ts_usec bigint, orig_len bigint, out_link_type int, data binary"

    def writer(self, schema, overwrite):
        return SplitWriter(self.options, overwrite)


class SplitWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.clean = options["path"], options.get("type", "pcap"), overwrite
        if self.kind not in ("pcap", "l7"):
            raise ValueError(f"unknown output type {self.kind!r}")

    def write(self, rows: Iterator) -> Written:
        import uuid

        temp = os.path.join(self.path, f".tmp-{uuid.uuid4().hex}")
        os.makedirs(temp, exist_ok=True)
        out, name, names = None, None, []
        for r in rows:
            if self.kind == "l7" and not r.data:
                continue
            if r.name != name:
                if out:
                    out.close()
                name = r.name
                names.append(name)
                out = open(os.path.join(temp, name), "wb")  # noqa: SIM115
                if self.kind == "pcap":
                    out.write(pcap_header(r.out_link_type))
            out.write(pcap_frame(r.ts_sec, r.ts_usec, r.orig_len, bytes(r.data)) if self.kind == "pcap" else r.data)
        if out:
            out.close()
        return Written(temp, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        mine = {os.path.basename(m.temp) for m in done}
        if self.clean:
            for x in os.listdir(self.path):
                if x not in mine:
                    full = os.path.join(self.path, x)
                    shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
        for m in done:
            for n in m.names:
                os.replace(os.path.join(m.temp, n), os.path.join(self.path, n))
            shutil.rmtree(m.temp, ignore_errors=True)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                shutil.rmtree(m.temp, ignore_errors=True)


def write_split(keyed: DataFrame, path: str, *, output_type: str = "pcap", clean: bool = False) -> None:
    """One file a group under ``path``; each group is one sorted run of one task, streamed to its file."""
    spark = keyed.sparkSession
    spark.dataSource.register(SplitSink)
    kind = output_type.lower()
    rows = keyed.join(output_names(keyed, kind).withColumnsRenamed({"file": "_f", "key": "_k"}), F.expr("file <=> _f AND key = _k"))
    rows = rows.withColumn("data", F.col("l7") if kind == "l7" else F.col("data"))
    rows = rows.repartition("name").sortWithinPartitions("name", "pkt_idx", "key_pos")
    rows = rows.select("name", "ts_sec", "ts_usec", "orig_len", "out_link_type", "data")
    os.makedirs(path, exist_ok=True)
    rows.write.format("capture_split").mode("overwrite" if clean else "append").option("path", path).option("type", kind).save()


def write_pipe(members: DataFrame, out: BinaryIO) -> int:
    """Length-prefixed PCAPs of the flows in id order; returns their number.

    Lengths are summed first, so packets stream one at a time and a flow may
    have any size.  ``members`` are as for ``pcap_blobs``.
    """
    sizes = members.groupBy("flow_id").agg(F.expr("sum(16 + octet_length(data)) + 24 AS size"), F.first("out_link_type").alias("link"))
    rows = members.join(sizes, "flow_id").orderBy("flow_id", "pkt_idx", "key_pos")
    n, now = 0, None
    for r in rows.select("flow_id", "size", "link", "ts_sec", "ts_usec", "orig_len", "data").toLocalIterator(prefetchPartitions=True):
        if r.flow_id != now:
            now, n = r.flow_id, n + 1
            out.write(struct.pack("<Q", r.size) + pcap_header(r.link))
        out.write(pcap_frame(r.ts_sec, r.ts_usec, r.orig_len, bytes(r.data)))
    return n


def read_pipe(stream: BinaryIO) -> Iterator[bytes]:
    """PCAP blobs of a length-prefixed stream, up to its end or a cut-off blob."""
    while len(head := stream.read(8)) == 8:
        blob = stream.read(n := struct.unpack("<Q", head)[0])
        if len(blob) < n:
            return
        yield blob


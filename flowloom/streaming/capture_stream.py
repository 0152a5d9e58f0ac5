"""Streaming: captures that land in a directory, and running flow statistics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader

from ..operators.strategies import Strategy, with_keys
from ..sources.capture import CaptureReader, Range, collect_files


class CaptureStreamReader(DataSourceStreamReader):
    """``spark.readStream.format("capture").load(directory)``: each finished file is read once.

    The offset is the modification time and name of the last file taken; writers
    should rename complete files into the directory.
    """

    def __init__(self, options):
        self.batch = CaptureReader(options)

    def _files(self) -> list[tuple[int, str]]:
        found = collect_files(self.batch.path, self.batch.recursive)
        return sorted((os.stat(f).st_mtime_ns, f) for f in found)

    def initialOffset(self) -> dict:
        return {"time": 0, "file": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        lo, hi = (start["time"], start["file"]), (end["time"], end["file"])
        return [Range(f, 0, None, 0) for t, f in self._files() if lo < (t, f) <= hi]

    def read(self, part: Range):
        yield from self.batch.read(part)

    def commit(self, end: dict) -> None:
        pass


def running_flows(packets: DataFrame, strategy: Strategy, *, watermark: str | None = None, window: str | None = None) -> DataFrame:
    """Flow statistics of a stream, updated as packets arrive.

    Arrival order within a file is the packet index, so first and last times
    agree with the batch operator.  With ``watermark`` and ``window`` the
    statistics are per event-time window and closed windows leave the state.
    Strategies that number packets need a whole file and are not offered.
    """
    if strategy.name == "packets":
        raise ValueError("packet buckets need a whole file")
    d = with_keys(packets, strategy)
    groups = ["file", "key"]
    if watermark and window:
        d = d.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", watermark)
        groups.append(F.window("ts", window))
    order = F.struct("pkt_idx", "key_pos")
    return d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("orig_len").alias("total_bytes"),
        F.min_by("ts_us", order).alias("start_ts_us"), F.max_by("ts_us", order).alias("end_ts_us"),
    )

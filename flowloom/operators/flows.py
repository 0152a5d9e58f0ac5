"""Flow statistics, flow ids, payloads and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import PacketFilter
from .strategies import Strategy, ranked_in_runs, with_keys

def flow_groups(packets: DataFrame, strategy: Strategy, where: PacketFilter | None = None) -> DataFrame:
    """Filtered packets with their keys, one row a packet and key."""
    return with_keys(where.apply(packets) if where else packets, strategy)


def flow_stats(keyed: DataFrame) -> DataFrame:
    """Row per (file, key): counts, bytes, first and last times by arrival, and the first packet's five-tuple.

    ``flow_id`` numbers a file's flows from 1 by first appearance.  Groups
    without IP have protocol and ports 0 and zero addresses.
    """
    order = "struct(pkt_idx, key_pos)"
    g = keyed.groupBy("file", "key").agg(*map(F.expr, (
        "count(1) AS packet_count", "CAST(sum(orig_len) AS BIGINT) AS total_bytes", f"min({order}) AS first",
        f"min_by(ts_us, {order}) AS start_ts_us", f"max_by(ts_us, {order}) AS end_ts_us", f"min_by(five_tuple, {order}) AS ft",
    )))
    zero = f"X'{'00' * 16}'"
    return with_flow_ids(g).selectExpr(
        "file", "flow_id", "key", "coalesce(ft.protocol, 0) AS protocol",
        f"coalesce(ft.src_ip, {zero}) AS src_ip", f"coalesce(ft.dst_ip, {zero}) AS dst_ip",
        "coalesce(ft.src_port, 0) AS src_port", "coalesce(ft.dst_port, 0) AS dst_port",
        "packet_count", "total_bytes", "start_ts_us", "end_ts_us",
    )


def with_flow_ids(groups: DataFrame) -> DataFrame:
    """Dense ids from 1 in the order of ``first``, by file; ranked in runs of the packet index, in parallel."""
    return ranked_in_runs(groups, "first.pkt_idx", "first").selectExpr("*", "_rank + 1 AS flow_id").drop("_rank")


def flow_packets(keyed: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets with the ``flow_id`` of each of their keys."""
    ids = flows.select(F.col("file").alias("_f"), F.col("key").alias("_k"), "flow_id")
    return keyed.join(ids, F.col("file").eqNullSafe(F.col("_f")) & (F.col("key") == F.col("_k"))).drop("_f", "_k")


def payloads(keyed: DataFrame, bytes_col: str = "l7") -> DataFrame:
    """(file, key, payload): a group's bytes in arrival order; groups without bytes are left out.

    The result is one value a group, so it holds groups under 2 GB; larger ones
    go through the split sink, which streams.
    """
    part = F.struct("pkt_idx", "key_pos", F.hex(bytes_col).alias("h"))
    g = keyed.where(F.length(bytes_col) > 0).groupBy("file", "key").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return g.select("file", "key", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("payload"))


def payload_sizes(keyed: DataFrame, bytes_col: str = "l7") -> DataFrame:
    """(file, key, payload_bytes): the length of a group's payload, for groups of any size; without bytes they are left out."""
    d = keyed.where(F.length(bytes_col) > 0)
    return d.groupBy("file", "key").agg(F.expr(f"CAST(sum(octet_length({bytes_col})) AS BIGINT) AS payload_bytes"))


def index(flows: DataFrame, *columns: str) -> DataFrame:
    """Inverted index: (value, flow_ids) over one or two columns, ids sorted and distinct."""
    e = flows.select(F.explode(F.array_distinct(F.array(*columns))).alias("value"), "flow_id").distinct()
    return e.groupBy("value").agg(F.array_sort(F.collect_list("flow_id")).alias("flow_ids"))


def lru_flows(keyed: DataFrame, max_sessions: int) -> DataFrame:
    """Compatibility mode: flows as a bounded least-recently-used table would leave them.

    Whenever the table is full, the flow that was touched longest ago is
    dropped before the next packet is looked up, even if that packet belongs to
    a flow in the table.  Sequential by nature: one task per file, with state
    for ``max_sessions`` flows.  Returns (file, key, packet_count, total_bytes)
    of the flows left at the end.
    """
    if max_sessions <= 0:
        raise ValueError("max_sessions must be above 0")
    rows = keyed.select("file", "pkt_idx", "key_pos", "key", "orig_len")
    rows = rows.repartition("file").sortWithinPartitions("file", "pkt_idx", "key_pos")

    def run(batches):
        import pandas as pd

        now, table = None, {}
        dump = lambda: pd.DataFrame([(now, k, *v) for k, v in table.items()], columns=["file", "key", "packet_count", "total_bytes"])
        for b in batches:
            for file, key, size in zip(b["file"], b["key"], b["orig_len"], strict=True):
                if file != now:
                    if table:
                        yield dump()
                    now, table = file, {}
                if len(table) >= max_sessions:
                    table.pop(next(iter(table)))
                n, total = table.pop(key, (0, 0))
                table[key] = n + 1, total + size  # dicts keep order: the last is the most recent
        if table:
            yield dump()

    return rows.mapInPandas(run, "file string, key string, packet_count bigint, total_bytes bigint")

"""Grouping strategies: one or two keys for each packet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_sql, mac_sql, session_order

NAMES = ("session", "flow", "host", "hostpair", "mac", "bssid", "nosplit", "seconds", "packets")


@dataclass(frozen=True)
class Strategy:
    name: str
    n: int | None = None  # of seconds and packets
    dedupe_hosts: bool = False

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"unknown strategy {self.name!r}; known: {', '.join(NAMES)}")
        if self.name in ("seconds", "packets") and (self.n is None or self.n <= 0):
            raise ValueError(f"strategy {self.name} needs a number above 0")

    @classmethod
    def parse(cls, text: str, n: int | None = None) -> Strategy:
        """``session``, ``seconds 3600``, ``packets:100`` and so on."""
        name, *rest = text.lower().replace(":", " ").split()
        return cls(name, int(rest[0]) if rest else n)


def _key_sql(strategy: Strategy) -> str:
    """The array of a packet's keys."""
    t = {k: f"five_tuple.{k}" for k in ("protocol", "src_ip", "dst_ip", "src_port", "dst_port")}
    src, dst, sp, dp = t["src_ip"], t["dst_ip"], t["src_port"], t["dst_port"]
    a, b = ip_sql(src), ip_sql(dst)
    name = strategy.name
    if name in ("session", "flow"):
        key = f"concat_ws('_', {t['protocol']}, _s, _d, {sp}, {dp})"
        if name == "session":
            key = f"CASE WHEN {session_order(src, sp, dst, dp)} THEN {key} ELSE concat_ws('_', {t['protocol']}, _d, _s, {dp}, {sp}) END"
    elif name == "hostpair":
        key = f"CASE WHEN {src} <= {dst} THEN concat_ws('_', _s, _d) ELSE concat_ws('_', _d, _s) END"
    elif name == "host":
        both = f"array({a}, {b})"
        return f"CASE WHEN five_tuple IS NULL THEN array('no_host') ELSE {f'array_distinct({both})' if strategy.dedupe_hosts else both} END"
    elif name == "mac":
        macs = f"array_distinct(array_compact(array({mac_sql('src_mac')}, {mac_sql('dst_mac')})))"
        return f"CASE WHEN src_mac IS NULL AND dst_mac IS NULL THEN array('no_mac') ELSE {macs} END"
    elif name == "bssid":
        return f"array(coalesce({mac_sql('bssid')}, 'no_bssid'))"
    elif name == "nosplit":
        return "array('all')"
    elif name == "seconds":
        return f"array(concat('ts_', ts_sec div {strategy.n}))"
    else:
        return f"array(concat('pkt_', _no div {strategy.n}))"
    return f"array(CASE WHEN five_tuple IS NULL THEN 'no_{name}' ELSE {key} END)"


def with_keys(packets: DataFrame, strategy: Strategy) -> DataFrame:
    """One row a packet and key: ``key`` and ``key_pos`` (0, or 1 for a second key).

    ``packets`` counts the rows it is given, so filters that came before count.
    """
    if strategy.name in ("session", "flow", "hostpair"):  # an address's text is made once
        packets = packets.selectExpr("*", f"{ip_sql('five_tuple.src_ip')} AS _s", f"{ip_sql('five_tuple.dst_ip')} AS _d")
    elif strategy.name == "packets":
        packets = _numbered(packets)
    return packets.selectExpr("*", f"posexplode({_key_sql(strategy)}) AS (key_pos, key)").drop("_no", "_s", "_d")


#: packets of one file are numbered in runs of this many indexes, in parallel
RUN = 1 << 16


def ranked_in_runs(rows: DataFrame, pkt_idx: str, order: str) -> DataFrame:
    """``rows`` with ``_rank``: the rank of each row in its file by ``order``, from 0.

    Ranks inside runs of the packet index, plus the sizes of the runs before:
    no file, however large, is sorted in one task.  The sizes hash every column,
    so that they have the same input plan as the ranks and it runs once.
    """
    d = rows.selectExpr("*", f"{pkt_idx} div {RUN} AS _run")
    every = ", ".join(f"`{c}`" for c in rows.columns)
    sizes = d.groupBy("file", "_run").agg(F.count(F.lit(1)).alias("_n"), F.expr(f"max(xxhash64({every}))").alias("_h")).where("_h IS NOT NULL")
    sizes = sizes.selectExpr(
        "file AS _f", "_run AS _r", "coalesce(sum(_n) OVER (PARTITION BY file ORDER BY _run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _b"
    )
    d = d.selectExpr("*", f"row_number() OVER (PARTITION BY file, _run ORDER BY {order}) - 1 AS _k")
    return d.join(sizes, F.expr("file <=> _f AND _run = _r")).selectExpr(*(f"`{c}`" for c in rows.columns), "CAST(_k + _b AS BIGINT) AS _rank")


def _numbered(packets: DataFrame) -> DataFrame:
    return ranked_in_runs(packets, "pkt_idx", "pkt_idx").withColumnRenamed("_rank", "_no")

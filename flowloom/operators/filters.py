"""Packet whitelists and flow lookups as predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_literal, lit_binary, protocol_number


class PacketFilter:
    """Address and port whitelists: OR inside a list, over both endpoints; AND between the lists.

    Packets without a five-tuple pass only an empty filter.
    """

    def __init__(self, ips: Sequence[str] = (), ports: Sequence[int] = ()):
        self.ips: list[bytes] = []
        self.ports: list[int] = []
        for ip in ips:
            self.add_ip(ip)
        for port in ports:
            self.add_port(port)

    def add_ip(self, ip: str) -> None:
        self.ips.append(ip_literal(ip))

    def add_port(self, port: int) -> None:
        if not 0 <= int(port) <= 65535:
            raise ValueError(f"no port: {port}")
        self.ports.append(int(port))

    def is_empty(self) -> bool:
        return not self.ips and not self.ports

    def predicate(self, src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column) -> Column:
        out = F.lit(True)
        if self.ips:
            known = [lit_binary(b) for b in self.ips]
            out = out & (src_ip.isin(*known) | dst_ip.isin(*known))
        if self.ports:
            out = out & (src_port.isin(*self.ports) | dst_port.isin(*self.ports))
        return F.coalesce(out, F.lit(False))

    def apply(self, packets: DataFrame) -> DataFrame:
        if self.is_empty():
            return packets
        t = F.col("five_tuple")
        return packets.where(self.predicate(t["src_ip"], t["dst_ip"], t["src_port"], t["dst_port"]))

    def counters(self, packets: DataFrame) -> DataFrame:
        """One row: packets seen, passed and rejected."""
        t = F.col("five_tuple")
        ok = self.predicate(t["src_ip"], t["dst_ip"], t["src_port"], t["dst_port"]) if not self.is_empty() else F.lit(True)
        return packets.agg(
            F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("filtered")
        )


def by_id(flows: DataFrame, flow_id: int) -> DataFrame:
    return flows.where(F.col("flow_id") == flow_id)


def by_ip(flows: DataFrame, ip: str) -> DataFrame:
    x = lit_binary(ip_literal(ip))
    return flows.where((F.col("src_ip") == x) | (F.col("dst_ip") == x))


def by_port(flows: DataFrame, port: int) -> DataFrame:
    """Flows with the port at either end; port 0 finds ICMP and non-IP flows, too."""
    return flows.where((F.col("src_port") == port) | (F.col("dst_port") == port))


def by_protocol(flows: DataFrame, proto: str | int) -> DataFrame:
    """Flows of a protocol by name or number; 0 finds non-IP flows."""
    n = proto if isinstance(proto, int) else protocol_number(proto)
    return flows.where(F.col("protocol") == n)


def by_all(flows: DataFrame, ips: Sequence[str] = (), ports: Sequence[int] = (), proto: str | int | None = None) -> DataFrame:
    """Flows that meet every given value: a true intersection."""
    if not ips and not ports and proto is None:
        raise ValueError("no filter given")
    for ip in ips:
        flows = by_ip(flows, ip)
    for port in ports:
        flows = by_port(flows, port)
    return flows if proto is None else by_protocol(flows, proto)

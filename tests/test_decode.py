import struct

from captures import THREE, ipv6_chain, tcp_frame
from pyspark.sql import functions as F

from flowloom.functions.decode import decode, payload_offset
from flowloom.functions.net import ip_text


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, link, bytearray(data)) for i, (link, data) in enumerate(rows)], "i int, link_type int, data binary")
    d = decode(df, **how).select("*", ip_text("five_tuple.src_ip").alias("src"), ip_text("five_tuple.dst_ip").alias("dst"))
    return d.orderBy("i").collect()


def test_three_packets(spark):
    rows = run(spark, [(1, p[2]) for p in THREE])
    t = rows[0].five_tuple
    assert (rows[0].src, rows[0].dst, t.protocol, t.src_port, t.dst_port) == ("10.0.0.1", "10.0.0.2", 6, 1234, 80)
    assert [r.l7_offset for r in rows] == [54] * 3
    assert bytes(rows[0].src_mac) == b"\x11" * 6 and bytes(rows[0].dst_mac) == bytes(6)


def test_ipv6_extensions(spark):
    tcp = struct.pack(">HHIIBBHHH", 12345, 80, 0, 0, 0x50, 0, 0, 0, 0) + b"HELLO"
    ok = ipv6_chain([(0, bytes(7)), (43, bytes(7))], 6, tcp)
    nine = ipv6_chain([(0, bytes(7))] * 9, 6, tcp)
    none, esp, odd = (ipv6_chain([], n, b"\0" * 8) for n in (59, 50, 200))
    cut = ipv6_chain([(0, b"")], 6, b"")[: 14 + 40 + 1]
    auth = ipv6_chain([(51, b"\x01" + bytes(10))], 6, tcp)  # 12 bytes in 4-byte units
    r = run(spark, [(1, x) for x in (ok, nine, none, esp, odd, cut, auth)])
    assert (r[0].five_tuple.protocol, r[0].five_tuple.src_port, r[0].l7_offset, r[0].src) == (6, 12345, 90, "::1")
    assert r[1].five_tuple.protocol == 0  # the ninth header is not walked
    assert [(x.five_tuple.protocol, x.l7_offset) for x in r[2:5]] == [(59, None), (50, None), (200, 54)]
    assert r[5].five_tuple is None
    assert r[6].five_tuple.src_port == 12345
    assert run(spark, [(1, auth)], compat_auth=True)[0].five_tuple.src_port != 12345


def test_l4_cuts(spark):
    f = tcp_frame("1.2.3.4", "5.6.7.8", 9, 10, b"")
    udp = f[:23] + b"\x11" + f[24:42]
    icmp = f[:23] + b"\x01" + f[24:]
    rows = run(spark, [(1, f[: 14 + 20 + 10]), (1, f[: 14 + 20 + 3]), (1, udp), (1, icmp), (1, f[:30]), (1, f[:13]), (101, f[14:])])
    ports = [(r.five_tuple.src_port, r.l7_offset) if r.five_tuple else None for r in rows]
    assert ports == [(9, None), (0, 34), (9, 42), (0, None), None, None, (9, 40)]


def test_vlan_and_wifi(spark):
    f = THREE[0][2]
    tagged = f[:12] + b"\x81\x00\x00\x05" + f[12:]
    wifi = lambda fc: struct.pack("<H", fc) + bytes(2) + b"\x01" * 6 + b"\x02" * 6 + b"\x03" * 6 + bytes(2)
    snap = b"\xaa\xaa\x03\0\0\0\x08\0" + f[14:]
    radiotap = b"\0\0\x08\0" + bytes(4)
    rows = run(spark, [(1, tagged), (105, wifi(0x80)), (105, wifi(0x108) + snap), (127, radiotap + wifi(0x208)), (105, wifi(0x308) + bytes(6) + snap), (105, wifi(0x04)), (127, b"\1" + radiotap[1:]), (105, b"\0" * 23)])
    bssid = [bytes(r.bssid)[0] if r.bssid is not None else None for r in rows]
    assert bssid == [None, 3, 1, 2, None, None, None, None]
    assert rows[0].l7_offset == 58 and rows[2].five_tuple.dst_port == 80 and rows[4].five_tuple.dst_port == 80
    assert bytes(rows[1].src_mac)[0] == 2 and bytes(rows[1].dst_mac)[0] == 1 and rows[6].src_mac is None


def test_payload_offset(spark):
    df = spark.createDataFrame([(bytearray(THREE[0][2][14:]),), (None,)], "data binary")
    assert [r.payload_offset for r in payload_offset(df).collect()] == [40, None]


def test_plan_stays_small(spark):
    from flowloom.api import decoded
    from flowloom.operators.flows import flow_stats
    from flowloom.operators.strategies import Strategy, with_keys

    raw = spark.createDataFrame([], "file string, pkt_idx bigint, ts_sec bigint, ts_usec bigint, orig_len bigint, link_type int, data binary")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(decoded(raw))) < 5_000
    assert len(plan(flow_stats(with_keys(decoded(raw), Strategy("session"))))) < 30_000


def test_flow_statistics_aggregate_once(spark, sf_dir):
    """Ranks and run sizes of flow ids read one aggregation."""
    from flowloom.plans.queries import flows_of

    d = flows_of(spark, sf_dir)
    d.collect()
    assert "ReusedExchange" in d._jdf.queryExecution().executedPlan().toString()


def test_empty_and_null_packets(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, None), (None, bytearray(THREE[0][2])), (1, bytearray(b""))], "link_type int, data binary")
    assert [r.five_tuple for r in decode(df).collect()] == [None] * 3

"""Queries over the packet view, one for each operator, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import decoded
from ..functions.net import ip_literal, ip_sql, ip_text, ip_text_full, lit_binary, mac_text, protocol_name, safe_name, session_order
from ..operators.archive import flow_properties, listing, listing_lines
from ..operators.filters import PacketFilter, by_all, by_id, by_ip, by_port, by_protocol
from ..operators.flows import flow_groups, flow_packets, flow_stats, index, lru_flows, payload_sizes, payloads
from ..operators.strategies import Strategy, with_keys
from ..functions.decode import payload_offset
from ..sources.archive_file import Entry, count_frames, decode_offsets, encode_offsets
from ..sources.capture import parse_blobs
from ..sources.sinks import output_names, pcap_blobs
from .view import CHUNK, DUCK_VIEW, captures, datagrams, event_packets, frames, ipv6_frames, whole_ports, wifi_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

IP, IP2, PORTS = "10.0.0.8", "9.9.9.1", (80, 443)
N_SECONDS, N_PACKETS = 86_400, 1_000


def ip_number(text: str) -> int:
    return int.from_bytes(ip_literal(text)[12:], "big")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = f"WITH p AS ({DUCK_VIEW})\n{sql}"
        return f

    return add


def duck_ip(x: str) -> str:
    return f"(({x} >> 24) || '.' || (({x} >> 16) & 255) || '.' || (({x} >> 8) & 255) || '.' || ({x} & 255))"


def tuple_cols():
    t = "five_tuple"
    return [
        F.expr(x) for x in (f"{t}.protocol", f"{ip_sql(t + '.src_ip')} AS src_ip", f"{ip_sql(t + '.dst_ip')} AS dst_ip", f"{t}.src_port", f"{t}.dst_port")
    ]


def frame_cols():
    """``tuple_cols`` of decoded frames of the view."""
    return [*tuple_cols()[:3], *map(F.expr, whole_ports())]


DUCK_TUPLE = (
    f"CAST(proto AS INTEGER) AS protocol, {duck_ip('src_ip')} AS src_ip, {duck_ip('dst_ip')} AS dst_ip,"
    " CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port"
)

_KEEP = "(src_ip < dst_ip OR (src_ip = dst_ip AND src_port < dst_port))"


def _five(a: str, b: str, x: str, y: str, none: str) -> str:
    return f"CASE WHEN is_ip THEN concat_ws('_', proto, {duck_ip(a)}, {duck_ip(b)}, {x}, {y}) ELSE '{none}' END"


_LO, _HI = (f"(CASE WHEN {_KEEP} THEN {a} ELSE {b} END)" for a, b in (("src_ip", "dst_ip"), ("dst_ip", "src_ip")))
_LP, _HP = (f"(CASE WHEN {_KEEP} THEN {a} ELSE {b} END)" for a, b in (("src_port", "dst_port"), ("dst_port", "src_port")))
#: DuckDB lists of a packet's keys, by strategy
DUCK_KEYS = {
    "session": f"[{_five(_LO, _HI, _LP, _HP, 'no_session')}]",
    "flow": f"[{_five('src_ip', 'dst_ip', 'src_port', 'dst_port', 'no_flow')}]",
    "host": f"CASE WHEN is_ip THEN [{duck_ip('src_ip')}, {duck_ip('dst_ip')}] ELSE ['no_host'] END",
    "hostpair": f"[CASE WHEN is_ip THEN concat_ws('_', {duck_ip('least(src_ip, dst_ip)')}, {duck_ip('greatest(src_ip, dst_ip)')}) ELSE 'no_hostpair' END]",
    "mac": "CASE WHEN src_mac = dst_mac THEN [src_mac] ELSE [src_mac, dst_mac] END",
    "bssid": "[coalesce(bssid, 'no_bssid')]",
    "nosplit": "['all']",
    "seconds": f"['ts_' || (ts_sec // {N_SECONDS})]",
    "packets": f"['pkt_' || ((row_number() OVER (ORDER BY pkt_idx) - 1) // {N_PACKETS})]",
}


def strategy(name: str) -> Strategy:
    return Strategy(name, {"seconds": N_SECONDS, "packets": N_PACKETS}.get(name))


def duck_keyed(name: str, where: str = "TRUE") -> str:
    """CTE body: packets with key and key_pos."""
    return (
        f"SELECT * EXCLUDE (ks), unnest(ks) AS key, unnest(range(len(ks))) AS key_pos "
        f"FROM (SELECT *, {DUCK_KEYS[name]} AS ks FROM p WHERE {where})"
    )


def duck_flows(name: str, where: str = "TRUE") -> str:
    """CTE body: the flow table with numbers for addresses."""
    order = "pkt_idx * 2 + key_pos"
    return f"""
SELECT row_number() OVER (ORDER BY f0) AS flow_id, * FROM (
  SELECT key, count(*) AS packet_count, CAST(sum(orig_len) AS BIGINT) AS total_bytes,
         arg_min(ts_us, {order}) AS start_ts_us, arg_max(ts_us, {order}) AS end_ts_us, min({order}) AS f0,
         arg_min({{'p': coalesce(CAST(proto AS INTEGER), 0), 's': coalesce(src_ip, -1), 'd': coalesce(dst_ip, -1),
                  'sp': coalesce(CAST(src_port AS INTEGER), 0), 'dp': coalesce(CAST(dst_port AS INTEGER), 0)}}, {order}) AS ft
  FROM ({duck_keyed(name, where)}) GROUP BY key)"""


def _ip_or_zero(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '::' ELSE {duck_ip(x)} END"


DUCK_FLOW_COLS = (
    f"flow_id, key, ft.p AS protocol, {_ip_or_zero('ft.s')} AS src_ip, {_ip_or_zero('ft.d')} AS dst_ip, ft.sp AS src_port,"
    " ft.dp AS dst_port, packet_count, total_bytes, start_ts_us, end_ts_us"
)


def flows_of(spark, sf_dir, name="session", where=None) -> DataFrame:
    return flow_stats(flow_groups(event_packets(spark, sf_dir), strategy(name), where))


def shown(flows: DataFrame) -> DataFrame:
    return flows.select(
        "flow_id", "key", "protocol", ip_text("src_ip").alias("src_ip"), ip_text("dst_ip").alias("dst_ip"),
        "src_port", "dst_port", "packet_count", "total_bytes", "start_ts_us", "end_ts_us",
    )


# scans, decode and filters

@query(f"SELECT pkt_idx, ts_sec, ts_usec, ts_us, orig_len, {DUCK_TUPLE}, src_mac, dst_mac, bssid FROM p")
def scan_packets(spark, sf_dir):
    return event_packets(spark, sf_dir).select(
        "pkt_idx", "ts_sec", "ts_usec", "ts_us", "orig_len", *tuple_cols(),
        *(mac_text(c).alias(c) for c in ("src_mac", "dst_mac", "bssid")),
    )


_IPS = f"{ip_number(IP)}, {ip_number(IP2)}"
_BY_IP = f"coalesce(src_ip IN ({_IPS}) OR dst_ip IN ({_IPS}), FALSE)"
_BY_PORT = f"coalesce(src_port IN {PORTS} OR dst_port IN {PORTS}, FALSE)"


def _filtered(spark, sf_dir, *args):
    return PacketFilter(*args).apply(event_packets(spark, sf_dir)).select("pkt_idx", *tuple_cols())


@query(f"SELECT pkt_idx, {DUCK_TUPLE} FROM p WHERE {_BY_IP}")
def filter_ip(spark, sf_dir):
    return _filtered(spark, sf_dir, (IP, IP2))


@query(f"SELECT pkt_idx, {DUCK_TUPLE} FROM p WHERE {_BY_PORT}")
def filter_port(spark, sf_dir):
    return _filtered(spark, sf_dir, (), PORTS)


@query(f"SELECT pkt_idx, {DUCK_TUPLE} FROM p WHERE {_BY_IP} AND {_BY_PORT}")
def filter_ip_port(spark, sf_dir):
    return _filtered(spark, sf_dir, (IP, IP2), PORTS)


@query(f"SELECT pkt_idx, {DUCK_TUPLE} FROM p WHERE coalesce(src_port = 0 OR dst_port = 0, FALSE)")
def filter_port_zero(spark, sf_dir):
    return _filtered(spark, sf_dir, (), (0,))


@query(f"SELECT pkt_idx, {DUCK_TUPLE} FROM p")
def filter_empty(spark, sf_dir):
    return _filtered(spark, sf_dir)


@query(f"SELECT count(*) AS processed, CAST(count_if({_BY_PORT}) AS BIGINT) AS passed, CAST(count_if(NOT {_BY_PORT}) AS BIGINT) AS filtered FROM p")
def scan_counters(spark, sf_dir):
    return PacketFilter((), PORTS).counters(event_packets(spark, sf_dir)).select(
        *(F.col(c).cast("decimal(38,0)").cast("bigint").alias(c) for c in ("processed", "passed", "filtered"))
    )


@query(f"SELECT pkt_idx, {_KEEP} AS keeps, {duck_ip(_LO)} AS a_ip, CAST({_LP} AS INTEGER) AS a_port, {duck_ip(_HI)} AS b_ip, CAST({_HP} AS INTEGER) AS b_port FROM p WHERE is_ip")
def session_normalize(spark, sf_dir):
    t = "five_tuple."
    keep = session_order(t + "src_ip", t + "src_port", t + "dst_ip", t + "dst_port")
    a, b = (f"struct({t}{x}_ip AS i, {t}{x}_port AS p)" for x in ("src", "dst"))
    d = event_packets(spark, sf_dir).where("five_tuple IS NOT NULL").selectExpr("pkt_idx", f"{keep} AS keeps", f"IF({keep}, {a}, {b}) AS a", f"IF({keep}, {b}, {a}) AS b")
    return d.selectExpr("pkt_idx", "keeps", f"{ip_sql('a.i')} AS a_ip", "a.p AS a_port", f"{ip_sql('b.i')} AS b_ip", "b.p AS b_port")


def _decode_check(spark, sf_dir, where: str, vlan: bool):
    d = decoded(frames(event_packets(spark, sf_dir).where(where), vlan=vlan).drop("src_mac", "dst_mac", "bssid", "five_tuple", "l7"))
    return d.select(
        "pkt_idx", *frame_cols(), mac_text("src_mac").alias("src_mac"), mac_text("dst_mac").alias("dst_mac"),
        "l7_offset", F.decode("l7", "utf-8").alias("payload"),
    )


def _duck_decode(where: str, shift: int) -> str:
    at = f"CASE proto WHEN 6 THEN {54 + shift} WHEN 17 THEN {42 + shift} END"
    return f"SELECT pkt_idx, {DUCK_TUPLE}, src_mac, dst_mac, CAST({at} AS INTEGER) AS l7_offset, CASE WHEN proto IN (6, 17) THEN payload END AS payload FROM p WHERE {where}"


@query(_duck_decode("TRUE", 0))
def decode_ethernet_roundtrip(spark, sf_dir):
    return _decode_check(spark, sf_dir, "TRUE", False)


@query(_duck_decode("TRUE", 4))
def decode_vlan_roundtrip(spark, sf_dir):
    return _decode_check(spark, sf_dir, "TRUE", True)


@query(_duck_decode("proto IN (1, 17)", 0))
def decode_udp_icmp_roundtrip(spark, sf_dir):
    return _decode_check(spark, sf_dir, "five_tuple.protocol IN (1, 17)", False)


_RAW = ("src_mac", "dst_mac", "bssid", "five_tuple", "l7")
_L4 = "CASE proto WHEN 6 THEN 20 WHEN 17 THEN 8 END"


def _decoded(d):
    return decoded(d.drop(*_RAW))


def duck_ip6(x: str) -> str:
    return f"('2001:db8::' || printf('%x', {x} >> 16) || ':' || printf('%x', {x} & 65535))"


@query(
    f"SELECT pkt_idx, CAST(CASE proto WHEN 1 THEN 58 ELSE proto END AS INTEGER) AS protocol, {duck_ip6('src_ip')} AS src_ip, {duck_ip6('dst_ip')} AS dst_ip,"
    " CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port,"
    f" CAST(54 + CASE pkt_idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 24 ELSE 12 END + {_L4} AS INTEGER) AS l7_offset,"
    " CASE WHEN proto <> 1 THEN payload END AS payload FROM p WHERE is_ip"
)
def decode_ipv6_roundtrip(spark, sf_dir):
    """Extension headers of several kinds, walked to the transport header."""
    d = _decoded(ipv6_frames(event_packets(spark, sf_dir)))
    return d.select("pkt_idx", *frame_cols(), "l7_offset", F.decode("l7", "utf-8").alias("payload"))


@query(
    f"SELECT pkt_idx, {DUCK_TUPLE}, src_mac, dst_mac, CASE pkt_idx % 4 WHEN 0 THEN 'aabbccddeeff' WHEN 1 THEN dst_mac WHEN 2 THEN src_mac END AS bssid,"
    f" CAST(CASE WHEN pkt_idx % 2 = 1 THEN 8 ELSE 0 END + CASE WHEN pkt_idx % 4 = 3 THEN 30 ELSE 24 END + 28 + {_L4} AS INTEGER) AS l7_offset FROM p"
)
def decode_wifi_roundtrip(spark, sf_dir):
    """802.11 data frames, with and without radiotap, in all distribution-system directions."""
    d = _decoded(wifi_frames(event_packets(spark, sf_dir)))
    return d.select("pkt_idx", *frame_cols(), *(mac_text(c).alias(c) for c in ("src_mac", "dst_mac", "bssid")), "l7_offset")


@query(f"SELECT pkt_idx, {DUCK_TUPLE}, CAST(20 + {_L4} AS INTEGER) AS l7_offset, CAST(20 + {_L4} AS INTEGER) AS payload_offset FROM p WHERE is_ip")
def decode_raw_ip_roundtrip(spark, sf_dir):
    """Datagrams without a link layer, as packets and by the payload offset of a column."""
    d = payload_offset(datagrams(event_packets(spark, sf_dir)).drop("l7"))
    return _decoded(d).select("pkt_idx", *frame_cols(), "l7_offset", "payload_offset")


_LENGTH = "CAST(CASE WHEN NOT is_ip THEN 14 ELSE 34 + CASE proto WHEN 6 THEN 20 ELSE 8 END + strlen(payload) END AS BIGINT)"
_CHUNKED = f"SELECT CAST(pkt_idx // {CHUNK} AS VARCHAR) AS file, row_number() OVER (PARTITION BY pkt_idx // {CHUNK} ORDER BY pkt_idx) - 1 AS idx"


def _parsed(spark, sf_dir, ng: bool):
    d = _parse_decoded(captures(event_packets(spark, sf_dir), ng))
    return d.select("file", F.col("pkt_idx").alias("idx"), "ts_us", "cap_len", "orig_len", "link_type", *frame_cols(), mac_text("src_mac").alias("src_mac"))


def _parse_decoded(blobs):
    return decoded(parse_blobs(blobs))


@query(f"{_CHUNKED}, ts_us, {_LENGTH} AS cap_len, CAST(orig_len AS BIGINT) AS orig_len, CAST(1 AS INTEGER) AS link_type, {DUCK_TUPLE}, src_mac FROM p")
def pcap_kinds_roundtrip(spark, sf_dir):
    """Captures of both byte orders, in micro- and nanoseconds."""
    return _parsed(spark, sf_dir, False)


@query(
    f"{_CHUNKED}, CASE WHEN pkt_idx % 7 = 0 THEN 0 ELSE ts_us END AS ts_us, {_LENGTH} AS cap_len,"
    f" CASE WHEN pkt_idx % 7 = 0 THEN {_LENGTH} ELSE CAST(orig_len AS BIGINT) END AS orig_len, CAST(1 AS INTEGER) AS link_type, {DUCK_TUPLE}, src_mac FROM p"
)
def pcapng_roundtrip(spark, sf_dir):
    """PCAP-NG sections of both byte orders, two clocks, enhanced, simple and unknown blocks."""
    return _parsed(spark, sf_dir, True)


# keys and buckets

def _key_query(name: str):
    def run(spark, sf_dir):
        return with_keys(event_packets(spark, sf_dir), strategy(name)).select("pkt_idx", "key_pos", "key")

    label = {"seconds": "bucket_seconds", "packets": "bucket_packets"}.get(name, f"key_{name}")
    query(f"SELECT pkt_idx, CAST(key_pos AS INTEGER) AS key_pos, key FROM ({duck_keyed(name)})", label)(run)


def _stats_query(name: str):
    query(f"SELECT {DUCK_FLOW_COLS} FROM ({duck_flows(name)})", f"flow_stats_{name}")(lambda spark, sf_dir: shown(flows_of(spark, sf_dir, name)))


for _name in DUCK_KEYS:
    _key_query(_name)
    _stats_query(_name)


@query(f"SELECT pkt_idx, CAST(key_pos AS INTEGER) AS key_pos, key FROM ({duck_keyed('packets', _BY_PORT)})")
def bucket_packets_after_filter(spark, sf_dir):
    keyed = flow_groups(event_packets(spark, sf_dir), strategy("packets"), PacketFilter((), PORTS))
    return keyed.select("pkt_idx", "key_pos", "key")


@query(f"SELECT key, start_ts_us, end_ts_us, end_ts_us - start_ts_us AS span_us FROM ({duck_flows('flow')})")
def flow_first_last_arrival(spark, sf_dir):
    return flows_of(spark, sf_dir, "flow").selectExpr("key", "start_ts_us", "end_ts_us", "end_ts_us - start_ts_us AS span_us")


@query(f"SELECT flow_id, key FROM ({duck_flows('host')})")
def flow_ids(spark, sf_dir):
    return flows_of(spark, sf_dir, "host").select("flow_id", "key")


@query(f"SELECT {DUCK_FLOW_COLS} FROM ({duck_flows('session', _BY_IP + ' AND ' + _BY_PORT)})")
def flow_stats_filtered(spark, sf_dir):
    return shown(flows_of(spark, sf_dir, "session", PacketFilter((IP, IP2), PORTS)))


# the flow table

_NAME = "CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE '?' END"
_FLOWS = f"f AS (SELECT {DUCK_FLOW_COLS} FROM ({duck_flows('session')}))"


def with_flows(sql: str) -> str:
    return f"SELECT * FROM (WITH {_FLOWS} {sql})"


@query(with_flows(f"SELECT flow_id, {_NAME} AS proto, src_ip, dst_ip, packet_count, total_bytes, start_ts_us // 1000000 AS start_s FROM f"))
def list_flows(spark, sf_dir):
    return listing(flows_of(spark, sf_dir))


@query(with_flows(f"SELECT flow_id, concat_ws(' ', rpad(flow_id::VARCHAR, 6, ' '), rpad({_NAME}, 6, ' '), rpad(src_ip, 22, ' '), rpad(dst_ip, 22, ' '), rpad(packet_count::VARCHAR, 8, ' '), rpad(total_bytes::VARCHAR, 10, ' '), rpad((start_ts_us // 1000000)::VARCHAR, 12, ' ')) AS line FROM f"))
def list_flows_text(spark, sf_dir):
    return listing_lines(flows_of(spark, sf_dir))


@query(with_flows("SELECT * FROM f WHERE flow_id = 7"))
def get_flow(spark, sf_dir):
    return shown(by_id(flows_of(spark, sf_dir), 7))


@query(with_flows(f"SELECT * FROM f WHERE src_ip = '{IP}' OR dst_ip = '{IP}'"))
def find_by_ip(spark, sf_dir):
    return shown(by_ip(flows_of(spark, sf_dir), IP))


@query(with_flows("SELECT * FROM f WHERE src_port = 53 OR dst_port = 53"))
def find_by_port(spark, sf_dir):
    return shown(by_port(flows_of(spark, sf_dir), 53))


@query(with_flows("SELECT * FROM f WHERE src_port = 0 OR dst_port = 0"))
def find_by_port_zero(spark, sf_dir):
    return shown(by_port(flows_of(spark, sf_dir), 0))


@query(with_flows("SELECT * FROM f WHERE protocol = 17"))
def find_by_protocol(spark, sf_dir):
    return shown(by_protocol(flows_of(spark, sf_dir), "UDP"))


@query(with_flows("SELECT * FROM f WHERE protocol = 0"))
def find_by_protocol_non_ip(spark, sf_dir):
    return shown(by_protocol(flows_of(spark, sf_dir), 0))


@query(with_flows(f"SELECT * FROM f WHERE '{IP2}' IN (src_ip, dst_ip) AND 80 IN (src_port, dst_port) AND protocol = 6"))
def extract_intersection(spark, sf_dir):
    return shown(by_all(flows_of(spark, sf_dir), (IP2,), (80,), "tcp"))


@query(with_flows(f"SELECT * FROM f WHERE '{IP2}' IN (src_ip, dst_ip) AND '{IP}' IN (src_ip, dst_ip)"))
def extract_two_ips(spark, sf_dir):
    return shown(by_all(flows_of(spark, sf_dir), (IP2, IP)))


def _duck_index(a: str, b: str | None = None) -> str:
    values = f"unnest(list_distinct([{a}, {b}]))" if b else a
    return with_flows(f"SELECT value, list_sort(list(flow_id))::VARCHAR AS flow_ids FROM (SELECT {values} AS value, flow_id FROM f) GROUP BY value")


def _index(flows: DataFrame, *cols) -> DataFrame:
    d = index(flows, *cols)
    return d.select("value", F.concat(F.lit("["), F.array_join(d.flow_ids.cast("array<string>"), ", "), F.lit("]")).alias("flow_ids"))


@query(_duck_index("src_ip", "dst_ip"))
def index_ip(spark, sf_dir):
    return _index(flows_of(spark, sf_dir), "src_ip", "dst_ip").withColumn("value", ip_text("value"))


@query(_duck_index("src_port", "dst_port"))
def index_port(spark, sf_dir):
    return _index(flows_of(spark, sf_dir), "src_port", "dst_port")


@query(_duck_index("protocol"))
def index_proto(spark, sf_dir):
    return _index(flows_of(spark, sf_dir), "protocol")


def _member_sql(select: str, name: str = "host") -> str:
    return f"SELECT {select} FROM ({duck_keyed(name)}) k JOIN ({duck_flows(name)}) f ON k.key = f.key"


def _members(spark, sf_dir, name="host"):
    keyed = flow_groups(event_packets(spark, sf_dir), strategy(name))
    return flow_packets(keyed, flow_stats(keyed))


@query(_member_sql("f.flow_id, k.pkt_idx, CAST(k.key_pos AS INTEGER) AS key_pos, k.orig_len"), "flow_packets")
def flow_packets_query(spark, sf_dir):
    return _members(spark, sf_dir).select("flow_id", "pkt_idx", "key_pos", "orig_len")


@query(_member_sql("f.flow_id, k.pkt_idx", "session") + f" WHERE f.ft.s IN ({_IPS}) OR f.ft.d IN ({_IPS})")
def flow_packets_semi_join(spark, sf_dir):
    found = flows_of(spark, sf_dir).where(F.col("src_ip").isin(*(lit_binary(ip_literal(x)) for x in (IP, IP2))) | F.col("dst_ip").isin(*(lit_binary(ip_literal(x)) for x in (IP, IP2))))
    return _members(spark, sf_dir, "session").join(found.select("flow_id"), "flow_id", "left_semi").select("flow_id", "pkt_idx")


# texts, names and payloads

@query(with_flows(f"SELECT DISTINCT protocol, {_NAME} AS name, CASE protocol WHEN 58 THEN 'ICMPv6' ELSE {_NAME} END AS name6 FROM f"))
def proto_name(spark, sf_dir):
    return flows_of(spark, sf_dir).select("protocol", protocol_name("protocol").alias("name"), protocol_name("protocol", True).alias("name6")).distinct()


@query(f"SELECT DISTINCT {duck_ip('src_ip')} AS ip, {duck_ip('src_ip')} AS ip_full FROM p WHERE is_ip")
def ip_format_v4(spark, sf_dir):
    ip = "five_tuple.src_ip"
    return event_packets(spark, sf_dir).where("five_tuple IS NOT NULL").select(ip_text(ip).alias("ip"), ip_text_full(ip).alias("ip_full")).distinct()


_SAFE = r"regexp_replace(key, '[\x00-\x1F\x7F/\\:*?\"<>|.]', '_', 'g')"


@query(f"SELECT DISTINCT key, {_SAFE} AS name FROM ({duck_keyed('session')})")
def sanitize_key(spark, sf_dir):
    d = with_keys(event_packets(spark, sf_dir), strategy("session")).select("key").distinct()
    return d.select("key", safe_name(F.col("key")).alias("name"))


@query(f"SELECT DISTINCT key, 'events_' || {_SAFE} || '.pcap' AS name FROM ({duck_keyed('hostpair')})", "output_names")
def output_names_query(spark, sf_dir):
    return output_names(with_keys(event_packets(spark, sf_dir), strategy("hostpair"))).select("key", "name")


@query(f"SELECT key, hex(encode(string_agg(payload, '' ORDER BY pkt_idx, key_pos))) AS payload FROM ({duck_keyed('session', 'is_ip')}) GROUP BY key")
def payload_concat_hex(spark, sf_dir):
    keyed = with_keys(event_packets(spark, sf_dir).where("five_tuple IS NOT NULL"), strategy("session"))
    return payloads(keyed).select("key", F.hex("payload").alias("payload"))


@query(f"SELECT key, CAST(sum(strlen(payload)) AS BIGINT) AS payload_bytes FROM ({duck_keyed('flow')}) GROUP BY key")
def payload_lengths(spark, sf_dir):
    keyed = with_keys(event_packets(spark, sf_dir), strategy("flow"))
    return payload_sizes(keyed).select("key", "payload_bytes")


_FRAME = "CASE WHEN NOT is_ip THEN 14 ELSE 34 + CASE proto WHEN 6 THEN 20 ELSE 8 END + strlen(payload) END"


@query(f"SELECT flow_id, 24 + bytes AS pcap_bytes FROM (SELECT key, CAST(sum(16 + {_FRAME}) AS BIGINT) AS bytes FROM ({duck_keyed('session')}) GROUP BY key) b JOIN ({duck_flows('session')}) f USING (key)")
def pipe_lengths(spark, sf_dir):
    return _pcaps(spark, sf_dir).select("flow_id", F.length("pcap").cast("bigint").alias("pcap_bytes"))


def _pcaps(spark, sf_dir):
    pkts = frames(event_packets(spark, sf_dir))
    keyed = flow_groups(pkts, strategy("session"))
    return pcap_blobs(flow_packets(keyed, flow_stats(keyed)))


@query(f"SELECT flow_id, count(*) AS n, CAST(sum({_FRAME}) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM ({duck_keyed('session')}) k JOIN (SELECT key, flow_id FROM ({duck_flows('session')})) f USING (key) GROUP BY flow_id")
def pcap_roundtrip(spark, sf_dir):
    """Flows as PCAP bytes, parsed again."""
    back = decoded(parse_blobs(_pcaps(spark, sf_dir).select(F.col("flow_id").cast("string").alias("file"), F.col("pcap").alias("blob"))))
    return back.groupBy(F.col("file").cast("bigint").alias("flow_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cap_len").alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


@query(f"SELECT flow_id, count(*) AS frames FROM ({duck_keyed('session')}) k JOIN (SELECT key, flow_id FROM ({duck_flows('session')})) f USING (key) GROUP BY flow_id")
def pipe_frame_counts(spark, sf_dir):
    """Length-prefixed flows of a pipe, read back and counted."""

    def run(batches):
        import io

        import pyarrow as pa

        from ..sources.sinks import read_pipe

        for b in batches:
            stream = b"".join(len(x).to_bytes(8, "little") + x for x in b.column(1).to_pylist())
            n = [count_frames(x) for x in read_pipe(io.BytesIO(stream))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["flow_id", "frames"])

    return _pcaps(spark, sf_dir).select("flow_id", "pcap").mapInArrow(run, "flow_id bigint, frames bigint")


@query(with_flows("SELECT flow_id, protocol, src_ip, dst_ip, src_port, dst_port, packet_count, total_bytes, start_ts_us, end_ts_us, 96 AS entry_size FROM f"))
def archive_entries_roundtrip(spark, sf_dir):
    """Flow table entries in the archive's layout, packed and read back."""
    names = ("flow_id", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "packet_count", "start_ts_us", "end_ts_us", "total_bytes")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            packed = [Entry(*row).pack() for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            back = [Entry.unpack(x) for x in packed]
            cols = [pa.array([getattr(e, n) for e in back], b.column(i).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in packed], pa.int32())], names=[*names, "entry_size"])

    d = flows_of(spark, sf_dir).select(*names)
    d = d.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", entry_size int")
    return d.withColumns({"src_ip": ip_text("src_ip"), "dst_ip": ip_text("dst_ip")})


@query(f"SELECT key, list_sort(list(pkt_idx * 300 + key_pos))::VARCHAR AS offsets FROM ({duck_keyed('host')}) GROUP BY key")
def archive_offsets_roundtrip(spark, sf_dir):
    """Offset lists as first offset and variable-length differences, and back."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = [str(decode_offsets(encode_offsets(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.string())], names=["key", "offsets"])

    d = with_keys(event_packets(spark, sf_dir), strategy("host")).groupBy("key").agg(F.expr("array_sort(collect_list(pkt_idx * 300 + key_pos)) AS o"))
    return d.mapInArrow(run, "key string, offsets string")


@query(with_flows("SELECT flow_id AS id, protocol AS proto, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 58 THEN 'ICMPv6' ELSE '?' END AS proto_name, CASE src_ip WHEN '::' THEN '0000:0000:0000:0000:0000:0000:0000:0000' ELSE src_ip END AS src_addr, CASE dst_ip WHEN '::' THEN '0000:0000:0000:0000:0000:0000:0000:0000' ELSE dst_ip END AS dst_addr, src_port, dst_port, packet_count, total_bytes, start_ts_us / 1e6 AS start_ts, end_ts_us / 1e6 AS end_ts FROM f"))
def flow_properties_full(spark, sf_dir):
    return flow_properties(flows_of(spark, sf_dir), full_v6=True)


def lru_compat(spark, sf_dir):
    return lru_flows(with_keys(event_packets(spark, sf_dir), strategy("session")), 50).drop("file")


QUERIES["lru_compat"] = lru_compat

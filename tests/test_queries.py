import glob
import os

import duckdb
import pytest

from flowloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(map(tuple, df.select(*names).collect())) == rows_of(cur.fetchall())


def test_lru(spark, sf_dir):
    """Against a step-by-step table."""
    from flowloom.operators.strategies import Strategy, with_keys
    from flowloom.plans.view import event_packets

    table = {}
    for r in with_keys(event_packets(spark, sf_dir), Strategy("session")).orderBy("pkt_idx", "key_pos").collect():
        if len(table) >= 50:
            del table[min(table, key=lambda k: table[k][2])]
        n, size, _ = table.get(r.key, (0, 0, 0))
        table[r.key] = (n + 1, size + r.orig_len, r.pkt_idx)
    got = {r.key: (r.packet_count, r.total_bytes) for r in QUERIES["lru_compat"](spark, sf_dir).collect()}
    assert got == {k: v[:2] for k, v in table.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


#: queries whose packets or entries have two bytes a port
TWO_BYTE_PORTS = [
    "archive_entries_roundtrip",
    "decode_ipv6_roundtrip",
    "decode_udp_icmp_roundtrip",
    "decode_wifi_roundtrip",
    "pcap_kinds_roundtrip",
    "pcapng_roundtrip",
    "decode_ethernet_roundtrip",
    "decode_raw_ip_roundtrip",
    "decode_vlan_roundtrip",
]


@pytest.fixture(scope="module")
def large_users(sf_dir, tmp_path_factory):
    """Events whose users, and with them client ports, start below 2^16 and end below 2^31."""
    d = tmp_path_factory.mktemp("large_users")
    c = duckdb.connect()
    events = f"SELECT * REPLACE (user_id + s AS user_id) FROM '{sf_dir}/events.parquet' JOIN (VALUES (0, 64505), (1, 90000), (2, 2147480000)) v(i, s) ON event_id % 3 = i"
    c.execute(f"COPY ({events}) TO '{d}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", TWO_BYTE_PORTS)
def test_ports_above_two_bytes(spark, large_users, name):
    d, c = large_users
    df = QUERIES[name](spark, d)
    cur = c.execute(ORACLES[name])
    want = cur.fetchall()
    assert any((r[i] or 0) > 1 << 30 for r in want for i, x in enumerate(cur.description) if x[0] in ("src_port", "dst_port"))
    assert rows_of(map(tuple, df.select(*(x[0] for x in cur.description)).collect())) == rows_of(want)

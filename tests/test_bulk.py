"""Kernels over packets: validity, counts, and packets without a payload."""

from frames import eth, fragment_stream, ip, packets, tagged, udp

from wirelane.operators import bulk, protocols


def test_flows(spark):
    frames = fragment_stream(5)[0] + [tagged(ip(udp(700, 701, b"x")), [1, 2]), eth(b"", 0x86DD), b"short"]
    table = bulk.bulk_decode(packets(spark, frames), bulk.flow, bulk.FLOW)
    rows = table.every.orderBy("packet_id").collect()
    for frame, row in zip(frames, rows, strict=True):
        ports = protocols.Walk(frame, reassembly=False).rows.get("udp")
        assert row.valid == bool(ports) and row.src_port == (ports[0]["src_port"] if ports else None)
    assert table.count() == sum(r.valid for r in rows) == table.rows.count() > 5
    assert table.rows.columns == ["file", "packet_id", "eth_type", "ip_src", "ip_dst", "protocol", "src_port", "dst_port"]


def test_a_null_descriptor_gives_no_rows(spark):
    p = packets(spark, [eth(ip(udp(1, 2, b"x")))])
    assert bulk.bulk_decode(p.unionByName(p.selectExpr("file", "packet_id + 1 as packet_id", "file_offset", "interface_id", "link_type", "ts_raw", "caplen", "origlen", "cast(null as binary) payload")), bulk.flow, bulk.FLOW).count() == 0
    assert bulk.bulk_decode(p.limit(0), bulk.flow, bulk.FLOW).count() == 0


def test_columns_are_set_in_any_order():
    columns = bulk.Columns(bulk.sql_type("struct<a: int>"), 3)
    columns.scatter(2, {"a": 7})
    columns.scatter(0, {"a": 5})
    assert columns.arrow().to_pylist() == [{"valid": True, "a": 5}, {"valid": False, "a": None}, {"valid": True, "a": 7}]

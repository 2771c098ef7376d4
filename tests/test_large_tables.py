"""What small tables do not show: large keys, files and groups."""

import test_streaming

from wirelane.plans import catalog, families
from wirelane.sources import pcap
from wirelane.streaming import reassembly


def test_numbers_of_large_keys(spark, tmp_path):
    keys = [0, 32_768, 32_769, 65_535, 65_536, 131_072, 2_147_483]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = {r.s_suppkey: r for r in families.number_parsers(spark, str(tmp_path)).collect()}
    assert {k: (r.a, r.b, r.g, r.h, r.m, r.n) for k, r in rows.items()} == {k: (k % 65536, k + 70000, -k, -k * 1000, -k, k + 0.5) for k in keys}


def test_captures_are_read_in_windows(spark, tmp_path):
    """No file is held whole: Spark reads none that is longer than maxLength. Names are taken as they are."""
    packets = [(i, i % 7, bytes(i % 50)) for i in range(3000)]
    (tmp_path / "a %41+b.pcap").write_bytes(pcap.write_pcap(packets))
    (tmp_path / "none.pcap").write_bytes(b"")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = pcap.read_captures(spark, str(tmp_path)).orderBy("packet_id").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.packet_id, r.ts_raw, r.payload) for r in rows] == [(i, s << 32 | f, p) for i, (s, f, p) in enumerate(packets)]
    assert {r.file.rpartition("/")[2] for r in rows} == {"a %41+b.pcap"}


def test_captures_of_a_store_that_arrow_does_not_reach(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap([(1, 2, b"x")]))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.captures.link./in", f"file://{tmp_path}")
    assert [r.payload for r in pcap.read_captures(spark, "viewfs://captures/in").collect()] == [b"x"]


def test_stream_keys_share_state(spark, tmp_path, monkeypatch):
    """Python is called for buckets of keys; datagrams of other keys in a bucket end as if they were alone."""
    monkeypatch.setattr(reassembly, "BUCKETS", 2)
    test_streaming.test_stream_is_batch(spark, tmp_path)


def test_messages_are_not_sent_to_the_driver(spark, tmp_path):
    """Spark guesses rows by the bytes of the table they are made of; each packet is walked once for each pass."""
    spark.createDataFrame([(k, k % 11) for k in range(9000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog.path_trace_join(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("ArrowEvalPython [run(payload") == 4
    want = {(k, k % 11 % 4, f"{k % 11:016x}") for k in range(9000) if k % 5}
    assert {tuple(r) for r in rows.collect()} == want

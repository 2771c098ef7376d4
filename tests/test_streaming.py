"""Reassembly of a stream is that of a batch."""

import random

from pyspark.sql import functions as F

from wirelane.operators import defrag
from wirelane.streaming.reassembly import reassemble_stream

SCHEMA = "file string, ip_version int, key binary, packet_id long, protocol smallint, frag_offset_bytes long, more_fragments boolean, data binary"


def test_stream_is_batch(spark, tmp_path):
    rng = random.Random(9)
    rows, packet = [], 0
    for _ in range(120):
        packet += rng.randrange(1, 4)
        rows.append(("f", 4, bytes([rng.randrange(6)]), packet, 17, 8 * rng.randrange(3), rng.random() < 0.6, bytes([rng.randrange(2)]) * 8))
    rows.append(("f", 4, b"end", packet + 100, 17, 0, True, b"x" * 8))
    rows.append(("f", 4, b"end2", packet + 200, 17, 0, True, b"x" * 8))
    config = defrag.Config(timeout=9)
    path = str(tmp_path / "in")
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = reassemble_stream(stream, config).writeStream.format("memory").queryName("datagrams").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = spark.read.schema(SCHEMA).parquet(path)
    found, _ = defrag.reassemble(batch, batch.groupBy("file").agg(F.max("packet_id").alias("last")), config)
    columns = ["first_packet_id", "last_packet_id", "total_length", "fragment_count", "gap_bytes"]
    # The last two datagrams are still open in the stream.
    rows_of = lambda df: sorted(tuple(map(str, r)) for r in df.where(F.col("last_packet_id") <= packet).select(*columns, F.col("completion_status").cast("int"), F.md5("payload")).collect())
    assert rows_of(spark.table("datagrams")) == rows_of(found)

"""Whole texts as datagrams: also those longer than one datagram."""

import hashlib
import random

from wirelane.plans import catalog


def test_long_texts_are_several_datagrams(spark, tmp_path):
    rng = random.Random(1)
    make = lambda n, letters="abcdefgh \n": "".join(rng.choices(letters, k=n))
    sizes = [0, 1, 1016, 1017, 59_999, 60_000, 60_001, 61_000, 120_000, 133_719, 300_001]
    texts = [make(n) for n in sizes] + [make(50_001, "aé日\U0001f600"), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = {i: t.encode() for i, t in enumerate(texts) if t is not None and len(t.encode()) > 1016}
    assert {r.doc_id: r.text_md5 for r in catalog.defrag_payload(spark, str(tmp_path)).collect()} == {i: hashlib.md5(b).hexdigest() for i, b in raw.items()}
    want = []
    for i, b in raw.items():
        n = -(-len(b) // catalog.PART_BYTES)
        for p in range(n):
            size = (p + 1) * len(b) // n - p * len(b) // n + 8
            want.append((p * catalog.PART_IDS + i * 100 + (size - 1) // 1024, size, (size - 1) // 1024 + 1))
    got = [tuple(r) for r in catalog.defrag_documents(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(size - 8 for _, size, _ in got) == sum(map(len, raw.values()))

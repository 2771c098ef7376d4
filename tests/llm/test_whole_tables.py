"""Queries read the whole of the tables that they are meant for."""

import hashlib
import random

from wirelane.llm import queries


def test_sampling_reads_all_documents(spark, tmp_path):
    rng = random.Random(4)
    words = ["the", "cat", "été", "日本語", "running", "x" * 30]
    texts = ["a text", None, "", " ".join(rng.choices(words, k=20_000)), "two  spaces\nand a line", "a text"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op4_sampling"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in got)
    assert [r.sample for r in sorted(got, key=lambda r: r.sample) if r.doc_id == 3] == [1, 2, 3, 4]

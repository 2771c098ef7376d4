"""Token ids against the tokenizer's own over all white space and marks; languages beyond what few values of lang show."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelane.llm import langid, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(encode, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]


def test_ids_beside_any_character():
    """Each character up to U+00FF, and white space and marks beyond, between letters, digits, symbols and each other."""
    tokenizer = Tokenizer.from_file(PATH)
    parts = packing.PartIds(tokenizer)
    assert parts.modelled
    odd = [chr(c) for c in range(256)] + list("      　᠎​﻿̸́ΣİǅﬁＡ٣")
    rng = random.Random(3)
    texts = [f"ready!{c}go{c}12{c}é" for c in odd] + [f"{a}{b}x{b}{a}!" for a in odd for b in rng.sample(odd, 40)]
    texts += ["".join(rng.choices(odd + list("abc'!19 "), k=rng.randrange(1, 12))) for _ in range(20_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [(t, a, b) for t, a, b in zip(texts, ids(parts.encode, texts), want, strict=True) if a != b]
    assert not wrong, wrong[:5]
    assert zlib.crc32(parts.encode(["ready!\x1cgo"])[0] + b"\1\0\0\0") == 1913736403


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    parts = packing.PartIds(tokenizer)
    texts = ["It's  two\n\nlines", "", " x\x1c!", "日本 é"]
    assert not parts.modelled and ids(parts.encode, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rng = random.Random(8)
    rows = [(i % 50, "word " * rng.choice([3, 3, 3, 30, 700]), "x", 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, length int")
    got = packing.pack(df, PATH, capacity=256).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 256
    want = sum(-(-(len(t.split()) + 1) // 256) for _, t, _, _ in rows)
    assert len(got) == want and sum(r.length for r in got) == sum(len(t.split()) + 1 for _, t, _, _ in rows)


@pytest.mark.parametrize("text", ["́ ̈", "́", "12 ̀!", "⃝", " \n"])
def test_marks_alone_are_no_language(spark, text):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = df.select(langid.identify(df, model).alias("f")).first().f
    assert (found.lang, found.score, found.spans) == ("und", 0.0, [])
    assert langid.letters("ét́") == "ét́"


def test_many_languages(spark):
    """More values of lang than a byte counts, a very long text of two of them, ties, and columns named like those made."""
    rng = random.Random(9)
    words = [["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(12)] for _ in range(150)]
    rows = [(150 * k + i, " ".join(rng.choices(words[i], k=30)), f"l{i:03}", "clash") for k in range(6) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, found string")
    model = langid.fit(df)
    assert len(model.langs) == 150
    long = " ".join(rng.choices(words[140], k=30_000) + rng.choices(words[3], k=20_000))
    odd = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, " ".join(words[149]), None)], "doc_id long, text string, found string")
    got = sorted((r.doc_id, r.f.lang, round(r.f.score, 3), len(r.f.spans)) for r in odd.select("doc_id", langid.identify(odd, model).alias("f")).collect())
    assert got == [(1, "l140", 0.6, 2), (1, "l140", 0.6, 2), (2, "l149", 1.0, 1)]
    held = df.where(langid.held_out(F.col("doc_id")))
    right = [r.lang == r.f.lang for r in held.select("lang", langid.identify(held, model).alias("f")).collect()]
    assert sum(right) > 0.98 * len(right)


def test_few_languages_are_learned_of_many(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    rows = [(i, "some words", "a") for i in range(60)] + [(i, "andere Worte", "b") for i in range(60, 100)] + [(i, "x y", f"dirty{i}") for i in range(100, 140)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["a", "b"]

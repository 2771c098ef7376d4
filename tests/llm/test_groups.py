"""Crowded groups, hubs, parts of slots, near fingerprints and bounded batches against plain versions."""

import collections
import random

import pyarrow as pa
from pyspark.sql import functions as F
from test_llm import brute_components, corpus, frame

from wirelane.llm import graph, minhash, queries, quotes, sharding, simhash
from wirelane.llm.common import Scratch, slices


def test_crowded_groups(spark, monkeypatch):
    """Two templates with drifting copies, and others, in blocks of a few members: pivots first, then what is left over."""
    rng = random.Random(12)
    rows = []
    for _ in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(30):
            near = list(base)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = near  # later copies are copies of this one
            rows.append(" ".join(near))
    rows += corpus(n=20)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_components(rows)
    for block in (4,):
        monkeypatch.setattr(minhash, "KEY_BLOCK", block)
        monkeypatch.setattr(minhash, "SET_BLOCK", block)
        got = minhash.near_duplicates(frame(spark, [t for _, t in rows])).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert max(collections.Counter(c for _, c in want.values()).values()) > 20


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    rng = random.Random(13)
    edges = [(1000, x) for x in range(1001, 1060)] + [(1000, 5), (5, 4)] + [(7, x) for x in range(2000, 2030)] + [(2029, 3000)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent if root(x) != x}


def test_slots_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    df = frame(spark, [f"text {i % 7}" for i in range(200)], [None] * 20 + [i // 2 for i in range(180)]).withColumn("place", F.lit("x")).withColumn("size", F.lit(1))
    rows, _ = sharding.shard_records(df, 4, 16)
    rows = rows.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.place)
    assert len(rows) == 200 and all(sorted(p) == list(range(len(p))) for p in by.values())
    assert len({r.virtual_slot for r in rows if r.doc_id is None}) > 1


def test_near_fingerprints(spark, tmp_path):
    """The counts of the query are those of comparing all fingerprints that it returns."""
    rng = random.Random(14)
    base = [f"word{rng.randrange(5000)}" for _ in range(600)]
    texts = []
    for _ in range(90):
        near = list(base)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "", "one two", " ".join(base * 60)] + corpus(n=40)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op3_simhash"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    prints = [int(r.fingerprint, 16) for r in rows]
    for r in rows:
        near = sum((int(r.fingerprint, 16) ^ p).bit_count() <= queries.NEAR_BITS for p in prints) - 1
        assert r.n_within == (near if r.doc_id % queries.NEAR_QUERIES == 0 else None)
    assert max(r.n_within or 0 for r in rows) > 5
    again = simhash.compare_with_edits(frame(spark, ["same text"] * 3, [4, 4, 4])).collect()
    assert len(again) == 3 and len({(r.hi, r.lo) for r in again}) == 1


def test_slices():
    batch = pa.record_batch([pa.array(["a" * n if n >= 0 else None for n in (3, 0, -1, 50, 2, 2, 2, 100, 1)])], ["text"])
    got = [p.column(0).to_pylist() for p in slices(batch, "text", 3, 10)]
    assert [x for part in got for x in part] == batch.column(0).to_pylist()
    assert all(len(part) == 1 or len(part) <= 3 and sum(len(x or "") for x in part) <= 10 for part in got)
    assert list(slices(batch.slice(0, 0), "text", 3)) == []


def test_rewrapped_and_edited_passages(spark):
    """Passages are found wherever their lines break, by paragraphs, by most of their words, and else line by line."""
    story = "It was late when the ship came in and nobody on the pier had thought of a lantern or a rope."
    two = "The first paragraph has two sentences. This is the second of them.\n\nAnother paragraph\nof two lines stands here."
    wrapped = "> It was late when the ship came in and\n> nobody on the pier had thought of a lantern\n> or a rope."
    most = "> It was late when the ship came in and nobody on the pier\n> had thought of a lantern or two."
    m = [
        (1, 0, "user", story), (1, 1, "user", two), (1, 2, "user", wrapped + "\nA reply"), (1, 3, "user", "> Another paragraph of two\n> lines stands here.\nYes"),
        (1, 4, "user", most + "\nNearly"), (1, 5, "user", "> A lantern would not have helped.\n> It was late when the ship came in and nobody\nNo"),
        (1, 6, "user", "> Another paragraph\n> made up, all of it, out of nothing at all\nBy a line"),
        (2, 0, "user", wrapped + "\nFrom elsewhere"), (2, 1, "user", "> late when the ship came\ntoo few words"),
    ]
    rows = quotes.reply_ordered(spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("body", F.lit("x"))).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert {t: got[1, t].parent_turn for t in range(7)} == {0: None, 1: None, 2: 0, 3: 1, 4: 0, 5: None, 6: 1}
    assert (got[2, 0].parent_turn, got[2, 0].source_conv, got[2, 0].source_turn) == (None, 1, 0) and got[2, 1].links is None
    assert [tuple(x) for x in got[1, 2].links] == [(0, 1, 1, 0)] and got[1, 2].body == "A reply"


def brute_quotes(messages):
    """(conv_id, turn) to the earlier message of the conversation that its one quoted passage comes from, if it is whole or re-wrapped."""
    out = {}
    for c, t, _, text in messages:
        quoted = " ".join(x[1:] for x in text.split("\n") if x.startswith(">")).casefold().split()
        if quoted:
            for c2, t2, _, other in sorted(messages):
                own = [x for x in other.split("\n") if not x.startswith(">")]
                if c2 == c and t2 < t and any(" ".join(x.casefold().split()) == " ".join(quoted) for x in [" ".join(own), *own]):
                    out[c, t] = t2
                    break
    return out


def test_planted_quotes_through_the_query(spark, tmp_path):
    """The registered query links what a linker that compares all messages of a conversation links."""
    rng = random.Random(15)
    words = [f"word{i}" for i in range(300)]
    messages = []
    for c in range(40):
        bodies = []
        for t in range(rng.randrange(2, 9)):
            lines = [" ".join(rng.choices(words, k=rng.randrange(2, 14))) for _ in range(rng.randrange(1, 4))]
            text = "\n".join(lines)
            if bodies and rng.random() < 0.6:
                source = rng.choice(bodies)
                quoted = source if rng.random() < 0.5 else rng.choice(source.split("\n"))
                again = quoted.split()
                k = rng.randrange(1, 8)
                text = "\n".join("> " + " ".join(again[i : i + k]) for i in range(0, len(again), k)) + "\n" + text
            bodies.append("\n".join(lines))
            messages.append((c, t, "user", text))
    spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.QUERIES["op9_quotes"](spark, str(tmp_path)).collect()
    want = brute_quotes(messages)
    assert len(rows) == len(messages) and len(want) > 60
    assert {(r.conv_id, r.turn): r.parent_turn for r in rows if r.parent_turn is not None} == want


def test_pipeline_keeps_the_users_columns(spark, tmp_path):
    """Columns named like those that the stages make, repeated rows, empty tables and very long texts."""
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 400").limit(40)
    extra = {"kept_text": "mine", "n_lines": "mine", "__selected": "mine", "__found": "mine", "row": "mine", "h1": "mine", "others": "mine", "length": "mine"}
    docs = docs.withColumns({k: F.lit(v) for k, v in extra.items()})
    long = docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.repeat(F.concat("text", F.lit(" and so on ")), 300))
    docs = docs.unionByName(docs.limit(3)).unionByName(long)
    scratch = Scratch(spark, "t")
    for k, (name, stage) in enumerate(cp.STAGES[:4]):
        before = docs.count()
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.columns == docs.columns and empty.count() == 0, name
        docs = scratch.save(stage(spark, docs, "/root/testdata/sf0.001"), f"s{k}")
        rows = docs.collect()
        assert rows and len(rows) <= before and all(r[c] == v for r in rows for c, v in extra.items()), name
    assert len({r.doc_id for r in rows}) == len(rows) and {r.n_chars == len(r.text) for r in rows} == {True}
    packed = cp.STAGES[4][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}

"""Each operator against a brute-force version on small fixtures, with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from wirelane.llm import ann, graph, langid, line_dedup, minhash, packing, quality, quotes, segment, sharding, shingles, simhash
from wirelane.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared lines, empties and one long text."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near).title())
    texts += [texts[0], texts[0], texts[3].upper(), None, "", " \n\t", "one", "a b c d", "  A  b C d ", " ".join(rng.choice(words) for _ in range(20_000))]
    lines = ["The same line in many documents.", "short", "Another shared line, é!"]
    texts += ["\n".join(rng.choice(lines + [f"own line number {i}"]) for _ in range(6)) for i in range(15)]
    return texts


# Sharding


def test_sharding(spark):
    texts = corpus()
    rows, slots = sharding.shard_records(frame(spark, texts, [None, *range(1, len(texts))]).withColumn("slot", F.lit(1)).withColumn("shard", F.lit("x")), 5, 64)
    rows = rows.collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        text = (texts[r.doc_id or 0] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    for own in by.values():
        assert sorted(r.place for r in own) == list(range(len(own)))
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})
    owner = {r.slot: r.shard for r in slots.table().collect()}
    assert len(owner) == 64
    # A shard more takes slots, all of them into itself; the older version stays.
    stats = {r.slot: (r.bytes, r.rows) for r in slots.table().collect()}
    assert slots.edit(stats, 6) == 2
    new = {r.slot: r.shard for r in slots.table().collect()}
    assert {r.slot: r.shard for r in slots.table(1).collect()} == owner
    assert sharding.shard_records(frame(spark, []), 3)[0].count() == 0


def test_deal_and_rebalance():
    rng = random.Random(2)
    weights = {s: rng.randrange(1, 1000) for s in range(500)}
    load = lambda owner, n: [sum(w for s, w in weights.items() if owner[s] == k) for k in range(n)]
    owner = sharding.deal(weights, 24)
    assert max(load(owner, 24)) - min(load(owner, 24)) <= max(weights.values())
    more = sharding.rebalance(owner, weights, 25)
    assert all(more[s] == 24 for s in weights if more[s] != owner[s])
    assert max(load(more, 25)) <= 1.1 * sum(weights.values()) / 25 + max(weights.values())
    less = sharding.rebalance(owner, weights, 23)
    assert set(less.values()) == set(range(23))


# Line dedup


def brute_lines(rows):
    """(doc_id, text) to {(doc_id, text): (n_lines, n_dropped, kept)}."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(strip)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(d, first.get(key(line), d))
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= d]
        out[d, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    texts = corpus()
    rows = list(enumerate(texts)) + [(5, "The same line in many documents.\nmore of document five"), (7, texts[7])]
    df = frame(spark, [t for _, t in rows], [d for d, _ in rows]).withColumn("h1", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.dedup_lines(df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), batches).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id, r.text], r.doc_id
        assert r.h1 == 1
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, Scratch(spark, "t"), fanout=2)
    for i in range(5):
        docs = frame(spark, ["a line that is shared\nline of document %d" % i], [i])
        runs.add(line_dedup.line_hashes(docs))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    table = runs.table().collect()
    assert len(table) == 6 and len({(r.h1, r.h2) for r in table}) == 6


# SimHash


def brute_fingerprint(text):
    # The operator splits at \s of Java, which is ASCII white space; a text's edges give empty words at its start.
    import re

    words = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
    u64 = lambda x: x & (2**64 - 1)
    votes, n = np.zeros(128, int), 0
    for a, b in zip(words, [*words[1:], None], strict=True):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        other = xxhash.xxh64_intdigest(u64(h).to_bytes(8, "little"), 42)
        votes += np.array([h >> k & 1 for k in range(64)] + [other >> k & 1 for k in range(64)])
        n += 1
    bits = 2 * votes > n
    value = lambda part: sum(1 << k for k, b in enumerate(part) if b)
    return f"{value(bits[:64]):016x}{value(bits[64:]):016x}"


def test_simhash(spark):
    texts = [t for t in corpus(n=20) if t is None or len(t) < 5000]
    df = frame(spark, texts, [3 * i - 20 for i in range(len(texts))]).withColumn("run", F.lit(0)).withColumn("ghost", F.lit(0))
    out = simhash.compare_with_edits(df.repartition(5))
    rows = out.select("*", simhash.as_text(F.col("hi"), F.col("lo")).alias("p"), simhash.as_text(F.col("edited_hi"), F.col("edited_lo")).alias("e")).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for i, r in enumerate(rows):
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.p == brute_fingerprint(text) and r.e == brute_fingerprint(edited)
        assert r.near_edited == near(r.p, r.e) and r.near_next == near(r.p, rows[(i + 1) % len(rows)].p)
    one = simhash.compare_with_edits(frame(spark, ["abcdef"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert simhash.compare_with_edits(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_block_tables(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for _ in range(120):
        x = rng.choice(prints)
        for _ in range(rng.randrange(10)):
            x ^= 1 << rng.randrange(128)
        prints.append(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (2**64 - 1))) for x in prints] + [(None, 1)], "hi long, lo long")
    got = simhash.within_radius(df, df, radius).collect()
    mask = 2**64 - 1
    found = collections.Counter((((r.q_hi & mask) << 64 | r.q_lo & mask), ((r.hi & mask) << 64 | r.lo & mask), r.distance) for r in got)
    want = {(a, b, (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}
    assert set(found) == want and set(found.values()) == {1}


# MinHash


def brute_components(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_minhash(spark, monkeypatch):
    rows = list(enumerate(corpus(n=30)))
    df = frame(spark, [t for _, t in rows]).withColumn("key", F.lit(1)).withColumn("rep", F.lit(1))
    want = brute_components(rows)
    got = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    # Crowded keys and clusters in many small blocks give the same.
    monkeypatch.setattr(minhash, "KEY_BLOCK", 3)
    monkeypatch.setattr(minhash, "SET_BLOCK", 2)
    again = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in again} == want
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def edited(words, n):
    """The words with n of them, far from each other, changed."""
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(words) // (2 * n)] = f"changed{k}"
    return out


def test_pipeline_near_duplicates(spark):
    """Pairs of a similarity from 0.80 to below 0.85 are near-duplicates of the pipeline, not of op10_minhash."""
    import corpus_pipeline as cp

    rows, low = [], set()
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(200 + 7 * k)]
        for n in range(3, 12):
            shingles_ = len(words) - 4
            if 0.80 <= (shingles_ - 5 * n) / (shingles_ + 5 * n) < 0.85:
                low.add(len(rows) + 1)
                rows += [" ".join(words), " ".join(edited(words, n))]
                break
    rows += corpus(n=30)
    rows = list(enumerate(rows))
    want = brute_components(rows, percent=80)
    assert len(low) > 20 and all(want[d][1] == d - 1 for d in low) and all(c == d for d, (_, c) in brute_components(rows).items() if d in low)
    got = {r.doc_id for r in cp.drop_near_duplicates(spark, frame(spark, [t for _, t in rows]), SF).collect()}
    assert got == {d for d, (_, c) in want.items() if c == d}


def test_error_keys_find_all_within_radius():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 256, minhash.SYMBOLS, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        b[at] ^= rng.integers(1, 256, minhash.RADIUS, dtype=np.uint8)
        keys = minhash.error_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40, 90)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(100, x) for x in range(101, 130)]
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
    assert graph.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), "c").count() == 0


def test_shingles():
    h = shingles.WordHashes()
    few = shingles.shingle_set(np.array([h[b"a"], h[b"b"]], np.uint64), 5)
    assert len(few) == 1 and shingles.words("A\x0bb C É".encode()) == ["a".encode(), "b c É".encode().lower().split()[0], "É".encode()]


# Packing


def naive_bfd(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def test_plan():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([8, 17, 64])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 200))]
        counts = collections.Counter(lengths)
        steps = packing.plan(counts, capacity)
        bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for size, rank, n, first, offset in steps:
            for i in range(n):
                bins[first + i].append((offset, size))
                ranks[size].append(rank + i)
        assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items()) and set(ranks) == set(counts)
        for own in bins.values():
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
            assert at <= capacity
        assert len(bins) == naive_bfd(lengths, capacity)


def test_capacity_tree():
    rng = random.Random(5)
    tree, counts = packing.CapacityTree(37), collections.Counter()
    for _ in range(500):
        c = rng.randrange(1, 38)
        n = rng.randrange(1, 4) if not counts[c] or rng.random() < 0.5 else -counts[c]
        tree.add(c, n)
        counts[c] += n
        need = rng.randrange(1, 38)
        assert tree.tightest(need) == min((k for k, v in counts.items() if v and k >= need), default=None)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["It's  FINE!! x́ é≠ Ça…ok... <|endoftext|>a <|x", "ΣΊΣΥΦΟΣ İ ﬁ 12ab'll 'S", "中文 字符　x", "a" * 300, "  \x1c b\x85c", "don't.'re--'", "É É ǅ ß ª"]
    texts = corpus(n=20) + odd
    rows = packing.pack(frame(spark, texts, [None, *range(1, len(texts))]).withColumn("piece", F.lit(1)), path, capacity=64).collect()
    by, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
        assert sorted(by[i or None]) == want, t
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0 and sum(n for _, n in own) <= 64
    assert len(bins) == naive_bfd([r.length for r in rows], 64)
    assert packing.pack(frame(spark, []), path).count() == 0


# Segmentation


@pytest.fixture(scope="module")
def sampler():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return segment.Sampler(segment.Vocabulary(f.read()))


def brute_lattice(vocabulary, unit):
    """For each position its edges (next position, log-probability, ids), by recursion over pieces."""
    n, out = len(unit), []
    ahead = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        found = [(j, hit[1], (hit[0],)) for j in range(i + 1, n + 1) if (hit := vocabulary.pieces.get(unit[i:j]))]
        if unit[i] not in vocabulary.pieces:
            raw = unit[i].encode()
            found.append((i + 1, vocabulary.byte_weight * len(raw), tuple(vocabulary.bytes[b] for b in raw)))
        ahead[i] = math.log(sum(math.exp(w + ahead[j]) for j, w, _ in found))
        out.append([(j, w + ahead[j] - ahead[i], ids) for j, w, ids in found])
    return out[::-1]


def test_lattices(sampler):
    """The lattices that are made at once are those of each unit by itself."""
    units = ["▁the", "▁▁cat", "x", "日本語", "\U0001f600é", "▁antidisestablishmentarianism", "\n", "a" * 40, "▁"]
    a, b, w, piece = sampler.vocabulary.edges(units)
    got, base, n = collections.defaultdict(dict), 0, sum(map(len, units))
    for x, y, p, i in zip(a, b, w, piece, strict=True):
        got[x][y] = (p, (int(i),) if i >= 0 else tuple(sampler.vocabulary.bytes[c] for c in chr(~i).encode()))
    for unit in units:
        for i, edges in enumerate(brute_lattice(sampler.vocabulary, unit)):
            want = {base + j if j < len(unit) else n: (p, ids) for j, p, ids in edges}
            assert set(want) == set(got[base + i])
            assert all(got[base + i][y][1] == ids and abs(got[base + i][y][0] - p) < 1e-9 for y, (p, ids) in want.items())
        base += len(unit)


def every_path(vocabulary, text):
    out = {(): 0.0}
    for unit in vocabulary.units(text):
        lattice, ends = brute_lattice(vocabulary, unit), {}

        def go(i, ids, w):
            if i == len(unit):
                ends[ids] = w
                return
            for j, more, piece in lattice[i]:
                go(j, ids + piece, w + more)

        go(0, (), 0.0)
        out = {a + b: x + y for a, x in out.items() for b, y in ends.items()}
    return out


def test_sampling_law(sampler):
    """First paths follow the lattice's law, second ones that law without the first; inclusion weighs rightly."""
    text, n = "the cat", 20_000
    law = every_path(sampler.vocabulary, text)
    assert abs(sum(map(math.exp, law.values())) - 1) < 1e-9
    first, second, mass = collections.Counter(), collections.Counter(), 0.0
    seeds = shingles.mix(np.arange(n).astype(np.uint64))
    for at in range(0, n, 500):
        for paths, after in sampler.sample([text] * 500, seeds[at : at + 500], 3):
            ids = [tuple(sampler.ids([p.edges])[0].tolist()) for p in paths]
            assert len(set(ids)) == 3 and [p.value for p in paths] == sorted((p.value for p in paths), reverse=True) and paths[-1].value >= after
            for path, i in zip(paths, ids, strict=True):
                assert abs(law[i] - path.total) < 1e-9
                mass += math.exp(path.total) / -math.expm1(-math.exp(path.total - after)) / n
            first[ids[0]] += 1
            second[ids[0], ids[1]] += 1
    cells = [(first[i], n * math.exp(w)) for i, w in law.items() if n * math.exp(w) > 5]
    assert sum((o - e) ** 2 / e for o, e in cells) < len(cells) + 5 * math.sqrt(2 * len(cells))
    cells = [(second[a, b], n * math.exp(x + y) / (1 - math.exp(x))) for a, x in law.items() for b, y in law.items() if a != b]
    cells = [(o, e) for o, e in cells if e > 5]
    assert sum((o - e) ** 2 / e for o, e in cells) < len(cells) + 5 * math.sqrt(2 * len(cells))
    assert abs(mass - 1) < 0.05


def test_few_and_no_segmentations(sampler):
    law = every_path(sampler.vocabulary, "ab")
    (paths, after), (none, _) = sampler.sample(["ab", ""], np.array([1, 2], np.uint64), 50)
    assert len(paths) == len(law) and after == -math.inf
    assert {tuple(sampler.ids([p.edges])[0].tolist()) for p in paths} == set(law)
    assert len(none) == 1 and not len(none[0].edges)


def test_window_changes_nothing(sampler, monkeypatch):
    """Regions are looked at in a window first; the paths and values are those of looking at all."""
    texts = ["the cat sat on a mat " * n for n in (1, 3, 40)] + ["日本" * 300, "\n" * 400, "\n" * 300 + "ab", "a" * 700]
    seeds = shingles.mix(np.arange(len(texts)).astype(np.uint64))
    found = []
    for window in (1, 5, 192, 1 << 20):
        monkeypatch.setattr(segment, "WINDOW", window)
        found.append([([(p.edges.tolist(), p.total, p.value) for p in paths], after) for paths, after in sampler.sample(texts, seeds, 6)])
    assert all(x == found[-1] for x in found)


def test_segmentations_decode(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["Hello  world\nfoo bar é x  ", "", None, "日本語 テキスト \U0001f600", "a" * 500, " lead", "x", "x"]
    df = frame(spark, texts).withColumn("ids", F.lit(1)).select("doc_id", "text", "ids")
    out = segment.sample_segmentations(df.repartition(3), path, ["doc_id"], 4)
    rows = out.withColumn("back", segment.decode(out, path)).orderBy("doc_id", "sample").collect()
    assert sorted({r.doc_id for r in rows}) == list(range(len(texts)))
    for r in rows:
        assert r.back == (texts[r.doc_id] or "") and 0 < r.inclusion <= 1
    assert len([r for r in rows if r.doc_id == 2]) == 1
    short = {(r.doc_id, r.sample): r for r in segment.sample_segmentations(df, path, ["doc_id"], 4, digest=True).collect()}
    assert len(short) == len(rows)
    for r in rows:
        d = short[r.doc_id, r.sample]
        assert (d.n_pieces, d.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        assert d.decoded_sha256 == hashlib.sha256(r.back.encode()).hexdigest() and d.inclusion == r.inclusion
    long = frame(spark, ["日本" * 20_000, "word " * 40_000]).withColumn("sample", F.lit("clash"))
    found = segment.sample_segmentations(long, path, ["doc_id"], 2)
    assert {(r.doc_id, r.back) for r in found.select("doc_id", segment.decode(found, path).alias("back")).collect()} == {(0, "日本" * 20_000), (1, "word " * 40_000)}
    again = segment.sample_segmentations(df.coalesce(1), path, ["doc_id"], 4).orderBy("doc_id", "sample").collect()
    assert [tuple(r)[:-1] for r in again] == [tuple(r)[:-2] for r in rows] or [r.ids for r in again] == [r.ids for r in rows]


# Language


def test_viterbi():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        scores = rng.normal(0, 3, (n, k)).astype(np.float32)
        worth = lambda path: sum(scores[t, x] for t, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(worth(path) for path in np.ndindex(*[k] * n))
        assert abs(worth(list(langid.viterbi(scores, 2.0))) - best) < 1e-4


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    found = docs.select("lang", langid.held_out(F.col("doc_id")).alias("out"), langid.identify(docs, model).alias("f")).where("out").collect()
    assert sum(r.lang == r.f.lang for r in found) >= 0.95 * len(found) > 0
    french = docs.where("lang = 'fr' and n_chars > 600").first().text[:300]
    german = docs.where("lang = 'de' and n_chars > 600").first().text[:300]
    odd = frame(spark, [None, "", "123 !! 45", french + " 77 " + german]).withColumn("score", F.lit(1))
    rows = [r.f for r in odd.orderBy("doc_id").select(langid.identify(odd, model).alias("f")).collect()]
    assert [r.lang for r in rows[:3]] == ["und"] * 3 and [r.score for r in rows[:3]] == [0, 0, 0]
    assert [s.lang for s in rows[3].spans] == ["fr", "de"] and 0.3 < rows[3].score < 0.7
    assert rows[3].spans[0].first_word == 0 and rows[3].spans[1].last_word == len((french + " 77 " + german).split()) - 1
    assert langid.fit(docs.limit(0)) is None
    assert frame(spark, ["abc"]).select(langid.identify(frame(spark, ["abc"]), None).alias("f")).first().f.lang == "und"
    held = docs.where(langid.held_out(F.col("doc_id")))
    assert langid.fit(held) is None


def test_scripts():
    grams = langid.Grams(["abc", "привет", "日本"])
    assert [langid.SCRIPTS[s] for s in grams.scripts] == ["Latin", "Cyrillic", "Han"]
    assert langid.letters("Don't!") == "dont"


# Quality


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("key", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.select(docs, labels).join(labels, "doc_id", "left").collect()
    good = [r.selected for r in rows if r.quality == 1 and not r.toxic]
    bad = [r.selected for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)
    by_key = sorted((r for r in rows), key=lambda r: (-r.key, r.doc_id))
    k = sum(r.selected for r in rows)
    assert all(r.selected for r in by_key[:k]) and not any(r.selected for r in by_key[k:])
    # Row by row decisions are the same, and texts without an n-gram are not selected.
    selector = quality.fit(docs, labels)
    _, _, selected = selector.columns(docs)
    assert {r.doc_id for r in docs.where(selected).collect()} == {r.doc_id for r in rows if r.selected}
    few = frame(spark, [None, "", "ab", "ab"], [1, 2, 3, 3])
    got = quality.select(few, labels.limit(0)).collect()
    assert sorted((r.doc_id, r.selected) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert quality.select(few.limit(0), labels).count() == 0


def test_toxic_texts(spark):
    """A toxic text of good quality goes, however long its clean remainder is; clean ones stay."""
    rng = random.Random(7)
    words, insults = vocabulary(rng, 400), ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(1600):
        text = [rng.choice(words) for _ in range(rng.choice([20, 200, 2000]))]
        kind = i % 4  # 0: junk, 1: toxic, 2 and 3: good
        if kind == 0:
            text = [rng.choice(["zzq", "qqx", "xxz"]) for _ in text]
        if kind == 1:
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append(" ".join(text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    out = quality.select(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = [np.mean([r.selected for r in out if r.doc_id % 4 == k]) for k in range(4)]
    assert kept[0] <= 0.05 and kept[1] <= 0.05 and min(kept[2:]) >= 0.95, kept


def test_toxic_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.select(docs, labels).join(labels, "doc_id").where("quality = 1").collect()
    toxic, clean = ([r.selected for r in rows if r.toxic == x] for x in (1, 0))
    # About a fifth of the toxic labels are of texts without any of the words that tell the others.
    assert np.mean(toxic) <= 0.35 and np.mean(clean) >= 0.95, (np.mean(toxic), np.mean(clean))


def test_weights_and_noise(spark):
    target, raw = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    np.add.at(target, quality.buckets(b"good words here"), 1)
    np.add.at(raw, quality.buckets(b"good words here, bad ones too"), 1)
    ratio = quality.log_ratio(target, raw)
    assert ratio[quality.buckets(b"good words")].sum() > 0 > ratio[quality.buckets(b"bad ones too")].sum()
    assert quality.buckets(b"a a a")[-1] == quality.BUCKETS - 1 and len(quality.buckets(b"")) == 0
    noise = [r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"))).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.03 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.03
    assert quality.threshold(np.array([1.0, 2, 3]), np.array([-3.0, -2])) == -0.5


def test_top_k(spark):
    rng = random.Random(6)
    keys = [(i, float(rng.randrange(20))) for i in range(200)]
    df = spark.createDataFrame(keys, "doc_id long, key double")
    for k in (0, 1, 57, 200, 300):
        cut = quality.top_k_cut(df, k, Scratch(spark, "t"))
        want = sorted(keys, key=lambda r: (-r[1], r[0]))[:k]
        got = [r for r in keys if cut and (r[1] > cut[0] or r[1] == cut[0] and r[0] <= cut[1])]
        assert sorted(got) == sorted(want)


# Nearest neighbours


def test_search(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 3, (30, 8))
    vectors = [(i, (centres[i % 30] + rng.normal(0, 1, 8)).astype(np.float32).tolist()) for i in range(3000)]
    same = vectors[100][1]
    vectors += [(4000 + i, same) for i in range(60)]
    vectors += [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0]), (None, same), (100, same)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("v", F.lit(1))
    rows = ann.search(df, lambda i: i % 100 == 0).collect()
    x = {i: np.array(v, np.float64) for i, v in vectors if i is not None and i not in (5000, 5100, 5200, 5300)}
    ids = np.array(sorted(x))
    data = np.stack([x[i] for i in ids])
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and abs(r.score - np.linalg.norm(x[r.query_id] - x[r.vec_id])) < 1e-12
    hit = total = 0
    for q in (i for i in ids if i % 100 == 0):
        far = np.sqrt(((data - x[q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        want = ids[np.lexsort((ids, far))[:10]]
        assert len(got[q]) == 10
        hit += len(set(want) & {v for v, _ in got[q]})
        total += 10
    assert hit >= 0.93 * total
    assert [v for v, _ in got[100]] == list(range(4000, 4010))
    assert set(got) == {i for i in ids if i % 100 == 0}


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(few, lambda i: i == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(few.limit(0), lambda i: i == 0).count() == 0


def test_best_bin_first():
    rng = np.random.default_rng(8)
    data = rng.normal(0, 1, (4000, 6))
    tree = ann.Tree(data, len(data))
    leaf = tree.assign(data)
    assert tree.leaves > 8 and set(leaf) <= set(range(tree.leaves))
    order = tree.visit(data[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visit(data[0], 3) == order[:3]
    assert np.mean([tree.visit(data[i], 1)[0] == leaf[i] for i in range(100)]) > 0.9


# Quotes


def test_quotes(spark):
    m = [
        (1, 0, "user", "The first question is here.\nAnd a second line."),
        (1, 1, "assistant", "Ann wrote:\n> The first   QUESTION is here.\n\nMy answer to that."),
        (1, 2, "user", "Something of its own."),
        (1, 3, "assistant", ">> The first question is here.\n> My answer to that.\nI agree with it."),
        (1, 4, "user", "> Something of its own.\nYes, that."),
        (2, 0, "user", "> The first question is here.\nSeen elsewhere."),
        (2, 1, "user", "> never said by anybody\nhm"),
        (3, 0, "user", None),
        (3, 0, "user", None),
        (4, 0, "user", ""),
        (None, 0, "user", "x"),
        (5, None, "user", "x"),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1)).withColumn("path", F.lit("x"))
    rows = quotes.reply_ordered(df).orderBy("conv_id", "position").collect()
    assert len(rows) == 10
    first = [(r.turn, r.parent_turn, r.depth, r.body) for r in rows if r.conv_id == 1]
    assert first == [
        (0, None, 0, "The first question is here.\nAnd a second line."), (1, 0, 1, "My answer to that."), (3, 1, 2, "I agree with it."),
        (2, None, 0, "Something of its own."), (4, 2, 1, "Yes, that."),
    ]
    other = [(r.turn, r.parent_turn, r.source_conv, r.source_turn, r.body) for r in rows if r.conv_id == 2]
    assert other == [(0, None, 1, 0, "Seen elsewhere."), (1, None, None, None, "hm")]
    assert [r.position for r in rows if r.conv_id == 3] == [0, 1]
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_quotes_long_chain(spark):
    """Each message quotes the one before: paths are doubled, not walked."""
    m = [(1, 0, "user", "message number 0 of the chain")] + [(1, i, "user", f"> message number {i - 1} of the chain\nmessage number {i} of the chain") for i in range(1, 40)]
    rows = quotes.reply_ordered(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [(r.turn, r.depth) for r in rows] == [(i, i) for i in range(40)]


def replies(spark, messages):
    rows = quotes.reply_ordered(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    return {(r.conv_id, r.turn): r for r in rows}


def test_short_quotes(spark):
    """Short lines link inside their conversation alone, and do not outvote longer ones."""
    got = replies(spark, [
        (1, 0, "user", "Something else\nBye"), (1, 1, "user", "Thanks!"), (1, 2, "user", "好。"), (1, 3, "user", "A line long enough to tell"),
        (1, 4, "user", "> thanks!\nWelcome"), (1, 5, "user", "> 好。\nFine"), (1, 6, "user", ">\n> \nnothing quoted"),
        (1, 7, "user", "> Thanks!\n> A line long enough to tell\nBoth"), (2, 0, "user", "> Thanks!\nFrom elsewhere"),
    ])
    assert {t: got[1, t].parent_turn for t in range(8)} == {0: None, 1: None, 2: None, 3: None, 4: 1, 5: 2, 6: None, 7: 3}
    assert got[1, 4].source_conv is None and (got[2, 0].parent_turn, got[2, 0].source_conv) == (None, None)


def test_deep_quotes(spark):
    """Where the shallowest level matches nothing the next one decides, and all levels are linked."""
    got = replies(spark, [
        (1, 0, "user", "The first thing that was said."), (1, 1, "user", "The second thing that was said."),
        (1, 2, "user", "> Some words edited by hand\n>> The first thing that was said.\nA reply"),
        (1, 3, "user", "> The second thing that was said.\n>> The first thing that was said.\n>>> never said at all\nAnother"),
        (1, 4, "user", ">> edited as well, this one\n>>> The second thing that was said.\nDeep"),
        (2, 0, "user", "A line of the second conversation."), (1, 5, "user", "> A line of the second conversation.\n>> The first thing that was said.\nBoth"),
    ])
    assert {t: got[1, t].parent_turn for t in range(6)} == {0: None, 1: None, 2: 0, 3: 1, 4: 1, 5: 0}
    assert {t: [tuple(x) for x in got[1, t].links or []] for t in range(2, 6)} == {2: [(1, 2, 1, 0)], 3: [(0, 1, 1, 1), (1, 2, 1, 0)], 4: [(1, 3, 1, 1)], 5: [(0, 1, 2, 0), (1, 2, 1, 0)]}
    assert (got[1, 5].source_conv, got[1, 5].source_turn) == (2, 0) and got[1, 2].source_conv is None


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = frame(spark, [None, "", "123 456"], [-1, -2, -3]).unionByName(frame(spark, ["text without an id"], [None]))
    docs = docs.unionByName(extra)
    start = docs.columns
    scratch = Scratch(spark, "t")
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = scratch.save(stage(spark, docs, SF), f"s{k}")
        if k < 4:
            assert docs.columns == start, name
        after = docs.collect()
        if name == "line dedup":
            want = {d: kept for (d, _), (_, _, kept) in brute_lines(before).items() if kept.strip(" \t\n\x0b\x0c\r")}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "MinHash near-dedup":
            want = brute_components(before)
            assert {r.doc_id for r in after} == {d for d, (_, c) in want.items() if c == d}
        elif name == "best-fit packing":
            assert {r.doc_id for r in after} == {d for d, _ in before}
        else:
            kept = {r.doc_id for r in after}
            gone = {-1, -2, None} if name == "quality classifier" else {-1, -2, -3, None}  # no text; no letter
            assert kept and kept <= {d for d, _ in before} and not kept & gone
    assert cp.run(spark, SF).count() > 0

"""Language identification: scripts narrow the candidates, word scores and Viterbi label spans.

A word's score for a language is the log-likelihood of its hashed character n-grams. The languages
of the word's script, as learned, are its candidates. Viterbi decoding with a penalty for each
switch then labels the words; runs of one label are the spans of a mixed-language text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelane.llm.common import give_back, ship, slices, tidy, worker_cache

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
_TIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
#: Values of lang that are learned at most, those of the most documents: the bound of what is collected.
MAX_LANGS = 512
#: About so many documents of each language, drawn by a hash of doc_id, are learned from.
FIT_DOCS = 3000
#: A language has a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.01
#: What a change of language costs, in nats, and how much of an n-gram's log-likelihood counts, as n-grams overlap.
SWITCH, SCALE = 12.0, 0.5
#: Remembered words of a worker, forgotten beyond, and texts that are labelled together.
CACHE_WORDS, TOGETHER = 400_000, 500

# The first code points of Unicode's script ranges, as far as they are told apart.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Aboriginal"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1DC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xA8E0, "Devanagari"), (0xA900, "Other"), (0xA960, "Hangul"), (0xA980, "Javanese"), (0xA9E0, "Myanmar"), (0xAA00, "Other"),
    (0xAA60, "Myanmar"), (0xAA80, "Other"), (0xAB00, "Ethiopic"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"),
    (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFEFF, "Latin"), (0xFF66, "Katakana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([at for at, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def letters(word: str) -> str:
    """The word's letters and the marks among them, lowered; empty without a letter, whatever marks there are."""
    if word.isalpha():
        return word.lower()
    if not any(map(str.isalpha, word)):
        return ""
    return "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M").lower()


class Grams:
    """The n-grams of 1 to 3 characters of words, ends included, for many words at once.

    kinds holds, for n of 1 to 3, the bucket of the n-gram that begins at each character, BUCKETS where
    none does; starts tells where each word begins, scripts the number of its main script.
    """

    def __init__(self, words: list[str]):
        text = "".join(f"<{w}>" for w in words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.ones(len(points), bool)
        inner[self.starts] = inner[self.starts + sizes - 1] = False
        n = len(points)
        self.kinds = []
        mixed = np.zeros(n, np.uint32)
        for k in range(3):
            mixed[: n - k] += points[k:] * _TIMES[k]
            bucket = ((mixed ^ np.uint32(k)) * _TIMES[3]) >> np.uint32(32 - BUCKET_BITS)
            whole = inner.copy() if not k else np.zeros(n, bool)
            if k:
                whole[: n - k] = self.owner[: n - k] == self.owner[k:]
            self.kinds.append(np.where(whole, bucket, BUCKETS).astype(np.int64))
        names = _SCRIPT_OF[np.searchsorted(_STARTS, points[inner], "right") - 1]
        counts = np.bincount(self.owner[inner] * len(SCRIPTS) + names, minlength=len(words) * len(SCRIPTS))
        self.scripts = counts.reshape(len(words), len(SCRIPTS)).argmax(axis=1)


class Model:
    """Languages, per-language log-likelihoods of buckets, and which languages have which scripts."""

    def __init__(self, langs: list[str], logs: np.ndarray, has_script: np.ndarray):
        self.langs, self.has_script = langs, has_script
        self.logs = np.vstack([logs, np.zeros((1, len(langs)), np.float32)])  # no n-gram: nothing

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word (of letters, not empty), relative to its best language."""
        grams = Grams(words)
        rows = np.add.reduceat(sum(self.logs[k] for k in grams.kinds), grams.starts, axis=0) * SCALE
        usual = self.has_script[grams.scripts]
        # A candidate must be usual in the word's script, if any is.
        rows -= np.where(usual | ~usual.any(axis=1, keepdims=True), 0, 3 * SWITCH).astype(np.float32)
        return rows - rows.max(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels with the highest sum of scores less `switch` for each change."""
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    # If no stretch is better by over half a switch under another label, no change pays.
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    if (gain - np.vstack([np.zeros((1, k)), lowest[:-1]])).max() <= switch / 2:
        return np.full(n, best, np.int64)
    back = np.empty(scores.shape, np.int32)
    total = [float(x) for x in scores[0]]
    labels = range(k)
    for t, row in enumerate(scores.tolist()):
        if not t:
            continue
        top = max(labels, key=total.__getitem__)
        jump = total[top] - switch
        for j in labels:
            if total[j] >= jump:
                back[t, j] = j
            else:
                back[t, j] = top
                total[j] = jump
            total[j] += row[j]
    out = np.empty(n, np.int64)
    out[-1] = max(labels, key=total.__getitem__)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


class Labeller:
    """Labels texts by a model. Words are remembered by the row of their letters: 0 for those without."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.cores: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1, np.int32)

    def learn(self, words: set[str]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.rows]
        cores = list(map(letters, new))
        fresh = [c for c in dict.fromkeys(cores) if c not in self.cores]
        if fresh:
            at = len(self.cores)
            self.cores.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            parts = [self.model.scores(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self.scores = np.concatenate([self.scores, *parts])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, fresh), np.int32, len(fresh))])
        self.rows.update(zip(new, map(self.cores.__getitem__, cores), strict=True))

    def label_all(self, texts: list[str | None]) -> list[dict]:
        """What is not remembered is looked up for all texts at once."""
        words = [t.split() if t else [] for t in texts]
        self.learn(set().union(*words))
        return [self.label(w) for w in words]

    def label(self, words: list[str]) -> dict:
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        some = np.flatnonzero(at)
        if not len(some):
            return {"lang": "und", "score": 0.0, "spans": []}
        at = at[some]
        labels = viterbi(self.scores[at], SWITCH)
        share = np.bincount(labels, self.letters[at], len(self.model.langs))
        best = int(share.argmax())
        cuts = np.flatnonzero(np.diff(labels)) + 1
        spans = [{"lang": self.model.langs[labels[a]], "first_word": int(some[a]), "last_word": int(some[b - 1])} for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)], strict=True)]
        return {"lang": self.model.langs[best], "score": float(share[best] / share.sum()), "spans": spans}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: how often each bucket and, beyond BUCKETS, each script occurs."""
    tables: dict[str, np.ndarray] = {}
    for batch in tidy(batches):
        for lang, rows in groupby(sorted(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)), key=lambda r: r[0]):
            table = tables.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
            words: Counter = Counter()
            for _, text in rows:
                words.update(text.split())
            cores: Counter = Counter()
            for word, n in words.items():
                if core := letters(word):
                    cores[core] += n
            if cores:
                grams, n = Grams(list(cores)), np.fromiter(cores.values(), np.int64, len(cores))
                for k in grams.kinds:
                    table[:BUCKETS] += np.bincount(k, n[grams.owner], BUCKETS + 1)[:BUCKETS].astype(np.int64)
                table[BUCKETS:] += np.bincount(grams.scripts, n * np.fromiter(map(len, cores), np.int64, len(cores)), len(SCRIPTS)).astype(np.int64)
    for lang, table in tables.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(table[at])], ["lang", "bucket", "n"])


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a quarter, by their id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """Learn from text and lang of documents that are not held out; None if there are none.

    Of each language about fit_docs documents are used, drawn by a hash of their id; of more than MAX_LANGS
    values of lang those of the most documents are learned (of equals the first by name). What is
    collected is at most BUCKETS counts for each language, and of those only the ones that occur.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return None
    per_million = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1_000_000, -(-1_000_000 * fit_docs // n)))))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < F.element_at(per_million, F.col("lang")))
    counts = drawn.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect()
    langs = sorted({r[0] for r in counts})
    if not langs:
        return None
    table, column = np.zeros((BUCKETS + len(SCRIPTS), len(langs))), {lang: i for i, lang in enumerate(langs)}
    for lang, bucket, n in counts:
        table[bucket, column[lang]] = n
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, logs, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


RESULT = "lang string, score double, spans array<struct<lang: string, first_word: int, last_word: int>>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32())])))])


def _label_all(model, token: str, texts: pa.Array) -> pa.Array:
    label_all = worker_cache(("labeller", token), lambda: Labeller(model())).label_all
    out: list[dict] = []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", TOGETHER):
        out += label_all(part.column(0).to_pylist())
    give_back()
    return pa.array(out, _ARROW)


def identify(docs: DataFrame, model: Model | None) -> Column:
    """A column for docs: struct (lang, score, spans) of its whole text.

    score is the share of the text's letters in spans of that language; of equal shares the first by name
    wins. A null text and one without a letter, marks or not, are `und` with score 0 and no span; so is every
    text if nothing was learned. Words are counted from 0, between white space. Texts may have any length, and
    only the column `text` is read: names of other columns do not matter. Repeated rows get the same.
    """
    if model is None:
        return F.expr("named_struct('lang', 'und', 'score', 0D, 'spans', cast(array() as array<struct<lang: string, first_word: int, last_word: int>>))")
    sent = ship(docs.sparkSession, model)  # BUCKETS rows, a column per language
    token = str(zlib.crc32(model.logs.tobytes()))

    def run(texts: pa.Array) -> pa.Array:
        return _label_all(sent, token, texts)

    return F.arrow_udf(run, f"struct<{RESULT}>")(docs["text"].cast("string"))

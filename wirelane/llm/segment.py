"""SentencePiece encoding with sampled segmentations, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces. Gumbel top-k draws k of
them without replacement: each path's log-probability gets Gumbel noise, and the k largest are
wanted. They are found by A-star search over regions of the lattice, without a list of all paths. A
region is a prefix and the edges already taken after it; its priority is the largest perturbed value
in it, which is drawn from a Gumbel at the region's log-mass, cut off at the value of the region
it was split from. The first path of a region inherits its value, so regions popped in order of
priority emit paths in order of their values.

No piece of the vocabulary reaches across white space, so the lattice falls into units, about a
word each, whose states and edges are remembered. The lattices of many units are made at once, and paths of
many texts are drawn step by step at once. All randomness is a hash of the row's key and the step, so
results do not depend on partitioning. Counters tell 2^24 units of a text and 2^23 steps of a unit apart.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelane.llm.common import slices, worker_store
from wirelane.llm.shingles import U64, mix

SPACE = "▁"
UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
SAMPLES = 4
#: Log weights are multiplied by this: below 1 it brings out rarer segmentations.
ALPHA = 0.3
#: Remembered edges of a worker, of about 30 bytes; forgotten beyond.
CACHE_EDGES = 4_000_000
#: Units whose lattices are made together.
LEARN_TOGETHER = 5_000
#: Bits of a counter for the steps of a unit and for its number.
STEP_BITS, UNIT_BITS = 24, 24
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Gumbel noise of uniform() is at most 53 log 2 = 36.7.
MOST_NOISE = 37.0
#: Of a path so many edges are looked at first for regions beside it, the others only if one of them could matter.
WINDOW = 192
#: Texts that are sampled together, and their bytes.
TOGETHER, TOGETHER_BYTES = 128, 1 << 19


class Vocabulary:
    """Pieces with a log weight: that of the Zipf law at the piece's rank, which the file holds as its score."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = np.zeros(256, np.int32)
        worst = 0.0
        p = self.processor
        for i in range(p.get_piece_size()):
            if p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                continue
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                continue
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece reaches across white space: texts do not fall into units")
            weight = -alpha * math.log(2 - p.get_score(i))
            worst = min(worst, weight)
            self.pieces[piece] = (i, weight)
        self.byte_weight = worst - alpha
        self.longest = max(map(len, self.pieces))
        self._tries()

    def _tries(self) -> None:
        """For each length the sorted hashes of all beginnings of pieces, and the id and weight of those that are pieces themselves."""
        beginnings: list[dict[str, str | None]] = [{} for _ in range(self.longest + 1)]
        for piece in self.pieces:
            for n in range(1, len(piece)):
                beginnings[n].setdefault(piece[:n], None)
            beginnings[len(piece)][piece] = piece
        self.trie = []
        for some in beginnings[1:]:
            texts = list(some)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
            hashes = (_mixed(points) * _powers(_BASE, points.shape[1])).sum(axis=1, dtype=U64)
            order = np.argsort(hashes)
            found = [self.pieces[t] if some[t] else (-1, 0.0) for t in texts]
            self.trie.append((hashes[order], np.array([f[0] for f in found], np.int32)[order], np.array([f[1] for f in found])[order]))

    def edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of many units, none empty: (from, to, log-probability, piece) of all edges, ordered by `from`, those of the longest pieces first.

        Positions count through all units; at a unit's end `to` is the number of positions. A piece below 0 is a
        character that no piece holds, written in bytes: its complement is the code point.
        """
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        n = len(points)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.repeat(np.cumsum(sizes), sizes)
        before = np.zeros(n + 1, U64)
        np.cumsum(_mixed(points) * _powers(_BASE, n), out=before[1:], dtype=U64)
        back = _powers(_INVERSE, n)
        alive = np.arange(n)
        left, right, weight, piece = [], [], [], []
        for size, (hashes, ids, weights) in enumerate(self.trie, 1):
            alive = alive[alive + size <= ends[alive]]
            if not len(alive):
                break
            key = (before[alive + size] - before[alive]) * back[alive]
            at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            known = hashes[at] == key
            if size == 1:
                lone = np.ones(n, bool)
                lone[alive[known & (ids[at] >= 0)]] = False
                lone = np.flatnonzero(lone)
                code = points[lone].astype(np.int64)
                width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
                left, right, weight, piece = [lone], [lone + 1], [self.byte_weight * width], [(~code).astype(np.int32)]
            alive, at = alive[known], at[known]
            whole = ids[at] >= 0
            left.append(alive[whole])
            right.append(alive[whole] + size)
            weight.append(weights[at[whole]])
            piece.append(ids[at[whole]])
        a, b, w, ids = map(np.concatenate, (left, right, weight, piece))
        size = b - a
        b = np.where(b == ends[a], n, b)
        # Log-mass from each position to its unit's end: positions as far from it together, the nearest first.
        far = (ends - np.arange(n))[a]
        order = np.argsort((far * n + a) * (self.longest + 1) - size)
        a, b, w, ids, far = a[order], b[order], w[order], ids[order], far[order]
        ahead = np.zeros(n + 1)
        first = np.flatnonzero(np.diff(a, prepend=-1))  # one run of edges for each position
        cuts = np.searchsorted(far[first], np.arange(1, far[-1] + 2))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if x < y:
                i, j = first[x], first[y] if y < len(first) else len(a)
                w[i:j] += ahead[b[i:j]]
                ahead[a[first[x:y]]] = np.logaddexp.reduceat(w[i:j], first[x:y] - i)
        w = np.minimum(w - ahead[a], 0.0)
        # Each position's run moves to where the positions are in their own order.
        edges = np.bincount(a, minlength=n)
        to = np.arange(len(a)) + np.repeat((np.cumsum(edges) - edges)[a[first]] - first, edges[a[first]])
        out = tuple(np.empty_like(x) for x in (a, b, w, ids))
        for moved, x in zip(out, (a, b, w, ids), strict=True):
            moved[to] = x
        return out

    def units(self, text: str) -> list[str]:
        return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _mixed(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U64) + U64(1))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included, each a hash of its seed and counter."""
    return ((mix(seed + counter * _GOLDEN) >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def cut_gumbel(place: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise at a place, given that it is below `most`."""
    with np.errstate(over="ignore", divide="ignore"):
        # With rate = exp(place - most): most - log(1 - log(u) / rate), kept apart for tiny rates.
        x = -np.log(u)
        far = place - most
        return np.where(far > -30, most - np.log1p(x * np.exp(-np.maximum(far, -30))), place - np.log(x))


class Drawn:
    """A drawn path: its edges, where it left the path that it was split from, and its own regions; units, rest and before end where no region can matter."""

    def __init__(self, edges: np.ndarray, units: np.ndarray, start: int, total: float, value: float, rest: np.ndarray, before: np.ndarray):
        self.edges, self.units, self.start, self.total, self.value = edges, units, start, total, value
        self.rest, self.before = rest, before  # of edges[start:]: value of the region beside, log-probability before
        self.taken: dict[int, set[int]] = {}


class Job:
    """A path to draw: the edges kept of an older path, their log-probability, the path's value, the state to go on from (-1: a unit's start) and its unit.

    beside: what the last kept edge leaves beside it: the value of that region, the log-probability before it, and the edges that are taken.
    """

    def __init__(self, doc: int, kept: np.ndarray, units: np.ndarray, before: float, value: float, state: int, unit: int):
        self.doc, self.kept, self.units, self.before, self.value, self.state, self.unit = doc, kept, units, before, value, state, unit
        self.beside: tuple[float, float, set[int]] | None = None
        self.total = before


class Sampler:
    """Edges of remembered units in flat arrays, whose memory is taken as it fills; they grow only for units beyond CACHE_EDGES. State s has the edges first[s] to first[s + 1] - 1; state 0 is the end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        room = CACHE_EDGES + CACHE_EDGES // 4
        self.first = np.zeros(room, np.int64)
        self.upto, self.log = np.zeros(room), np.zeros(room)  # cumulative probability in the state; beyond 1 at its last edge
        self.next, self.piece = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.forget()

    def forget(self) -> None:
        """Begin anew in the same arrays."""
        self.start: dict[str, int] = {}
        self.states, self.size = 1, 0
        self.first[:2] = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held[:at], np.zeros(len(values) + at // 4, held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def learn(self, docs: list[list[str]]) -> None:
        """Remember the units of all docs."""
        if self.size > CACHE_EDGES:
            self.forget()
        new = list(set().union(*docs).difference(self.start))
        for k in range(0, len(new), LEARN_TOGETHER):
            some = new[k : k + LEARN_TOGETHER]
            a, b, w, piece = self.vocabulary.edges(some)
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            n, base = int(sizes.sum()), self.states
            edges = np.bincount(a, minlength=n)
            last = np.cumsum(edges)
            upto = np.exp(w)
            at = last - edges
            while len(at):  # sums in each state by itself, so that they are the same whatever is learnt together
                more = edges > 1
                at, edges = at[more] + 1, edges[more] - 1
                upto[at] += upto[at - 1]
            upto[last - 1] = 2.0
            self.start.update(zip(some, (base + np.cumsum(sizes) - sizes).tolist(), strict=True))
            self._put("first", base + 1, self.size + last)
            for name, values in (("upto", upto), ("log", w), ("next", np.where(b < n, base + b, 0)), ("piece", piece)):
                self._put(name, self.size, values)
            self.states, self.size = base + n, self.size + len(a)

    def ids(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of many paths' edges one after the other, characters without one as the pieces of their bytes, and how many each path has."""
        out = self.piece[np.concatenate([np.zeros(0, np.int64), *paths])]
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        odd = out < 0
        if odd.any():
            code = (~out[odd]).astype(np.uint32)
            width = np.ones(len(out), np.int64)
            width[odd] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            raw = code.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ends = np.concatenate([[0], np.cumsum(width)])
            out = np.repeat(out, width)
            out[out < 0] = self.vocabulary.bytes[np.frombuffer(raw, np.uint8)]
            sizes = np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])
        return out, sizes

    def draw(self, state: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each start state to its unit's end, in order of starts and steps: (where each start's begin, and their number at last; edges)."""
        n_starts = len(state)
        who = np.flatnonzero(state > 0)
        state, seed, counter = state[who], seed[who], counter[who]
        got_who, got_edge, step = [], [], 0
        while len(state):
            u = uniform(seed, counter + U64(2 * step))
            edge = self.first[state]
            late = np.flatnonzero(u >= self.upto[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= self.upto[edge[late]]]
            got_who.append(who)
            got_edge.append(edge)
            state = self.next[edge]
            live = np.flatnonzero(state)
            who, state, seed, counter = who[live], state[live], seed[live], counter[live]
            step += 1
        if not got_who:
            return np.zeros(n_starts + 1, np.int64), np.zeros(0, np.int64)
        # Where a start's edges go is known from how many each has, so nothing is sorted.
        place = np.zeros(n_starts + 1, np.int64)
        for who in got_who:
            place[who + 1] += 1
        place = np.cumsum(place)
        edges = np.empty(place[-1], np.int64)
        for step, (who, edge) in enumerate(zip(got_who, got_edge, strict=True)):
            edges[place[who] + step] = edge
        return place, edges

    def sample(self, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[list[Drawn], float]]:
        """For each text its k paths (all, if there are fewer) by descending value, and the next value after them."""
        units = [self.vocabulary.units(t) for t in texts]
        self.learn(units)
        starts = [np.fromiter(map(self.start.__getitem__, doc), np.int64, len(doc)) for doc in units]
        top = -np.log(-np.log(uniform(seeds, np.full(len(texts), 1, U64))))
        paths: list[list[Drawn]] = [[] for _ in texts]
        heaps: list[list] = [[] for _ in texts]
        nothing = np.zeros(0, np.int64)
        # Each text's next path: what is kept of an older one, the state to go on from, and the units to come.
        todo = [Job(d, nothing, nothing, 0.0, float(top[d]), -1, 0) for d in range(len(texts))]
        for r in range(k):
            if not todo:
                break
            state = np.concatenate([starts[job.doc][job.unit :] for job in todo])
            size = np.array([len(starts[job.doc]) - job.unit for job in todo])
            base = np.cumsum(size) - size
            for i, job in enumerate(todo):
                if job.state >= 0:
                    state[base[i]] = job.state
            unit = np.arange(len(state)) + np.repeat(np.array([job.unit for job in todo]) - base, size)
            seed = np.repeat(seeds[[job.doc for job in todo]], size)
            counter = (U64(r + 1) << U64(STEP_BITS + UNIT_BITS)) + ((unit.astype(U64) + U64(1)) << U64(STEP_BITS))
            place, edge = self.draw(state, seed, counter)
            ends = place[np.concatenate([base, [len(state)]])].tolist()
            p = self.log[edge]
            before = np.empty(len(edge))
            for job, a, b in zip(todo, ends, ends[1:]):
                sums = np.cumsum(p[a:b])
                before[a + 1 : b] = sums[:-1]
                before[a : a + 1] = 0.0
                before[a:b] += job.before
                job.total = job.before + float(sums[-1]) if b > a else job.before

            def beside(spans: list[tuple[int, int]], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
                """The units of the edges in each span, and the values of the regions beside them, given the paths' values."""
                sizes = np.array([y - x for x, y in spans], np.int64)
                at = np.arange(sizes.sum()) + np.repeat(np.array([x for x, _ in spans], np.int64) - np.cumsum(sizes) + sizes, sizes)
                whose = np.searchsorted(place, at, "right") - 1
                rest = np.full(len(at), -np.inf)
                free = np.flatnonzero(p[at] < 0)
                some, start = at[free], whose[free]
                u = uniform(seed[start], counter[start] + U64(2) * (some - place[start]).astype(U64) + U64(1))
                rest[free] = cut_gumbel(before[some] + np.log(-np.expm1(np.minimum(p[some], -1e-300))), np.repeat(values, sizes)[free], u)
                return unit[whose], rest

            spans = [(a, min(a + WINDOW, b)) for a, b in zip(ends, ends[1:])]
            cut = np.cumsum([y - x for x, y in spans])[:-1]
            units_of, rests = (np.split(x, cut) for x in beside(spans, [job.value for job in todo]))
            # Noise is below MOST_NOISE. So regions that begin lower than that under the k-th value so far are never among the k best.
            longer = [i for i, b in enumerate(ends[1:]) if spans[i][1] < b and (k > WINDOW or before[spans[i][1]] + MOST_NOISE >= np.partition(rests[i], -k)[-k])]
            if longer:
                spans_on = [(spans[i][1], ends[i + 1]) for i in longer]
                cut = np.cumsum([y - x for x, y in spans_on])[:-1]
                more = (np.split(x, cut) for x in beside(spans_on, [todo[i].value for i in longer]))
                for i, of, rest in zip(longer, *more, strict=True):
                    units_of[i], rests[i] = np.concatenate([units_of[i], of]), np.concatenate([rests[i], rest])
            for job, a, b, of, rest in zip(todo, ends, ends[1:], units_of, rests):
                ahead = before[a : a + len(rest)]
                if job.beside is None:
                    path = Drawn(edge[a:b], of, 0, job.total, job.value, rest, ahead)
                else:  # the region that stays beside the edge it was split by
                    start = len(job.kept) - 1
                    left, at_left, taken = job.beside
                    path = Drawn(np.concatenate([job.kept, edge[a:b]]), np.concatenate([job.units, of]), start, job.total, job.value, np.concatenate([[left], rest]), np.concatenate([[at_left], ahead]))
                    path.taken[start] = taken
                paths[job.doc].append(path)
                self._push(heaps[job.doc], paths[job.doc], len(paths[job.doc]) - 1)
            going = [d for d in range(len(texts)) if heaps[d] and len(paths[d]) == r + 1]
            todo = self._split(heaps, paths, starts, seeds, going, r) if r + 1 < k else []
        return [(paths[d], -heaps[d][0][0] if heaps[d] else -math.inf) for d in range(len(texts))]

    def _push(self, heap: list, paths: list[Drawn], i: int) -> None:
        rest = paths[i].rest
        if len(rest):
            at = int(rest.argmax())
            if rest[at] > -np.inf:
                heapq.heappush(heap, (-float(rest[at]), i, at))

    def _split(self, heaps: list[list], paths: list[list[Drawn]], starts: list[np.ndarray], seeds: np.ndarray, docs: list[int], r: int) -> list[Job]:
        """Take each text's best region, draw the edge that its first path leaves by, and tell where that goes on."""
        step_seed = U64(r + 2) << U64(STEP_BITS + UNIT_BITS)
        pick = uniform(seeds[docs], step_seed + np.full(len(docs), 1, U64)).tolist()
        jobs, places, bounds, left_of = [], [], [], []
        for d, u in zip(docs, pick, strict=True):
            value, i, at = heapq.heappop(heaps[d])
            path = paths[d][i]
            step = path.start + at
            path.rest[at] = -np.inf
            self._push(heaps[d], paths[d], i)
            edge, unit = int(path.edges[step]), int(path.units[step])
            state = self._state(path, starts[d], step, unit)
            taken = path.taken.get(step, set()) | {edge}
            first = int(self.first[state])
            log = self.log[first : self.first[state + 1]].tolist()
            free = [e for e in range(first, first + len(log)) if e not in taken]
            sums = list(itertools.accumulate(math.exp(log[e - first]) for e in free))
            got = free[min(bisect.bisect_right(sums, u * sums[-1]), len(free) - 1)]
            before = float(path.before[at])
            left = sums[-1] - math.exp(log[got - first])
            more = len(free) > 1 and left > 0
            places.append(before + math.log(left) if more else -math.inf)
            bounds.append(-value)
            left_of.append((before, taken))
            kept, units = np.append(path.edges[:step], got), path.units[: step + 1]
            following = int(self.next[got])
            jobs.append(Job(d, kept, units, before + log[got - first], -value, following or -1, unit if following else unit + 1))
        u = uniform(seeds[docs], step_seed + np.full(len(docs), 2, U64))
        some = np.flatnonzero(np.isfinite(places))
        rest = np.full(len(docs), -np.inf)
        rest[some] = cut_gumbel(np.array(places)[some], np.array(bounds)[some], u[some])
        for job, value, (before, taken) in zip(jobs, rest.tolist(), left_of, strict=True):
            job.beside = (value, before, taken)
        return jobs

    def _state(self, path: Drawn, starts: np.ndarray, step: int, unit: int) -> int:
        """The state that a path's edge leaves."""
        if step and path.units[step - 1] == unit:
            return int(self.next[path.edges[step - 1]])
        return int(starts[unit])


def _rows(model, k: int, keys: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        name = ("sampler", zlib.crc32(model.value))
        if name not in store:
            store[name] = Sampler(Vocabulary(model.value))
        sampler: Sampler = store[name]
        for batch in batches:
            for part in slices(batch, "text", TOGETHER, TOGETHER_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                seeds = part.column("seed").to_numpy().view(U64)
                whose, rank, edges, log, value, inclusion = [], [], [], [], [], []
                for d, (paths, after) in enumerate(sampler.sample(texts, seeds, k)):
                    for i, path in enumerate(paths):
                        whose.append(d)
                        rank.append(i + 1)
                        edges.append(path.edges)
                        log.append(path.total)
                        value.append(path.value)
                        # The chance that a Gumbel at the path's log-probability is above the first value left out.
                        inclusion.append(-math.expm1(-math.exp(min(path.total - after, 700.0))) if after > -math.inf else 1.0)
                ids, sizes = sampler.ids(edges)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                made = {"sample": pa.array(rank, pa.int32())} | (_digests(model, ids) if digest else {"ids": ids})
                made |= {"log_prob": pa.array(log, pa.float64()), "perturbed": pa.array(value, pa.float64()), "inclusion": pa.array(inclusion, pa.float64())}
                own = part.select(keys).take(pa.array(whose, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, *made.values()], [*keys, *made])

    return run


def sample_segmentations(rows: DataFrame, model_path: str, keys: list[str], k: int = SAMPLES, seed: int = 4, digest: bool = False) -> DataFrame:
    """(keys..., sample, ids, log_prob, perturbed, inclusion): up to k distinct segmentations of each row's text.

    rows: the key columns and text. sample counts from 1 by falling perturbed log-probability.
    inclusion is the probability of a path to be among the first given the first value left out, 1 if none is.
    With digest, (n_pieces, ids_crc32, decoded_sha256) stand in place of ids: the checksum is of little-endian 32-bit ids,
    the hash of what they decode to. They are made where the ids are, which no other worker then receives.
    A text with fewer segmentations has all; a null or empty text has the empty one. Rows that repeat
    keys and text repeat their samples. Null keys are keys like others. Other columns are not carried.
    """
    model = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())  # one vocabulary file
    source = rows.select(*keys, F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), *keys).alias("seed"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema)
    ids = "n_pieces int, ids_crc32 long, decoded_sha256 string" if digest else "ids array<int>"
    return source.mapInArrow(_rows(model, k, keys, digest), f"{kinds}, sample int, {ids}, log_prob double, perturbed double, inclusion double")


class Decoder:
    """The bytes of all pieces. Control pieces are empty, the unknown one is U+2047 between spaces."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = []
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                pieces.append(bytes([int(p.id_to_piece(i)[1:-1], 16)]))
            else:
                pieces.append(b"" if p.is_control(i) else " \u2047 ".encode() if p.is_unknown(i) else p.id_to_piece(i).replace(SPACE, " ").encode())
        self.pieces = pa.array(pieces, pa.large_binary())

    def __call__(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, less the space that every text begins with."""
        if not len(ids):
            return b""
        raw = self.pieces.take(pa.array(ids)).buffers()[2]
        raw = raw.to_pybytes() if raw else b""
        return raw[1:] if raw[:1] == b" " else raw


def _decoder(model) -> Decoder:
    store = worker_store()
    name = ("decoder", zlib.crc32(model.value))
    if name not in store:
        store[name] = Decoder(model.value)
    return store[name]


def _arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The values of each list of integers."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        yield flat[a:b] if column[i].is_valid else None


def decode(rows: DataFrame, model_path: str, ids: str = "ids") -> Column:
    """The text of a column of id arrays: pieces joined, byte pieces as UTF-8, the first space dropped. Null ids give null."""
    model = rows.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(column: pa.Array) -> pa.Array:
        decoder = _decoder(model)
        return pa.array([None if i is None else decoder(i).decode("utf-8", "replace") for i in _arrays(column)], pa.string())

    return F.arrow_udf(run, "string")(rows[ids])


def _digests(model, column: pa.Array) -> dict[str, pa.Array]:
    """What stands for lists of ids, none null."""
    decoder, own = _decoder(model), list(_arrays(column))
    sums = [zlib.crc32(i.astype("<u4").tobytes()) for i in own]
    hashes = [hashlib.sha256(decoder(i)).hexdigest() for i in own]
    return {"n_pieces": pa.array([len(i) for i in own], pa.int32()), "ids_crc32": pa.array(sums, pa.int64()), "decoded_sha256": pa.array(hashes, pa.string())}

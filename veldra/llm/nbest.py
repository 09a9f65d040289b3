"""SentencePiece encoding and decoding by N-best segmentation of the piece lattice.

A text (spaces written as U+2581, one put before it) is a lattice whose edges are pieces with scores. A unigram model
states them as logarithms of probabilities. A BPE model states merge ranks, whose sum says nothing about a text; a piece
of rank r is then given -log(RANK + r), which falls as pieces get rarer. The result is the best segmentation by these
scores; it isn't always the one that merging in the order of the ranks gives.
Forward Viterbi gives the best score of every prefix; these are exact heuristics for a backward A* search, which pops
complete segmentations in the order of their scores. No piece of the vocabulary has a space after another character, nor,
in most models, an ASCII sign or digit after an ASCII letter, so a text falls apart into units at these places, and its
score is the sum over units. Each
distinct unit is solved once: many at a time by a vectorised forward and backward Viterbi that yields its best
segmentation and by how much its second best is worse. The N best of a text differ from its best one in the N - 1 units with
the smallest such differences at most, so A* runs over those units alone, and its result is exact for the whole text.

Characters without a piece are spelled in byte pieces, at a score under that of every piece. Decoding joins pieces,
turns byte pieces into text and drops the space that was put before it: the round trip is exact for every text.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm import textcodes as tc

SPACE = "▁"
#: Stands for U+2581 in a text, which is spelled in bytes so that decoding tells it from a space. No valid text has it.
LITERAL = "\udc81"
#: A byte piece's penalty under the worst score of a usable piece.
BYTE_PENALTY = 10.0
#: Scores of pieces under this are merges that the model never makes on their own; they are taken like the worst other.
FLOOR = -1e6
#: Added to a BPE model's merge ranks: of 1 to 10,000 the power of ten whose best segmentations are most often the model's.
RANK = 1000.0
#: Units longer than this are solved one by one.
LONG_UNIT = 64
#: Bytes of the texts whose results go back together.
SENT_BYTES = 1 << 18
#: Lattice cells (start x end x unit) that are held at once: about 20 bytes each.
CELLS = 1 << 20

_models: dict[str, Pieces] = {}


def _spelling(char: str) -> bytes:
    return SPACE.encode() if char == LITERAL else char.encode("utf-8", "surrogatepass")


@dataclass
class Pieces:
    """Vocabulary of a model file: piece -> (id, score), the ids of bytes, and the score of a byte."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    byte_score: float
    text: list[str | int]
    longest: int
    #: No piece has an ASCII character other than a letter after an ASCII letter.
    letters_end: bool = False
    cache: dict = field(default_factory=dict)

    @staticmethod
    def of(path: str) -> Pieces:
        if path not in _models:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path)
            ids, raw, bytes_, text = {}, {}, [0] * 256, []
            for i in range(m.vocab_size()):
                piece = m.id_to_piece(i)
                if m.is_byte(i):
                    bytes_[int(piece[3:5], 16)] = i
                    text.append(int(piece[3:5], 16))
                elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                    text.append("")
                else:
                    ids[piece], raw[piece] = i, m.get_score(i)
                    text.append(piece)
            _models[path] = Pieces.build(ids, raw, bytes_, text)
        return _models[path]

    @staticmethod
    def build(ids: dict[str, int], raw: dict[str, float], bytes_: list[int], text: list) -> Pieces:
        for piece in ids:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece has a space after another character")
        worst = min((s for s in raw.values() if s > FLOOR), default=0.0)
        scores = {p: max(s, worst) for p, s in raw.items()}
        if all(s <= 0 and s == int(s) for s in raw.values()):  # merge ranks
            scores = {p: -math.log(RANK - s) for p, s in scores.items()}
            worst = -math.log(RANK - worst)
        joins = re.compile(r"[A-Za-z][\x00-\x40\x5b-\x60\x7b-\x7f]")
        return Pieces(ids, scores, bytes_, worst - BYTE_PENALTY, text, max(map(len, ids), default=1), not any(joins.search(p) for p in ids))

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the edges into it: (start, score, ids)."""
        out: list = [[] for _ in range(len(unit) + 1)]
        for a in range(len(unit)):
            for b in range(a + 1, min(len(unit), a + self.longest) + 1):
                piece = unit[a:b]
                if piece in self.ids:
                    out[b].append((a, self.scores[piece], (self.ids[piece],)))
            if unit[a] not in self.ids:
                raw = _spelling(unit[a])
                out[a + 1].append((a, self.byte_score * len(raw), tuple(self.bytes_[x] for x in raw)))
        return out


def forward_scores(edges: list) -> list[float]:
    """Best score of each prefix."""
    best = [0.0] + [-np.inf] * (len(edges) - 1)
    for b in range(1, len(edges)):
        best[b] = max((best[a] + s for a, s, _ in edges[b]), default=-np.inf)
    return best


def n_best(edges: list, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a lattice as (score, ids): backward A* with the forward scores as heuristic.

    Equal scores come in the order of their ids, so the result doesn't depend on how the lattice is walked.
    """
    ahead = forward_scores(edges)
    heap = [(-ahead[-1], (), len(edges) - 1, 0.0)]
    out: list = []
    while heap and (len(out) < n or -heap[0][0] >= out[-1][0]):
        total, ids, at, done = heapq.heappop(heap)
        if at == 0:
            out.append((-total, ids))
            continue
        for a, s, piece in edges[at]:
            heapq.heappush(heap, (-(ahead[a] + s + done), piece + ids, a, s + done))
        if len(out) > 16 * n:  # more ties than that: those found so far
            break
    return sorted(out, key=lambda x: (-x[0], x[1]))[:n]


#: Comes before the first id of each lattice but the first of several joined ones.
CUT = -1


def joined(lattices: list[list]) -> list:
    """One lattice out of several in sequence; ``CUT`` stands between the ids of two."""
    out: list = [[]]
    for e in lattices:
        base = len(out) - 1
        out += [[(a + base, s, (CUT, *p) if base and not a else p) for a, s, p in into] for into in e[1:]]
    return out


def parted(ids: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The ids of each of several joined lattices."""
    edges = [-1, *(i for i, x in enumerate(ids) if x == CUT), len(ids)]
    return [ids[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Solver:
    """Best segmentation of many units at once: ids, score, and the second best's difference (inf if there is none)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        order = sorted(pieces.ids)
        table: dict[int, np.ndarray] = {}
        self.base = np.uint64(0x9E3779B97F4A7C15)
        for length in range(1, pieces.longest + 1):
            own = [p for p in order if len(p) == length]
            if own:
                codes = np.array([[ord(c) for c in p] for p in own], np.uint64)
                h = self._hash(codes)
                place = np.argsort(h)
                table[length] = (h[place], np.array([pieces.ids[p] for p in own])[place], np.array([pieces.scores[p] for p in own])[place])
        self.table = table
        self.byte_ids = np.array(pieces.bytes_, np.int64)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[0], np.uint64)
        for j in range(codes.shape[1]):
            h = h * self.base + tc.mix(codes[:, j])
        return h

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, where each unit's begin, how many it has, its score and its second best's difference)."""
        at, size, values = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros((len(units), 2))
        flat, total = [], 0
        length = np.fromiter(map(len, units), np.int64, len(units))
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            step = max(16, CELLS // int(n + 1) ** 2)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                ids, count, value = self._same_length([units[i] for i in part], int(n)) if n <= LONG_UNIT else self._one_by_one([units[i] for i in part])
                at[part], size[part], values[part] = total + np.cumsum(count) - count, count, value
                total += len(ids)
                flat.append(ids)
        return np.concatenate([np.zeros(0, np.int32), *flat]), at, size, values

    def _one_by_one(self, units: list[str]):
        found = [self._alone(u) for u in units]
        return np.concatenate([f[0] for f in found]), np.array([len(f[0]) for f in found]), np.array([f[1:] for f in found])

    def _alone(self, unit: str):
        edges = self.pieces.edges(unit)
        ahead = forward_scores(edges)
        behind = [-np.inf] * len(edges)
        behind[-1] = 0.0
        for b in range(len(edges) - 1, 0, -1):
            for a, s, _ in edges[b]:
                behind[a] = max(behind[a], behind[b] + s)
        ids, at, used = [], len(edges) - 1, set()
        while at:
            a, s, p = min((e for e in edges[at] if ahead[e[0]] + e[1] == ahead[at]), key=lambda e: (-e[0], e[2]))
            used.add((a, at))
            ids[:0] = p
            at = a
        second = max((ahead[a] + s + behind[b] for b in range(1, len(edges)) for a, s, _ in edges[b] if (a, b) not in used), default=-np.inf)
        return np.array(ids, np.int32), ahead[-1], ahead[-1] - second

    def _same_length(self, units: list[str], n: int):
        m = len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        mixed = tc.mix(codes.ravel()).reshape(m, n)
        score = np.full((n + 1, n + 1, m), -np.inf)
        ident = np.full((n + 1, n + 1, m), -1, np.int32)
        h = np.zeros((n, m), np.uint64)
        for length in range(1, min(n, self.pieces.longest) + 1):
            for a in range(n - length + 1):
                h[a] = h[a] * self.base + mixed[:, a + length - 1]
                if length not in self.table:
                    continue
                keys, ids, scores = self.table[length]
                at = np.minimum(np.searchsorted(keys, h[a]), len(keys) - 1)
                ok = keys[at] == h[a]
                score[a, a + length] = np.where(ok, scores[at], -np.inf)
                ident[a, a + length] = np.where(ok, ids[at], -1)
        size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        for a in range(n):
            lone = np.isinf(score[a, a + 1])
            score[a, a + 1] = np.where(lone, self.pieces.byte_score * size[:, a], score[a, a + 1])
            ident[a, a + 1] = np.where(lone, np.where(codes[:, a] < 0x80, self.byte_ids[np.minimum(codes[:, a], 0xFF).astype(np.int64)], -2), ident[a, a + 1])
        ahead, behind = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        ahead[0], behind[n] = 0.0, 0.0
        back = np.zeros((n + 1, m), np.int64)
        for b in range(1, n + 1):
            low = max(0, b - self.pieces.longest)
            options = ahead[low:b] + score[low:b, b]
            last = options[::-1]
            pick = len(options) - 1 - last.argmax(axis=0)
            back[b], ahead[b] = low + pick, options.max(axis=0)
        for a in range(n - 1, -1, -1):
            high = min(n, a + self.pieces.longest)
            behind[a] = (score[a, a + 1 : high + 1] + behind[a + 1 : high + 1]).max(axis=0)
        used = np.zeros((n + 1, n + 1, m), bool)
        at, rows, path = np.full(m, n), np.arange(m), []
        while (live := at > 0).any():
            r = rows[live]
            a = back[at[live], r]
            used[a, at[live], r] = True
            step = np.full((2, m), -1)
            step[0, r], step[1, r] = ident[a, at[live], r], a
            path.append(step)
            at[live] = a
        through = ahead[:, None, :] + score + behind[None, :, :]
        through[used] = -np.inf
        second = through.max(axis=(0, 1))
        steps = np.stack(path[::-1], axis=2)  # (ids or places, unit, step)
        value = np.stack((ahead[n], ahead[n] - second), axis=1)
        ids = steps[0]
        if not (ids == -2).any():
            return ids[ids != -1].astype(np.int32), (ids != -1).sum(axis=1), value
        out = [self._spelled(units[i], ids[i], steps[1, i]) if (ids[i] == -2).any() else ids[i][ids[i] >= 0] for i in range(m)]
        return np.concatenate(out).astype(np.int32), np.array([len(x) for x in out]), value

    def _spelled(self, unit: str, ids: np.ndarray, places: np.ndarray) -> list[int]:
        """Ids of a unit some of whose characters are written in several bytes."""
        flat: list[int] = []
        for k, a in zip(ids, places, strict=True):
            if k == -2:
                flat += [self.pieces.bytes_[x] for x in _spelling(unit[a])]
            elif k >= 0:
                flat.append(int(k))
        return flat


class Encoder:
    """Encodes many texts; keeps the results of distinct units between batches."""

    def __init__(self, path: str, most: int = 1 << 18):
        self.pieces = Pieces.of(path)
        self.solver, self.most = Solver(self.pieces), most
        self._reset()

    def _reset(self) -> None:
        self.cache = tc.PieceCache(self.most)
        self.values = np.zeros((0, 2))
        self.names: list[str] = []

    def encode(self, data: np.ndarray, offsets: np.ndarray, n: int):
        """For each text: (ids of the best segmentation, scores of the n best, whole ids of the others in the order of scores)."""
        # The space put before a text joins its first unit, so units that begin a text are told apart by a mark.
        raw = data.tobytes()
        space = data == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.pieces.letters_end:
            first[1:] |= tc.LETTER[data[:-1]] & tc.SIGN[data[1:]]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = True
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(data))
        lead = np.zeros(len(start), bool)
        lead[np.searchsorted(start, begins)] = True
        key = tc.piece_hashes(data, start, stop) ^ np.where(lead, np.uint64(0x5DEECE66D1234567), np.uint64(0))
        if len(self.cache.hash) > self.most:
            self._reset()

        def unit(i: int) -> str:
            return (SPACE if lead[i] else "") + raw[start[i] : stop[i]].decode().replace(SPACE, LITERAL).replace(" ", SPACE)

        def compute(new):
            names = [unit(i) for i in new]
            self.names += names
            flat, at, size, values = self.solver.solve(names)
            self.values = np.concatenate((self.values, values))
            return flat, at, size

        at, size = self.cache.lookup(key, compute) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        number = self.cache.found if len(at) else at
        ids = tc.gathered(self.cache.pool, at, size)
        edge = np.searchsorted(start, offsets)
        upto = np.concatenate(([0], np.cumsum(size)))
        total = upto[edge]
        for i in range(len(offsets) - 1):
            own = number[edge[i] : edge[i + 1]]
            best = ids[total[i] : total[i + 1]]
            if not len(own):
                yield best, [0.0], []
                continue
            score = float(self.values[own, 0].sum())
            if n == 1:
                yield best, [score], []
                continue
            gap = self.values[own, 1]
            near = np.sort(np.argsort(gap, kind="stable")[: n - 1])
            near = near[np.isfinite(gap[near])]
            if not len(near):
                yield best, [score], []
                continue
            some = n_best(joined([self._edges(int(own[j])) for j in near]), n)
            rest = score - some[0][0]
            first = edge[i] + near  # where the ids of these units lie in the best segmentation
            start_, stop_ = (upto[first + k] - total[i] for k in range(2))
            held = [best[a:b] for a, b in zip([0, *stop_.tolist()], [*start_.tolist(), len(best)], strict=True)]
            own_best = [tuple(best[a:b].tolist()) for a, b in zip(start_.tolist(), stop_.tolist(), strict=True)]
            ways = [w for w in (parted(x) for _, x in some) if w != own_best][: len(some) - 1]  # of equal scores the best one is the first
            others = [np.concatenate([held[0], *(y for x, h in zip(w, held[1:], strict=True) for y in (np.array(x, np.int32), h))]) for w in ways]
            yield best, [s + rest for s, _ in some], others

    def _edges(self, number: int) -> list:
        name = self.names[number]
        known = self.pieces.cache
        if name not in known:
            if len(known) > 20_000:
                known.clear()
            known[name] = self.pieces.edges(name)
        return known[name]


def decode(pieces: Pieces, ids) -> str:
    """The text of a sequence of ids."""
    out = bytearray()
    for i in ids:
        t = pieces.text[i]
        out += bytes([t]) if isinstance(t, int) else t.replace(SPACE, " ").encode()
    return out.decode("utf-8", "replace")[1:]


_encoders: dict[str, Encoder] = {}


def _byte_table(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [bytes([t]) if isinstance(t, int) else t.replace(SPACE, " ").encode() for t in pieces.text]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


_RESULT = "n_tokens int, ids array<int>, scores array<double>, others array<array<int>>, round_trip boolean"


def _places(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(_places([len(x) for x in ids]), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def with_segmentation(df: DataFrame, text: str, model: str, n: int = 4, into: str = "segmentation") -> DataFrame:
    """``df`` with a struct column: n_tokens and ids of the best segmentation, scores of the n best, others, round_trip.

    ``others``: the whole ids of the second best to the n-th best, in the order of ``scores``. Null texts are empty: no ids
    and one score, 0. Fewer than n segmentations give fewer scores and others. round_trip: decoding gives the very text
    back, byte for byte, from each of the n best. Repeated rows each return, an empty table stays empty. A column
    already called ``into`` is replaced, others stay.
    """
    tc.bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoders.setdefault(model, None) or Encoder(model)
        _encoders[model] = encoder
        flat, first, width = _byte_table(encoder.pieces)
        for column in batches:
            data, offsets = tc.utf8(column)
            for a, b in tc.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                ids, scores, good, others, many, held = [], [], [], [], [], 0
                for i, (best, some, rest) in enumerate(encoder.encode(part, offsets[a : b + 1] - offsets[a], n), a):
                    own = data[offsets[i] : offsets[i + 1]]
                    ids.append(best)
                    scores.append(some)
                    good.append(all(np.array_equal(tc.gathered(flat, first[x], width[x])[1:] if len(x) else own[:0], own) for x in (best, *rest)))
                    others += rest
                    many.append(len(rest))
                    held += len(own)
                    if held >= SENT_BYTES or i == b - 1:  # all that a batch gives would be several times as large as it
                        size = np.fromiter(map(len, ids), np.int64, len(ids))
                        yield pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), _lists(ids), pa.array(scores, pa.list_(pa.float64())), pa.ListArray.from_arrays(_places(many), _lists(others)), pa.array(good, pa.bool_())], ["n_tokens", "ids", "scores", "others", "round_trip"])
                        ids, scores, good, others, many, held = [], [], [], [], [], 0

    from pyspark.sql.pandas.functions import ArrowUDFType

    return df.withColumn(into, F.arrow_udf(run, _RESULT, ArrowUDFType.SCALAR_ITER)(F.col(text)))

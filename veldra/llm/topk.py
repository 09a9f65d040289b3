"""Exact top-k search by inner product with a pivot table.

Vectors become whole numbers: floor(scale * x). With one more coordinate, sqrt(M^2 - |x|^2) for candidates and 0 for
queries, the order by inner product is the order by distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x, with M the largest norm. A
table holds the distances of all rows to many pivots, chosen among the candidates. It is computed once. Two rows' lines
of the table bound their distance from below: a line gives a point's place in the simplex that the pivots span and its
height over it, and the distance there is at least the largest |d(q, p) - d(x, p)|. An upper bound on the score follows.

Queries are a stated set, dealt to blocks, and candidates to tiles; each pair of a block and a tile is one group of rows,
streamed with its queries first. Candidates are evaluated in the order of their bounds, round by round, until the next
bound is under the query's k-th best score so far, which is carried from batch to batch, or under the k-th best of a drawn
sample of candidates, which every group knows from the start; all others are eliminated. Scores are exact. Each group returns k rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm import textcodes as tc
from veldra.storage import Scratch

#: Pivots of a dimension, candidates that they are chosen from, and dimensions that get pivots; others have no bounds.
PIVOTS, SAMPLE, DIMENSIONS = 56, 2048, 64
#: Queries in a block, candidates in a tile.
BLOCK, TILE = 8192, 16384
#: Candidates that are bounded at once, queries that are compared with them at once.
CANDIDATES, QUERIES = 4096, 128
#: Candidates of a query that the first round evaluates; each further round takes four times as many.
FIRST = 32


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; doubles from 2^52 on are whole and beyond what a long floor holds."""

    def floor(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) >= float(1 << 52), y).otherwise(F.floor(y).cast("double"))

    return F.transform(vector, floor)


def usable(vector: Column, scale: int = 64) -> Column:
    """Neither null nor empty, and every component is finite, ``scale`` times as large too."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


@dataclass
class Pivots:
    """Pivots of one dimension. ``top``: square of the largest norm. ``inverse``: from inner products to places."""

    vectors: np.ndarray
    top: float
    inverse: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, top: float, n: int = PIVOTS) -> Pivots:
        """Farthest-first choice; vectors that lie in the span of the chosen ones add nothing and end it."""
        far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
        at = [int(far.argmax())]
        far = ((sample - sample[at[0]]) ** 2).sum(axis=1)
        while len(at) < n and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
        while True:
            base = sample[at[1:]] - sample[at[0]]
            if not len(base):
                return Pivots(sample[at], top, np.zeros((0, 0)))
            r = np.linalg.qr(base.T, mode="r")
            good = np.abs(np.diag(r)) > 1e-3 * np.abs(np.diag(r)).max()
            good = np.concatenate((good, np.zeros(len(base) - len(good), bool)))
            if good.all():
                return Pivots(sample[at], top, np.linalg.inv(r))
            at = [at[0], *(x for x, keep in zip(at[1:], good, strict=True) if keep)]

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """A line of the table for each vector."""
        own = (x**2).sum(axis=1)[:, None] if query else self.top
        return np.sqrt(np.maximum((self.vectors**2).sum(axis=1)[None, :] + own - 2 * (x @ self.vectors.T), 0))

    def placed(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the span of the pivots, height over it) of the points with these lines."""
        square = table**2
        edges = ((self.vectors[1:] - self.vectors[0]) ** 2).sum(axis=1)
        inner = (square[:, :1] - square[:, 1:] + edges[None, :]) / 2
        place = inner @ self.inverse
        return place, np.sqrt(np.maximum(square[:, 0] - (place**2).sum(axis=1), 0))


def upper_bounds(pivots: Pivots, q2: np.ndarray, query_table: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The highest score that each candidate (column) can have with each query (row).

    Every pivot lies in the simplex, so the distance between two points' places and heights is at least the largest
    |d(q, p) - d(x, p)|, and still a lower bound on theirs.
    """
    a, u = pivots.placed(query_table)
    b, v = pivots.placed(table)
    own = (a**2).sum(axis=1) + u**2
    near = a @ b.T
    near += u[:, None] * v[None, :]
    scale = q2 + pivots.top
    near += ((scale - own) / 2 + 1e-6 * scale + 0.5)[:, None] - ((b**2).sum(axis=1) + v**2)[None, :] / 2
    return near


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), bool)

    def least(self, rows) -> np.ndarray:
        """Score that a candidate must reach: the k-th best, or none."""
        return np.where(self.filled[rows].all(axis=1), self.score[rows, -1].astype(float), -np.inf)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, one entry for each: query, score, id."""
        if not len(row):
            return
        hit = np.unique(row)
        r, c = np.nonzero(self.filled[hit])
        row = np.concatenate((hit[r], row))
        score, ids = np.concatenate((self.score[hit][r, c], score)), np.concatenate((self.ids[hit][r, c], ids))
        order = np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        keep = place < self.k
        self.score[row[keep], place[keep]], self.ids[row[keep], place[keep]], self.filled[row[keep], place[keep]] = score[keep], ids[keep], True


class Search:
    """The k best of all candidates seen so far for a block of queries, and how many scores were evaluated.

    ``floor``: a score that k candidates reach, found before the search; what is below it can't be among the k best.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, pivots: Pivots | None, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.table, self.pivots = ids, vectors, table, pivots
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.best, self.evaluated, self.seen = Best(len(ids), k), 0, 0
        self.q2 = (vectors**2).sum(axis=1)

    def add(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        for c in range(0, len(ids), CANDIDATES):
            for a in range(0, len(self.ids), QUERIES):
                self._tile(np.arange(a, min(a + QUERIES, len(self.ids))), ids[c : c + CANDIDATES], x[c : c + CANDIDATES], table[c : c + CANDIDATES])

    def _least(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.best.least(rows), self.floor[rows])

    def _tile(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        best, least_of = self.best, self._least
        bound = np.full((len(rows), len(ids)), np.inf)
        if self.pivots is not None:
            bound = upper_bounds(self.pivots, self.q2[rows], self.table[rows], table)
        bound[ids[None, :] == self.ids[rows][:, None]] = -np.inf
        self.seen += bound.size
        size, left = min(FIRST, len(ids)), np.arange(len(rows))
        while len(left):
            rest, least = bound[left], least_of(rows[left])
            pick = np.argpartition(-rest, size - 1, axis=1)[:, :size]
            value = np.take_along_axis(rest, pick, axis=1)
            r, j = np.nonzero((value >= least[:, None]) & (value > -np.inf))
            c = pick[r, j]
            self.evaluated += len(r)
            best.add(rows[left[r]], _pair_scores(self.vectors[rows], x, left[r], c), ids[c])
            bound[left[:, None], pick] = -np.inf
            top = bound[left].max(axis=1)
            left = left[(top >= least_of(rows[left])) & (top > -np.inf)]
            size = min(4 * size, len(ids))


def _pair_scores(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (r[i], c[i]): in floating point where no sum can be rounded, else in whole numbers.

    A score beyond a long is the nearest long.
    """
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    out = np.empty(len(r), np.int64)
    if most < 1 << 53:
        for i in range(0, len(r), 1 << 14):
            out[i : i + (1 << 14)] = np.einsum("ij,ij->i", q[r[i : i + (1 << 14)]], x[c[i : i + (1 << 14)]])
    else:
        for i in range(len(r)):
            out[i] = min(max(sum(int(u) * int(v) for u, v in zip(q[r[i]], x[c[i]], strict=True)), low), high)
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; no columns if they are empty."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) and len(lists[0]) else np.zeros((len(lists), 0))


def _pivots(rows: DataFrame, n: int) -> tuple[dict[int, Pivots], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Pivots of the ``DIMENSIONS`` smallest dimensions of a bounded sample, ``SAMPLE`` rows with the smallest hashes of their
    ids; and (ids, vectors) of the sample's rows of those dimensions."""
    dim = F.size("v").alias("dim")
    tops = rows.groupBy(dim).agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).orderBy("dim").limit(DIMENSIONS).collect()
    sample: dict[int, list] = {}
    for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append((r.id, r.v))
    # Squares of distances beyond the whole numbers of a double would make the bounds wrong.
    able = [r for r in tops if r.dim in sample and r.top < 1 << 50]
    drawn = {r.dim: (np.array([i for i, _ in sample[r.dim]], np.int64), np.asarray([v for _, v in sample[r.dim]], float)) for r in able}
    return {r.dim: Pivots.of(drawn[r.dim][1], r.top, n) for r in able}, drawn


def floors(ids: np.ndarray, x: np.ndarray, drawn: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th best score of each query among the drawn candidates other than itself, less than any where they are fewer.

    The drawn rows are candidates themselves, so the k best of all candidates reach this score. Below 2^50 products don't
    round.
    """
    out = np.full(len(ids), -np.inf)
    for a in range(0, len(ids), QUERIES):
        score = x[a : a + QUERIES] @ drawn[1].T
        score[ids[a : a + QUERIES, None] == drawn[0][None, :]] = -np.inf
        if score.shape[1] >= k:
            out[a : a + QUERIES] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return out


def with_table(rows: DataFrame, pivots: dict[int, Pivots], drawn: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(id, v, ask, t, q, floor): ``t`` the distances to the pivots of the vector's dimension as a candidate, ``q`` those as a
    query or empty, ``floor`` a score that k candidates reach."""
    held = rows.sparkSession.sparkContext.broadcast((pivots, drawn))  # PIVOTS and SAMPLE vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, drawn_ = held.value
        for batch in batches:
            lists, ask = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                part = lists.take(pa.array(own))
                x = _matrix(part)
                tables = []
                for query in (False, True):
                    t = known[int(dim)].distances(x, query) if int(dim) in known else np.zeros((len(own), 0))
                    at = np.concatenate(([0], np.cumsum(np.where(ask[own] | (not query), t.shape[1], 0))))
                    tables.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t[ask[own] | (not query)].ravel())))
                floor, asked = np.full(len(own), -np.inf), np.flatnonzero(ask[own])
                ids = batch.column(0).take(pa.array(own))
                if int(dim) in drawn_ and len(asked):
                    floor[asked] = floors(ids.to_numpy(zero_copy_only=False)[asked], x[asked], drawn_[int(dim)], k)
                yield pa.RecordBatch.from_arrays([ids, part, batch.column(2).take(pa.array(own)), *tables, pa.array(floor)], ["id", "v", "ask", "t", "q", "floor"])

    return rows.select("id", "v", "ask").mapInArrow(run, "id long, v array<double>, ask boolean, t array<double>, q array<double>, floor double")


def _groups(batches: Iterator[pa.RecordBatch], pivots: dict[int, Pivots], k: int) -> Iterator[Search]:
    """A search for each group of rows (block, tile, dim, side, id, v, t, floor), sorted so: queries (side 0), then candidates."""
    name, waiting, search = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            group, side = tuple(keys[a, :3].tolist()), keys[a, 3]
            if group != name:
                if search is not None:
                    yield search
                name, waiting, search = group, [], None
            part = batch.slice(a, b - a)
            rows = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5)), _matrix(part.column(6))
            if side == 0:
                waiting.append((*rows, part.column(7).to_numpy(zero_copy_only=False)))
            elif waiting:
                if search is None:
                    own, vectors, table, floor = (np.concatenate(c) for c in zip(*waiting, strict=True))
                    search = Search(own, vectors, table, pivots.get(group[2]), k, floor)
                search.add(*rows)
    if search is not None:
        yield search


def top_k(df: DataFrame, id_: str, vector: str, is_query: Column, k: int = 20, scale: int = 64, block: int = BLOCK, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for each query.

    Candidates are all rows but the query's own id; ties go to smaller ids, repeated ids each count. Rows with a null
    id, a null or empty vector or a component that is null or not finite take no part; a pair of different dimensions
    has no score. Scores beyond a long are the nearest long, and rank as such. Fewer than k candidates give fewer rows; no queries give none. Other columns don't matter.
    """
    spark = df.sparkSession
    tc.bounded_batches(spark)
    scratch = Scratch(spark, "topk")
    rows = df.select(F.col(id_).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"), usable(F.col(vector), scale).alias("ok")).where(F.col("ok") & F.col("id").isNotNull())
    chosen, drawn = _pivots(rows, pivots)
    table = scratch.keep(with_table(rows, chosen, drawn, k), "table")
    n, asked = table.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    blocks, tiles = max(1, -(-asked // block)), max(1, -(-n // tile))
    dealt = F.xxhash64("id", F.lit(3))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    queries = table.where("ask").select(F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), all_of(tiles).alias("tile"), F.size("v").alias("dim"), F.lit(0).alias("side"), "id", "v", F.col("q").alias("t"), "floor")
    candidates = table.select(all_of(blocks).alias("block"), F.pmod(dealt, F.lit(tiles)).cast("int").alias("tile"), F.size("v").alias("dim"), F.lit(1).alias("side"), "id", "v", "t", F.lit(None).cast("double").alias("floor"))
    held = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _groups(batches, held.value, k):
            r, c = np.nonzero(s.best.filled)
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[r]), pa.array(s.best.ids[r, c]), pa.array(s.best.score[r, c])], ["query_id", "vec_id", "score"])

    both = queries.unionByName(candidates).repartition("block", "tile", "dim").sortWithinPartitions("block", "tile", "dim", "side")
    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

"""Joins that plain equality doesn't give: ranges, pairs, Hamming distance, look-back, best match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.storage import Scratch


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Pairs with equal ``on`` whose inclusive spans overlap. Columns other than ``on`` must have different names.

    Spans are dealt to bins of ``width`` and joined by bin, so no nested loop over all rows is needed; a pair counts in
    the first bin that both touch. ``how``: inner only; anti and outer forms follow from a join with the result.
    """
    if how != "inner":
        raise ValueError(how)
    (a0, a1), (b0, b1) = left_span, right_span
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = left.where(F.col(a0) <= F.col(a1)).withColumn("_bin", bins(a0, a1))
    b = right.where(F.col(b0) <= F.col(b1)).withColumn("_bin", bins(b0, b1))
    both = a.join(b, [*on, "_bin"])
    return both.where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & (F.col("_bin") == F.floor(F.greatest(a0, b0) / width))).drop("_bin")


def equal_in_blocks(left: DataFrame, right: DataFrame, keys: list[str], scratch: Scratch, most: int = 4_000_000, tasks: int = 2_000, weights: tuple[str, str] | None = None) -> DataFrame:
    """Pairs with equal ``keys``, met by a hash join in blocks of bounded size: nothing is sorted, and pairs are never kept.

    A key with more than ``most`` pairs, or with more than its share of all pairs among ``tasks`` tasks, is cut: its rows on
    either side are dealt to blocks by a hash of their columns, and each block of one goes to those of the other, so that both
    travel about as much. ``weights``: a column of each side that says how many rows a row stands for. Both sides are read
    twice. Columns other than ``keys`` must have different names; rows with a null key take no part.
    """
    p, s = left.dropna(subset=keys), right.dropna(subset=keys)
    n_p, n_s = (F.sum(c) for c in weights) if weights else (F.count(F.lit(1)),) * 2
    none = F.lit(0).cast("long")
    counts = s.groupBy(*keys).agg(n_s.alias("_s"), none.alias("_p")).unionByName(p.groupBy(*keys).agg(none.alias("_s"), n_p.alias("_p"))).groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_p").alias("_p"))
    sizes = scratch.keep(counts.withColumn("_size", F.greatest(F.col("_s") * F.col("_p"), F.col("_s") + F.col("_p"))), "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    share = max(most, -(-total // tasks))
    n = F.ceil(F.col("_size") / share)
    cut = sizes.where(F.col("_size") > share).withColumn("_ns", F.greatest(F.lit(1), F.least(n, F.ceil(F.sqrt(n * F.col("_s") / F.greatest("_p", F.lit(1)))))).cast("int"))
    cut = F.broadcast(cut.select(*keys, "_ns", F.ceil(n / F.col("_ns")).cast("int").alias("_np")))  # at most ``tasks`` rows

    def dealt(df, columns, own, other):
        d = df.join(cut, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        d = d.select("*", F.pmod(F.xxhash64(*columns), own).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other"))
        i, j = ("_own", "_other") if own == "_ns" else ("_other", "_own")
        d = d.withColumn("_block", (F.col(i) * F.col("_np") + F.col(j)).cast("short")).drop("_ns", "_np", "_own", "_other")
        return d.repartition(max(1, min(tasks, -(-total * 2 // share))), *keys, "_block")

    rest = [c for c in right.columns if c not in keys] or keys
    return dealt(p, left.columns, "_np", "_ns").join(dealt(s, rest, "_ns", "_np").hint("shuffle_hash"), [*keys, "_block"]).drop("_block")


def points_in_spans(points: DataFrame, spans: DataFrame, on: list[str], at: str, span: tuple[str, str], scratch: Scratch, most: int = 4_000_000, tasks: int = 2_000) -> DataFrame:
    """Pairs with equal ``on`` where the whole number ``at`` of ``points`` lies in the inclusive ``span`` of ``spans``.

    A span goes to each number that it holds, so spans must be short; what meets is a pair, none is met twice. Numbers with
    many pairs are cut into blocks (``equal_in_blocks``). Columns other than ``on`` must have different names; a row with a
    null in ``on``, ``at`` or ``span`` takes no part.
    """
    lo, hi = span
    s = spans.where(F.col(lo) <= F.col(hi)).dropna(subset=on).withColumn(at, F.explode(F.sequence(lo, hi))).withColumn(at, F.col(at).cast(points.schema[at].dataType))
    return equal_in_blocks(points, s, [*on, at], scratch, most, tasks)


def overlap_pairs(spans: DataFrame, id_: str, start: str, stop: str, scratch: Scratch) -> DataFrame:
    """(a, b, a_start, a_stop, b_start, b_stop), a < b: every two short inclusive spans of different ids that overlap.

    Two spans meet where the later one starts; of two that start together the smaller id counts as the later one.
    """
    of = lambda x: spans.select(F.col(id_).alias(f"_{x}"), F.col(start).alias(f"_{x}_start"), F.col(stop).alias(f"_{x}_stop"))
    later = of("p").where(F.col("_p_start") <= F.col("_p_stop")).withColumn("_at", F.col("_p_start").cast("int"))
    met = points_in_spans(later, of("q"), [], "_at", ("_q_start", "_q_stop"), scratch).where((F.col("_p") != F.col("_q")) & ((F.col("_q_start") < F.col("_p_start")) | (F.col("_p") < F.col("_q"))))
    first = F.col("_p") < F.col("_q")
    side = lambda x, y: [F.when(first, F.col(f"_{x}{c}")).otherwise(F.col(f"_{y}{c}")) for c in ("", "_start", "_stop")]
    (a, a0, a1), (b, b0, b1) = side("p", "q"), side("q", "p")
    return met.select(a.alias("a"), b.alias("b"), a0.alias("a_start"), a1.alias("a_stop"), b0.alias("b_start"), b1.alias("b_stop"))


def hamming_pairs(df: DataFrame, id_: str, bits: str, most: int, n_bits: int = 63) -> DataFrame:
    """(a, b, distance), a < b, with at most ``most`` different bits, by the pigeonhole principle.

    With ``most`` + 1 chunks of the bits, a pair within the bound agrees in one chunk at least; pairs are joined by
    equal chunks and then counted exactly.
    """
    parts = most + 1
    edges = [i * n_bits // parts for i in range(parts + 1)]
    chunk = lambda i: F.shiftright(F.col(bits), edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keyed = df.select(F.col(id_).alias("_id"), F.col(bits).alias("_bits"), F.posexplode(F.array(*(chunk(i) for i in range(parts)))).alias("_part", "_chunk"))
    a, b = (keyed.select(F.col("_part"), F.col("_chunk"), F.col("_id").alias(x), F.col("_bits").alias(f"_{x}")) for x in ("a", "b"))
    near = a.join(b, ["_part", "_chunk"]).where("a < b").select("a", "b", F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))).alias("distance"))
    return near.where(F.col("distance") <= most).distinct()


def look_back(left: DataFrame, right: DataFrame, on: list[str], at: str, before: str, reach: int, value: list[str]) -> DataFrame:
    """``left`` with the ``value`` columns of the latest ``right`` row at most ``reach`` before ``at`` (``at`` included)."""
    steps = left.select(*on, F.col(at)).distinct().withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(reach)))).withColumn("_frame", F.col(at) - F.col("_back"))
    r = right.select(*on, F.col(before).alias("_frame"), F.struct(*value).alias("_value"))
    best = steps.join(r, [*on, "_frame"]).groupBy(*on, at).agg(F.min_by(F.struct("_frame", "_value"), "_back").alias("_best"))
    out = left.join(best, [*on, at], "left")
    return out.select(*left.columns, F.col("_best._frame").alias("found_at"), *(F.col(f"_best._value.{v}").alias(v) for v in value))


def best_match(pairs: DataFrame, by: list[str], score: Column, order: list[Column], least: float) -> DataFrame:
    """The pair with the highest score of each group, if it reaches ``least``; ties by ``order``."""
    w = Window.partitionBy(*by).orderBy(score.desc(), *order)
    return pairs.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r").where(F.col("score") >= least)


def box_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, cell: int) -> DataFrame:
    """Pairs with equal ``on`` whose boxes overlap; ``a`` and ``b``: prefixes of their columns x1, y1, x2, y2.

    Boxes are dealt to the grid cells that they touch, so a crowded frame is many groups; a pair counts in the first
    cell that both touch. Columns other than ``on`` must have different names.
    """
    cells = lambda p, lo, hi: F.explode(F.sequence(F.floor(F.col(p + lo) / cell), F.floor((F.col(p + hi) - 1) / cell)))
    x = left.withColumn("_cx", cells(a, "x1", "x2")).withColumn("_cy", cells(a, "y1", "y2"))
    y = right.withColumn("_cx", cells(b, "x1", "x2")).withColumn("_cy", cells(b, "y1", "y2"))
    overlap = (F.col(a + "x1") < F.col(b + "x2")) & (F.col(b + "x1") < F.col(a + "x2")) & (F.col(a + "y1") < F.col(b + "y2")) & (F.col(b + "y1") < F.col(a + "y2"))
    first = (F.col("_cx") == F.floor(F.greatest(a + "x1", b + "x1") / cell)) & (F.col("_cy") == F.floor(F.greatest(a + "y1", b + "y1") / cell))
    return x.join(y, [*on, "_cx", "_cy"]).where(overlap & first).drop("_cx", "_cy")


def query_gallery_best(queries: DataFrame, gallery: DataFrame, id_: str, vector: str, gallery_id: str, side: str, digits: int = 6, block: int = 8192, tile: int = 32768) -> DataFrame:
    """(query_id, side, score, gallery_id): the most similar gallery row of each side but the query itself.

    The score is the inner product of unit vectors, clamped and rounded; ties go to smaller ids. Queries are dealt to
    blocks and the gallery to tiles of bounded size; each pair of both is one group of rows, streamed with its queries
    first, and compared by matrix products of at most 512 by 1,024 entries. Rows with a null id or vector take no part.
    """
    ask = queries.where(F.col(id_).isNotNull() & F.col(vector).isNotNull())
    held = gallery.where(F.col(gallery_id).isNotNull() & F.col(vector).isNotNull())
    blocks, tiles = max(1, -(-ask.count() // block)), max(1, -(-held.count() // tile))
    dealt = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")
    q = ask.select(dealt(id_, blocks).alias("block"), every(tiles).alias("tile"), F.size(vector).alias("dim"), F.lit(0).alias("kind"), F.col(id_).cast("long").alias("id"), F.lit("").alias("side"), v)
    g = held.select(every(blocks).alias("block"), dealt(gallery_id, tiles).alias("tile"), F.size(vector).alias("dim"), F.lit(1).alias("kind"), F.col(gallery_id).cast("long").alias("id"), F.col(side).cast("string").alias("side"), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, rows, best = None, [], [], {}

        def ended():
            found = [(s, i, x, y) for s, (score, who) in best.items() for i, x, y in zip(np.concatenate(ids), score, who, strict=True) if x > -np.inf]
            return pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())], ["query_id", "side", "score", "gallery_id"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if tuple(keys[a, :3]) != name:
                    if best:
                        yield ended()
                    name, ids, rows, best = tuple(keys[a, :3]), [], [], {}
                part = batch.slice(a, b - a)
                own = part.column(4).to_numpy(zero_copy_only=False)
                x = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                if keys[a, 3] == 0:
                    ids.append(own)
                    rows.append(x)
                    continue
                if not rows:
                    continue
                if len(ids) > 1:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                asked, asking, of = ids[0], rows[0], np.array(part.column(5).to_pylist(), object)
                order = np.argsort(own, kind="stable")  # so that the first of equal scores has the smallest id
                own, x, of = own[order], x[order], of[order]
                for s in sorted(set(of)):
                    mine = np.flatnonzero(of == s)
                    score, who = best.setdefault(s, (np.full(len(asked), -np.inf), np.zeros(len(asked), np.int64)))
                    for c in range(0, len(asked), 512):  # products of bounded size, whatever a batch holds
                        rest = slice(c, c + 512)
                        for d in range(0, len(mine), 1024):
                            some = mine[d : d + 1024]
                            value = asking[rest] @ x[some].T
                            np.clip(value, -1, 1, out=value)
                            np.round(value, digits, out=value)
                            value[asked[rest, None] == own[some][None, :]] = -np.inf
                            at = value.argmax(axis=1)
                            top, name_ = value[np.arange(len(at)), at], own[some][at]
                            better = (top > score[rest]) | ((top == score[rest]) & (top > -np.inf) & (name_ < who[rest]))
                            score[rest][better], who[rest][better] = top[better], name_[better]
        if best:
            yield ended()

    both = q.unionByName(g).repartition("block", "tile", "dim").sortWithinPartitions("block", "tile", "dim", "kind")
    found = both.mapInArrow(run, "query_id long, side string, score double, gallery_id long")
    best = found.groupBy("query_id", "side").agg(F.max(F.struct(F.col("score"), (-F.col("gallery_id")).alias("_neg"))).alias("m"))
    return best.select("query_id", "side", F.round("m.score", digits).alias("score"), (-F.col("m._neg")).alias("gallery_id"))

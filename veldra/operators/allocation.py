"""Batches of items under quotas: a greedy choice whose order depends on what was chosen, in rounds over few candidates."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.storage import Scratch

#: Candidates of a class that a round brings to the driver.
ROUND = 2_048


class Shortage(ValueError):
    """No candidate is left for a quota."""


@dataclass(frozen=True)
class Batch:
    """``strata``: how many items of each stratum; ``first``: how many of them from the scarce source. Their total is the batch."""

    name: str
    strata: dict[str, int]
    first: int

    @property
    def rest(self) -> int:
        return sum(self.strata.values()) - self.first


@dataclass(frozen=True)
class Caps:
    per_segment: int
    per_track: int
    frame_gap: int


@dataclass
class _State:
    """What was chosen: of the batch, and the owners of groups over all batches. Its size is the sum of the quotas."""

    caps: Caps
    owners: dict = field(default_factory=dict)
    ids: set = field(default_factory=set)

    def begin(self) -> None:
        self.segments, self.tracks, self.bins, self.frames = Counter(), Counter(), Counter(), defaultdict(list)

    def accepts(self, r, batch: str) -> bool:
        near = any(abs(r["frame"] - f) < self.caps.frame_gap for f in self.frames[r["track"]])
        return r["id"] not in self.ids and self.owners.get(r["grp"], batch) == batch and self.segments[r["segment"]] < self.caps.per_segment and self.tracks[r["track"]] < self.caps.per_track and not near

    def key(self, r, sized: bool) -> tuple:
        return (r["size"] if sized else 0, self.bins[r["bin"]], self.tracks[r["track"]], r["id"])

    def add(self, r, batch: str) -> None:
        self.ids.add(r["id"])
        self.owners[r["grp"]] = batch
        self.segments[r["segment"]] += 1
        self.tracks[r["track"]] += 1
        self.bins[r["bin"]] += 1
        self.frames[r["track"]].append(r["frame"])


def _candidates(rows: DataFrame, state: _State, batch: str, sized: bool, n: int, scratch: Scratch) -> list:
    """The first n rows by the present key among those that the present state accepts; each task keeps n.

    They are written before they are brought to the driver, which would else gather n rows of every task.
    """
    spark = rows.sparkSession
    small = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema))  # no larger than the quotas
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    out = rows
    if state.ids:
        out = out.join(small([(i,) for i in state.ids], f"_id {kind['id']}"), F.col("id") == F.col("_id"), "left_anti")
    foreign = [(g,) for g, b in state.owners.items() if b != batch]
    if foreign:
        out = out.join(small(foreign, f"_g {kind['grp']}"), F.col("grp") == F.col("_g"), "left_anti")
    full = [(s,) for s, k in state.segments.items() if k >= state.caps.per_segment]
    if full:
        out = out.join(small(full, f"_s {kind['segment']}"), F.col("segment") == F.col("_s"), "left_anti")
    near = [(t, f) for t, fs in state.frames.items() for f in fs]
    if near:
        out = out.join(small(near, f"_t {kind['track']}, _f {kind['frame']}"), (F.col("track") == F.col("_t")) & (F.abs(F.col("frame") - F.col("_f")) < state.caps.frame_gap), "left_anti")
    used = [(t, k) for t, k in state.tracks.items() if k]
    out = out.join(small(used, f"_ut {kind['track']}, _uk int"), F.col("track") == F.col("_ut"), "left") if used else out.withColumn("_uk", F.lit(0))
    out = out.where(F.coalesce("_uk", F.lit(0)) < state.caps.per_track)
    bins = [(b, k) for b, k in state.bins.items() if k]
    out = out.join(small(bins, f"_bb {kind['bin']}, _bk int"), F.col("bin") == F.col("_bb"), "left") if bins else out.withColumn("_bk", F.lit(0))
    first = out.orderBy(*(["size"] if sized else []), F.coalesce("_bk", F.lit(0)), F.coalesce("_uk", F.lit(0)), "id").select(*rows.columns).limit(n)
    kept = scratch.keep(first, "first")
    found = kept.collect()
    scratch.drop(kept)
    sort = lambda r: state.key(r, sized)  # a table has no order
    return sorted(found, key=sort)


def allocate(items: DataFrame, first_source: str, batches: list[Batch], first_order: list[str], order: list[str], caps: Caps, scratch: Scratch, n: int = ROUND) -> DataFrame:
    """(id, batch, batch_order, stratum, source): items dealt to batches one after another.

    ``items``: (id, stratum, source, segment, track, frame, bin, grp), ids unique. A batch takes its items of the scarce
    source first, from the first stratum in ``first_order`` with a quota left and a candidate: the one of the smallest
    group, then of the timeline bin and of the track that were chosen least, then of the least id. The others follow in
    ``order`` of the strata, without regard to group sizes. A group belongs to the batch that takes its first item. In a
    batch a segment and a track have at most their caps, and frames of a track are ``frame_gap`` apart. Shortage is
    raised where a quota can't be filled; nothing is filled up from elsewhere. Null keys must not occur.

    The order changes with every choice, but a candidate's key only rises and one that is refused stays refused within a
    batch. So the first ``n`` candidates of a class settle all choices whose key is below the n-th: only then the class is
    asked again, over all rows. The driver holds n rows a class and the choices.
    """
    sizes = items.where(F.col("source") == first_source).groupBy(F.col("grp").alias("_grp")).agg(F.count(F.lit(1)).alias("size"))
    rows = scratch.keep(items.join(sizes, F.col("grp") == F.col("_grp"), "left").select("id", "stratum", "source", "segment", "track", "frame", "bin", "grp", F.coalesce("size", F.lit(0)).alias("size")), "items")
    state, out = _State(caps), []
    for batch in batches:
        state.begin()
        left, kept = dict(batch.strata), {}

        def pick(stratum: str, first: bool, kept=kept, batch=batch):
            while True:
                if (stratum, first) not in kept:
                    source = F.col("source") == first_source
                    rows_of = rows.where((F.col("stratum") == stratum) & (source if first else ~source))
                    found = _candidates(rows_of, state, batch.name, first, n, scratch)
                    kept[stratum, first] = (found, state.key(found[-1], first) if len(found) == n else None)
                found, bound = kept[stratum, first]
                able = [r for r in found if state.accepts(r, batch.name)]
                best = min(able, key=lambda r: state.key(r, first)) if able else None
                if bound is None or (best is not None and state.key(best, first) <= bound):
                    return best
                del kept[stratum, first]

        for first, strata, quota in ((True, first_order, batch.first), (False, order, batch.rest)):
            for _ in range(quota):
                row = next((r for s in strata if left.get(s, 0) > 0 and (r := pick(s, first)) is not None), None)
                if row is None:
                    raise Shortage(f"{batch.name}: no candidate, {left} left")
                state.add(row, batch.name)
                left[row["stratum"]] -= 1
                out.append((row["id"], batch.name, sum(b == batch.name for _, b, *_ in out) + 1, row["stratum"], row["source"]))
    return rows.sparkSession.createDataFrame(out, f"id {rows.schema['id'].dataType.simpleString()}, batch string, batch_order int, stratum string, source string")


def ranked_quota_vectors(capacity: DataFrame, batch: str, least: str, most: str, share: float, total: int) -> DataFrame:
    """Every way to deal ``total`` scarce items over four batches, best first: (v1, v2, v3, v4, total, rank).

    ``capacity``: four rows (batch, least, most) in the order of their names. Where the total doesn't fit, the largest
    one that does is dealt. Best: the shares of the batches' capacities deviate least from ``share``, then the first two
    batches' share least from the other two's, then most items in the first and third batch, then the larger vector.
    """
    ends = capacity.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(batch).alias("_b"), F.col(least).cast("long").alias("lo"), F.col(most).cast("long").alias("hi")))).alias("_c"))  # four rows
    lo, hi = (lambda i: F.col("_c")[i]["lo"]), (lambda i: F.col("_c")[i]["hi"])
    d = ends.withColumn("total", F.least(F.lit(total).cast("long"), hi(0) + hi(1) + hi(2) + hi(3)))
    for i in range(3):
        used = sum((F.col(f"v{j + 1}") for j in range(i)), F.lit(0))
        rest_lo, rest_hi = sum((lo(j) for j in range(i + 1, 4)), F.lit(0)), sum((hi(j) for j in range(i + 1, 4)), F.lit(0))
        a, b = F.greatest(lo(i), F.col("total") - used - rest_hi), F.least(hi(i), F.col("total") - used - rest_lo)
        d = d.withColumn("_a", a).withColumn("_z", b).where("_a <= _z").withColumn(f"v{i + 1}", F.explode(F.sequence("_a", "_z")))
    d = d.withColumn("v4", F.col("total") - F.col("v1") - F.col("v2") - F.col("v3"))
    v = [F.col(f"v{i + 1}") for i in range(4)]
    off = sum((F.abs(v[i] / hi(i) - share) for i in range(4)), F.lit(0.0))
    halves = F.abs((v[0] + v[1]) / (hi(0) + hi(1)) - (v[2] + v[3]) / (hi(2) + hi(3)))
    from veldra.operators.windows import numbered

    keyed = d.select("v1", "v2", "v3", "v4", "total", F.round(off, 9).alias("_off"), F.round(halves, 9).alias("_half"))
    return numbered(keyed, [F.col("_off"), F.col("_half"), (F.col("v1") + F.col("v3")).desc(), F.desc("v1"), F.desc("v2"), F.desc("v3"), F.desc("v4")], "rank").drop("_off", "_half")


class Inconclusive(RuntimeError):
    """The search ended before a quota vector fitted."""


def capacity_search(items: DataFrame, first_source: str, strata: dict[str, dict[str, int]], least: dict[str, int], first_order: list[str], order: list[str], caps: Caps, scratch: Scratch, tries: int = 20) -> tuple[DataFrame, dict[str, int]]:
    """(allocation, scarce items of each batch): the largest number of scarce items over four batches that can be allocated.

    Totals fall from what the batches and the items allow; the vectors of a total are tried in the order of
    ``ranked_quota_vectors``, with the scarce source's share of all items as the aim. Batches keep their totals by
    stratum; what isn't scarce fills them. Every try is a whole allocation; after ``tries`` of them Inconclusive is raised,
    and Shortage where even the least quotas don't fit.
    """
    spark = items.sparkSession
    n, scarce = items.agg(F.count(F.lit(1)), F.count_if(F.col("source") == first_source)).first()
    names = sorted(strata)
    most = {b: sum(strata[b].values()) for b in names}
    capacity = spark.createDataFrame([(b, least[b], most[b]) for b in names], "batch string, least long, most long")
    tried = 0
    for total in range(min(sum(most.values()), scarce), sum(least.values()) - 1, -1):
        for v in ranked_quota_vectors(capacity, "batch", "least", "most", scarce / max(n, 1), total).orderBy("rank").limit(tries - tried).collect():
            quotas = {b: v[f"v{i + 1}"] for i, b in enumerate(names)}
            try:
                return allocate(items, first_source, [Batch(b, strata[b], quotas[b]) for b in names], first_order, order, caps, scratch), quotas
            except Shortage:
                tried += 1
        if tried >= tries:
            raise Inconclusive(f"{tried} quota vectors tried, the last of {total} items")
    raise Shortage("no quota vector fits")


def clean_split(items: DataFrame, edges: DataFrame, keys: list[str], first_source: str, strata: dict[str, dict[str, int]], least: dict[str, int], first_order: list[str], order: list[str], caps: Caps, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """Batches of items of which no leakage group is in two: (id, batch, batch_order, stratum, source, grp), and the scarce quotas.

    ``items``: (id, stratum, source, segment, track, frame, bin) and ``keys``; ids are longs. Items that share a key or an edge
    (a, b), directly or through others, are one leakage group, named by its least id.
    """
    from veldra.operators.graph import connected_components

    all_edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    for k in keys:
        hub = items.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min("id").alias("_hub"))
        all_edges = all_edges.unionByName(items.join(hub, F.col(k) == F.col("_k")).select(F.col("id").alias("a"), F.col("_hub").alias("b")).where("a <> b"))
    groups = connected_components(all_edges, "a", "b", scratch)
    grouped = scratch.keep(items.join(groups, F.col("id") == F.col("node"), "left").select("id", "stratum", "source", "segment", "track", "frame", "bin", F.coalesce("component", "id").alias("grp")), "grouped")
    chosen, quotas = capacity_search(grouped, first_source, strata, least, first_order, order, caps, scratch)
    return chosen.join(grouped.select(F.col("id").alias("_id"), "grp"), F.col("id") == F.col("_id")).drop("_id"), quotas

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators.windows import numbered
from veldra.storage import Scratch


def _mapped(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace both ends by their parents; keep each remaining edge once, smaller end first."""
    a = parents.select(F.col("node").alias("_na"), F.col("parent").alias("_pa"))
    b = parents.select(F.col("node").alias("_nb"), F.col("parent").alias("_pb"))
    out = edges.join(a, edges["lo"] == a["_na"], "left").join(b, edges["hi"] == b["_nb"], "left")
    x, y = F.coalesce("_pa", "lo"), F.coalesce("_pb", "hi")
    return out.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where("lo <> hi").distinct()


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of an undirected edge list of longs; component = smallest reachable node.

    Null ends and self loops are ignored, repeated edges count once; an empty list gives an empty table. Each round
    hooks every node to its smallest smaller neighbour, shortens the chains by two pointer jumps and contracts the
    edges, so a star takes one round and a path a logarithmic number. Chains that two jumps don't end go on in the
    contracted edges. All rounds are joins and partial aggregates; a vertex with a third of all edges is split by
    adaptive skew joins. Nothing is collected.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    left = scratch.keep(edges.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    total = None
    while not left.isEmpty():
        parents = left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))
        up, far = (parents.select(F.col("node").alias(f"_{k}"), F.col("parent").alias(f"_up{k}")) for k in (1, 2))
        hop = parents.join(up, parents["parent"] == up["_1"], "left").withColumn("parent", F.coalesce("_up1", "parent")).select("node", "parent")
        hop = scratch.keep(hop.join(far, hop["parent"] == far["_2"], "left").select("node", F.coalesce("_up2", "parent").alias("parent")), "hop")
        if total is None:
            merged = hop.select("node", F.col("parent").alias("component"))
        else:
            down = hop.select(F.col("node").alias("_n"), F.col("parent").alias("_c"))
            merged = total.join(down, total["component"] == down["_n"], "left").select("node", F.coalesce("_c", "component").alias("component"))
            merged = merged.unionByName(hop.join(total.select(F.col("node").alias("_t")), hop["node"] == F.col("_t"), "left_anti").select("node", F.col("parent").alias("component")))
        kept = scratch.keep(merged, "components")
        nxt = scratch.keep(_mapped(left, hop), "edges")
        scratch.drop(total, left, hop)
        total, left = kept, nxt
    scratch.drop(left)
    if total is None:
        return scratch.spark.createDataFrame([], "node long, component long")
    roots = total.select(F.col("component").alias("node"), "component").distinct()
    return total.unionByName(roots)


def clique_components(vertices: DataFrame, edges: DataFrame, conflicts: DataFrame, id_: str, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(id, component, size, status): components of approved edges, applied only if they are cliques without conflicts.

    status: singleton, applied, incomplete (not every pair is approved) or conflict. The component of a vertex that
    isn't applied is the vertex itself.
    """
    e = edges.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).where("_a <> _b").distinct()
    comp = scratch.keep(connected_components(e, "_a", "_b", scratch), "cliques")
    inside = lambda rows, x, y, name: rows.join(comp.select(F.col("node").alias("_x"), F.col("component").alias("_cx")), F.col(x) == F.col("_x")).join(comp.select(F.col("node").alias("_y"), F.col("component").alias("_cy")), F.col(y) == F.col("_y")).where("_cx = _cy").groupBy(F.col("_cx").alias("component")).agg(F.count(F.lit(1)).alias(name))
    c = conflicts.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct()
    return applied_cliques(vertices, comp, inside(e, "_a", "_b", "approved"), inside(c, "_a", "_b", "conflicts"), id_)


def applied_cliques(vertices: DataFrame, comp: DataFrame, approved: DataFrame, conflicts: DataFrame, id_: str) -> DataFrame:
    """``clique_components`` from ``comp`` (node, component) and the number of approved and of conflicting pairs of each component."""
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    s = size.join(approved, "component", "left").join(conflicts, "component", "left")
    status = F.when(F.col("conflicts") > 0, "conflict").when(F.col("approved") == F.col("size") * (F.col("size") - 1) / 2, "applied").otherwise("incomplete")
    s = s.select(F.col("component").alias("_c"), "size", status.alias("status"))
    v = vertices.select(F.col(id_).cast("long").alias("id")).join(comp, F.col("id") == F.col("node"), "left").join(s, F.col("component") == F.col("_c"), "left")
    done = F.coalesce(F.col("status") == "applied", F.lit(False))
    return v.select("id", F.when(done, F.col("component")).otherwise(F.col("id")).alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("status", F.lit("singleton")).alias("status"))


def groups_by_shared_keys(df: DataFrame, id_: str, keys: list[str], scratch: Scratch) -> DataFrame:
    """(id, group): rows that share a value of any key column, directly or through others, form a group.

    Items are joined to the smallest item of each key value, not to each other, so a frequent value adds one edge a row.
    """
    e = None
    for k in keys:
        hub = df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(id_).alias("_hub"))
        part = df.join(hub, F.col(k) == F.col("_k")).select(F.col(id_).alias("a"), F.col("_hub").alias("b")).where("a <> b")
        e = part if e is None else e.unionByName(part)
    comp = connected_components(e, "a", "b", scratch)
    return df.select(F.col(id_).alias("id")).join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group"))


def range_edges(df: DataFrame, id_: str, key: str, start: str, stop: str) -> DataFrame:
    """(a, b): edges that connect exactly the rows of a key whose inclusive ranges overlap, directly or through others.

    Sorted by start, a row is tied to the one with the latest end so far if it begins before that ends: one edge a row at
    most, no pairs. Null keys connect nothing.
    """
    w = Window.partitionBy(key).orderBy(start, stop, id_).rowsBetween(Window.unboundedPreceding, -1)
    d = df.where(F.col(key).isNotNull()).withColumn("_far", F.max(F.struct(F.col(stop).alias("_end"), F.col(id_).alias("_who"))).over(w))
    return d.where(F.col(start) <= F.col("_far._end")).select(F.col("_far._who").alias("a"), F.col(id_).alias("b"))


def evaluation_components(df: DataFrame, id_: str, keys: list[str], range_keys: list[str], start: str, stop: str, scratch: Scratch) -> DataFrame:
    """(id, component, number, size): rows that share a key value, or whose ranges overlap within a range key's value.

    Components are numbered from 1 by their least start, least end and least id. Ids are longs, each once.
    """
    e = None
    for k in keys:
        hub = df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("_k")).agg(F.min(id_).alias("_hub"))
        part = df.join(hub, F.col(k) == F.col("_k")).select(F.col(id_).alias("a"), F.col("_hub").alias("b")).where("a <> b")
        e = part if e is None else e.unionByName(part)
    for k in range_keys:
        part = range_edges(df, id_, k, start, stop)
        e = part if e is None else e.unionByName(part)
    comp = connected_components(e, "a", "b", scratch)
    all_ = df.select(F.col(id_).alias("id"), F.col(start).alias("_s"), F.col(stop).alias("_e")).join(comp, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    all_ = scratch.keep(all_.select("id", "component", "_s", "_e"), "members")
    each = all_.groupBy(F.col("component").alias("_c")).agg(F.min("_s").alias("_s0"), F.min("_e").alias("_e0"), F.min("id").alias("_i0"), F.count(F.lit(1)).alias("size"))
    order = numbered(each, [F.col("_s0"), F.col("_e0"), F.col("_i0")], "number")
    return all_.select("id", "component").join(order, F.col("component") == F.col("_c")).select("id", "component", "number", "size")

"""Linking the members of nodes (buckets, bands, tree nodes) without emitting the pairs of a group.

A node is a set of items that may be linked. Only nodes whose items lie in two components or more matter. Their rows
are dealt to blocks of bounded size, a large node by a salt; one task compares a block's items with each other and
returns a spanning forest of the links that it finds, so what comes out never exceeds the items that went in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.operators.graph import connected_components
from veldra.storage import Scratch

#: Items of a block and bytes of their content; larger nodes are dealt to several blocks.
SMALL, BLOCK_BYTES = 2048, 8 << 20
#: Nodes of up to so many blocks are compared exhaustively, block by block.
BLOCKS = 8
#: Cells of a dense matrix that is held at once.
CELLS = 1 << 21


#: Rows of a table that are broadcast, at most (16 MB of numbers); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 19


def sized(df: DataFrame) -> DataFrame:
    """A written table of numbers, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``rows`` (node, item, size) of the nodes with at least two items."""
    many = rows.groupBy(F.col("node").alias("_node")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_node")
    many = scratch.keep(many, "shared")
    out = scratch.keep(rows.join(sized(many), F.col("node") == F.col("_node"), "left_semi"), "rows")
    scratch.drop(many)
    return out


def mixed_rows(rows: DataFrame, components: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(node, item, size, comp, blocks): rows of the nodes whose items are in two components or more; ``rows``: (node, item, size).

    ``components``: (node, component) of linked items; all others are their own. ``blocks``: how many blocks the node needs.
    Both sides of the last join are plain tables, so a node with a third of all rows is split by an adaptive skew join.
    """
    own = rows.withColumn("comp", F.col("item"))
    if components is not None:
        c = components.select(F.col("node").alias("_item"), F.col("component").alias("_comp"))
        own = scratch.keep(rows.join(sized(c), F.col("item") == c["_item"], "left").select("node", "item", "size", F.coalesce("_comp", "item").alias("comp")), "owned")
    stats = own.groupBy(F.col("node").alias("_node")).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes")).where("_lo <> _hi")
    stats = scratch.keep(stats.select("_node", F.greatest(F.ceil(F.col("_n") / SMALL), F.ceil(F.col("_bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks")), "nodes")
    out = scratch.keep(own.join(sized(stats), F.col("node") == F.col("_node")).select("node", "item", "size", "comp", "blocks"), "mixed")
    scratch.drop(stats)
    if components is not None:
        scratch.drop(own)
    return out


def block_key(salt: int) -> Column:
    """The block of a row (node, item, blocks); another ``salt`` deals the items of a large node differently."""
    return F.xxhash64("node", F.pmod(F.xxhash64("item", F.lit(salt)), F.col("blocks")))


def block_pairs(rows: DataFrame, salt: int) -> DataFrame:
    """(key, item, comp): rows of nodes of several blocks, repeated so that any two items of a node meet in a pair of blocks."""
    own = F.pmod(F.xxhash64("item", F.lit(salt)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = rows.select("node", "item", "comp", own.alias("_i"), other.alias("_j")).where("_i <> _j")
    return both.select(F.xxhash64("node", F.least("_i", "_j"), F.greatest("_i", "_j")).alias("key"), "item", "comp")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of some whole blocks, where each begins and the end), from batches sorted by their first column, the key."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        out = pa.Table.from_batches(held)
        key = out.column(0).to_numpy()
        return out, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))

    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = len(key) - int((key[::-1] != key[-1]).argmax()) if key[0] != key[-1] else 0
        if held and (last or held[0].column(0)[0].as_py() != int(key[0])):
            held.append(batch.slice(0, last))
            yield table()
            held = []
        elif last:
            held = [batch.slice(0, last)]
            yield table()
            held = []
        held.append(batch.slice(last))
    if held:
        yield table()


def column(table: pa.Table, i: int) -> np.ndarray:
    return table.column(i).to_numpy()


def in_blocks(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of whole blocks and their edges; the first column of ``rows`` is the key."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches):
            out = work(table, edges)
            if out is not None and len(out):
                yield out

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


#: Blocks of up to so many items are compared many at a time.
FEW = 8


def agreeing(tokens: np.ndarray, comps: np.ndarray, least: int) -> np.ndarray:
    """True for each item that agrees in ``least`` tokens with an item of another component."""
    n = len(tokens)
    out = np.zeros(n, bool)
    step = max(1, CELLS // max(1, tokens.size))
    for a in range(0, n, step):
        part = tokens[a : a + step]
        same = np.zeros((len(part), n), np.int16)
        for j in range(tokens.shape[1]):
            same += part[:, j][:, None] == tokens[:, j][None, :]
        out[a : a + step] = ((same >= least) & (comps[a : a + step, None] != comps[None, :])).any(axis=1)
    return out


def agreeing_in_blocks(tokens: np.ndarray, comps: np.ndarray, edges: np.ndarray, least: int) -> np.ndarray:
    """``agreeing`` in each block."""
    out, size = np.zeros(len(tokens), bool), np.diff(edges)
    for n in range(2, FEW + 1):
        first = edges[:-1][size == n]
        step = max(1, CELLS // (n * n * tokens.shape[1]))
        for a in range(0, len(first), step):
            at = first[a : a + step, None] + np.arange(n)[None, :]
            t, c = tokens[at], comps[at]
            same = (t[:, :, None, :] == t[:, None, :, :]).sum(axis=3, dtype=np.int16)
            out[at] = ((same >= least) & (c[:, :, None] != c[:, None, :])).any(axis=2)
    for g in np.flatnonzero(size > FEW):
        own = slice(edges[g], edges[g + 1])
        out[own] = agreeing(tokens[own], comps[own], least)
    return out


def similar(sets: list[np.ndarray], numerator: int) -> np.ndarray:
    """Matrix of the pairs of sorted sets with 100 * intersection >= numerator * union; empty sets are like nothing."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    flat, row = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    ident = np.cumsum(new) - 1
    shared = np.bincount(ident) > 1 if len(ident) else np.zeros(0, bool)
    keep = shared[ident]
    ident, row = (np.cumsum(shared) - 1)[ident[keep]], row[keep]
    common = np.zeros((n, n), np.float32)  # whole numbers, exact up to 1 << 24
    width, total = max(256, CELLS // max(1, n)), int(shared.sum())
    for a in range(0, total, width):
        lo, hi = np.searchsorted(ident, (a, a + width))
        x = np.zeros((n, min(width, total - a)), np.float32)
        x[row[lo:hi], ident[lo:hi] - a] = 1
        common += x @ x.T
    out = np.zeros((n, n), bool)
    for a in range(0, n, max(1, CELLS // max(1, n))):
        some = slice(a, a + max(1, CELLS // max(1, n)))
        both = size[some, None] + size[None, :] - common[some].astype(np.int64)
        out[some] = (100 * common[some].astype(np.int64) >= numerator * both) & (size[some, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left, a, b = linked.any(axis=1), [], []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(linked[u] & left)
            left[found] = False
            a += [u] * len(found)
            b += found.tolist()
            todo += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _few(sets: list[np.ndarray], rows: np.ndarray, group: np.ndarray, numerator: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` of one group with 100 * intersection >= numerator * union, from the elements that they share."""
    size = np.fromiter((len(sets[i]) for i in rows), np.int64, len(rows))
    place = np.repeat(np.arange(len(rows)), size)
    flat = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in rows)])
    order = np.lexsort((flat, group[place]))
    flat, place = flat[order], place[order]
    n = len(rows)
    codes = [np.zeros(0, np.int64)]
    for d in range(1, FEW):
        both = np.flatnonzero((flat[d:] == flat[:-d]) & (group[place[d:]] == group[place[:-d]])) if len(flat) > d else np.zeros(0, np.int64)
        if not len(both):
            break
        x, y = place[both], place[both + d]
        codes.append(np.minimum(x, y) * n + np.maximum(x, y))
    code, common = np.unique(np.concatenate(codes), return_counts=True)
    i, j = code // n, code % n
    near = 100 * common >= numerator * (size[i] + size[j] - common)
    return rows[i[near]], rows[j[near]]


def linked_in_blocks(items: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], edges: np.ndarray, numerator: int) -> pa.RecordBatch:
    """(a, b): a spanning forest of the links between components in each block; ``sets``: sorted and distinct."""
    size = np.diff(edges)
    group = np.repeat(np.arange(len(size)), size)
    rows = np.flatnonzero((size[group] > 1) & (size[group] <= FEW))
    i, j = _few(sets, rows, group[rows], numerator)
    other = comps[i] != comps[j]
    a, b, root = [], [], {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for x, y in zip(i[other].tolist(), j[other].tolist(), strict=True):
        u, v = top(x), top(y)
        if u != v:
            root[u] = v
            a.append(x)
            b.append(y)
    for g in np.flatnonzero(size > FEW):
        first, stop = edges[g], edges[g + 1]
        links = similar(sets[first:stop], numerator)
        links &= comps[first:stop, None] != comps[None, first:stop]
        x, y = forest(links)
        a += (x + first).tolist()
        b += (y + first).tolist()
    return pa.RecordBatch.from_arrays([pa.array(items[np.array(a, np.int64)], pa.int64()), pa.array(items[np.array(b, np.int64)], pa.int64())], ["a", "b"])


class Forest:
    """The links found so far and their components, (node, component); None before the first link."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.links, self.components = scratch, None, None

    def add(self, links: DataFrame) -> None:
        """Take in more links (a, b), a written table."""
        if links.isEmpty():
            return
        self.links = links if self.links is None else self.links.unionByName(links)
        old, self.components = self.components, self.scratch.keep(components_of(self.links, self.scratch), "components")
        self.scratch.drop(old)

    def compare(self, shared: DataFrame, salt: int, linked: Callable[[DataFrame], DataFrame], last: bool = False) -> DataFrame | None:
        """Compare the items of nodes, ``shared``: a table from ``shared_rows``, and return the rows (node, item) of those too large.

        ``linked``: rows (key, item, comp) -> links of each block, a written table. The blocks of a node come first, so
        that groups contract; what is still in several components then meets block by block, in nodes of up to
        ``BLOCKS`` blocks, or in all of them if this is the ``last`` comparison.
        """
        mixed = mixed_rows(shared, self.components, self.scratch)
        self.add(linked(mixed.select(block_key(salt).alias("key"), "item", "comp")))
        more = F.col("blocks") > 1 if last else F.col("blocks").between(2, BLOCKS)
        several = mixed.where(more).select("node", "item", "size")
        if not several.isEmpty():
            again = mixed_rows(several, self.components, self.scratch)
            self.add(linked(block_pairs(again.where("blocks > 1"), salt)))
            self.scratch.drop(again)
        large = None if last else self.scratch.keep(mixed.where(F.col("blocks") > BLOCKS).select("node", "item"), "large")
        self.scratch.drop(shared, mixed)
        return large

    def table(self) -> DataFrame:
        return self.scratch.spark.createDataFrame([], "node long, component long") if self.components is None else self.components


def components_of(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the links' ends; see ``graph.connected_components`` for nulls, repeats and empty tables."""
    return connected_components(links, "a", "b", scratch)

"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``k`` words. Documents with equal sets form a class, and only one
document of each class goes on. Each is embedded as ``TOKENS`` minwise tokens. A tree deals documents to nodes by a
selected token. The documents of a small node are compared exhaustively: first their tokens, with a bound that a pair
at the threshold misses with a probability of about 2e-6, then, of those that agree with one of another component, the full
sets. Nodes are compared in blocks, first each block for itself, so that groups of near copies contract, then pairs of
blocks. A node of many blocks contracts alike and then branches by tokens selected by its own hash, 1.75 on average.
Independent trees repeat this.

A pair with a similarity of 0.8 follows an endless path of common tokens with a probability of 5/6 below a node, as
q = 1/6 solves q = u / 4 + 3 * u ** 2 / 4 with u = 0.2 + 0.8 * q. So it misses ``TREES`` trees with a probability of
(1 - 0.8 * 5/6) ** 12 = 2e-6 at most, however deep they are.

Components are contracted between steps: nodes whose documents are all in one component are left out, and only pairs
across components count. No pair is ever written but the links of a spanning forest. Nodes that are still large after
``LEVELS`` branchings, which takes documents that agree in nearly all tokens, are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm import clusters
from veldra.llm import textcodes as tc
from veldra.storage import Scratch

TOKENS = 64
#: Independent trees, and how many of them are dealt first, before most near copies are contracted.
TREES, FIRST_TREES = 12, 2
LEVELS = 16
#: Equal tokens of 64 that a pair must have: 5 standard deviations under the mean at a similarity of 0.8.
AGREE = 35
#: Rows (key, item, component) that are broadcast to pick texts (8 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18

_SKETCH = "id long, n_shingles long, size long, s1 long, s2 long, tok array<int>"


def sketches(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(id, n_shingles, size, s1, s2, tok): set size, bytes, 128-bit signature of the set, minwise tokens. Null texts have no words."""
    tc.bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = tc.keys(TOKENS)
        for batch in batches:
            data, offsets = tc.utf8(batch.column(1))
            size, sign, tok = np.zeros(len(offsets) - 1, np.int64), np.zeros((len(offsets) - 1, 2), np.uint64), np.zeros((len(offsets) - 1, TOKENS), np.int32)
            for a, b in tc.chunks(offsets):
                h, _, _, at = tc.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tc.SPACED)
                for i in range(a, b):
                    s = tc.shingle_set(h[at[i - a] : at[i - a + 1]], k)
                    size[i] = len(s)
                    if len(s):
                        sign[i] = tc.mix(s).sum(), tc.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                        tok[i] = tc.minwise(s, keys)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(tok.ravel()), TOKENS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.diff(offsets)), pa.array(sign[:, 0].view(np.int64)), pa.array(sign[:, 1].view(np.int64)), lists], ["id", "n_shingles", "size", "s1", "s2", "tok"])

    return docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sketch, _SKETCH)


def _links(rows: DataFrame, tokens: DataFrame, docs: DataFrame, doc: str, text: str, k: int, numerator: int, scratch: Scratch) -> DataFrame:
    """(a, b) of a spanning forest of the links in each block; ``rows``: (key, item, comp).

    Tokens travel first. Only the texts of documents that agree with one of another component in their block do then,
    one text a row; a task holds the texts of one block.
    """
    t = tokens.select(F.col("item").alias("_item"), F.col("tok").alias("tok"))
    sketched = rows.join(t, F.col("item") == t["_item"]).select("key", "item", "comp", "tok")

    def promising(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch | None:
        tok = table.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), TOKENS)
        hit = clusters.agreeing_in_blocks(tok, clusters.column(table, 2), edges, AGREE)
        return table.select([0, 1, 2]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None

    wanted = scratch.keep(clusters.in_blocks(sketched, promising, "key long, item long, comp long").distinct(), "wanted")
    want = wanted.select("key", F.col("item").alias("_item"), "comp")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    if few:
        want = F.broadcast(want)
    else:
        ids = wanted.select(F.col("item").alias("_id")).distinct()
        texts = texts.join(ids, F.col("id") == F.col("_id"), "left_semi")
    placed = texts.join(want, F.col("id") == F.col("_item")).select("key", "id", "comp", "text")

    def verified(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        data, offsets = tc.utf8(table.column(3).combine_chunks())
        sets = []
        for a, b in tc.chunks(offsets):
            h, _, _, at = tc.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tc.SPACED)
            sets += [tc.shingle_set(h[at[i] : at[i + 1]], k) for i in range(b - a)]
        return clusters.linked_in_blocks(clusters.column(table, 1), clusters.column(table, 2), sets, edges, numerator)

    links = scratch.keep(clusters.in_blocks(placed, verified, "a long, b long"), "links")
    scratch.drop(wanted)
    return links


def _branch(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Deal the rows (node, item) of large nodes to child nodes by one token, and by a second in three of four nodes."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(4)) > 0, F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS)))
    picks = F.filter(F.array(first, second), lambda x: x.isNotNull())
    t = tokens.select(F.col("item").alias("_item"), F.col("size").alias("size"), F.col("tok").alias("_tok"))
    out = rows.join(t, F.col("item") == t["_item"]).select("node", "item", "size", "_tok", F.explode(picks).alias("_pos"))
    return out.select(F.xxhash64("node", "_pos", F.element_at("_tok", F.col("_pos") + 1)).alias("node"), "item", "size").distinct()


def near_duplicates(docs: DataFrame, doc: str, text: str, k: int = 5, numerator: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    component_id: the smallest doc_id reachable by links of Jaccard similarity >= numerator / 100, itself included.
    Documents without words or with null text have n_shingles 0 and are alone. Rows with a null id are linked with
    nothing: component_id null, kept true. Repeated rows each return. A doc_id with several texts has the links of all.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    s = scratch.keep(sketches(docs, doc, text, k), "sketches")
    linkable = s.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = scratch.keep(linkable.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    c = classes.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("rep"))
    same_rep = (linkable["s1"] == c["_s1"]) & (linkable["s2"] == c["_s2"]) & (linkable["id"] == c["rep"])
    tokens = scratch.keep(linkable.join(c, same_rep, "left_semi").select(F.col("id").alias("item"), "size", "tok").distinct(), "tokens")

    found = clusters.Forest(scratch)
    # A doc_id with several texts joins their classes.
    twice = linkable.groupBy(F.col("id").alias("_id")).agg(F.min("s1").alias("_lo"), F.max("s1").alias("_hi")).where("_lo <> _hi").select("_id")
    several = linkable.join(twice, linkable["id"] == F.col("_id"), "left_semi").join(c, (linkable["s1"] == c["_s1"]) & (linkable["s2"] == c["_s2"]))
    found.add(scratch.keep(several.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "several"))
    linked = lambda rows: _links(rows, tokens, docs, doc, text, k, numerator, scratch)
    large = []
    for a, b in ((1, FIRST_TREES), (FIRST_TREES + 1, TREES)):
        picks = F.posexplode(F.slice("tok", a, b - a + 1)).alias("t", "v")
        dealt = tokens.select("item", "size", picks).select(F.xxhash64(F.col("t") + a, "v").alias("node"), "item", "size").distinct()
        large.append(found.compare(clusters.shared_rows(dealt, scratch), 0, linked))
        scratch.sweep()
    rest = large[0].unionByName(large[1])
    for level in range(1, LEVELS + 1):
        if rest is None or rest.isEmpty():
            break
        rest = found.compare(clusters.shared_rows(_branch(rest, tokens), scratch), level, linked, level == LEVELS)
        scratch.sweep()

    comps = found.table()
    reach = classes.join(comps.select(F.col("node").alias("_n"), F.col("component")), F.col("rep") == F.col("_n"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("_root"))
    r = reach.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "_root")
    narrow = s.select("id", "n_shingles", "s1", "s2")
    out = narrow.join(r, (narrow["s1"] == r["_s1"]) & (narrow["s2"] == r["_s2"]) & (F.col("n_shingles") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("_root", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

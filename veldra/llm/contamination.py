"""Benchmark decontamination by suffix arrays over shards of the training text.

Every Arrow batch of training documents is cut into shards of bounded size. A shard gets a suffix array over its word
sequence (by rank combination, to a context of 16 words). Every suffix of every benchmark item is located by binary
search for its window, and each match is extended to its longest verbatim length. A document lies whole in one shard,
so no shuffle is needed, and a lost executor costs its own shards. A small benchmark is broadcast; a larger one is written
in blocks to the shared folder, and each shard is searched for one block after another, so that a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm import textcodes as tc
from veldra.storage import Scratch, exists

#: Words that a benchmark item's window has; a shorter item is one window.
WINDOW = 10
#: Words of context by which suffixes are ordered; longer matches are extended word by word.
CONTEXT = 16
#: Bytes of benchmark text that are broadcast or read at once; larger benchmarks are taken block by block.
BLOCK_BYTES = 16 << 20
_kept: list = [None, None]
_PAIRS = 1 << 20


def suffix_array(ranks: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``context`` entries at least."""
    rank, span = ranks.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < context and len(rank):
        bits = max(1, int(rank.max()).bit_length())
        take = max(2, min(-(-context // span), 63 // bits))
        key = rank.copy()
        for j in range(1, take):
            key <<= bits
            if j * span < len(rank):
                key[: len(rank) - j * span] |= rank[j * span :]
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(len(key), np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank, span = new, span * take
    return order


class Benchmark:
    """The words of a block of benchmark items, one after another, and the windows to look for."""

    def __init__(self, items: list, texts: list[str], window: int = WINDOW):
        data, offsets = tc.utf8(pa.array(texts, pa.large_string()))
        self.words, _, _, at = tc.words(data, offsets, tc.ALNUM)
        size = np.diff(at)
        self.item = np.repeat(np.asarray(items, np.int64), size)
        self.end = np.repeat(at[1:], size)
        self.begin = np.repeat(at[:-1], size)
        pos = np.arange(len(self.words))
        width = np.minimum(window, np.repeat(size, size))
        keep = pos + width <= self.end
        self.test, self.width = pos[keep], width[keep]


def _bounds(sa: np.ndarray, seq: np.ndarray, want: np.ndarray, width: np.ndarray, upper: bool) -> np.ndarray:
    """First place in ``sa`` whose suffix isn't below (upper: is above) each wanted word row, over its width."""
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        at, sign = sa[mid], np.zeros(len(live), np.int8)
        for j in range(want.shape[1]):
            open_ = (sign == 0) & (j < width[live])
            p = at + j
            here = np.where(p < len(seq), seq[np.minimum(p, len(seq) - 1)], -1)
            sign = np.where(open_, np.sign(here - want[live, j]).astype(np.int8), sign)
        right = (sign < 0) | (upper & (sign == 0))
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)


class SuffixArray:
    """Of the word hashes of a shard, 0 between documents."""

    def __init__(self, seq: np.ndarray):
        self.vocabulary, self.ranks = np.unique(seq, return_inverse=True)
        self.order = suffix_array(self.ranks)


def longest_matches(shard: SuffixArray, bench: Benchmark) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(benchmark position, training position, length) of verbatim matches that can't be extended on either side.

    Yields bounded groups.
    """
    vocabulary, ranks, sa = shard.vocabulary, shard.ranks, shard.order
    if not len(ranks) or not len(bench.test):
        return
    where = np.searchsorted(vocabulary, bench.words)
    known = (where < len(vocabulary)) & (vocabulary[np.minimum(where, len(vocabulary) - 1)] == bench.words)
    target = np.where(known, where, len(vocabulary) + 1)
    most = int(bench.width.max())
    grid = np.minimum(bench.test[:, None] + np.arange(most)[None, :], len(target) - 1)
    want = target[grid]
    can = np.flatnonzero(np.all((want < len(vocabulary)) | (np.arange(most)[None, :] >= bench.width[:, None]), axis=1))
    test, width, want = bench.test[can], bench.width[can], want[can]
    low, high = _bounds(sa, ranks, want, width, False), _bounds(sa, ranks, want, width, True)
    count = high - low
    test, width, low, count = (x[count > 0] for x in (test, width, low, count))
    done, total = 0, np.cumsum(count)
    while done < len(test):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, "right")))
        c = count[done:stop]
        i = np.repeat(test[done:stop], c)
        size = np.repeat(width[done:stop], c)
        p = sa[np.repeat(low[done:stop], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        done = stop
        before = (i > bench.begin[i]) & (p > 0)
        before &= target[np.maximum(i - 1, 0)] == ranks[np.maximum(p - 1, 0)]
        i, p, size = i[~before], p[~before], size[~before].copy()
        live = np.arange(len(i))
        while len(live):
            a, b = i[live] + size[live], p[live] + size[live]
            more = (a < bench.end[i[live]]) & (b < len(ranks))
            more &= target[np.minimum(a, len(target) - 1)] == ranks[np.minimum(b, len(ranks) - 1)]
            live = live[more]
            size[live] += 1
        yield i, p, size


class Shard:
    """Some texts, their suffix array, and what was found in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, _, _, at = tc.words(data, offsets, tc.ALNUM)
        self.n = np.diff(at)
        place = np.arange(len(h)) + np.repeat(np.arange(len(self.n)), self.n)  # a gap of one after each text
        seq = np.zeros(len(h) + len(self.n), np.uint64)
        seq[place] = np.where(h == 0, np.uint64(1), h)
        self.shift = at[:-1] + np.arange(len(self.n))
        self.array = SuffixArray(seq)
        self.change = np.zeros(len(seq) + 1, np.int64)
        self.found: list[np.ndarray] = []

    def search(self, bench: Benchmark) -> None:
        for i, p, size in longest_matches(self.array, bench):
            np.add.at(self.change, p, 1)
            np.add.at(self.change, p + size, -1)
            d = np.searchsorted(self.shift, p, "right") - 1
            self.found.append(np.stack((d, bench.item[i], p - self.shift[d], size, i - bench.begin[i])))

    def matches(self) -> np.ndarray:
        """Columns (text, item, place in the text, length, place in the item)."""
        return np.concatenate([np.zeros((5, 0), np.int64), *self.found], axis=1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, one past the last) of the runs of words that matches cover."""
        hit = (np.cumsum(self.change[:-1]) > 0).astype(np.int8)
        edge = np.diff(np.concatenate(([0], hit, [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        d = np.searchsorted(self.shift, a, "right") - 1
        return d, a - self.shift[d], b - self.shift[d]


@dataclass(frozen=True)
class Blocks:
    """A benchmark of bounded size (``small``), or the folders of its blocks."""

    small: Benchmark | None
    folders: tuple[str, ...] = ()

    def each(self) -> Iterator[Benchmark]:
        if self.small is not None:
            yield self.small
        for folder in self.folders:
            if _kept[0] != folder:
                table = _read(folder)
                _kept[:] = [folder, Benchmark(table.column("i").to_pylist(), table.column("t").to_pylist())]
            yield _kept[1]


def _read(folder: str) -> pa.Table:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    return pyarrow.dataset.dataset(path, filesystem=fs, format="parquet").to_table()


def _searched(column: pa.Array, blocks: Blocks) -> list[tuple[int, Shard]]:
    """The shards of a batch with the number of their first row, searched for all blocks."""
    data, offsets = tc.utf8(column)
    shards = [(a, Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in tc.chunks(offsets)]
    for bench in blocks.each():
        for _, shard in shards:
            shard.search(bench)
    return shards


_RESULT = "n_words long, spans array<struct<start:long,stop:long>>, items array<long>"


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _searcher(held):
    """Arrow UDF: text -> (words, hit spans, items)."""

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [[], [], [], [], [], []]
            for a, shard in _searched(column, held.value):
                d, s, e = shard.hits()
                pair = np.unique(shard.matches()[:2], axis=1)
                for to, x in zip(out, (shard.n, d + a, s, e, pair[0] + a, pair[1]), strict=True):
                    to.append(x)
            n, d, s, e, di, it = (np.concatenate([np.zeros(0, np.int64), *x]) for x in out)
            spans = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["start", "stop"])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), _lists(d, len(column), spans), _lists(di, len(column), pa.array(it, pa.int64()))], ["n_words", "spans", "items"])

    from pyspark.sql.pandas.functions import ArrowUDFType

    return F.arrow_udf(search, _RESULT, ArrowUDFType.SCALAR_ITER)


def benchmark_blocks(bench: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES):
    """A broadcast of ``Blocks``: the benchmark itself up to ``block_bytes`` of text, else the folders of blocks of about that size.

    Null texts have no words; rows with a null item id take no part; repeated rows count once.
    """
    spark = bench.sparkSession
    rows = bench.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    if size + 16 * n <= block_bytes:
        found = rows.collect()  # block_bytes at most
        return spark.sparkContext.broadcast(Blocks(Benchmark([r.i for r in found], [r.t for r in found])))
    parts = -(-(size + 16 * n) // block_bytes)
    folder = Scratch(spark, "benchmark").fresh("blocks")
    rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(parts))).repartition(parts, "block").write.partitionBy("block").parquet(folder)
    names = [f"{folder}/block={k}" for k in range(parts)]
    return spark.sparkContext.broadcast(Blocks(None, tuple(x for x in names if exists(spark, x))))


def find_contamination(docs: DataFrame, text: str, bench: DataFrame, item: str, item_text: str, into: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, spans (word positions that benchmark windows cover), items.

    Null texts have no words; a column already called ``into`` is replaced, others stay; an empty benchmark hits nothing.
    A null item id takes no part. Repeated rows are judged alike.
    """
    tc.bounded_batches(docs.sparkSession)
    return docs.drop(into).withColumn(into, _searcher(benchmark_blocks(bench, item, item_text, block_bytes))(F.col(text)))


def decontaminate(docs: DataFrame, text: str, bench: DataFrame, item: str, item_text: str) -> DataFrame:
    """``docs`` without the rows in which any benchmark window occurs. Null and empty texts stay."""
    into = "_contamination"
    return find_contamination(docs, text, bench, item, item_text, into).where(F.size(f"{into}.items") == 0).drop(into)


def locations(docs: DataFrame, doc: str, text: str, bench: DataFrame, item: str, item_text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, doc_start, item_id, item_start, n_words) of each longest verbatim match; word positions from 0."""
    tc.bounded_batches(docs.sparkSession)
    held = benchmark_blocks(bench, item, item_text, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, shard in _searched(batch.column(1), held.value):
                m = shard.matches()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(m[0] + a)), *(pa.array(x, pa.int64()) for x in (m[2], m[1], m[4], m[3]))], ["doc_id", "doc_start", "item_id", "item_start", "n_words"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, "doc_id long, doc_start long, item_id long, item_start long, n_words long")

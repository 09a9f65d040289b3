"""Substring dedup: MinHash banding of paragraphs.

A text is cut into paragraphs at places that the words around them choose (the word whose hash is least among its
``REACH`` neighbours on either side ends one), so that a passage copied into other surroundings is cut alike and holds
whole paragraphs. Paragraphs with equal sets of ``SHINGLE``-word shingles form a class. Bands of minwise hashes, tuned
for the wanted recall with the fewest rows, bring similar classes together. The exact Jaccard
similarity of classes that collide is verified on full sets in blocks of bounded size (see clusters), and connected components of the links are the clusters. Of a cluster that spans documents, the first
paragraph by document and position stays and all others are removals; neighbouring removals join to one span.
A span that is short stays only if the words around one of its paragraphs go on alike in an earlier document, so far
that the run they share is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm import clusters
from veldra.llm import textcodes as tc
from veldra.storage import Scratch

SHINGLE, REACH = 5, 7
#: A span of removals, or the run of words that it shares with an earlier document, has at least so many words.
LEAST_WORDS = 20


def tuned_bands(similarity: float, recall: float) -> tuple[int, int]:
    """(bands, rows of a band) with the fewest bands that find a pair of this similarity with this probability.

    One row a band always needs the fewest; a second is taken where it costs none, as it keeps unlike pairs apart.
    """
    need = lambda r: next(b for b in range(1, 1 << 20) if 1 - (1 - similarity**r) ** b >= recall)
    return need(1), max(r for r in range(1, 9) if need(r) == need(1))


def cuts(hashes: np.ndarray, at: np.ndarray, reach: int = REACH) -> np.ndarray:
    """True for each word that begins a paragraph; ``at``: index of each text's first word, one more than texts."""
    n, size = len(hashes), np.diff(at)
    first = np.zeros(n, bool)
    if not n:
        return first
    text = np.repeat(np.arange(len(size)), size)
    high = np.iinfo(np.uint64).max
    place = np.arange(n) + reach * (text + 1)  # a gap around every text
    padded = np.full(n + reach * (len(size) + 1), high, np.uint64)
    key = np.full(n, high, np.uint64)
    key[:-1] = tc.mix(hashes[:-1] + hashes[1:] * np.uint64(0x9FB21C651E98DF25))  # of two words: single ones are too frequent
    key[at[1:][size > 0] - 1] = high
    padded[place] = key
    least = padded.copy()
    for d in range(1, reach + 1):
        np.minimum(least[d:], padded[:-d], out=least[d:])
        np.minimum(least[:-d], padded[d:], out=least[:-d])
    chosen = (least[place] == key) & (key != high)
    since, left = np.arange(n) - at[text], at[text + 1] - np.arange(n)
    chosen &= (since + 1 >= reach) & (left - 1 >= reach)
    first[1:] = chosen[:-1]
    run, last = first.copy(), first.copy()
    run[1:] &= ~first[:-1]  # of neighbouring ties the first and the last count
    last[:-1] &= ~first[1:]
    run |= last
    run[at[:-1][size > 0]] = True
    return run


def _bounds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, one past the last word, text, position) of the paragraphs; short cuts are joined to what follows.

    The last paragraph of a text is never short, unless the whole text is; such texts have none.
    """
    begin = np.flatnonzero(cuts(h, at))
    text = np.searchsorted(at, begin, "right") - 1
    size = np.append(begin[1:], len(h)) - begin
    joined = np.zeros(len(begin), bool)
    small = np.flatnonzero(size < SHINGLE)
    words, follows = 0, -1
    for u, n in zip(small.tolist(), size[small].tolist(), strict=True):
        words = n + (words if u == follows else 0)
        if words < SHINGLE and u + 1 < len(begin) and text[u + 1] == text[u]:
            joined[u + 1], follows = True, u + 1
        else:
            follows = -1
    begin, text = begin[~joined], text[~joined]
    end = np.append(begin[1:], len(h))
    order = np.arange(len(begin)) - np.searchsorted(text, text)
    keep = end - begin >= SHINGLE
    return begin[keep], end[keep], text[keep], order[keep]


def _chunk_units(data: np.ndarray, offsets: np.ndarray):
    """For the texts of one chunk: (text, position, first byte, last byte, words, signature, shingles, their first index)."""
    h, start, stop, at = tc.words(data, offsets, tc.SPACED)
    begin, end, text, order = _bounds(h, at)
    size = end - begin
    if not len(begin):
        return None
    every = tc.shingles(h, SHINGLE)
    count = size - SHINGLE + 1
    first = np.cumsum(count) - count
    own = tc.gathered(every, begin, count)
    signature = tc.mix(np.add.reduceat(tc.mix(own), first) + count.astype(np.uint64)).view(np.int64)
    return text, order, start[begin], stop[end - 1], size, signature, own, np.append(first, len(own))


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, ord, start, stop, n_words, sig, b0, b1, ...) of all paragraphs; start and stop in code points.

    ``docs``: (_doc, _row, _text). ``sig``: 64-bit signature of the paragraph's shingles. ``b``: the keys of the bands.
    Null texts have none.
    """
    tc.bounded_batches(docs.sparkSession)
    names = ["doc_id", "row", "ord", "start", "stop", "n_words", "sig", *(f"b{i}" for i in range(bands))]
    schema = "doc_id long, row long, ord int, start int, stop int, n_words int, sig long" + "".join(f", b{i} long" for i in range(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = tc.keys(bands * rows, 3)
        for batch in batches:
            data, offsets = tc.utf8(batch.column(2))
            for a, b in tc.chunks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found = _chunk_units(part, own)
                if found is None:
                    continue
                text_, order, start, stop, size, signature, sh, first = found
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                zero = points[own[text_]]
                least = [np.minimum.reduceat(tc.mix(sh ^ k), first[:-1]) for k in keys]
                band = [tc.mix(np.sum(least[i * rows : (i + 1) * rows], axis=0, dtype=np.uint64) + np.uint64(i)).view(np.int64) for i in range(bands)]
                columns = [batch.column(0).take(pa.array(text_ + a)), batch.column(1).take(pa.array(text_ + a)), *(pa.array(x.astype(np.int32)) for x in (order, points[start] - zero, points[stop] - zero, size)), pa.array(signature), *map(pa.array, band)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("_doc", "_row", "_text").mapInArrow(run, schema)


def _sets(wanted: DataFrame, homes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, s): the shingles of the ``wanted`` classes (sig), cut again from the document ``homes`` (sig, doc_id) names."""
    w = wanted.select(F.col("sig").alias("_w"))
    where = homes.join(w, F.col("sig") == F.col("_w"), "left_semi").groupBy(F.col("doc_id").alias("_home")).agg(F.collect_set("sig").alias("_sigs"))
    where = scratch.keep(where, "homes")
    texts = docs.select("_doc", "_text").join(where, F.col("_doc") == F.col("_home")).select("_text", "_sigs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tc.utf8(batch.column(0))
            want = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            for a, b in tc.chunks(offsets):
                found = _chunk_units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if found is None:
                    continue
                signature, sh, first = found[5:]
                _, at = np.unique(signature, return_index=True)
                at = at[np.isin(signature[at], want)]
                out = [np.unique(sh[first[i] : first[i + 1]]).view(np.int64) for i in at]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(signature[at]), pa.array(out, pa.list_(pa.int64()))], ["sig", "s"])

    return scratch.keep(texts.mapInArrow(sets, "sig long, s array<long>").groupBy("sig").agg(F.first("s").alias("s")), "sets")


def _block_links(rows: DataFrame, sets: DataFrame, numerator: int, scratch: Scratch) -> DataFrame:
    """(a, b) of a spanning forest of the links in each block; ``rows``: (key, item, comp)."""

    def verified(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        lists = table.column(3).combine_chunks()
        flat, size = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(size))).tolist()
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return clusters.linked_in_blocks(clusters.column(table, 1), clusters.column(table, 2), sets, edges, numerator)

    full = rows.join(sets, F.col("item") == F.col("sig")).select("key", "item", "comp", "s")
    return scratch.keep(clusters.in_blocks(full, verified, "a long, b long"), "links")


def _components(classes: DataFrame, bands: int, docs: DataFrame, numerator: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the classes that are linked with others.

    A band's nodes are found one band after another, so that the keys of one band alone are shuffled at a time. They are
    compared together: groups contract inside blocks, and what is left in large nodes meets block by block.
    """
    nodes = []
    for i in range(bands):
        nodes.append(clusters.shared_rows(classes.select(F.col(f"b{i}").alias("node"), F.col("sig").alias("item"), F.lit(128).cast("long").alias("size")), scratch))
        scratch.sweep()
    every = nodes[0].select("item")
    for x in nodes[1:]:
        every = every.unionByName(x.select("item"))
    wanted = scratch.keep(every.distinct().select(F.col("item").alias("sig")), "wanted")
    sets = _sets(wanted, classes.select("sig", F.col("first").alias("doc_id")), docs, scratch)
    scratch.sweep()
    found = clusters.Forest(scratch)
    linked = lambda rows: _block_links(rows, sets, numerator, scratch)
    bound = nodes[0]
    for x in nodes[1:]:
        bound = bound.unionByName(x)
    found.compare(bound, 0, linked, True)
    scratch.drop(*nodes)
    scratch.sweep()
    scratch.drop(wanted, sets)
    return found.table()


def _around(h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, cluster: np.ndarray, lack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the paragraph, key) for every way to take ``lack`` words around a paragraph of a text, i before and the rest after."""
    most = int(lack.max(initial=0))
    base = np.uint64(0x9FB21C651E98DF25)
    before, after = [np.zeros(len(begin), np.uint64)], [np.zeros(len(begin), np.uint64)]
    for i in range(1, most + 1):
        before.append(tc.mix(before[-1] * base + h[np.maximum(begin - i, 0)]))
        after.append(tc.mix(after[-1] * base + h[np.minimum(end + i - 1, len(h) - 1)]))
    after = np.stack(after)
    which, keys = [], []
    for i in range(most + 1):
        on = np.flatnonzero((lack >= i) & (begin - i >= at[text]) & (end + lack - i <= at[text + 1]))
        which.append(on)
        keys.append(tc.mix(before[i][on] * base + after[lack[on] - i, on] + tc.mix(cluster[on].view(np.uint64) + tc.mix(np.full(1, i, np.uint64)))))
    return np.concatenate(which), np.concatenate(keys).view(np.int64)


def _longer(held: DataFrame, repeats: DataFrame, docs: DataFrame, least_words: int, scratch: Scratch) -> DataFrame:
    """(doc_id, row, ord) of paragraphs in short spans whose shared run with an earlier place has ``least_words`` words.

    ``held``: removals with ``_sum``, the words of their span. The run is the paragraph and the equal words around it.
    It may be shared with any earlier place of the cluster, in runs that at least two documents have.
    """
    short = scratch.keep(held.where(F.col("_sum") < least_words).select("doc_id", "row", "ord", "cluster", (F.lit(least_words) - F.col("n_words")).cast("int").alias("lack")), "short")
    lacks = scratch.keep(short.select(F.col("cluster").alias("_k"), F.col("lack")).distinct(), "lacks")
    # Every place of the cluster is cut for every lack, as partner; only a removal's own runs are looked up among the shared ones.
    mine = repeats.select("doc_id", "row", "ord", "cluster").join(short.select("doc_id", "row", "ord", F.col("lack").alias("_mine")), ["doc_id", "row", "ord"], "left")
    ask = mine.join(lacks, F.col("cluster") == F.col("_k")).select("doc_id", "row", "ord", "cluster", "lack", F.coalesce(F.col("lack") == F.col("_mine"), F.lit(False)).alias("own"))
    n = scratch.keep(ask, "asked")
    ask = scratch.keep(n.groupBy(F.col("doc_id").alias("_home"), F.col("row").alias("_hash")).agg(F.collect_set(F.struct("ord", "cluster", "lack", "own")).alias("_asks")), "asks")
    texts = docs.join(ask, (F.col("_doc") == F.col("_home")) & (F.col("_row") == F.col("_hash"))).select("_doc", "_row", "_text", "_asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = tc.utf8(batch.column(2))
            row = np.repeat(np.arange(len(batch)), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            order, cluster, lack, own = (x.to_numpy(zero_copy_only=False) for x in batch.column(3).flatten().flatten())
            for a, b in tc.chunks(offsets):
                h, _, _, at = tc.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tc.SPACED)
                begin, end, text_, _ = _bounds(h, at)
                mine = np.flatnonzero((row >= a) & (row < b))
                first = np.searchsorted(text_, np.arange(b - a + 1))
                unit = first[row[mine] - a] + order[mine]
                if not len(mine):
                    continue
                which, keys = _around(h, at, begin[unit], end[unit], text_[unit], cluster[mine].astype(np.int64), lack[mine].astype(np.int64))
                mine = mine[which]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[mine]]), pa.array(rows[row[mine]]), pa.array(order[mine]), pa.array(lack[mine]), pa.array(keys), pa.array(own[mine].astype(bool))], ["doc_id", "row", "ord", "lack", "key", "own"])

    runs = scratch.keep(texts.mapInArrow(run, "doc_id long, row long, ord int, lack int, key long, own boolean"), "runs")
    shared = runs.groupBy(F.col("key").alias("_key"), F.col("lack").alias("_lack")).agg(F.min(F.struct("doc_id", "row", "ord")).alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo.doc_id <> _hi")
    shared = scratch.keep(shared, "shared")
    found = runs.where("own").join(shared, (F.col("key") == F.col("_key")) & (F.col("lack") == F.col("_lack"))).where("not (doc_id = _lo.doc_id and row = _lo.row and ord = _lo.ord)")
    longer = scratch.keep(found.select("doc_id", "row", "ord").distinct(), "longer")
    scratch.drop(short, lacks, n, ask, runs, shared)
    return longer


def text_key(text) -> Column:
    """64-bit hash by which texts of one doc_id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_passages(docs: DataFrame, doc: str, text: str, numerator: int = 80, recall: float = 0.99, least_words: int = LEAST_WORDS) -> DataFrame:
    """Removals: (doc_id, row, start, stop, n_words, n_paragraphs, keep_doc_id, cluster).

    A row is a span of neighbouring paragraphs, start to stop in code points, each of which repeats a paragraph that
    stays in another document or in an earlier place of the first one. keep_doc_id: the document in which the first of
    them stays; cluster: that paragraph's cluster; row: ``text_key`` of the text. A repeated passage is defined by its
    length: ``least_words`` words at least, in whole paragraphs or in the run that one of them shares with an earlier
    document. What repeats inside one document only isn't one.

    Documents without repeats, null or empty texts, texts of fewer than ``least_words`` words and rows with a null id
    have no rows. Equal rows count once; several texts of a doc_id are one document, and each text has its own spans.
    An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    docs = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text")).where(F.col("_doc").isNotNull()).withColumn("_row", text_key("_text"))
    bands, rows = tuned_bands(numerator / 100, recall)
    # The paragraphs are cut twice, which takes less than to keep them all.
    u = units(docs, bands, rows)
    classes = u.groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), *(F.min(f"b{i}").alias(f"b{i}") for i in range(bands)))
    classes = scratch.keep(classes, "classes")
    scratch.sweep()
    comps = _components(classes, bands, docs, numerator, scratch)

    c = comps.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    repeated = classes.where("first <> last").select("sig", "first", "last")
    joined = classes.select("sig", "first", "last").join(c, F.col("sig") == c["_n"]).select("sig", "first", "last", F.col("_c").alias("cluster"))
    joined = scratch.keep(joined, "joined")
    alone = repeated.join(joined.select(F.col("sig").alias("_s")), F.col("sig") == F.col("_s"), "left_anti").withColumn("cluster", F.col("sig"))
    # Sums of a cluster are written before they are joined, so that adaptive joins can split a cluster with a third of all rows.
    spans = joined.groupBy(F.col("cluster").alias("_k")).agg(F.min("first").alias("_first"), F.max("last").alias("_last")).where("_first <> _last")
    spans = scratch.keep(spans, "spans")
    near = joined.join(spans, F.col("cluster") == F.col("_k")).select("sig", "cluster", F.col("_first").alias("keep_doc_id"))
    hit = scratch.keep(near.unionByName(alone.select("sig", "cluster", F.col("first").alias("keep_doc_id"))).withColumnRenamed("sig", "_sig"), "hit")
    scratch.drop(classes, joined)
    scratch.sweep()
    cut = u.select("doc_id", "row", "ord", "start", "stop", "n_words", "sig")
    repeats = cut.join(hit, F.col("sig") == F.col("_sig")).select("doc_id", "row", "ord", "start", "stop", "n_words", "cluster", "keep_doc_id")
    repeats = scratch.keep(repeats, "repeats")
    scratch.sweep()
    # What stays: the first paragraph of the cluster in its first document.
    stays = repeats.where("doc_id = keep_doc_id").groupBy(F.col("cluster").alias("_k")).agg(F.min(F.struct("row", "ord")).alias("_at"))
    stays = scratch.keep(stays, "stays")
    gone = repeats.join(stays, F.col("cluster") == F.col("_k"), "left").where("not (doc_id = keep_doc_id and row = _at.row and ord = _at.ord)")
    w = Window.partitionBy("doc_id", "row").orderBy("ord")
    once = gone.withColumn("_was", F.lag("ord").over(w)).where("_was is null or _was <> ord").drop("_was")  # equal rows of the table
    island = once.withColumn("_island", F.col("ord") - F.row_number().over(w))
    held = scratch.keep(island.withColumn("_sum", F.sum("n_words").over(Window.partitionBy("doc_id", "row", "_island"))).drop("_k", "_at"), "gone")
    scratch.sweep()
    longer = _longer(held, repeats, docs, least_words, scratch).withColumn("_long", F.lit(True))
    scratch.sweep()
    held = held.join(longer, ["doc_id", "row", "ord"], "left")
    out = held.groupBy("doc_id", "row", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_paragraphs"), F.min_by("keep_doc_id", "ord").alias("keep_doc_id"), F.min_by("cluster", "ord").alias("cluster"), F.max(F.coalesce("_long", F.lit(False))).alias("_long"))
    return out.where((F.col("n_words") >= least_words) | F.col("_long")).drop("_island", "_long")


def without_passages(docs: DataFrame, doc: str, text: str, removals: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of the text; documents without removals stay as they are."""
    spans = removals.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    joined = docs.join(spans, (F.col(doc).cast("long") == F.col("_id")) & (text_key(text) == F.col("_row")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])).alias("out"), s["stop"].cast("int").alias("at"))
    done = F.aggregate("_spans", start, step)
    cut = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return joined.withColumn(text, F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col(text))).drop("_id", "_row", "_spans")

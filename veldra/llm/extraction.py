"""HTML extraction by wrapper induction.

A wrapper is induced for each host from all of its pages: their DOM trees are aligned with that of one seed page by
simple tree matching. Texts of the seed that nearly all pages have become the template. Of the elements that they have,
the one in which most of the varying text lies is the slot of the article. A page's text is what its host's slot holds,
without template texts and marked elements (menus, notices, forms, comments and the like). Hosts with one page, or with
copies of one page only, have no wrapper; there, and on pages without the slot, the page's own structure decides.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm import dom
from veldra.llm import textcodes as tc
from veldra.storage import Scratch

#: Bytes of wrappers, or of seed pages, that are broadcast; more are joined.
BROADCAST_BYTES, BROADCAST_ROWS = 24 << 20, 1 << 20
#: Parsed seeds that a task keeps.
SEEDS = 64


def host_of(url: Column) -> Column:
    """Lower-case host of an address, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, seed) -> (host, kind, i, n, size), summed over the pages of a batch.

    kind 0: all unlike pages; 1: pages that have the text i of the seed; 2: pages that have its element i, and the
    characters of varying text below it.
    """
    seeds: dict[str, dom.Node] = {}
    for batch in batches:
        pages: Counter = Counter()
        size: Counter = Counter()
        for host, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host not in seeds:
                if len(seeds) >= SEEDS:
                    seeds.clear()
                seeds[host] = dom.parse(first)
            found = dom.supported(seeds[host], dom.parse(html))
            if found is not None:
                pages[host, 0, 0] += 1
                pages.update((host, 1, i) for i in found[0])
                pages.update((host, 2, i) for i in found[1])
                for i, n in found[1].items():
                    size[host, 2, i] += n
        if pages:
            columns = [pa.array([k[j] for k in pages], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(pages.values()), pa.int64()), pa.array([size[k] for k in pages], pa.int64())], ["host", "kind", "i", "n", "size"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, seed, counts) -> (host, wrapper as JSON)."""
    for batch in batches:
        rows = []
        for host, seed, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            others = sum(c["n"] for c in counts if c["kind"] == 0)
            texts = {c["i"]: c["n"] for c in counts if c["kind"] == 1}
            slots = {c["i"]: (c["n"], c["size"]) for c in counts if c["kind"] == 2}
            if found := dom.wrapper_of(dom.parse(seed), texts, slots, others):
                rows.append((host, json.dumps(found)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "wrapper"])


def wrappers(pages: DataFrame, url: str, html: str, scratch: Scratch) -> DataFrame:
    """(host, wrapper as JSON) of the hosts with unlike pages. Every page is aligned with its host's seed; sums meet, not pages.

    Seed: the page whose address has the smallest hash. Equal pages of a host count once.
    """
    tc.bounded_batches(pages.sparkSession)
    h = F.xxhash64(F.col(url), F.col(html))
    base = pages.where((F.col(url).isNotNull()) & (F.col(html) != "")).select(host_of(F.col(url)).alias("host"), h.alias("h"), F.xxhash64(html).alias("c"), F.col(html).alias("html")).where("host <> ''")
    once = scratch.keep(base.groupBy("host", "c").agg(F.min("h").alias("h")).select(F.col("host").alias("_host"), F.col("h").alias("_h")), "once")
    first = once.groupBy("_host").agg(F.min("_h").alias("_h"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_host", "_h")
    first = scratch.keep(first, "first")
    sized = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    on = (F.col("host") == F.col("_host")) & (F.col("h") == F.col("_h"))
    seeds = base.join(sized(first), on, "left_semi").groupBy("host").agg(F.min("html").alias("seed"))
    seeds = scratch.keep(seeds.select(F.col("host").alias("_s"), "seed"), "seeds")
    size = seeds.agg(F.sum(F.octet_length("seed"))).first()[0] or 0
    small = F.broadcast(seeds) if size <= BROADCAST_BYTES else seeds
    others = base.join(sized(once), on, "left_semi").join(small, F.col("host") == F.col("_s")).where("html <> seed").select("host", "html", "seed")
    counts = others.mapInArrow(_tally, "host string, kind int, i int, n long, size long").groupBy("host", "kind", "i").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("kind", "i", "n", "size")).alias("counts"))  # as many as the seed has nodes
    return scratch.keep(seeds.join(counts, F.col("host") == F.col("_s")).select("host", "seed", "counts").mapInArrow(_build, "host string, wrapper string"), "wrappers")


def _extractor(held):
    def one(html: str | None, wrapper: tuple | None) -> str:
        return dom.main_text(dom.parse(html), wrapper) if html else ""

    if held is None:

        def joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for html, wrapper in batches:
                yield pa.array([one(x, tuple(json.loads(w)) if w else None) for x, w in zip(html.to_pylist(), wrapper.to_pylist(), strict=True)], pa.string())

        return joined

    def looked_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, parsed = held.value, {}
        for html, host in batches:
            out = []
            for x, name in zip(html.to_pylist(), host.to_pylist(), strict=True):
                if name in known and name not in parsed:
                    parsed[name] = tuple(json.loads(known[name]))
                out.append(one(x, parsed.get(name)))
            yield pa.array(out, pa.string())

    return looked_up


def with_main_text(pages: DataFrame, url: str, html: str, into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``into`` (replaced if it is there; other columns stay).

    Blocks are joined in page order by one line feed, white space in a block is one space. Null or empty html, and
    pages without text, give an empty string. A null address has no host and so no wrapper. Repeated rows each return.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType

    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "pages")
    learned = wrappers(pages, url, html, scratch)
    size = learned.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r.host: r.wrapper for r in learned.collect()})  # BROADCAST_BYTES at most
        run = F.arrow_udf(_extractor(held), "string", ArrowUDFType.SCALAR_ITER)
        scratch.drop(learned)
        return pages.withColumn(into, run(F.col(html), host_of(F.col(url))))
    run = F.arrow_udf(_extractor(None), "string", ArrowUDFType.SCALAR_ITER)
    keep = [c for c in pages.columns if c != into]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.col(html).alias("_html"), host_of(F.col(url)).alias("_host"))
    w = learned.select(F.col("host").alias("_h"), F.col("wrapper").alias("_wrapper"))
    return rows.join(w, rows["_host"] == w["_h"], "left").select("_row.*", run(F.col("_html"), F.col("_wrapper")).alias(into))

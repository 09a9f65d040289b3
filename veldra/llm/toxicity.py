"""Toxicity: non-negative positive-unlabelled learning over hashed words and word beginnings.

Confirmed toxic texts are the positives; all other texts are unlabelled, whatever their labels say. The risk of a
classifier g under the class prior p is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]): the unlabelled texts count as
negative, less the share of positives among them, and where that difference is below zero the classifier has begun to
memorise, so the step goes the other way. Linear NumPy classifiers are trained on slices of the sample and averaged.

A feature is a lower-cased word or its first bytes; its value saturates with its rate in the text, c / (c + HALF +
RATE * words), so neither long texts nor a single chance word reach the value of a text that is full of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm import textcodes
from veldra.storage import Scratch

#: Rows that the classifiers are fitted on, at most: confirmed toxic and unlabelled ones with the smallest hashes of their ids.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 8_000
#: Hash space of features, and how many of them take part: those that tell most.
#: A feature needs LEAST_TEXTS positives.
SPACE, FEATURES = 1 << 20, 512
LEAST_TEXTS = 3
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
HALF, RATE = 1.0, 0.005
CLASSIFIERS, STEPS, STEP_SIZE, RIDGE, TOLERANCE = 3, 300, 0.1, 2e-5, 0.0
#: Share of the positives that a cut must keep to bear on the prior where labels don't tell it.
PRIOR_RECALL = 0.5

#: Delimiters: all of ASCII but letters and digits, so words of a text part at punctuation.
KINDS = textcodes.ALNUM


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, feature, words of the text) for every word and beginning, in a few arrays; repeats stay."""
    low = KINDS[data]
    whole, start, stop, at = textcodes.words(data, offsets, KINDS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    yield doc, (whole & np.uint64(SPACE - 1)).astype(np.int64), np.diff(at)
    if not len(start):
        return
    power, inverse = textcodes._power_tables(len(low))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textcodes._VALUES[low] * power[: len(low)], dtype=np.uint64)))
    for k in BEGINNINGS:
        longer = np.flatnonzero(stop - start > k)
        s = start[longer]
        h = textcodes.mix((total[s + k] - total[s]) * inverse[s] + np.uint64(k * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        yield doc[longer], (h & np.uint64(SPACE - 1)).astype(np.int64), np.diff(at)


def values(column: pa.Array, chosen: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, text, feature, value) of whole chunks of texts, each feature of a text once.

    ``chosen``: number of each feature of the hash space, -1 for those that take no part; None for all as they are.
    """
    data, offsets = textcodes.utf8(column)
    for a, b in textcodes.chunks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        keys, words = [], np.zeros(b - a, np.int64)
        for doc, feature, words in features(part, own):  # noqa: B007
            if chosen is not None:
                feature = chosen[feature]
                doc, feature = doc[feature >= 0], feature[feature >= 0]
            keys.append(doc * SPACE + feature)
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        doc = key // SPACE
        yield a, b - a, doc, key % SPACE, count / (count + HALF + RATE * words[doc])


def places(chosen: np.ndarray) -> np.ndarray:
    """Number of each feature of the hash space among the chosen ones, else -1."""
    table = np.full(SPACE, -1, np.int32)
    table[chosen] = np.arange(len(chosen))
    return table


@dataclass
class ToxicityModel:
    #: Features of the hash space that take part, sorted, and their weights.
    features: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    @cached_property
    def places(self) -> np.ndarray:
        return places(self.features)

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = np.full(len(column), self.intercept)
        for a, n, doc, feature, value in values(column, self.places):
            margin[a : a + n] += np.bincount(doc, self.weights[feature] * value, n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def risk_step(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Derivatives of the non-negative risk with the logistic loss by the margins of both samples, the risk, and whether it was clipped."""
    sig_pos, sig_unl = 1 / (1 + np.exp(-g_pos)), 1 / (1 + np.exp(-g_unl))
    n, m = len(g_pos), len(g_unl)
    positive = prior * np.logaddexp(0, -g_pos).mean()
    negative = np.logaddexp(0, g_unl).mean() - prior * np.logaddexp(0, g_pos).mean()
    if negative >= -TOLERANCE:
        return prior * (sig_pos - 1) / n - prior * sig_pos / n, sig_unl / m, positive + negative, False
    return prior * sig_pos / n, -sig_unl / m, positive, True  # away from the negative part


def train(x_pos: np.ndarray, x_unl: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """One linear classifier by full-batch steps with moment estimates and a ridge penalty."""
    d = x_pos.shape[1]
    w, moment, square = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    for t in range(1, STEPS + 1):
        narrow = w[:d].astype(np.float32)  # the matrices are 32-bit and aren't copied
        g_pos, g_unl, _, _ = risk_step(x_pos @ narrow + w[d], x_unl @ narrow + w[d], prior)
        slope = g_pos.astype(np.float32) @ x_pos + g_unl.astype(np.float32) @ x_unl
        grad = np.concatenate((slope + RIDGE * w[:d], [g_pos.sum() + g_unl.sum()]))
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w -= STEP_SIZE * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def estimated_prior(s_pos: np.ndarray, s_unl: np.ndarray) -> float:
    """Least ratio of unlabelled to positive texts above a cut that keeps PRIOR_RECALL of the positives."""
    cuts = np.quantile(s_pos, np.linspace(0, 1 - PRIOR_RECALL, 50))
    ratio = [(s_unl >= c).mean() / (s_pos >= c).mean() for c in cuts]
    return float(np.clip(min(ratio), 0.005, 0.95))


def fit_matrices(x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, prior): the mean of classifiers that each leave out another slice of the unlabelled sample."""
    if prior is None:
        w, b = train(x_pos, x_unl, 0.1)
        prior = estimated_prior(x_pos @ w + b, x_unl @ w + b)
    found = [train(x_pos, x_unl[np.arange(len(x_unl)) % CLASSIFIERS != k] if len(x_unl) > CLASSIFIERS else x_unl, prior) for k in range(CLASSIFIERS)]
    return np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found])), prior


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the values of each feature in the positives and the unlabelled texts of a task, and in how many positives it is."""
    sums, texts = np.zeros((2, SPACE)), np.zeros(SPACE, np.int64)
    for batch in batches:
        side = np.asarray(batch["positive"]).astype(np.int64)
        for a, _, doc, feature, value in values(batch["text"], None):
            for s in (0, 1):
                at = side[a + doc] == s
                sums[s] += np.bincount(feature[at], value[at], SPACE)
            texts += np.bincount(feature[side[a + doc] == 1], minlength=SPACE)
    seen = np.flatnonzero(sums.any(axis=0))
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[0, seen]), pa.array(sums[1, seen]), pa.array(texts[seen], pa.int64())], ["feature", "u", "p", "texts"])


def _vectors(chosen: np.ndarray):
    table = places(chosen)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, doc, feature, value in values(batch["text"], table):
                offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, n), batch["positive"].slice(a, n), *lists], ["id", "positive", "features", "values"])

    return run


def fit(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, label: str, usable: Column, usable_docs: Column, prior: float | None = None) -> ToxicityModel:
    """Fit on confirmed toxic documents (``label`` 1, where ``usable`` over ``labels`` holds) and unlabelled ones.

    Unlabelled documents are those with the smallest hashes of their ids among all for which ``usable_docs`` holds; their
    labels are not looked at. ``prior``: the share of toxic documents; where it isn't given, that of label 1 among
    labels 0 and 1 of usable rows, over all of them, if both occur, else an estimate from the classifier's scores.
    Null texts count as empty; labels without a document are ignored, of documents with one id twice as many rows as
    the sample has are taken at most, in the order of hashes. Without a confirmed document every score is 0.
    """
    spark = docs.sparkSession
    textcodes.bounded_batches(spark)
    scratch = Scratch(spark, "toxicity")
    told = labels.where(usable & F.col(label).isin(0, 1)).agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if prior is None and 0 < told["p"] < told["n"]:
        prior = told["p"] / told["n"]
    confirmed = labels.where(usable & (F.col(label) == 1)).select(F.col(label_doc).alias("_d")).distinct().orderBy(F.xxhash64("_d"), "_d").limit(POSITIVE_ROWS).select("_d", F.lit(True).alias("positive"))
    others = docs.where(usable_docs).select(F.col(doc).alias("_d")).distinct().orderBy(F.xxhash64(F.lit(7), "_d"), "_d").limit(UNLABELLED_ROWS).select("_d", F.lit(False).alias("positive"))
    picked = confirmed.unionByName(others)  # two bounded lists of ids
    rows = docs.select(F.col(doc).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_d")).select("id", "text", "positive")
    rows = scratch.keep(rows, "sample")
    n = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -30.0, prior or 0.0)
    counts = rows.select("positive", "text").mapInArrow(_counted, "feature long, u double, p double, texts long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("u", "p", "texts")))
    u, p = F.col("u") / n[False], F.col("p") / n[True]
    best = counts.where((F.col("texts") >= LEAST_TEXTS) & (p > u)).select("feature", ((p - u) / F.sqrt(u + 1e-4)).alias("z")).orderBy(F.round("z", 6).desc(), "feature").limit(FEATURES)
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], np.int64))
    found = rows.mapInArrow(_vectors(chosen), f"id {rows.schema['id'].dataType.simpleString()}, positive boolean, features array<int>, values array<float>")
    found = found.orderBy(F.xxhash64("id"), "positive", "features", "values").limit(2 * (POSITIVE_ROWS + UNLABELLED_ROWS)).toArrow()
    x = np.zeros((len(found), len(chosen)), np.float32)
    lists, flat = found["features"].combine_chunks(), found["values"].combine_chunks()
    x[np.repeat(np.arange(len(found)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())] = np.asarray(flat.flatten())
    positive = np.asarray(found["positive"]).astype(bool)
    w, b, prior = fit_matrices(x[positive], x[~positive], prior)
    return ToxicityModel(chosen, w, b, prior)


def with_score(df: DataFrame, text: str, model: ToxicityModel, into: str = "score") -> DataFrame:
    """``df`` with the score of each whole text, 0 to 1; a column already called ``into`` is replaced, others stay.

    A null text is scored like an empty one; repeated rows each return; an empty table stays empty.
    """
    spark = df.sparkSession
    textcodes.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return df.withColumn(into, score(F.col(text)))

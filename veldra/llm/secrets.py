"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of the text). A ledger in a shared folder holds which
(blob, rule, rule version) triples were scanned and what was found. A run scans only the triples that the ledger
lacks, once per blob however many paths and versions hold it, and joins the findings back to all of them.

Ledger folder: ``findings/run=R`` (blob, rule, rule_version, start, stop) and ``scanned/run=R`` (blob, rule,
rule_version). ``scanned`` is written last and so commits the run; findings of a run that never committed are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra import storage


@dataclass(frozen=True)
class Rule:
    """A regular expression, whose matches are taken leftmost and without overlap, and a least length.

    ``group``: the part whose length counts. ``hint``: a cheap test that every text with a match passes.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str | None = None


# The base rules.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

#: Rules beyond the base: headers of private keys, and signed web tokens.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ".eyJ"),
)
RULES = BASE_RULES + MORE_RULES

LEDGER_KEYS = ["blob", "rule", "rule_version"]
_SCANNED = "blob string, rule string, rule_version int"
_FINDINGS = _SCANNED + ", start long, stop long"


def blob_id(content: Column) -> Column:
    """Content address of a text; null counts as the empty text."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (before, size, counted): code points since the last match, of the match, and of the counted part."""
    pattern = F.lit(rule.pattern)
    whole, parts, counted = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.transform(F.arrays_zip(whole.alias("m"), counted.alias("c"), F.slice(parts, F.lit(1), F.size(whole)).alias("p")), lambda x: F.struct(F.length(x["p"]).alias("before"), F.length(x["m"]).alias("size"), F.length(x["c"]).alias("counted")))
    can = text.contains(rule.hint) if rule.hint else text.rlike(rule.pattern)
    return F.when(can, found)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, rule_version, start, stop) of every match in the ``text`` of distinct blobs; code points, end exclusive."""
    per_rule = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.lit(r.least).alias("least"), _matches(F.col("text"), r).alias("found")) for r in rules))
    # The rows of a blob already lie together, so the running sums need no further shuffle.
    one = blobs.select("blob", F.explode(per_rule).alias("r")).where(F.size(F.coalesce("r.found", F.array())) > 0).select("blob", "r.rule", "r.rule_version", "r.least", F.posexplode("r.found").alias("i", "f"))
    w = Window.partitionBy("blob", "rule", "rule_version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("f.before") + F.col("f.size")).over(w)
    spans = one.select("blob", "rule", "rule_version", "least", F.col("f.counted").alias("counted"), F.col("f.size").alias("size"), stop.alias("stop"))
    return spans.where("counted >= least").select("blob", "rule", "rule_version", (F.col("stop") - F.col("size")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


class Ledger:
    """The tables of a ledger folder. One writer at a time; readers see committed runs only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        empty = self.spark.createDataFrame([], schema + ", run string")
        return self.spark.read.schema(schema + ", run string").parquet(at) if storage.exists(self.spark, at) else empty

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        """Findings of committed runs."""
        runs = self.scanned().select("run", *LEDGER_KEYS)
        return self._read("findings", _FINDINGS).join(runs, ["run", *LEDGER_KEYS], "left_semi").drop("run")

    def commit(self, run: str, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.folder}/{name}/run={run}")


def update(spark: SparkSession, versions: DataFrame, content: str, folder: str, rules=RULES) -> Ledger:
    """Scan what is unseen in the ``content`` column of all historical ``versions`` and commit it to the ledger.

    Only one text per unseen blob is shuffled and scanned; groups of copies are reduced before the shuffle. Null content
    is the empty blob; repeated rows and versions are one blob; other columns don't matter. An empty table commits
    nothing new; scanning the same versions again scans nothing.
    """
    ledger, run = Ledger(spark, folder), uuid.uuid4().hex
    text = F.coalesce(F.col(content), F.lit(""))
    texts = versions.select(blob_id(F.col(content)).alias("blob"), text.alias("text"))
    want = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules)))
    triples = texts.select("blob").distinct().select("blob", want.alias("w")).select("blob", "w.*")
    first = not storage.exists(spark, f"{folder}/scanned")
    if first:
        unseen = texts.dropDuplicates(["blob"])
        ledger.commit(run, "findings", scan_blobs(unseen, rules))
        ledger.commit(run, "scanned", triples)
        return ledger
    todo = storage.Scratch(spark, "ledger")
    pairs = todo.keep(triples.join(ledger.scanned(), LEDGER_KEYS, "left_anti"), "unseen")
    for r in rules:  # a few rules; each scans only the blobs that lack it
        lacking = pairs.where((F.col("rule") == r.kind) & (F.col("rule_version") == r.version)).select("blob")
        fresh = texts.join(lacking, "blob", "left_semi").dropDuplicates(["blob"])
        scan_blobs(fresh, (r,)).write.mode("append").parquet(f"{folder}/findings/run={run}")
    ledger.commit(run, "scanned", pairs)
    todo.drop(pairs)
    return ledger


def span_order(rules=RULES) -> Column:
    """Rank of a rule in the stated order."""
    return F.coalesce(*(F.when(F.col("rule") == r.kind, F.lit(i)) for i, r in enumerate(rules)), F.lit(len(rules)))


def spans_by_blob(ledger: Ledger, rules=RULES) -> DataFrame:
    """(blob, spans): the findings of the given rules as an array of (start, rank, rule, stop), by start, then rank."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("rule_version") == r.version))
    row = F.struct("start", span_order(rules).alias("rank"), "rule", "stop")
    return ledger.findings().where(current).groupBy("blob").agg(F.array_sort(F.collect_set(row)).alias("spans"))


def with_spans(df: DataFrame, content: str, ledger: Ledger, rules=RULES, into: str = "secret_spans") -> DataFrame:
    """Every row of ``df`` with the spans found in its content, an empty array where there are none.

    A column already called ``into`` is replaced; other columns stay. Groups of copies larger than a partition are
    split by adaptive skew joins.
    """
    kept = [c for c in df.columns if c != into]
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), blob_id(F.col(content)).alias("_blob"))
    found = spans_by_blob(ledger, rules).select(F.col("blob").alias("_b"), F.col("spans").alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,rule:string,stop:bigint>>")
    return inner.join(found, inner["_blob"] == found["_b"], "left").select("_row.*", F.coalesce("_spans", none).alias(into))


def redact(df: DataFrame, content: str, spans: str, mask: str = "[SECRET]") -> DataFrame:
    """Replace every span in the content by ``mask``; overlapping spans are replaced once. Null content stays null."""
    text = F.col(content)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        cut = F.greatest(s["start"], acc["at"])
        piece = F.substring(text, acc["at"].cast("int") + 1, (cut - acc["at"]).cast("int"))
        new = F.when(s["stop"] > acc["at"], F.concat(acc["out"], piece, F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit("")))).otherwise(acc["out"])
        return F.struct(new.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    done = F.aggregate(F.col(spans), start, step)
    rest = F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))
    return df.withColumn(content, F.when(F.size(spans) > 0, rest).otherwise(text))

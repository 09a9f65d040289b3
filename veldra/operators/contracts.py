"""Data contracts: keys, finite numbers, forbidden columns, stored against recomputed values, set equality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.functions.text import finite


class ContractError(ValueError):
    """A table breaks its contract."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count) that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = duplicate_keys(df, keys).take(3)
    if found:
        raise ContractError(f"duplicate keys {keys}: {[tuple(r) for r in found]}")
    return df


def require_finite(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with NaN or infinity fail when they are read."""
    checked = {c: F.when(F.col(c).isNull() | finite(F.col(c)), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} isn't finite: "), F.col(c).cast("string")))) for c in columns}
    return df.withColumns(checked)


def column_names(schema: T.DataType, prefix: str = "") -> list[str]:
    """All names of a schema, nested ones with their path."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            out += [prefix + f.name, *column_names(f.dataType, f"{prefix}{f.name}.")]
        return out
    if isinstance(schema, T.ArrayType):
        return column_names(schema.elementType, prefix)
    if isinstance(schema, T.MapType):
        return column_names(schema.valueType, prefix)
    return []


def forbidden_columns(df: DataFrame, exact: Iterable[str] = (), prefixes: Iterable[str] = (), parts: Iterable[str] = ()) -> list[str]:
    """Names of the schema, at any depth, that are in ``exact``, begin with a prefix or hold a part. Reads no data."""
    exact, prefixes, parts = set(exact), tuple(prefixes), tuple(parts)
    return [n for n in column_names(df.schema) if (last := n.rsplit(".", 1)[-1].lower()) in exact or last.startswith(prefixes) or any(p in last for p in parts)]


def blind_projection(df: DataFrame, allowed: list[str], **forbidden) -> DataFrame:
    """Only the allowed columns; an error if any of them is forbidden."""
    out = df.select(*allowed)
    if found := forbidden_columns(out, **forbidden):
        raise ContractError(f"forbidden columns: {found}")
    return out


def mismatches(stored: DataFrame, computed: DataFrame, keys: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows whose stored and recomputed values differ, or that one side lacks: keys, ``column``, ``stored``, ``computed``."""
    a = stored.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_s"), F.struct(*columns).alias("_sv"))
    b = computed.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_c"), F.struct(*columns).alias("_cv"))
    kinds = dict(stored.dtypes)
    both = a.join(b, keys, "full")

    def same(c: str) -> Column:
        if tolerance and kinds[c] in ("double", "float"):
            return F.coalesce(F.abs(F.col(f"_sv.{c}") - F.col(f"_cv.{c}")) <= tolerance, F.col(f"_sv.{c}").isNull() & F.col(f"_cv.{c}").isNull() & F.col("_s").isNotNull() & F.col("_c").isNotNull())
        return F.col(f"_s.{c}").eqNullSafe(F.col(f"_c.{c}")) & F.col("_s").isNotNull() & F.col("_c").isNotNull()

    rows = F.array(*(F.when(~same(c), F.struct(F.lit(c).alias("column"), F.col(f"_s.{c}").alias("stored"), F.col(f"_c.{c}").alias("computed"))) for c in columns))
    return both.select(*keys, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(*keys, "r.*")


def key_coverage(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: keys of ``whole`` that are missing in ``parts``, extra ones, and those assigned more than once."""
    p = parts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    w = whole.select(key).distinct().withColumn("_w", F.lit(True))
    both = w.join(p, key, "full")
    return both.agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_w") & F.col("_n").isNotNull()).alias("covered")
    )


def batch_overlap(df: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch_a, batch_b, overlap): keys that two batches share, for pairs that share any."""
    d = df.select(F.col(batch).alias("_b"), F.col(key).alias("_k")).distinct()
    pairs = d.groupBy("_k").agg(F.array_sort(F.collect_set("_b")).alias("bs")).where(F.size("bs") > 1)
    a = pairs.select("_k", "bs", F.explode("bs").alias("batch_a")).select("_k", "batch_a", F.explode("bs").alias("batch_b")).where("batch_a < batch_b")
    return a.groupBy("batch_a", "batch_b").agg(F.count(F.lit(1)).alias("overlap"))


def rule_errors(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(keys, code): every rule that a row breaks; a rule is (code, condition that is an error)."""
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules)), lambda c: c.isNotNull())
    return df.select(*keys, F.explode(found).alias("code"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """One row (rows, fingerprint): an order-free hash of rounded rows, from per-row hashes that add up as decimals."""
    kinds = dict(df.dtypes)
    text = F.concat_ws("|", *(F.coalesce((F.format_number(F.col(c), digits) if kinds[c] in ("double", "float") else F.col(c).cast("string")), F.lit("null")) for c in [*keys, *columns]))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def exactly_one(rules: dict[str, Column]) -> Column:
    """The name of the one rule that holds; an error where none or several do. A null rule doesn't hold."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return F.when(F.size(held) == 1, held[0]).otherwise(F.raise_error(F.concat(F.lit("not exactly one class: "), F.concat_ws(", ", held))))

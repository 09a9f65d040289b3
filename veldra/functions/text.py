"""Scalar rules on strings and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digit_candidate(text: Column, most: int = 2) -> tuple[Column, Column]:
    """(digits, reason): the text if it is one to ``most`` ASCII digits, else null and why."""
    t = F.trim(text)
    ok = t.rlike(f"^[0-9]{{1,{most}}}$")
    reason = F.when(t.isNull() | (t == ""), "empty").when(ok, F.lit(None).cast("string")).when(t.rlike("^[0-9]+$"), "too_many_digits").otherwise("not_digits")
    return F.when(ok, t), reason


def frame_rate(text: Column) -> Column:
    """'30000/1001' or '25' as a double; null if malformed or divided by zero."""
    parts = F.split(text, "/")
    top, low = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.when(F.size(parts) <= 2, F.try_divide(top, low))


def zoned_timestamp(text: Column) -> Column:
    """ISO-8601 with a mandatory zone; null otherwise."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(ok, F.try_to_timestamp(text))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def safe_relative_path(path: Column) -> Column:
    """Not empty, not absolute, without a parent or drive component."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^[A-Za-z]:"), F.lit(False))


def code(prefix: str, number: Column, width: int = 3) -> Column:
    """'EXT_007'."""
    return F.format_string(f"{prefix}_%0{width}d", number.cast("int"))


def finite(value: Column) -> Column:
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def frame_seconds(frame: Column, fps: float, end: bool = False) -> Column:
    """Start of a frame in seconds, or its end."""
    return (frame + (1 if end else 0)) / F.lit(float(fps))


def nfkc(column: str | Column) -> Column:
    """Unicode NFKC and trim: not among the built-in functions, so an Arrow UDF."""
    import unicodedata

    import pyarrow as pa
    from pyspark.sql.pandas.functions import ArrowUDFType

    def run(v):
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x).strip() for x in v.to_pylist()], pa.string())

    return F.arrow_udf(run, "string", ArrowUDFType.SCALAR)(column)

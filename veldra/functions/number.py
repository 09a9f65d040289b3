"""Rounding and exact text of doubles as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers are arrays of limbs of LIMB_DIGITS decimal digits, the least first.
LIMB_DIGITS, LIMB = 9, 10**9
DIGITS = 17


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def rounded(x: Column | str, digits: int) -> Column:
    """``x``, a double, rounded to ``digits`` decimals as SQL engines round doubles: scaled, half away from zero, scaled back.

    Spark's round takes the shortest decimal text instead: 41 / 5120, 0.0080078125 as text, lies just below that half.
    Beyond 1e290, where scaling could overflow, there is nothing to round.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 1e290, F.round(x * 10.0**digits) / 10.0**digits).otherwise(x)


def double_bits(x: Column) -> Column:
    """The 64 bits of a double as a long; null stays null."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(x.isNotNull(), bits.cast("long"))


def double_hex(x: Column) -> Column:
    """16 hexadecimal digits of a double's bits, the sign first."""
    return F.lower(F.lpad(F.hex(double_bits(x)), 16, "0"))


def _div(v: Column) -> Column:
    """v divided by LIMB without its remainder: the difference is a multiple, so the quotient is exact."""
    return ((v - F.pmod(v, F.lit(LIMB))).cast("decimal(20,0)") / F.lit(LIMB).cast("decimal(20,0)")).cast("long")


def _times(limbs: Column, factor: Column) -> Column:
    """The whole number times ``factor`` (below 2^33)."""
    empty = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))

    def step(acc: Column, limb: Column) -> Column:
        return let(limb * factor + acc["carry"], lambda v: F.struct(F.concat(acc["out"], F.array(F.pmod(v, F.lit(LIMB)))).alias("out"), _div(v).alias("carry")))

    return let(F.aggregate(limbs, empty, step), lambda done: F.when(done["carry"] > 0, F.concat(done["out"], F.array(done["carry"]))).otherwise(done["out"]))


def double_text(x: Column) -> Column:
    """The double with 17 significant digits, rounded half to even from its exact value, as C prints ``%.17g``.

    The mantissa times a power of 2, or of 5 for negative exponents, is expanded to all its decimal digits. Not-a-number
    is nan, infinities inf and -inf; null stays null.
    """
    value = x.cast("double")
    return let(double_bits(x), lambda bits: let(_expanded(bits), lambda parts: _spelled(value, bits, parts["digits"], parts["scale"])))


def _expanded(bits: Column) -> Column:
    """(digits, scale): all digits of the absolute value as a whole number, and how many of them are behind the point."""
    raw = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    power = F.greatest(raw, F.lit(1)) - 1075
    mantissa = bits.bitwiseAND(F.lit((1 << 52) - 1)) + F.when(raw > 0, F.lit(1 << 52)).otherwise(F.lit(0))
    limbs = F.array(F.pmod(mantissa, F.lit(LIMB)), _div(mantissa))
    scale = F.greatest(-power, F.lit(0)).cast("long")  # digits behind the point
    step, unit = F.when(power < 0, F.lit(12)).otherwise(F.lit(28)), F.when(power < 0, F.lit(5)).otherwise(F.lit(2))
    n = F.abs(power)
    whole = F.when(power < 0, F.lit(5**12)).otherwise(F.lit(1 << 28)).cast("long")
    rest = F.aggregate(F.array_repeat(unit.cast("long"), (n % step).cast("int")), F.lit(1).cast("long"), lambda a, b: a * b)
    factors = F.concat(F.array_repeat(whole, F.floor(n / step).cast("int")), F.array(rest))
    full = F.aggregate(factors, limbs, _times)
    digits = F.regexp_replace(F.concat_ws("", F.transform(F.reverse(full), lambda d: F.lpad(d.cast("string"), LIMB_DIGITS, "0"))), "^0+", "")
    return F.struct(digits.alias("digits"), scale.alias("scale"))


def _spelled(x: Column, bits: Column, digits: Column, scale: Column) -> Column:
    raw = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    size = F.length(digits)
    head, tail = F.rpad(F.substring(digits, 1, DIGITS), DIGITS, "0"), F.substring(digits, DIGITS + 1, 2000)
    odd = (F.substring(head, DIGITS, 1).cast("int") % 2) == 1
    up = (F.substring(tail, 1, 1) > "5") | ((F.substring(tail, 1, 1) == "5") & (F.rlike(F.substring(tail, 2, 2000), F.lit("[1-9]")) | odd))
    rounded = (head.cast("decimal(20,0)") + F.when(up, 1).otherwise(0)).cast("decimal(20,0)").cast("string")
    text = F.when(digits == "", "0").otherwise(let(rounded, lambda r: _formatted(F.substring(r, 1, DIGITS), (size - 1 - scale + (F.length(r) > DIGITS).cast("int")).cast("int"))))
    sign = F.when(bits < 0, "-").otherwise("")
    special = F.when(raw == 0x7FF, F.when(F.isnan(x), "nan").otherwise(F.concat(sign, F.lit("inf"))))
    return F.when(x.isNotNull(), F.coalesce(special, F.concat(sign, text)))


def _formatted(kept: Column, exponent: Column) -> Column:
    """DIGITS digits and the power of 10 of the first one, as ``%g`` prints them."""
    short = F.regexp_replace(kept, "0+$", "")
    short = F.when(short == "", "0").otherwise(short)
    behind = F.substring(short, 2, DIGITS)
    science = F.concat(F.substring(short, 1, 1), F.when(behind != "", F.concat(F.lit("."), behind)).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), short)
    front, back = F.substr(kept, F.lit(1), exponent + 1), F.regexp_replace(F.substr(kept, exponent + 2, F.lit(DIGITS)), "0+$", "")
    large = F.concat(front, F.when(back != "", F.concat(F.lit("."), back)).otherwise(""))
    return F.when((exponent < -4) | (exponent >= DIGITS), science).when(exponent < 0, small).otherwise(large)

"""Scalar operators with the predicate language's rules: no operator raises, errors are nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def real(x: float) -> Column:
    return F.lit(float(x))


def int_op(op: str, a: Column, b: Column, overflow: str = "null") -> Column:
    """+ - * on 64 bits. Overflow gives null, or wraps around with overflow="wrap"."""
    if overflow == "wrap":
        wide = [x.cast("decimal(19,0)") for x in (a, b)]
        value = {"+": wide[0] + wide[1], "-": wide[0] - wide[1], "*": wide[0] * wide[1]}[op].cast("decimal(38,0)")
        turn, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")
        rest = F.pmod(value, turn)
        return F.when(rest >= half, rest - turn).otherwise(rest).cast("long")
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)


def int_div(a: Column, b: Column) -> Column:
    """Truncating division; by zero null."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def real_div(a: Column, b: Column) -> Column:
    """IEEE division: by zero an infinity, or NaN for zero by zero."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a), real("nan")).when(a > 0, real("inf")).when(a < 0, real("-inf")).when(a.isNotNull() & b.isNotNull(), real("nan"))


def int_pow(a: Column, b: Column) -> Column:
    """Whole powers; a negative exponent is a power of the whole number 1 / a, so 0 but for 1 and -1."""
    small = F.when(a == 1, 1).when(a == -1, F.when(b % 2 == 0, 1).otherwise(-1)).when(a != 0, 0)
    return F.when(b >= 0, F.pow(a, b).cast("long")).otherwise(small).cast("long")


def log(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), F.ln(F.when(x > 0, x))).when(x == 0, real("-inf")).when((x < 0) | F.isnan(x), real("nan"))


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def to_int(x: Column) -> Column:
    """Truncates toward zero; null beyond 64 bits."""
    return x.try_cast("long")


def char_at(s: Column, i: Column) -> Column:
    """Code of the i-th character from 0; null outside."""
    one = F.substring(s, i.cast("int") + 1, F.lit(1))
    return F.when((i >= 0) & (i < F.char_length(s)), F.ascii(one).cast("long"))


def to_date(s: Column) -> Column:
    """A date literal: ISO 8601, or month name, day, year and 12-hour time."""
    return F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("MMM d, yyyy h:mm:ss a")), F.try_to_timestamp(s, F.lit("MMM d, yyyy"))).cast("timestamp_ntz")


def decimal_scale(x: Column, digits: int, scale: int) -> Column:
    """A fixed-point value of at most 18 digits, rounded half up."""
    return F.round(x, scale).cast(f"decimal({min(18, digits + scale)},{scale})")




def decimal_mul(a: Column, b: Column, digits: int, scale: int) -> Column:
    return (a * b).cast(f"decimal({digits},{scale})")


def decimal_div(a: Column, b: Column, digits: int, scale: int) -> Column:
    """Rounded half up; null where b is 0."""
    return F.try_divide(a, b).cast(f"decimal({digits},{scale})")


def decimal_abs(a: Column) -> Column:
    return F.abs(a)


def decimal_neg(a: Column) -> Column:
    return F.negative(a)


def decimal_format(a: Column, scale: int, width: int = 0, fill: str = " ") -> Column:
    """As text with `scale` digits after the point, filled up from the left."""
    text = F.round(a, scale).cast(f"decimal(38,{scale})").cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, fill)).otherwise(text)

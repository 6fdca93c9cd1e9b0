"""Numbers as statements print them; all pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a grouped number. Points and commas both group, decimals don't exist, and neither
# side needs a border, so it may be found inside a longer run of digits.
NUMBER = r"\(?\s*-?\s*\d{1,3}(?:[.,]\d{3})+\s*\)?"


#: A number's type where whole numbers of more than 18 digits or fractions may come: exact up to
#: 30 digits before the point, which leaves room for sums and tenfold values, and six behind it.
WIDE, WIDE_DIGITS = "decimal(38,6)", 30


def bounded(number: Column, kind: str) -> Column:
    """Null for what arithmetic of that type couldn't add up: over 30 digits, and bigint's least value, which has no absolute value."""
    if kind == WIDE:
        return F.when(F.abs(number) < F.lit(f"1{'0' * WIDE_DIGITS}").cast(WIDE), number)
    return F.nullif(number, F.lit(-(2**63))) if kind == "bigint" else number


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() only takes spaces)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_number(text: Column, strict: bool = False, kind: str = "bigint") -> Column:
    """All digits as one number, negative if the first character is ( or -; null, or an error if strict, without digits or beyond the type."""
    text = stripped(text)
    digits = F.regexp_replace(text, r"(?U)\D", "")
    number = bounded(digits.try_cast(kind), kind) * F.when(F.substring(text, 1, 1).isin("(", "-"), -1).otherwise(1)
    if strict:
        return F.when(text.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("no number in "), text)).cast(kind)).otherwise(number)
    return number.cast(kind)


def coerce(raw: Column, kind: str = "bigint") -> Column:
    """A raw value (kind, txt) as a number: numbers as they are, strings by their digits, null and booleans null.

    `kind` is the number's type: bigint is exact and takes floats that are whole; WIDE takes long
    numbers and floats, these to six places; double takes all floats, NaN and infinities too. What a
    type can't hold is null, and so unreadable.
    """
    name, text = raw["kind"], raw["txt"]
    number = text.try_cast(kind)
    if kind == "bigint":
        double = text.try_cast("double")
        number = F.when(double == F.floor(double), double.try_cast("bigint"))
    return (
        F.when(name.isNull() | name.isin("null", "bool"), F.lit(None))
        .when(name == "int", bounded(text.try_cast(kind), kind))
        .when(name == "float", bounded(number, kind))
        .otherwise(parse_number(text, kind=WIDE if kind == "double" else kind))
        .cast(kind)
    )


def grouped(number: Column) -> Column:
    """Thousands parted by commas, a fraction only where there is one; null for null."""
    return F.call_function("format_number", number, F.lit("#,##0.######"))


def shown(number: Column, kind: str) -> Column:
    """A number as text, without the zeros that end a fraction."""
    text = number.cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if kind == WIDE else text


def percent(ratio: Column, digits: int) -> Column:
    """As C and Python print it: from the double's exact value, halves to even (format_string rounds the shortest digits that stand for it)."""
    x, half = ratio * 100, 2.0**63
    high = F.floor(x / half)
    low = F.floor(x - high * F.lit(half))
    whole = high.cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + low.cast("decimal(19,0)")
    number = (
        F.when(F.abs(x) < 2.0**53, F.call_function("format_number", x, F.lit("0." + "0" * digits)))
        .when(x.between(0, 2.0**125), F.concat(whole.cast("string"), F.lit("." + "0" * digits)))  # whole numbers all
        .otherwise(F.format_string(f"%.{digits}f", x))
    )
    return F.when(ratio.isNotNull(), F.concat(number, F.lit("%")))


def rounded(seconds: Column) -> Column:
    return F.round(seconds, 2)

"""Number and text conversions of dynamic languages: what counts as a number, how one is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that trimming removes: the Unicode kind, line ends and the byte-order mark.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
DECIMAL = r"^[+-]?(Infinity|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def trimmed(col: Column) -> Column:
    """Without white space at both ends; null is the empty text."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), rf"^{BLANK}+|{BLANK}+$", "")


def text_number(col: Column) -> Column:
    """A trimmed text as a double if all of it is a decimal, hexadecimal, octal or binary number, else null.

    The empty text is null here; ``1d``, ``NaN`` and ``1_000`` are no numbers.
    """
    based = lambda prefix, digits, base: F.when(col.rlike(f"^0[{prefix}]{digits}+$"), F.conv(F.substring(col, 3, 64), base, 10).cast("double"))
    return F.coalesce(
        F.when(col.rlike(DECIMAL), col.try_cast("double")),
        based("xX", "[0-9a-fA-F]", 16),
        based("oO", "[0-7]", 8),
        based("bB", "[01]", 2),
    )


def number_text(col: Column) -> Column:
    """A double as text with the fewest digits: 20, 10000000, 0.0001, 1e+21, NaN, Infinity."""
    raw = col.cast("double").cast("string")
    mantissa = F.regexp_extract(raw, r"^(-?[0-9.]+)E(-?[0-9]+)$", 1)
    power = F.regexp_extract(raw, r"^(-?[0-9.]+)E(-?[0-9]+)$", 2).try_cast("int")
    sign = F.when(raw.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"[-.]", ""), "0+$", "")
    n = F.length(digits)
    large = F.concat(sign, F.rpad(digits, F.greatest(power + 1, n), "0"))
    large = F.when(n > power + 1, F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, n))).otherwise(large)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(sign, F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power > 0, F.lit("+")).otherwise(F.lit("")), power.cast("string"))
    return (
        F.when(raw.isin("NaN", "Infinity", "-Infinity"), raw)
        .when(power.isNull(), F.regexp_replace(F.regexp_replace(raw, r"\.0$", ""), "^-0$", "0"))
        .when(power >= 21, scientific)
        .when(power >= 0, large)
        .when(power >= -7, small)
        .otherwise(scientific)
    )


def cell_text(col: Column, kind: T.DataType) -> Column:
    """A cell as shown and searched: null empty, numbers short, times ISO in UTC, nested values JSON."""
    if isinstance(kind, T.StringType):
        out = col
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number_text(col.cast("string").cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(col)
    elif isinstance(kind, T.BinaryType):
        out = F.lower(F.hex(col))
    else:
        out = col.cast("string")
    return F.coalesce(out, F.lit(""))

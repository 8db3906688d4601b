"""Scalar number helpers: MySQL text coercion, PHP integer rules, ratios.

All are plain Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
WIDE = "decimal(38,4)"
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

# Fixed value: the longest numeric prefix MySQL reads from a text value
# ("3x" -> 3, "-2.5e1z" -> -25, ".5" -> 0.5, "abc" -> nothing).
NUMERIC_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
# Fixed value: the integer prefix read by CAST(text AS SIGNED).
INTEGER_PREFIX = r"^\s*([+-]?\d+)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: characters a well-formed number may start / end with.
_FIRST_CHARS = tuple("0123456789+-.")
_LAST_CHARS = tuple("0123456789.")


def _whole_text_is_candidate(c: Column) -> Column:
    """ASCII text without surrounding blanks that starts and ends like a
    number.  For such text a successful decimal/integer cast reads exactly
    the characters the prefix pattern would keep, so the regex is skipped."""
    return ((F.length(c) == F.octet_length(c))
            & F.substring(c, 1, 1).isin(*_FIRST_CHARS)
            & F.substring(c, -1, 1).isin(*_LAST_CHARS))


def saturated(number: Column, dtype: str) -> Column:
    """``number`` as ``dtype`` (decimal or bigint), beyond its range the nearest bound;
    a double has no bound."""
    if dtype == "double":
        return number.cast(dtype)
    if dtype == "bigint":
        least, most = F.lit(LONG_MIN), F.lit(LONG_MAX)
    else:
        digits, scale = (int(x) for x in dtype[len("decimal("):-1].split(","))
        bound = "9" * (digits - scale) + ("." + "9" * scale if scale else "")
        least, most = F.lit("-" + bound).cast(dtype), F.lit(bound).cast(dtype)
    return F.coalesce(number.try_cast(dtype), F.when(number < 0, least).when(number > 0, most))


def coercion_counts(c, dtype: str = MONEY) -> dict[str, Column]:
    """Counts over text values, by what ``mysql_number`` makes of them: all,
    without a number (0), with text after it (dropped), beyond ``dtype`` (its bound)."""
    c = _col(c)
    prefix = F.regexp_extract(c, NUMERIC_PREFIX, 1)
    beyond = (prefix != "") & prefix.try_cast(WIDE).try_cast(dtype).isNull() & (F.abs(prefix.try_cast("double")) >= 1)
    return {"values": F.count(c), "not_numbers": F.count(F.when(prefix == "", c)),
            "cut": F.count(F.when((prefix != "") & (prefix != F.trim(c)), c)), "saturated": F.count(F.when(beyond, c))}


def mysql_number(c, dtype: str = "double") -> Column:
    """Text -> number the way MySQL's SUM/compare coerces it.

    Empty or non-numeric text is 0, a numeric prefix is kept, null stays null.
    Integer targets truncate the number ("1e3" is 1000, "3.7" is 3).
    Decimal and integer targets first try a plain cast of well-formed text
    (the common case) and only fall back to the prefix pattern when it
    fails; a double target always uses the pattern (the JVM's double parser
    also reads hex and "1d"-style text that MySQL does not).  A number that
    the target cannot hold is its nearest bound, never 0 and never an error
    (``coercion_counts`` counts these).
    """
    c = _col(c)
    prefix = F.regexp_extract(c, NUMERIC_PREFIX, 1)
    if dtype == "double":
        value = prefix.try_cast(dtype)
        return F.when(c.isNull(), F.lit(None).cast(dtype)).otherwise(F.coalesce(value, F.lit(0).cast(dtype)))
    # beyond 38 digits only the sign and whether it is large matter
    far = F.when(F.abs(prefix.try_cast("double")) < 1, F.lit(0).cast(dtype)).otherwise(saturated(prefix.try_cast("double"), dtype))
    near = saturated(prefix.try_cast(WIDE), dtype)
    number = F.when(prefix == "", F.lit(0).cast(dtype)).otherwise(F.coalesce(near, far))
    return F.when(c.isNull(), F.lit(None).cast(dtype)).otherwise(
        F.coalesce(F.when(_whole_text_is_candidate(c), c.try_cast(dtype)), number))


def mysql_money(c) -> Column:
    """Text -> DECIMAL(18,4) money with MySQL's prefix rule."""
    return mysql_number(c, MONEY)


def mysql_signed(c) -> Column:
    """CAST(text AS SIGNED): leading integer digits, else 0; null stays null;
    more digits than a bigint holds give its nearest bound."""
    c = _col(c)
    prefix = F.regexp_extract(c, INTEGER_PREFIX, 1)
    bound = F.when(prefix.startswith("-"), F.lit(LONG_MIN)).otherwise(F.lit(LONG_MAX))
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(prefix == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(prefix.try_cast("bigint"), bound))


def php_int(c) -> Column:
    """PHP ``(int)`` / ``intval`` of a number: truncation toward zero; beyond
    the bigint range the nearest bound."""
    c = _col(c)
    size = c.cast("double")
    return (F.when(size >= F.lit(float(1 << 63)), F.lit(LONG_MAX)).when(size <= F.lit(float(LONG_MIN)), F.lit(LONG_MIN))
            .otherwise(c.cast(WIDE).cast("bigint")))


def absint(c) -> Column:
    """PHP ``absint``: abs of the truncated integer; null -> 0."""
    value = php_int(c)
    return F.coalesce(F.when(value == LONG_MIN, F.lit(LONG_MAX)).otherwise(F.abs(value)), F.lit(0).cast("bigint"))


def ratio(num, den) -> Column:
    """num / den as double, 0 when den is not positive."""
    num, den = _col(num), _col(den)
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def round2_ratio(num, den) -> Column:
    """round(num / den, 2) half-up for non-negative integer counts.

    Integer arithmetic, so it equals ``number_format(num/den, 2)`` exactly:
    floor((num * 200 + den) / (2 * den)) / 100.
    """
    num, den = _col(num).cast("bigint"), _col(den).cast("bigint")
    return (F.floor((num * 200 + den) / (den * 2)).cast("bigint").cast("double") / 100.0)


def round2_percent(num, den) -> Column:
    """round(num / den * 100, 2) half-up for non-negative integer counts."""
    num, den = _col(num).cast("bigint"), _col(den).cast("bigint")
    return (F.floor((num * 20000 + den) / (den * 2)).cast("bigint").cast("double") / 100.0)


def positive_or_null(c) -> Column:
    """The reports' "n/a": the value when > 0, else null."""
    c = _col(c)
    return F.when(c > 0, c)


def share_of_max(value, maximum, rounded: bool = False) -> Column:
    """Bar width in percent: value / max * 100, 0 when value <= 0.

    ``rounded`` rounds both sides to whole numbers first (half away from
    zero); a zero rounded maximum gives null instead of a division by zero.
    """
    value, maximum = _col(value), _col(maximum)
    num, top = (F.round(value, 0), F.round(maximum, 0)) if rounded else (value, maximum)
    den = F.when(top.cast("double") != 0, top.cast("double"))
    return F.when(value > 0, num.cast("double") / den * 100.0).otherwise(F.lit(0.0))


def to_double(c) -> Column:
    return _col(c).cast("double")


def number_text(c, decimals: int = 2) -> Column:
    """Display text with thousands separators and ``decimals`` places
    (``1234.5`` -> ``1,234.50``), rounding half up; reports keep numbers and
    render only at the edge."""
    return F.format_number(_col(c).cast("double"), decimals)


def money_text(c, symbol: str = "") -> Column:
    """Money for display: optional symbol + ``number_text(c, 2)``."""
    return F.concat(F.lit(symbol), number_text(c, 2))

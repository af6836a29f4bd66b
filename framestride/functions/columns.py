"""Scalar columns: missing values, rounding, names, moments.

"Missing" is NULL throughout: NaN and infinities are turned into NULL on the way
in, comparisons with NULL are no flags, and divisions by zero give NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = "long"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def finite(c: Column | str) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def flag(c: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def uint8(c: Column | str) -> Column:
    """Rounded half to even into 0..255; missing is 0, infinities are the bounds."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c))))


def round_scaled(c: Column | str, digits: int) -> Column:
    """Rounded half away from zero as binary numbers are in SQL: scaled, rounded, scaled back.

    ``F.round`` goes by the decimal that a double prints as. A value just under a half, as 1.0594999999999999,
    stays under it there, but scaled by 1000 is 1059.5.
    """
    scale = float(10**digits)
    return F.round(col(c) * scale) / scale


def unbiased_kurtosis(c: Column | str) -> Column:
    """Aggregate: bias-corrected excess kurtosis; NULL for constants and under four values."""
    n, g = F.count(c).cast("double"), F.kurtosis(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation over rows with both values; NULL where one side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), "([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """The file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """The last extension with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def last_number(name: Column | str) -> Column:
    """The last run of digits as a number, -1 without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(col(name), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast(LONG), F.lit(-1).cast(LONG))


def natural_key(name: Column | str) -> Column:
    """Pieces of a name that sort as people expect: digit runs by value, text without case."""
    pieces = F.regexp_extract_all(F.concat(F.lit("\x01"), col(name)), F.lit(r"(\d+|\D+)"), F.lit(1))

    def padded(p: Column) -> Column:
        bare = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.lpad(bare, F.greatest(F.length(bare), F.lit(24)), "0")

    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(F.lower(p)))


def frame_name(index: Column | str, total: Column | str) -> Column:
    """``frame_0001.png``: at least four digits, as many as the total needs."""
    width = F.greatest(F.lit(4), F.length(col(total).cast("string")))
    return F.concat(F.lit("frame_"), F.lpad(col(index).cast("string"), width, "0"), F.lit(".png"))


def fourcc(code: Column | str) -> Column:
    """Four characters of a little-endian integer."""
    c = col(code).cast(LONG)
    return F.concat(*[F.chr(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255).cast(LONG))) for i in range(4)])

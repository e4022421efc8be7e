"""Scalar column expressions (F1-F10 and the portable pseudo-random mix).

All are built-in Catalyst expressions, so they stay inside whole-stage code
generation; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantrisk import schemas

MIX_RANGE = 1 << 60


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mix(i: str | Column, seed: int) -> Column:
    """Portable pseudo-random integer in [0, 2^60) from an id and a seed.

    The first 15 hexadecimal digits of the md5 of ``seed|id``: defined for
    every id, the same in any SQL engine with md5, independent for different
    seeds, and stable across retries because it depends only on the row's
    id, never on partitioning.  A NULL id counts as the empty text.
    """
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(_c(i).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def uniform01(i: str | Column, seed: int) -> Column:
    """``mix`` scaled to [0, 1)."""
    return mix(i, seed).cast("double") / F.lit(float(MIX_RANGE))


def fill_zero_expr(c: str, dtype: str | None = None) -> Column:
    """NULL and NaN -> 0 (NaN only exists for floating columns)."""
    col = F.col(c)
    if dtype in ("double", "float"):
        col = F.nanvl(col, F.lit(None).cast(dtype))
    return F.coalesce(col, F.lit(0).cast(dtype) if dtype else F.lit(0)).alias(c)


def fill_missing_expr(c: str, token: str = schemas.MISSING) -> Column:
    """NULL -> constant category."""
    return F.coalesce(F.col(c), F.lit(token)).alias(c)


def share(num: str | Column, den: str | Column) -> Column:
    """ratio; zero or NULL denominator gives NULL (no ANSI error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def parse_date(c: str | Column, fmt: str = schemas.DATE_FORMAT) -> Column:
    """text date -> DATE; malformed or impossible dates give NULL."""
    return F.try_to_date(_c(c), fmt)


def day_diff(end: str | Column, start: str | Column) -> Column:
    """whole days end - start (negative kept)."""
    return F.datediff(_c(end), _c(start))


def repair_separators(c: str | Column) -> Column:
    """``[ ]+;`` -> `` -`` then ``;[ ]+`` -> ``- `` (in that order)."""
    first = F.regexp_replace(_c(c), "[ ]+;", " -")
    return F.regexp_replace(first, ";[ ]+", "- ")


def value_band(c: str | Column) -> Column:
    """right-closed value bands; <= 0 and NULL give NULL.

    The chain ends with an explicit ``> last edge`` test instead of
    ``otherwise`` so that NULL never falls into the top band.
    """
    x = _c(c)
    e, lab = schemas.VALUE_BAND_EDGES, schemas.VALUE_BAND_LABELS
    expr = F.when((x > e[0]) & (x <= e[1]), lab[0])
    for lo, hi, name in zip(e[1:-1], e[2:], lab[1:-1]):
        expr = expr.when((x > lo) & (x <= hi), name)
    return expr.when(x > e[-1], lab[-1])


def fmt3(c: str | Column) -> Column:
    """three-decimal rendering (report views only)."""
    return F.format_string("%.3f", _c(c))


def decimal_comma_to_double(c: str | Column) -> Column:
    """``1.234,56`` / ``1234,56`` text -> 1234.56; bad text -> NULL."""
    s = F.trim(_c(c))
    s = F.when(F.instr(s, ",") > 0, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(s)
    return s.try_cast("double")


def double_to_decimal_comma(c: str | Column) -> Column:
    """F10 inverse: double -> plain text with a decimal comma (no exponent, no grouping).

    The shortest text that reads back as the same double, its exponent
    written out.  NaN becomes NULL; infinities keep their names.
    """
    text = F.nanvl(_c(c).cast("double"), F.lit(None).cast("double")).cast("string")
    short = F.translate(F.regexp_replace(text, r"\.0$", ""), ".", ",")
    # Few doubles have an exponent.  Taking theirs apart inside a lambda keeps the code of wide exports small.
    return F.when(~text.contains("E"), short).otherwise(F.transform(F.array(text), _without_exponent)[0])


def _without_exponent(text: Column) -> Column:
    """``-1.25E-7`` -> ``-0,000000125``; text of another shape as it is."""
    shape = r"^-?(\d+)\.(\d+?)0*E(-?\d+)$"
    whole, part, exponent = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    point = F.length(whole) + exponent.try_cast("int")
    padded = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), 1 - point), digits)) \
        .otherwise(F.rpad(digits, F.greatest(point, F.length(digits)), "0"))
    point = F.greatest(point, F.lit(1))
    front, back = F.substring(padded, 1, point), F.substring(padded, point + 1, F.length(padded))
    plain = F.concat(F.when(text.startswith("-"), "-").otherwise(""), front, F.when(back == "", "").otherwise(F.concat(F.lit(","), back)))
    return F.when(text.rlike(shape), plain).otherwise(text)

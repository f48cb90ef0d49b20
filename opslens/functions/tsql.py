"""Column expressions for the places where the source dialect's rules differ
from Spark defaults (SURVEY 1.3, S1-S20). All are plain ``Column``
builders, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
PAGES_PER_MB = 128          # 8 KiB pages (S20)
UNLIMITED_MEMORY_MB = 2147483647
INTEGRITY_NEVER = "1900-01-01 00:00:00"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``); NULL for 0."""
    return F.when(_c(b) == 0, F.lit(None).cast("long")).otherwise(
        F.call_function("div", _c(a), _c(b)))


def safe_idiv(a, b, zero=0) -> Column:
    """S1 + S15: integer division, ``zero`` when the divisor is 0."""
    return F.when(_c(b) == 0, F.lit(zero)).otherwise(idiv(a, b))


def scaled(x, exponent: int, out: str) -> Column:
    """Exact ``x / 10**exponent`` rounded half-up into decimal type ``out``
    (no binary floating point on the way, so x.xx5 rounds as written)."""
    from decimal import Decimal
    return (_c(x).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-exponent))).cast(out)


def pages_to_mb_trunc(pages) -> Column:
    """``pages*8/1024`` with per-row integer truncation."""
    return idiv(_c(pages) * 8, F.lit(1024))


def datediff_boundaries(unit: str, start, end) -> Column:
    """S3: number of ``unit`` boundaries crossed from ``start`` to ``end``.

    ``unit`` in day, hour, minute, second. Both sides are truncated to the
    unit first, then subtracted, which is the boundary count.
    """
    s, e = _c(start), _c(end)
    if unit == "day":
        return F.datediff(e.cast("date"), s.cast("date")).cast("long")
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, s), F.date_trunc(unit, e))


def ci_like_any(col, patterns) -> Column:
    """Case-insensitive ``LIKE`` against any of the patterns."""
    c = F.lower(_c(col))
    out = None
    for p in patterns:
        t = c.like(p.lower())
        out = t if out is None else (out | t)
    return out


def tsql_len(x) -> Column:
    """``LEN`` ignores trailing blanks."""
    return F.length(F.regexp_replace(_c(x), " +$", ""))


def tsql_substring(x, start, length) -> Column:
    """``SUBSTRING`` keeps positions ``start .. start+length-1`` that
    fall on the string; a start below 1 therefore shortens the result."""
    st = _c(start).cast("long")
    last = st + _c(length).cast("long") - 1
    first = F.greatest(st, F.lit(1))
    n = last - first + 1
    return F.when(n <= 0, F.lit("")).otherwise(
        F.substr(_c(x), first.cast("int"), n.cast("int")))


def parsename(v, part: int) -> Column:
    """``PARSENAME(v, part)`` counting from the right."""
    return F.element_at(F.split(_c(v), r"\."), -part)


def str10(n) -> Column:
    """``STR(n)`` right-justified to 10 characters."""
    return F.format_string("%10d", _c(n).cast("long"))


def quotename(x) -> Column:
    """Bracket-quote an identifier, doubling ``]``."""
    return F.concat(F.lit("["), F.replace(_c(x), F.lit("]"), F.lit("]]")), F.lit("]"))


def money(x) -> Column:
    """``CONVERT(varchar, CAST(x AS money), 1)``: comma-grouped, 2 decimals.

    Rounded half-up to cents on the double value (``floor(x*100 + 0.5)``),
    then formatted exactly, so the text does not depend on how an engine
    rounds binary fractions.
    """
    cents = F.floor(_c(x).cast("double") * 100 + 0.5)
    from decimal import Decimal
    return F.format_number(cents.cast("decimal(38,0)") * F.lit(Decimal("0.01")), 2)


def version_name(v) -> Column:
    """A2: product version prefix -> release year name, NULL if unknown."""
    c = _c(v)
    # Version prefix -> release name, tested in this order.
    return (F.when(c.startswith("8."), "2000")
            .when(c.startswith("9."), "2005")
            .when(c.startswith("10.0"), "2008")
            .when(c.startswith("10.5"), "2008 R2")
            .when(c.startswith("11."), "2012")
            .when(c.startswith("12."), "2014")
            .when(c.startswith("13."), "2016")
            .when(c.startswith("14."), "2017")
            .when(c.startswith("15."), "2019"))


def hexstr(b) -> Column:
    """``fn_varbintohexstr``: ``0x`` + lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_c(b))))

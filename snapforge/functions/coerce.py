"""Cleaning casts P5-P9 as Column expressions.

Spark 4 runs with ANSI mode on, so every cast here is a ``try_`` form: bad text
becomes null instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapforge.constants import BOOL_STRICT, BOOL_TRUE_LENIENT
from snapforge.functions.text import _c, strip

# fixed values: accepted date layouts after '/' has been turned into '-': year, month, day and day, month, year
YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}$"
DAY_FIRST = r"^\d{1,2}-\d{1,2}-\d{4}$"
# fixed values: the text of a number
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# fixed value: a time of day followed by a zone offset
OFFSET = r":\d{2}[^+Zz-]*([Zz]|[+-]\d{2}(:?\d{2})?)$"
INFINITIES = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def coerce_date(c: Column | str, extra_formats: Iterable[str] = ()) -> Column:
    """P5: year-first then day-first dates, ``-`` or ``/``; blank or impossible dates -> null."""
    text = F.replace(strip(c), F.lit("/"), F.lit("-"))
    # a lambda's argument is computed once, however often it is used
    known = F.get(F.transform(F.array(text), _date_of), F.lit(0))
    return F.coalesce(known, *[F.when(text != "", F.try_to_date(text, fmt)) for fmt in extra_formats])


def _date_of(text: Column) -> Column:
    year_first = text.rlike(YEAR_FIRST)
    parts = F.when(year_first | text.rlike(DAY_FIRST), F.transform(F.split(text, "-"), lambda p: p.cast("int")))
    return F.get(F.transform(F.array(F.when(year_first, parts).otherwise(F.reverse(parts))), _real_date), F.lit(0))


def _real_date(ymd: Column) -> Column:
    """The date of [year, month, day], null for an impossible one. Checked by arithmetic: a parser's error costs far more than a parse."""
    year, month, day = (F.get(ymd, F.lit(i)) for i in range(3))
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(
        (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)
    real = (year >= 1) & month.between(1, 12) & day.between(F.lit(1), days)
    return F.when(real, F.make_date(year, month, day))


def coerce_int(c: Column | str, dtype: str = "bigint") -> Column:
    """Numeric text -> integer. ``' 7 '``, ``'3.0'`` and ``'1e3'`` pass; fractions and text -> null."""
    text = strip(c)
    # plain digits are cast exactly; a fraction of zeros or an exponent goes through a number that must be whole
    fraction = F.when(text.rlike(NUMBER), text.try_cast("double"))
    whole = F.when(fraction == F.floor(fraction), text.try_cast("decimal(38,10)"))
    beyond = text.rlike(r"\.\d*[1-9]") & ~text.rlike("[eE]")  # a fraction too small for a double to show
    return F.when(~beyond, F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)")), whole)).try_cast(dtype)


def coerce_decimal(c: Column | str, dtype: str = "double") -> Column:
    """Decimal comma -> dot, then numeric; anything else (also NaN) -> null."""
    text = F.replace(strip(c), F.lit(","), F.lit("."))
    text = F.when(text.rlike(NUMBER) | F.lower(text).isin(INFINITIES), text)  # no Java suffixes such as 1d
    if dtype.startswith("decimal"):
        return text.try_cast(dtype)
    num = text.try_cast("double")
    return num if dtype == "double" else num.try_cast(dtype)


def coerce_bool(c: Column | str, strict: bool = False) -> Column:
    """Lenient form is true for ``true 1 yes y t`` and false otherwise (null included).

    Strict form: ``true``/``1`` -> true, ``false``/``0`` -> false, anything else -> null.
    """
    text = F.lower(strip(c))
    if not strict:
        return F.coalesce(text.isin(BOOL_TRUE_LENIENT), F.lit(False))
    return F.when(text.isin(BOOL_STRICT[0], BOOL_STRICT[2]), F.lit(True)).when(
        text.isin(BOOL_STRICT[1], BOOL_STRICT[3]), F.lit(False)
    )


def coerce_timestamp(c: Column | str) -> Column:
    """ISO timestamp or date text -> timestamp; blank or unparseable -> null. Text with a zone
    offset names an instant; its UTC time is the result."""
    text = strip(c)
    instant = F.convert_timezone(None, F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(OFFSET), instant).when(text != "", text.try_cast("timestamp_ntz"))


def coerce_to(c: Column | str, dtype: str) -> Column:
    """Dispatch a text column to the cleaning cast of a Spark type (DDL string)."""
    d = dtype.lower()
    if d == "date":
        return coerce_date(c)
    if d.startswith("timestamp"):
        return coerce_timestamp(c).cast(d)
    if d in ("tinyint", "smallint", "int", "integer", "bigint"):
        return coerce_int(c, d)
    if d in ("float", "double") or d.startswith("decimal"):
        return coerce_decimal(c, d)
    if d == "boolean":
        return coerce_bool(c)
    return _c(c).cast("string")

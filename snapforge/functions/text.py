"""Text Column expressions (P3, P4, P11 and shared helpers). All JVM-side, codegen friendly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapforge.constants import READ_NULL_TOKENS, WRITE_NULL_TOKENS

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed value: the characters that Unicode text handling takes as blanks, in code point order
WHITESPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = f"[{WHITESPACE}]+"


def strip(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace of every kind (SQL ``trim`` only removes spaces).

    A character-set trim, not a regex: the same result as a leading/trailing whitespace regex,
    at a fraction of the cost.
    """
    return F.btrim(_c(c), F.lit(WHITESPACE))


def casefold(c: ColumnOrName) -> Column:
    """Case-insensitive comparison form: lower-case, with sharp s folded to ``ss``."""
    return F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss"))


def null_tokens(c: ColumnOrName, tokens: Iterable[str] | None = None, side: str = "read") -> Column:
    """Map null tokens to null.

    ``side="read"``: exact match against the upload reader's token set.
    ``side="write"``: stripped, lower-cased text in ``"" null na nan``.
    """
    col = _c(c)
    if side == "read":
        toks = list(READ_NULL_TOKENS if tokens is None else tokens)
        return F.when(col.isin(toks), F.lit(None).cast("string")).otherwise(col)
    toks = list(WRITE_NULL_TOKENS if tokens is None else tokens)
    return F.when(F.lower(strip(col)).isin(toks), F.lit(None).cast("string")).otherwise(col)


def collapse_whitespace(c: ColumnOrName) -> Column:
    """Collapse inner whitespace runs to one space and strip the ends."""
    return strip(F.regexp_replace(_c(c), BLANK_RUN, " "))


def is_blank(c: ColumnOrName, dtype: str = "string") -> Column:
    """Null, NaN (floating columns) or whitespace-only text."""
    col = _c(c)
    if dtype in ("double", "float"):
        return col.isNull() | F.isnan(col)
    if dtype == "string":
        return col.isNull() | (strip(col) == "")
    return col.isNull()

"""Scalar column expressions. All are JVM-side built-ins, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "strip", "is_blank", "norm_key_sql", "norm_key_py", "edit_strip", "fold_case",
    "iexact", "base_sku", "plus_sku", "null_if_marker", "toggle_prefix",
    "company_for_region", "canonical_channel", "department_of", "datetime_text",
    "iso_text", "utc_now",
    "ALT_PREFIX", "CSV_NULLS",
]

# Every character Unicode-aware stripping removes.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts that stand for a null left behind by an earlier text cast.
_NULL_MARKERS = ["None", "nan", "NaT"]

# CSV fields that are read as null.
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Alternate-SKU prefix, companies by region, channel spelling.
ALT_PREFIX = "M-"
_COMPANY = {"IT": "B2fitness", "UK": "B2fitness", "DE": "B2fitness", "ES": "B2fitness LTD"}
_CHANNEL = {"Amazon.co.uk": "Amazon.uk"}

_DEPARTMENTS = {
    "modified_by": "SCM",
    "modified_by_finance": "FINANCE",
    "modified_by_admin": "ADMIN",
}


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(_WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or whitespace-only (P5)."""
    return F.coalesce(strip(c) == "", F.lit(True))


def norm_key_sql(c: Column) -> Column:
    """Upper case without surrounding spaces; other whitespace stays."""
    return F.upper(F.trim(c))


def norm_key_py(c: Column) -> Column:
    """Upper case without surrounding whitespace; null stays null."""
    return F.upper(strip(c))


def edit_strip(c: Column) -> Column:
    """Strip an edited value: an empty text clears the field, blanks become ''."""
    return F.when(c != "", strip(c))


def fold_case(c: Column) -> Column:
    return F.lower(c)


def iexact(a: Column, b: Column) -> Column:
    """Case-insensitive equality that still plans as an equi-join."""
    return fold_case(a) == fold_case(b)


def base_sku(c: Column) -> Column:
    """Drop one trailing plus sign."""
    return F.when(c.endswith("+"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def plus_sku(c: Column) -> Column:
    return F.concat(c, F.lit("+"))


def null_if_marker(c: Column) -> Column:
    """Turn text left over from casting a null back into a null."""
    return F.when(~c.isin(_NULL_MARKERS), c)


def toggle_prefix(c: Column, prefix: str = ALT_PREFIX) -> Column:
    """Strip the prefix where present, add it otherwise."""
    rest = F.substring(c, F.lit(len(prefix) + 1), F.length(c))
    return F.when(c.startswith(prefix), rest).otherwise(F.concat(F.lit(prefix), c))


def _map_values(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, result in values.items():
        out = F.when(c == value, F.lit(result)).otherwise(out)
    return out


def company_for_region(c: Column) -> Column:
    """Company that sells in a region; null elsewhere."""
    return _map_values(c, _COMPANY)


def canonical_channel(c: Column) -> Column:
    """One spelling per sales channel."""
    return F.coalesce(_map_values(c, _CHANNEL), c)


def department_of() -> Column:
    """Department of an edit: the first attribution column that is filled."""
    out = F.lit(None).cast("string")
    for column, name in reversed(_DEPARTMENTS.items()):
        out = F.when(~is_blank(F.col(column)), F.lit(name)).otherwise(out)
    return out


def department_column(name: str) -> str:
    return next(c for c, n in _DEPARTMENTS.items() if n == name)


def datetime_text(c: Column) -> Column:
    """Text of a timestamp: six fractional digits, or none when they are zero.

    A cast rather than a date format, which would go through the session's time zone.
    """
    text = c.cast("string")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def iso_text(c: Column) -> Column:
    """ISO 8601 text of a UTC timestamp."""
    return F.concat(F.replace(datetime_text(c), F.lit(" "), F.lit("T")), F.lit("Z"))


def utc_now() -> Column:
    """Current time in UTC without a zone, like the stored timestamps."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())

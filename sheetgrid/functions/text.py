"""Column expressions on cell text: blank tests, keywords, names, typed views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() sees it: Unicode white space plus U+001C..U+001F.
_SPACE = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)^{_SPACE}+|{_SPACE}+$"
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"

NUMERIC_TEXT = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)
# Texts that may be tried as a timestamp: a full date with optional time.
ISO_DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"
SLASH_DATE_FORMATS = {
    r"^\s*\d{4}/\d{1,2}/\d{1,2}\s*$": "yyyy/M/d",
    r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$": "M/d/yyyy",
}


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, non-breaking spaces included."""
    return F.regexp_replace(text, _STRIP, "")


def is_not_blank(text: Column) -> Column:
    """Text holds something other than white space (null counts as blank).

    No white space lies in U+0021..U+007E or U+00A1..U+167F, so one look at the
    first character settles nearly all cells before the regexp runs.
    """
    first = F.ascii(text)
    return F.coalesce(
        first.between(0x21, 0x7E) | first.between(0xA1, 0x167F) | text.rlike(_NON_SPACE),
        F.lit(False),
    )


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Text contains at least one keyword, compared as is."""
    return reduce(lambda a, b: a | b, [text.contains(F.lit(k)) for k in keywords])


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Case-insensitive contains-any; keywords may be given in any case."""
    return contains_any(F.upper(text), [k.upper() for k in keywords])


def _keep_name_characters(text: Column) -> Column:
    joined = F.translate(text, " -", "__")
    return F.regexp_replace(joined, r"[^\p{L}\p{N}_]", "")


def clean_column_name(name: Column) -> Column:
    """Database-safe column name: letters, digits and `_`, lower case.

    Spaces and dashes become `_`; a name that does not start with a letter gets
    the prefix `col_`; a name with nothing left is `unnamed_column`.
    """
    kept = _keep_name_characters(strip(name))
    named = (
        F.when(kept == "", F.lit("unnamed_column"))
        .when(kept.rlike(r"^\p{L}"), kept)
        .otherwise(F.concat(F.lit("col_"), kept))
    )
    return F.lower(named)


def clean_table_name(name: Column, fallback: str | Column = "dataframe_0") -> Column:
    """Database-safe table name for a sheet name, with prefix `table_` if needed."""
    kept = _keep_name_characters(F.lower(name))
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return (
        F.when(F.coalesce(kept, F.lit("")) == "", fallback)
        .when(kept.rlike(r"^\p{L}"), kept)
        .otherwise(F.concat(F.lit("table_"), kept))
    )


def is_numeric_text(text: Column) -> Column:
    """Text reads as a number. A regexp, as `try_cast` also takes '1d' and '1f'."""
    return text.rlike(NUMERIC_TEXT)


def is_datetime_text(text: Column) -> Column:
    """Text reads as a calendar date or timestamp.

    The shape is checked first: `try_cast` alone would take a bare year.
    """
    valid = text.rlike(ISO_DATE_TEXT) & F.trim(text).try_cast("timestamp").isNotNull()
    for shape, fmt in SLASH_DATE_FORMATS.items():
        valid = valid | (
            text.rlike(shape)
            & F.try_to_timestamp(F.trim(text), F.lit(fmt)).isNotNull()
        )
    return valid

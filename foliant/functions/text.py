"""Text expressions on transcription lines. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_text(text: Column) -> Column:
    """The reader's text of a transcription line: drawing gaps are word breaks, markup and braces go, the
    first of alternative readings stands, and runs of '.', ',' and blanks are one blank. Null stays null."""
    t = F.regexp_replace(text, r"<[-~]>", ".")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.regexp_replace(t, r"\[([^:\[\]]*):[^\[\]]*\]", "$1")
    t = F.regexp_replace(t, r"[{}]", "")
    t = F.regexp_replace(t, r"[.,\s]+", " ")
    return F.trim(t)


def squeezed(text: Column) -> Column:
    """Runs of blanks are one blank, trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def page_name(folio: Column) -> Column:
    """One spelling of a page's name: no blanks, lower case, no zeros before the leaf's number."""
    return F.regexp_replace(F.lower(F.regexp_replace(folio, r"\s+", "")), r"^f0+(?=[0-9])", "f")


def page_leaf(folio: Column) -> Column:
    """The leaf in a page's name, null for a page without one (such as fRos)."""
    return F.nullif(F.regexp_extract(page_name(folio), r"^f(\d+)[rv]\d*$", 1), F.lit("")).try_cast("int")


def blank_as_null(text: Column) -> Column:
    """Trimmed of U+0020; empty equals null."""
    return F.nullif(F.trim(text), F.lit(""))

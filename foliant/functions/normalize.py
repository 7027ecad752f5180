"""Normalising of text and tokens. Unicode forms, which Spark has no function for, come from Python in Arrow batches; the
rest stays in the JVM."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _composed(form: str, text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return _composed("NFKC", text)


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    return _composed("NFC", text)


#: The ends of lines, as Unicode has them.
_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def text_lines(text: Column) -> Column:
    """The lines of a text, without their ends."""
    return F.split(text, _LINE_ENDS)


def letters(text: Column) -> Column:
    """Maximal runs of letters of a text in compatibility form and lower case; all else parts them."""
    return F.filter(F.split(F.lower(nfkc(text)), r"[^\p{L}]+"), lambda w: w != "")


def letter_lines(text: Column) -> Column:
    """`letters` of each line of a text, lines without any left out. A text without letters gives no lines."""
    lines = F.transform(text_lines(F.lower(nfkc(text))), lambda x: F.filter(F.split(x, r"[^\p{L}]+"), lambda w: w != ""))
    return F.filter(lines, lambda ws: F.size(ws) > 0)


def canonical_token(token: Column) -> Column:
    """One spelling of a token in composed form, or null: lower case, typewriter apostrophes, no apostrophe or hyphen at
    the ends; letters, marks and inner apostrophes and hyphens only, with a letter at least. token: already composed
    (see nfc)."""
    t = F.regexp_replace(F.lower(F.trim(token)), "’", "'")
    t = F.regexp_replace(t, r"^['-]+|['-]+$", "")
    return F.when(t.rlike(r"^[\p{L}\p{M}'-]+$") & t.rlike(r"\p{L}"), t)


#: Fixed value: what may be a token, before it is looked at closely.
ROUGH = r"([\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*)"


def line_tokens(line: Column) -> Column:
    """The canonical tokens of a line, unusable ones left out."""
    rough = F.regexp_extract_all(nfc(line), F.lit(ROUGH), 1)
    return F.filter(F.transform(rough, canonical_token), lambda t: t.isNotNull())


def source_tokens(line: Column) -> Column:
    """The tokens of a normalised line, parted by blanks; an empty line is an error."""
    t = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(t != "", F.split(t, " ")).otherwise(F.raise_error(F.lit("an empty source line")))


def serialized(glyphs: Column) -> Column:
    """A token's glyphs as compact JSON."""
    return F.to_json(glyphs)


def short_id(glyphs: Column) -> Column:
    """Sixteen hex digits that stand for a token."""
    return F.substring(F.sha2(serialized(glyphs), 256), 1, 16)


def stable_seed(*parts: Column) -> Column:
    """A seed below 2^63 - 1 from its parts: the first eight bytes of their SHA-256."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    number = F.conv(F.substring(h, 1, 8), 16, 10).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + F.conv(F.substring(h, 9, 8), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def pairwise_hamming(variants: Column) -> Column:
    """The mean number of places in which two of the variants (arrays of one length) differ; null for fewer than two,
    an error for two lengths."""
    n = F.size(variants)

    def apart(a: Column, b: Column) -> Column:
        differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
        return F.when(F.size(a) == F.size(b), differ).otherwise(F.raise_error(F.lit("variants of two lengths")).cast("int"))

    each = F.flatten(F.transform(variants, lambda a, i: F.transform(F.slice(variants, i + 2, n), lambda b: apart(a, b))))
    return F.when(n > 1, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each))


def mean_hamming(variants: Column) -> Column:
    """As pairwise_hamming, but fewer than two variants are an error."""
    return F.when(F.size(variants) > 1, pairwise_hamming(variants)).otherwise(F.raise_error(F.lit("fewer than two variants")).cast("double"))


def edit_share(edits: Column, a: Column, b: Column) -> Column:
    """Edits by the longer one's length, 0 for two of nothing."""
    return edits / F.greatest(a, b, F.lit(1))


def code_point_glyph(character: Column) -> Column:
    """U and the eight hex digits of a character's code point."""
    return F.concat(F.lit("U"), F.lpad(F.hex(F.ascii(character)), 8, "0"))


def glyph_character(glyph: Column) -> Column:
    """The character that code_point_glyph stands for."""
    return F.decode(F.unhex(F.substring(glyph, 2, 8)), "UTF-32")


#: Keys of a manifest that hold no text.
_NO_TEXT = frozenset(("@id", "id", "@type", "type", "service", "items", "images", "thumbnail", "height", "width"))


def _texts(value: object) -> list[str]:
    if isinstance(value, list):
        return [x for v in value for x in _texts(v)]
    if isinstance(value, dict):
        return [x for k, v in value.items() if k not in _NO_TEXT for x in _texts(v)]
    return [] if value is None else [str(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_texts(value: pd.Series) -> pd.Series:
    """The texts and numbers of nested JSON in order, at any depth; null stays null."""
    return value.map(lambda v: _texts(json.loads(v)), na_action="ignore")

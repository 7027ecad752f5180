"""Markup figures, corpus reports, and comparison of several transcriptions of the same lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import page_name, plain_text
from foliant.sources.transcription import PAGE

_PATTERNS = {
    "uncertain_spaces": ",", "alternative_readings": r"\[[^:\[\]]*:[^\[\]]*\]", "drawing_interruptions": r"<[-~]>", "inline_comments": r"<![^>]*>", "high_ascii_codes": r"@\d+;", "ligatures": r"\{", "unknown_runs": r"\?+",
    "unknown_marks": r"\?",
}


def markup(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in _PATTERNS.items()}


def records(loci: DataFrame) -> DataFrame:
    """The last delivery of every record."""
    columns = [c for c in loci.columns if c not in ("record_id", "ingested_at")]
    return loci.groupBy("record_id").agg(F.max_by(F.struct(*columns), "ingested_at").alias("r")).select("record_id", "r.*")


def markup_counts(loci: DataFrame, *keys: str) -> DataFrame:
    own = records(loci).select(*keys, *[c.alias(k) for k, c in markup(F.col("text_normalized")).items()])
    return own.groupBy(*keys).agg(*[F.sum(k).cast("long").alias(k) for k in _PATTERNS])


def long_words(text: Column) -> Column:
    """Words where uncertain spaces don't part."""
    t = F.regexp_replace(F.regexp_replace(text, r"<[-~]>", "."), r"<%>|<\$>|<@[A-Z]=[^>]>|<![^>]*>", "")
    return F.size(F.filter(F.split(t, r"\."), lambda w: F.trim(w) != ""))


def corpus_report(loci: DataFrame) -> DataFrame:
    """Per transcription: records, pages, leaves, paragraphs, long words, blank records."""
    page = page_name(F.col("folio"))
    own = records(loci).select("transcription_id", page.alias("page"), "physical_leaf", "paragraph_start", long_words(F.col("text_normalized")).alias("words"), (plain_text(F.col("text_normalized")) == "").alias("blank"))
    return own.groupBy("transcription_id").agg(
        F.count("*").alias("records"), F.count_distinct("page").alias("pages"), F.count_distinct("physical_leaf").alias("leaves"), F.count_if("paragraph_start").alias("paragraphs"),
        F.sum("words").cast("long").alias("long_words"), F.count_if("blank").alias("blank_records"),
    )


def same_lines(loci: DataFrame) -> DataFrame:
    """(line_key, a, b, text_a, text_b, …) of every two transcriptions of a line; a line has few. The key is the
    locus without its transcriber."""
    own = records(loci).select(F.regexp_replace("locus", ";.$", "").alias("line_key"), "transcription_id", plain_text(F.col("text_normalized")).alias("text"), "currier", "scribe", "section", "quire")
    a, b = (own.select("line_key", *[F.col(c).alias(f"{c}_{x}") for c in own.columns if c != "line_key"]) for x in "ab")
    return a.join(b, "line_key").where("transcription_id_a < transcription_id_b")


def comparisons(loci: DataFrame, low: float = 0.8, high: float = 0.95) -> DataFrame:
    """(line_key, transcriptions, edits, similarity, class): by glyph stream, then by word boundaries."""
    p = same_lines(loci)
    bare = lambda c: F.regexp_replace(c, " ", "")
    edits = F.levenshtein(bare("text_a"), bare("text_b"))
    longest = F.greatest(F.length(bare("text_a")), F.length(bare("text_b")))
    similarity = F.when(longest == 0, 1.0).otherwise(F.round(1 - edits / F.nullif(longest, F.lit(0)), 6))
    uncertain = F.contains("text_a", F.lit("?")) | F.contains("text_b", F.lit("?"))
    kind = (
        F.when((F.col("text_a") == F.col("text_b")) & uncertain, "exact_with_uncertainty").when(F.col("text_a") == F.col("text_b"), "exact").when(F.col("edits") == 0, "boundary_only")
        .when(F.col("similarity") < low, "low").when(F.col("similarity") < high, "moderate").otherwise("high")
    )
    return p.withColumn("edits", edits).withColumn("similarity", similarity).select("line_key", F.col("transcription_id_a").alias("a"), F.col("transcription_id_b").alias("b"), "edits", "similarity", kind.alias("class"))


def metadata_conflicts(loci: DataFrame) -> DataFrame:
    """(field, conflicts): lines whose transcriptions hold different known values."""
    own = records(loci).select(F.regexp_replace("locus", ";.$", "").alias("line_key"), *[F.col(c).cast("string").alias(c) for c in ("currier", "scribe", "section", "quire")])
    n = own.groupBy("line_key").agg(*[F.count_distinct(c).alias(c) for c in ("currier", "scribe", "section", "quire")])
    each = n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) > 1).cast("long").alias("x")) for c in ("currier", "scribe", "section", "quire")])))
    return each.groupBy("field").agg(F.sum("x").alias("conflicts"))


def review_sample(compared: DataFrame, per_page: int = 2, most: int = 100) -> DataFrame:
    """The least similar lines, at most `per_page` of a page: a top-k report."""
    page = F.regexp_extract("line_key", rf"^({PAGE})\.", 1)
    ranked = compared.where("class not like 'exact%'").withColumn("page", page).withColumn("place", F.expr("row_number() over (partition by page order by similarity, line_key, a, b)"))
    return ranked.where(F.col("place") <= per_page).orderBy("similarity", "line_key", "a", "b").limit(most).select("line_key", "a", "b", "page", "similarity")

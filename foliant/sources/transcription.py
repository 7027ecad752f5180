"""Transcription files: a header line, page headers with variables, and lines of text that may be wrapped.

Files are read whole and split into numbered lines, so line numbers are stable however the input is partitioned.
What a sequential reader carries from line to line (page, sticky tags, open paragraph) are windows over a page or a
file. A file is one task's work by design; a corpus is many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The format's patterns and its codes of sections.
PAGE = r"f(?:\d+[rv]\d*|Ros)"
PAGE_HEADER = rf"^<({PAGE})>(.*)$"
LOCUS = rf"^<({PAGE})\.(\d+),(.)([A-Z][a-z0-9])(?:;(.))?>"
FILE_HEADER = r"^#=IVTFF\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
SECTIONS = {
    "A": "astronomical", "B": "biological", "C": "cosmological", "H": "herbal", "P": "pharmaceutical", "S": "marginal_stars", "T": "text_only", "Z": "zodiac",
}
_KEYS = [chr(c) for c in range(ord("A"), ord("Z") + 1)]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, text) of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("i", "text")).select("file", (F.col("i") + 1).alias("n"), "text")


def logical_lines(lines: DataFrame) -> DataFrame:
    """(file, n, numbers, parts): a line ending in '/' goes on in the next; comments don't."""
    w = Window.partitionBy("file").orderBy("n")
    before = F.lag("text").over(w)
    begins = F.coalesce(~(before.endswith("/") & ~before.startswith("#")), F.lit(True)).cast("int")
    grouped = lines.withColumn("begins", begins).withColumn("g", F.sum("begins").over(w)).groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return grouped.select("file", F.col("l")[0]["n"].alias("n"), F.transform("l", lambda x: x["n"]).alias("numbers"), F.transform("l", lambda x: x["text"]).alias("parts"))


def page_variables(rest: Column) -> Column:
    """The $X=y pairs of a page header as a map; '@' is null, the last of a repeated key wins."""
    pairs = F.regexp_extract_all(rest, F.lit(r"\$([A-Z]=[^\s>])"), 1)
    return _last_wins(pairs)


def text_tags(text: Column) -> Column:
    return _last_wins(F.regexp_extract_all(text, F.lit(r"<@([A-Z]=[^>])>"), 1))


def _last_wins(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: F.substring(p, 1, 1)))
    value = lambda k: F.substring(F.element_at(F.filter(pairs, lambda p: F.substring(p, 1, 1) == k), -1), 3, 1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.nullif(value(k), F.lit("@"))))


def normalized(parts: Column) -> Column:
    """Wrapped lines unwrapped: a trailing and a leading '/' go, and the blanks around them."""
    piece = F.transform(parts, lambda p, i: F.when(i == 0, F.rtrim(p)).otherwise(F.rtrim(F.ltrim(F.regexp_replace(p, "^/", "")))))
    n = F.size(piece)
    joined = F.transform(piece, lambda p, i: F.when(i < n - 1, F.regexp_replace(p, "/$", "")).otherwise(p))
    return F.trim(F.array_join(joined, ""))


def section_name(code: Column) -> Column:
    name = F.lit(None).cast("string")
    for k, v in SECTIONS.items():
        name = F.when(code == k, v).otherwise(name)
    return F.when(code.isNotNull(), F.coalesce(name, F.concat(F.lit("unknown_"), code)))


def quire_number(code: Column) -> Column:
    return F.when(code.rlike("^[A-T]$"), F.ascii(code) - 64)


def parse(lines: DataFrame) -> DataFrame:
    """The records of lines (file, n, text): 33 columns of a record, `file` in place of its transcription."""
    rows = logical_lines(lines).withColumn("first", F.col("parts")[0])
    head = lines.where("n = 1").select("file", F.col("text").alias("file_header_original"))
    rows = rows.where("not startswith(first, '#') and first <> '' and not startswith(first, '/')")
    is_locus = F.col("first").rlike(LOCUS)
    is_page = ~is_locus & F.col("first").rlike(PAGE_HEADER)
    rows = rows.withColumn("kind", F.when(is_locus, "locus").when(is_page, "page"))
    w = Window.partitionBy("file").orderBy("n")
    page_row = F.col("kind") == "page"
    rows = rows.withColumns({
        "page_no": F.sum(F.when(page_row, 1).otherwise(0)).over(w),
        "page_header_original": F.last(F.when(page_row, F.col("first")), ignorenulls=True).over(w),
    }).where("kind = 'locus'")
    x = lambda i: _some(F.regexp_extract("first", LOCUS, i))
    rows = rows.withColumns({"folio": x(1), "line": x(2).cast("int"), "locator": x(3), "locus_subtype": x(4), "transcriber": x(5), "locus_raw": F.regexp_extract("first", LOCUS, 0)})
    rest = F.concat(F.array(F.ltrim(F.substr("first", F.length("locus_raw") + 1))), F.slice("parts", F.lit(2), F.size("parts")))
    rows = rows.withColumns({"texts": rest}).withColumns({"text_raw": F.array_join("texts", "\n"), "text_normalized": F.when(F.size("texts") > 1, normalized(F.col("texts"))).otherwise(F.trim(F.col("texts")[0]))})
    rows = rows.withColumns({"own_tags": text_tags(F.col("text_normalized")), "header_vars": page_variables(F.regexp_extract("page_header_original", PAGE_HEADER, 2)), "locus_type": F.substring("locus_subtype", 1, 1)})

    on_page = Window.partitionBy("file", "page_no").orderBy("n")
    upto, before = on_page.rowsBetween(Window.unboundedPreceding, 0), on_page.rowsBetween(Window.unboundedPreceding, -1)
    # a key may be set to null: '@' stands for that inside the window
    tag = {k: F.last(F.when(F.map_contains_key("own_tags", k), F.coalesce(F.col("own_tags")[k], F.lit("@"))), ignorenulls=True).over(upto) for k in _KEYS}
    in_text = F.col("locus_type") == "P"
    start, end = in_text & F.contains("text_normalized", F.lit("<%>")), in_text & F.contains("text_normalized", F.lit("<$>"))
    rows = rows.withColumns({"tag": F.struct(*[c.alias(k) for k, c in tag.items()]), "paragraph_start": start, "paragraph_end": end})
    begun, ended = F.last(F.when(F.col("paragraph_start"), F.col("n")), ignorenulls=True).over(upto), F.last(F.when(F.col("paragraph_end"), F.col("n")), ignorenulls=True).over(before)
    number = F.sum(F.col("paragraph_start").cast("int")).over(upto)
    rows = rows.withColumn("paragraph", F.when(in_text & begun.isNotNull() & (begun > F.coalesce(ended, F.lit(-1))), number).cast("int"))

    active = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col("tag")[k].alias("v")) for k in _KEYS]), lambda e: e["v"].isNotNull())
    tags = F.map_from_entries(F.transform(active, lambda e: F.struct(e["k"], F.nullif(e["v"], F.lit("@")))))
    kept = F.map_filter("header_vars", lambda k, v: ~F.map_contains_key("text_tags", k))
    rows = rows.withColumn("text_tags", tags).withColumn("page_vars", F.map_concat(kept, "text_tags")).join(head, "file")
    h = lambda i: _some(F.regexp_extract("file_header_original", FILE_HEADER, i))
    v = lambda k: F.col("page_vars")[k]
    page = lambda i: _some(F.regexp_extract("folio", r"^f(\d+)([rv])(\d*)$", i))
    return rows.select(
        "file", h(1).alias("ivtff_alphabet"), h(2).alias("ivtff_version"), h(3).alias("ivtff_options"), "file_header_original", "folio", quire_number(v("Q")).alias("quire"), v("L").alias("currier"),
        v("H").alias("scribe"), section_name(v("I")).alias("section"), F.expr("substring(locus_raw, 2, length(locus_raw) - 2)").alias("locus"), "locus_type", "paragraph", "line", "text_raw",
        "text_normalized", F.array_join("parts", "\n").alias("original"), F.col("parts").alias("original_lines"), F.col("n").alias("source_line_number"), F.col("numbers").alias("source_line_numbers"),
        "page_header_original", v("Q").alias("quire_code"), v("I").alias("section_code"), "locus_raw", "locus_subtype", "locator", "transcriber", page(1).cast("int").alias("physical_leaf"),
        page(2).alias("recto_verso"), page(3).cast("int").alias("foldout_panel"), "page_vars", "text_tags", "paragraph_start", "paragraph_end",
    )


def issues(lines: DataFrame) -> DataFrame:
    """(file, n, issue): what a strict reader refuses."""
    rows = logical_lines(lines).withColumn("first", F.col("parts")[0])
    w = Window.partitionBy("file").orderBy("n")
    page = F.when(~F.col("first").rlike(LOCUS), _some(F.regexp_extract("first", PAGE_HEADER, 1)))
    rows = rows.withColumn("page", F.last(page, ignorenulls=True).over(w)).withColumn("is_locus", F.col("first").rlike(LOCUS))
    own = F.regexp_extract("first", LOCUS, 1)
    issue = (
        F.when((F.col("n") == 1) & ~F.col("first").startswith("#=IVTFF"), "no file header").when(F.col("first").startswith("#") | (F.col("first") == ""), None).when(F.col("first").startswith("/"), "orphan continuation")
        .when(~F.col("is_locus") & ~F.col("first").rlike(PAGE_HEADER), "unrecognised line").when(F.col("is_locus") & F.col("page").isNull(), "line before any page").when(F.col("is_locus") & (own != F.col("page")), "line of another page")
    )
    plain = rows.select("file", "n", issue.alias("issue")).where("issue is not null")
    p = parse(lines).where("locus_type = 'P'")
    on = Window.partitionBy("file", "page_header_original").orderBy("source_line_number").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum(F.col("paragraph_start").cast("int") - F.col("paragraph_end").cast("int")).over(on), F.lit(0))
    nested = F.when(F.col("paragraph_start") & (open_before > 0), "nested paragraph start").when(F.col("paragraph_end") & ~F.col("paragraph_start") & (open_before <= 0), "paragraph end without start")
    return plain.unionByName(p.select("file", F.col("source_line_number").alias("n"), nested.alias("issue")).where("issue is not null"))


def parse_strict(lines: DataFrame) -> DataFrame:
    """parse, once no issue is found."""
    from foliant.operators.selection import enforce

    enforce(issues(lines).groupBy(F.col("issue").alias("check")).agg(F.count("*").alias("violations")), "transcription")
    return parse(lines)


def as_lines(loci: DataFrame) -> DataFrame:
    """(file, n, text): the files that records of loci came from, with their pages' headers put before the first
    record of a page."""
    last = loci.groupBy("record_id").agg(F.max_by(F.struct("transcription_id", "file_header_original", "page_header_original", "original_lines", "source_line_number"), "ingested_at").alias("r")).select("record_id", "r.*")
    w = Window.partitionBy("transcription_id").orderBy("source_line_number", "record_id")
    rows = last.withColumn("first", F.row_number().over(w) == 1).withColumn("turn", ~F.coalesce(F.lag("page_header_original").over(w) == F.col("page_header_original"), F.lit(False)))
    texts = F.concat(F.when(F.col("first"), F.array("file_header_original")).otherwise(F.array().cast("array<string>")), F.when(F.col("turn"), F.array("page_header_original")).otherwise(F.array().cast("array<string>")), "original_lines")
    each = rows.select("transcription_id", "source_line_number", "record_id", F.posexplode(texts).alias("k", "text"))
    number = F.row_number().over(Window.partitionBy("transcription_id").orderBy("source_line_number", "record_id", "k"))
    return each.select(F.col("transcription_id").alias("file"), number.alias("n"), "text")

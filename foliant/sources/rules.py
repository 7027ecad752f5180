"""Substitution rules of native alphabets to glyph codes, and conversion by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rules that conversion folds into one expression.
MOST_RULES = 2_000
_FIRST_PRIVATE, _GAP = 0xE000, chr(0xF8FF)
_CODE = r"[A-Z][1-9a-z]"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(target, source, ord) of a two-column rule file: comments and blank lines skipped, other shapes refused."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("ord", "line"))
    own = lines.where((F.col("ord") > 0) & (F.trim("line") != "") & ~F.trim("line").startswith("#") & ~F.contains("line", F.lit("(comment)"))).select("ord", F.split(F.trim("line"), r"\s+").alias("p"))
    ok = (F.size("p") == 2) & F.get("p", F.lit(0)).rlike(rf"^(?:{_CODE})+$")
    checked = own.select("ord", F.when(ok, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.array_join("p", " ")))).alias("p"))
    return checked.select(F.get("p", F.lit(0)).alias("target"), F.get("p", F.lit(1)).alias("source"), "ord")


def ordered(rules: DataFrame) -> list[tuple[str, str]]:
    """(source, target) in order of use: the longest source first, then as in the file. An ambiguous source is refused."""
    rows = sorted(rules.dropDuplicates(["source", "target", "ord"]).limit(MOST_RULES + 1).collect(), key=lambda r: (-len(r["source"]), r["ord"]))
    if len(rows) > MOST_RULES or len({r["source"] for r in rows}) < len({(r["source"], r["target"]) for r in rows}):
        raise ValueError("too many rules, or a source with two targets")
    return [(r["source"], r["target"]) for r in rows]


def first_alternatives(text: Column, strict: bool = False) -> Column:
    """The first reading of each '[a:b]', however deep they are nested: each pass resolves the innermost ones, and there are
    as many passes as brackets. strict: a bracket that is left over is an error when it is read."""
    passes = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("["), F.lit(""))))
    out = F.aggregate(passes, text, lambda t, _: F.regexp_replace(t, r"\[([^:\[\]]*):[^\[\]]*\]", "$1"))
    if not strict:
        return out
    return F.when(out.rlike(r"[\[\]]"), F.raise_error(F.concat(F.lit("unpaired bracket: "), text)).cast("string")).otherwise(out)


def checked_header(header: Column, alphabets: list[str]) -> Column:
    """A rule file's first line, if it names one of the alphabets as its source; else an error when it is read."""
    named = F.exists(F.array(*map(F.lit, alphabets)), lambda a: F.contains(header, a))
    return F.when(named, header).otherwise(F.raise_error(F.concat(F.lit("no rules for these alphabets: "), header)).cast("string"))


#: The rule file of each native alphabet.
RULE_FILES = {"Eva-": "STA-Eva_def.bit", "EvaT": "STA-EvaT_def.bit", "v101": "STA-v101_def.bit"}


def rule_file(alphabet: str, folder: str) -> str:
    """The path of an alphabet's rules; an unknown alphabet is an error."""
    if alphabet not in RULE_FILES:
        raise ValueError(f"no rules for alphabet {alphabet!r}, only for {', '.join(sorted(RULE_FILES))}")
    return f"{folder.rstrip('/')}/{RULE_FILES[alphabet]}"


def converted(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Native text as glyph codes: each rule replaces wherever it can, in order, and what it wrote is not read again
    (it stands as a private character until the end). '<…>' is left out; null where text stays unconverted."""
    # what stands on the two sides of a '<…>' is not read together
    t = F.regexp_replace(text, "<[^>]*>", _GAP)
    for i, (source, _) in enumerate(rules):
        t = F.replace(t, F.lit(source), F.lit(chr(_FIRST_PRIVATE + i)))
    whole = ~t.rlike(r"[^\x{E000}-\x{F8FF}.,\[\]: \t\r\n]")
    for i, (_, target) in enumerate(rules):
        t = F.replace(t, F.lit(chr(_FIRST_PRIVATE + i)), F.lit(target))
    return F.when(whole, F.regexp_replace(t, _GAP, ""))


def glyph_tokens(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Tokens of glyph codes: drawing gaps, '.', ',' and blanks part tokens, the first alternative stands."""
    t = first_alternatives(F.regexp_replace(F.regexp_replace(text, r"<[-~]>", "."), "<[^>]*>", ""))
    tokens = F.transform(F.split(t, r"[.,\s]+"), lambda w: F.regexp_extract_all(converted(w, rules), F.lit(f"({_CODE})"), 1))
    return F.filter(tokens, lambda g: F.size(g) > 0)


def glyph_stream(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All glyphs of a text in order, null where a token ends."""
    tokens = glyph_tokens(text, rules)
    none = F.array(F.lit(None).cast("string"))
    return F.flatten(F.transform(tokens, lambda t, i: F.when(i == 0, t).otherwise(F.concat(none, t))))


def glyph_count(codes: Column, collapse: bool = False) -> Column:
    """The number of glyph codes; with collapse, a run of unknown ones counts once."""
    text = F.regexp_replace(codes, "(?:Z1)+", "Z1") if collapse else codes
    return F.size(F.regexp_extract_all(text, F.lit(f"({_CODE})"), 1))


def semantic_count(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Glyphs where '???' is one unknown run, '??' two unknown glyphs; null beyond three or where unconverted."""
    t = first_alternatives(text)
    runs = F.regexp_extract_all(t, F.lit(r"(\?+)"), 1)
    rest = converted(F.regexp_replace(t, r"(?<!\?)\?{3}(?!\?)", "<>"), rules)
    return F.when(~F.exists(runs, lambda r: F.length(r) > 3), glyph_count(rest) + F.size(F.filter(runs, lambda r: F.length(r) == 3)))

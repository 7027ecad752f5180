"""Three transcriptions of a line against each other, and samples for people to look at.

Samples are small by definition; choices that go one by one work on the few candidates that can win, which are cut
down by windows first, and give what they would give over all candidates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import page_leaf, page_name
from foliant.operators.compare import markup
from foliant.operators.numbering import numbered_within
from foliant.operators.resample import draw
from foliant.session import written
from foliant.sources.rules import converted, first_alternatives

#: As many different symbols may two lines hold that are compared.
_SIGNS = "".join(chr(0x4E00 + i) for i in range(8192))


def comparable_text(records: DataFrame, rules: list[tuple[str, str]], text: str = "text_normalized") -> DataFrame:
    """records with `tokens` (arrays of glyph codes; null where the text stays unconverted), and the unknown glyphs, doubtful
    spaces and alternative readings of the native text."""
    plain = F.regexp_replace(first_alternatives(F.regexp_replace(text, r"<[-~]>", ".")), r"[{}]", "")
    codes = converted(plain, rules)
    tokens = F.filter(F.transform(F.split(codes, r"[.,\s]+"), lambda w: F.regexp_extract_all(w, F.lit(r"([A-Z][1-9a-z])"), 1)), lambda g: F.size(g) > 0)
    marks = markup(F.col(text))
    unknown = F.size(F.filter(F.flatten("tokens"), lambda g: g == "Z1"))
    return records.withColumn("tokens", tokens).withColumn("unknown", unknown).withColumn("doubtful_spaces", marks["uncertain_spaces"]).withColumn("alternatives", marks["alternative_readings"])


def similarity(a: Column, b: Column) -> Column:
    """1 less the edits between two arrays by the longer one's size, 1 for two empty ones. Items become single characters
    by their place among the pair's, so the JVM's levenshtein counts items."""
    names = F.array_distinct(F.concat(a, b))
    held = F.when(F.size(names) <= len(_SIGNS), names).otherwise(F.raise_error(F.lit("too many different items")).cast("array<string>"))
    spelled = lambda x: F.array_join(F.transform(x, lambda i: F.substr(F.lit(_SIGNS), F.array_position(held, i).cast("int"), F.lit(1))), "")
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(spelled(a), spelled(b)) / longest)


def three_way(lines: DataFrame, corpora: Sequence[str]) -> DataFrame:
    """lines (line_key, corpus, tokens, unknown, doubtful_spaces, alternatives), a row for each line and corpus; corpora: the
    primary one and two others. For each line that all three hold: whether pairs agree in glyphs and in tokens, how
    similar their glyphs are, whether the others agree against the primary one, which others support it, and the doubts
    marked in all three."""
    side = lambda k: F.max(F.when(F.col("corpus") == corpora[k], F.struct(F.lit(1).alias("there"), "tokens", "unknown", "doubtful_spaces", "alternatives")))
    by = lines.where(F.col("corpus").isin(*corpora)).groupBy("line_key").agg(*[side(k).alias(f"c{k}") for k in range(3)]).where("c0 is not null and c1 is not null and c2 is not null")
    glyphs = lambda k: F.flatten(F.col(f"c{k}.tokens"))
    rows = by
    for x, y in ((0, 1), (0, 2), (1, 2)):
        rows = rows.withColumn(f"glyphs_{x}{y}", glyphs(x).eqNullSafe(glyphs(y))).withColumn(f"tokens_{x}{y}", F.col(f"c{x}.tokens").eqNullSafe(F.col(f"c{y}.tokens")))
        rows = rows.withColumn(f"similar_{x}{y}", F.round(similarity(glyphs(x), glyphs(y)), 9))
        words = [F.transform(F.col(f"c{k}.tokens"), lambda t: F.array_join(t, "-")) for k in (x, y)]
        rows = rows.withColumn(f"alike_{x}{y}", F.round(similarity(*words), 9))
    doubts = sum((F.coalesce(F.col(f"c{k}.{c}"), F.lit(0)) for k in range(3) for c in ("unknown", "doubtful_spaces", "alternatives")), F.lit(0))
    least = F.least("similar_01", "similar_02", "similar_12")
    mean = (F.col("similar_01") + F.col("similar_02") + F.col("similar_12")) / 3
    against = lambda c: F.col(f"{c}_12") & ~F.col(f"{c}_01")
    rows = rows.withColumns({"doubts": doubts, "least_similarity": least, "mean_similarity": F.round(mean, 9), "glyphs_against": against("glyphs"), "tokens_against": against("tokens")})
    return rows.withColumn("supporters", F.col("tokens_01").cast("int") + F.col("tokens_02").cast("int")).drop("c0", "c1", "c2")


def classified(rows: DataFrame, low: float = 0.8, high: float = 0.95) -> DataFrame:
    """three_way rows with class, mandatory, priority and reason: the first class that applies."""
    far, doubts = 100.0 * (1.0 - F.col("least_similarity")), F.col("doubts")
    glyphs, tokens = (F.col(f"{c}_01") & F.col(f"{c}_02") & F.col(f"{c}_12") for c in ("glyphs", "tokens"))
    kind = lambda name, mandatory, priority, reason: F.struct(F.lit(name).alias("class"), F.lit(mandatory).alias("mandatory"), F.round(priority, 6).alias("priority"), F.lit(reason).alias("reason"))
    case = (
        F.when(F.col("tokens_against"), kind("others_agree_against_primary", True, 1000 + far + doubts, "the two others hold the same tokens, the primary one does not"))
        .when(F.col("glyphs_against"), kind("others_agree_on_glyphs_against_primary", True, 950 + far + doubts, "the two others hold the same glyphs, the primary one does not"))
        .when(F.col("least_similarity") < low, kind("low_agreement", False, 900 + far + doubts, "two of the three are less alike than the low threshold"))
        .when(glyphs & ~tokens, kind("boundaries_only", True, 850.0 + doubts, "all hold the same glyphs, parted otherwise"))
        .when(tokens & (doubts > 0), kind("exact_with_doubts", False, 40.0 + doubts, "all agree, with doubts marked"))
        .when(tokens, kind("exact", False, F.lit(0.0), "all agree"))
        .when(F.col("least_similarity") < high, kind("moderate_agreement", False, 650 + far + doubts, "two of the three are less alike than the high threshold"))
        .when(F.col("supporters") == 1, kind("primary_supported_by_one", False, 350 + far + doubts, "one other agrees with the primary one"))
        .otherwise(kind("high_but_not_exact", False, 450 + far + doubts, "all are much alike, none agrees with the primary one"))
    )
    return rows.withColumn("__k", case).select("*", "__k.*").drop("__k")


def recommended(rows: DataFrame, target: int, controls: int, per_page: int) -> DataFrame:
    """(review_rank, role, rows…): every mandatory row of rows (line_key, page, place, mandatory, exact, priority); then the
    highest of the other disagreements up to `target` in all, first with at most per_page of a page (mandatory ones
    count), then without that bound; then `controls` lines that all agree on, from pages not yet there where possible."""
    order = "priority desc, place, line_key"
    rows = written(rows, "reviewed")
    must = rows.where("mandatory")
    need = max(0, target - must.count())
    used = must.groupBy("page").agg(F.count("*").alias("__used"))
    rest = rows.where("not mandatory and not exact")
    ranked = rest.withColumn("__r", F.expr(f"row_number() over (partition by page order by {order})")).join(used, "page", "left")
    first = ranked.where(F.col("__r") + F.coalesce("__used", F.lit(0)) <= per_page).orderBy(F.desc("priority"), "place", "line_key").limit(need).select(rows.columns)
    fill = rest.join(first.select("line_key"), "line_key", "left_anti").orderBy(F.desc("priority"), "place", "line_key").limit(max(0, need - first.count()))
    chosen = must.withColumn("role", F.lit("mandatory")).withColumn("__step", F.lit(0))
    for df, step in ((first, 1), (fill, 2)):
        chosen = chosen.unionByName(df.withColumn("role", F.lit("disagreement")).withColumn("__step", F.lit(step)))
    agreed = rows.where("exact and not mandatory")
    own = agreed.withColumn("__r", F.expr("row_number() over (partition by page order by place, line_key)")).where("__r = 1").join(chosen.select("page").distinct(), "page", "left_anti")
    fresh = own.orderBy("place", "line_key").limit(controls).select(rows.columns)
    more = agreed.join(fresh.select("line_key"), "line_key", "left_anti").orderBy("place", "line_key").limit(max(0, controls - fresh.count()))
    for df, step in ((fresh, 3), (more, 4)):
        chosen = chosen.unionByName(df.withColumn("role", F.lit("control")).withColumn("__step", F.lit(step)))
    by = "case when __step < 3 then -priority else 0 end, place, line_key"
    return chosen.withColumn("review_rank", F.expr(f"row_number() over (order by __step, {by})")).drop("__step")  # a sample


#: What a new value of each field is worth.
FIELD_WORTH = {"section": 8, "scribe": 5, "currier": 3, "locus_type": 2}


def diverse_lines(lines: DataFrame, size: int, seed: int = 0, worth: Mapping[str, int] = FIELD_WORTH) -> list[str]:
    """`size` lines (line_key, fields of worth) that together show the most field values: one after another the line whose
    new values are worth most, ties by a drawn place. Of lines with the same values only the first `size` in drawn order
    can be chosen, so only these reach the driver."""
    fields = [F.coalesce(F.col(f).cast("string"), F.lit("UNSET")).alias(f) for f in worth]
    drawn = lines.select("line_key", *fields, (draw(F.lit(seed), "line_key") / F.lit(2.0**32)).alias("at"))
    few = drawn.withColumn("r", F.expr(f"row_number() over (partition by {', '.join(worth)} order by at, line_key)")).where(F.col("r") <= size)
    rows = sorted(few.collect(), key=lambda r: (r["at"], r["line_key"]))
    if len(rows) < size:
        raise ValueError(f"{size} lines are asked for, {len(rows)} are there")
    seen: dict[str, set] = {f: set() for f in worth}
    chosen: list[str] = []
    left = list(rows)
    for _ in range(size):
        best = max(left, key=lambda r: (sum(w * (r[f] not in seen[f]) for f, w in worth.items()) - r["at"], -left.index(r)))
        left.remove(best)
        chosen.append(best["line_key"])
        for f in worth:
            seen[f].add(best[f])
    return chosen


def shared_lines(lines: DataFrame, corpora: Sequence[str]) -> DataFrame:
    """(line_key) of lines that every one of the corpora holds."""
    n = lines.where(F.col("corpus").isin(*corpora)).groupBy("line_key").agg(F.count_distinct("corpus").alias("n"))
    return n.where(F.col("n") == len(corpora)).select("line_key")


#: What signs of doubt count for.
MARK_WEIGHTS = {"uncertain_spaces": 1, "alternative_readings": 2, "unknown_marks": 2, "drawing_interruptions": 1}


def markup_score(text: Column) -> Column:
    m = markup(text)
    return sum((m[k] * w for k, w in MARK_WEIGHTS.items()), F.lit(0))


#: What a feature of each sort counts for, by the root of how many pages have it.
FEATURE_WEIGHTS = {"markup": 4.0, "side": 4.0, "profile": 2.0, "scribe": 3.0, "section": 3.0, "currier": 2.5}


def page_candidates(records: DataFrame, text: str = "text_normalized") -> DataFrame:
    """(page, leaf_group, lines, richness, features): each page with the values of its records' fields, the signs of doubt
    it shows, and its side as features sort:value."""
    m = markup(F.col(text))
    own = records.select(page_name(F.col("folio")).alias("page"), page_leaf(F.col("folio")).alias("leaf"), *[F.coalesce(F.col(c).cast("string"), F.lit("UNSET")).alias(c) for c in ("currier", "scribe", "section", "locus_type")], *[m[k].alias(k) for k in MARK_WEIGHTS])
    fields = ("currier", "scribe", "section", "locus_type")
    by = own.where("page is not null").groupBy("page").agg(F.max("leaf").alias("leaf"), F.count("*").alias("lines"), *[F.array_sort(F.collect_set(c)).alias(c) for c in fields], *[F.sum(k).alias(k) for k in MARK_WEIGHTS])

    def named(c: str) -> Column:
        return F.transform(c, lambda v: F.concat(F.lit("type:" if c == "locus_type" else f"{c}:"), v))

    side = F.array(F.concat(F.lit("side:"), F.coalesce(F.nullif(F.regexp_extract("page", r"^f\d+([rv])", 1), F.lit("")), F.lit("none"))))
    profile = F.array(F.concat(F.lit("profile:"), F.array_join("section", "+"), F.lit("|"), F.array_join("currier", "+"), F.lit("|"), F.array_join("scribe", "+")))
    signs = F.filter(F.array(*[F.when(F.col(k) > 0, F.lit(f"markup:{k}")) for k in MARK_WEIGHTS]), lambda x: x.isNotNull())
    features = F.array_sort(F.concat(*map(named, fields), side, profile, signs))
    richness = sum((F.col(k) * w for k, w in MARK_WEIGHTS.items()), F.lit(0))
    group = F.coalesce(F.concat(F.lit("f"), F.col("leaf").cast("string")), F.col("page"))
    return by.select("page", group.alias("leaf_group"), "lines", richness.alias("richness"), features.alias("features"))


def feature_weights(candidates: DataFrame) -> DataFrame:
    """(feature, pages, weight): rare features count for more."""
    n = candidates.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("pages"))
    sort = F.split("feature", ":")[0]
    worth = F.coalesce(*[F.when(sort == k, F.lit(v)) for k, v in FEATURE_WEIGHTS.items()], F.lit(1.0))
    return n.withColumn("weight", F.round(worth / F.sqrt("pages"), 9))


def representative_pages(candidates: DataFrame, size: int, per_group: int, seed: int = 0) -> list[str]:
    """`size` pages, one after another the one whose new features weigh most, with a little for signs of doubt and lines, at
    most per_group of a leaf group; ties by richness, lines and a drawn number. Of pages with the same features only
    the best per_group of a group, and of these the best `size`, can be chosen; only these reach the driver."""
    bonus = F.log1p("richness") * 0.08 + F.log1p("lines") * 0.02
    drawn = candidates.withColumn("bonus", F.round(bonus, 12)).withColumn("key", F.array_join("features", ",")).withColumn("d", draw(F.lit(seed), "page"))
    order = "bonus desc, richness desc, lines desc, d desc, page"
    few = drawn.withColumn("r", F.expr(f"row_number() over (partition by key, leaf_group order by {order})")).where(F.col("r") <= per_group)
    few = few.withColumn("r", F.expr(f"row_number() over (partition by key order by {order})")).where(F.col("r") <= size)
    rows = few.collect()
    weights = {r["feature"]: r["weight"] for r in feature_weights(candidates).collect()}  # labels
    covered: set[str] = set()
    taken: dict[str, int] = {}
    chosen: list[str] = []
    left = list(rows)
    for _ in range(size):
        able = [r for r in left if taken.get(r["leaf_group"], 0) < per_group]
        if not able:
            raise ValueError(f"fewer than {size} pages with at most {per_group} of a leaf group")
        best = max(able, key=lambda r: (round(sum(weights[f] for f in r["features"] if f not in covered) + r["bonus"], 9), r["richness"], r["lines"], r["d"], r["page"]))
        left.remove(best)
        chosen.append(best["page"])
        covered.update(best["features"])
        taken[best["leaf_group"]] = taken.get(best["leaf_group"], 0) + 1
    return chosen


def representative_lines(records: DataFrame, limit: int, text: str = "text_normalized") -> DataFrame:
    """(page, place, record_id, …): of each page the first, middle, last and richest line, and lines evenly spaced until
    there are `limit`, or all. Lines are numbered in parts, so a page may be of any size."""
    rows = records.where("line is not null").withColumn("page", page_name(F.col("folio"))).withColumn("score", markup_score(F.col(text)))
    placed = numbered_within(rows, "page", ("line", "source_line_number", "locus", "record_id"), "place")
    facts = placed.groupBy("page").agg(F.count("*").alias("n"), F.max_by("place", F.struct(F.col("score"), -F.col("place"))).alias("richest"))
    base = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 1, F.col("richest")))
    spread = F.when(F.col("n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(max(1, limit - 1)), 0).cast("long")))
    want = F.least(F.lit(limit), F.col("n"))
    extra = F.slice(F.array_except(spread, base), F.lit(1), F.greatest(want - F.size(base), F.lit(0)).cast("int"))
    places = F.slice(F.array_sort(F.concat(base, extra)), 1, limit)
    chosen = facts.select("page", F.explode(places).alias("place"))
    return placed.join(chosen, ["page", "place"]).drop("score")


def review_verdict(pages: DataFrame, lines: DataFrame, status: str = "status") -> DataFrame:
    """One row of the reviews of pages and lines: whether all have a status, how many report a fault of the pipeline or stay
    open, and the verdict."""
    given = lambda df: df.select(F.nullif(F.trim(F.coalesce(F.col(status), F.lit(""))), F.lit("")).alias("s"))
    both = given(pages).unionByName(given(lines))
    s = both.agg(F.count("*").alias("rows"), F.count_if(F.col("s").isNull()).alias("blank"), F.count_if(F.col("s") == "PARSER_OR_ALIGNMENT_ISSUE").alias("faults"), F.count_if(F.col("s") == "UNRESOLVED").alias("unresolved"))
    verdict = F.when(F.col("blank") > 0, "INCOMPLETE").when(F.col("faults") > 0, "FAIL").when(F.col("unresolved") > 0, "INCOMPLETE_UNRESOLVED").otherwise("PASS")
    return s.withColumn("verdict", verdict)


def qc_summary(reports: DataFrame) -> DataFrame:
    """One row of reports (status): corpora, how many pass, pass with a limitation and mismatch, and the whole's status."""
    s = reports.agg(F.count("*").alias("corpora"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "PASS WITH LIMITATION").alias("limited"), F.count_if(F.col("status") == "MISMATCH").alias("mismatched"))
    return s.withColumn("overall", F.when(F.col("mismatched") > 0, "MISMATCH").otherwise("PASS"))

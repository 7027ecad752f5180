"""Analytical lines as token, glyph and window rows, and the statistics over them.

Lines come from analytical_loci (or any frame with its columns); a line delivered twice counts once. Null and
empty glyphs are skipped, tokens without glyphs too. The unknown glyph stays in lengths and frequencies, and
takes no part in entropies, windows and positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Z1"
UNSET = "UNSET"
_META = ("folio", "physical_leaf", "section", "currier", "scribe", "locus", "locus_type", "paragraph", "line", "source_line_number")


def clean_tokens(tokens: Column) -> Column:
    glyphs = F.transform(tokens, lambda t: F.filter(t, lambda g: g.isNotNull() & (g != "")))
    return F.filter(glyphs, lambda t: F.size(t) > 0)


def analytical_lines(analytical: DataFrame) -> DataFrame:
    """One row a line: record_id, metadata (null as UNSET in the labels), tokens."""
    last = analytical.groupBy("record_id").agg(F.max_by(F.struct(*_META, "tokens"), "built_at").alias("r")).select("record_id", "r.*")
    labels = {c: F.coalesce(c, F.lit(UNSET)) for c in ("section", "currier", "scribe")}
    return last.withColumns(labels).withColumn("tokens", clean_tokens(F.col("tokens")))


def lines_of_records(records: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Lines as analytical_lines has them, from records of native text and the rules of its alphabet: drawing gaps, stops and
    blanks part tokens, braces go, the first of alternative readings stands. A word that stays unconverted is an
    unreadable token."""
    from foliant.functions.text import plain_text
    from foliant.sources.rules import converted

    words = F.filter(F.split(plain_text(F.col("text_normalized")), " "), lambda w: w != "")
    codes = F.transform(words, lambda w: F.coalesce(F.regexp_extract_all(converted(w, rules), F.lit(r"([A-Z][1-9a-z])"), 1), F.array(F.lit(UNKNOWN))))
    labels = {c: F.coalesce(c, F.lit(UNSET)) for c in ("section", "currier", "scribe")}
    return records.select("record_id", *_META, clean_tokens(codes).alias("tokens")).withColumns(labels)


def tokens(lines: DataFrame, *keep: str) -> DataFrame:
    """(record_id, keep…, token_index, glyphs, tok): tok joins the glyphs by U+001F, so it is one-to-one."""
    each = lines.select("record_id", *keep, F.posexplode("tokens").alias("token_index", "glyphs"))
    return each.withColumn("tok", F.array_join("glyphs", "\x1f"))


def readable(glyphs: Column) -> Column:
    return ~F.array_contains(glyphs, UNKNOWN)


def glyphs(lines: DataFrame, *keep: str) -> DataFrame:
    """(record_id, keep…, token_index, glyph_index, glyph)."""
    return tokens(lines, *keep).select("record_id", *keep, "token_index", F.posexplode("glyphs").alias("glyph_index", "glyph"))


def windows(sequence: Column, length: int) -> Column:
    """Every run of `length` items of an array."""
    starts = F.when(F.size(sequence) >= length, F.sequence(F.lit(1), F.size(sequence) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(sequence, i, F.lit(length)))


def _xlogx(c: str) -> Column:
    return F.col(c) * F.log2(c)


def entropy(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """(keys, observations, states, entropy_bits) of count rows; 0 bits for a single state."""
    total = F.sum(n)
    return counts.groupBy(*keys).agg(total.alias("observations"), F.count("*").alias("states"), F.round(F.log2(total) - F.sum(_xlogx(n)) / total, 6).alias("entropy_bits"))


def window_counts(lines: DataFrame, length: int, *keys: str) -> DataFrame:
    """(keys, window, n): readable windows of glyphs within tokens."""
    w = tokens(lines, *keys).select(*keys, F.explode(windows(F.col("glyphs"), length)).alias("window")).where(readable(F.col("window")))
    return w.groupBy(*keys, "window").agg(F.count("*").alias("n"))


def conditional_entropy(lines: DataFrame, order: int, *keys: str) -> DataFrame:
    """H(next glyph | previous `order` glyphs) within tokens, with its unweighted mean over contexts."""
    n = window_counts(lines, order + 1, *keys).withColumn("context", F.slice("window", 1, order))
    by_context = n.groupBy(*keys, "context").agg(F.sum("n").alias("c"), F.sum(_xlogx("n")).alias("x"))
    total = F.sum("c")
    return by_context.groupBy(*keys).agg(
        total.alias("observations"), F.count("*").alias("contexts"), F.round(F.sum(_xlogx("c") - F.col("x")) / total, 6).alias("entropy_bits"),
        F.round(F.avg(F.log2("c") - F.col("x") / F.col("c")), 6).alias("branching_bits"),
    ).withColumn("order", F.lit(order))


def mutual_information(pairs: DataFrame, key: str) -> DataFrame:
    """(key, pairs, left_states, right_states, mi_bits) of rows (key, a, b); the marginals are the pairs' own."""
    joint = pairs.groupBy(key, "a", "b").agg(F.count("*").alias("n"))
    j = joint.groupBy(key).agg(F.sum("n").alias("pairs"), F.sum(_xlogx("n")).alias("jx"))
    left = joint.groupBy(key, "a").agg(F.sum("n").alias("n")).groupBy(key).agg(F.count("*").alias("left_states"), F.sum(_xlogx("n")).alias("lx"))
    right = joint.groupBy(key, "b").agg(F.sum("n").alias("n")).groupBy(key).agg(F.count("*").alias("right_states"), F.sum(_xlogx("n")).alias("rx"))
    mi = F.log2("pairs") + (F.col("jx") - F.col("lx") - F.col("rx")) / F.col("pairs")
    return j.join(left, key).join(right, key).select(key, "pairs", "left_states", "right_states", (F.round(mi, 6) + 0.0).alias("mi_bits"))


def glyph_pairs(lines: DataFrame, most: int) -> DataFrame:
    """(distance, a, b): readable glyphs up to `most` apart within a token."""
    def at(d: int) -> Column:
        starts = F.when(F.size("glyphs") > d, F.sequence(F.lit(1), F.size("glyphs") - d)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(d).alias("distance"), F.element_at("glyphs", i).alias("a"), F.element_at("glyphs", i + d).alias("b")))

    t = tokens(lines).select(F.inline(F.flatten(F.array(*[at(d) for d in range(1, most + 1)]))))
    return t.where((F.col("a") != UNKNOWN) & (F.col("b") != UNKNOWN))


def token_pairs(lines: DataFrame, most: int) -> DataFrame:
    """(distance, a, b): readable tokens up to `most` apart within a line."""
    t = lines.select(F.transform("tokens", lambda x: F.struct(F.array_join(x, "\x1f").alias("tok"), readable(x).alias("ok"))).alias("t"))

    def at(d: int) -> Column:
        starts = F.when(F.size("t") > d, F.sequence(F.lit(1), F.size("t") - d)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(d).alias("distance"), F.element_at("t", i).alias("x"), F.element_at("t", i + d).alias("y")))

    p = t.select(F.inline(F.flatten(F.array(*[at(d) for d in range(1, most + 1)]))))
    return p.where("x.ok and y.ok").select("distance", F.col("x.tok").alias("a"), F.col("y.tok").alias("b"))


def glyph_positions(lines: DataFrame) -> DataFrame:
    """(position, item, n): first, middle and last glyphs of tokens, once unknown ones are dropped; the glyph of
    a token of one is first and last."""
    known = F.filter("glyphs", lambda g: g != UNKNOWN)
    t = tokens(lines).select(known.alias("g")).where("size(g) > 0")
    middle = F.when(F.size("g") > 2, F.slice("g", 2, F.size("g") - 2)).otherwise(F.array().cast("array<string>"))
    at = lambda p, g: F.transform(g, lambda x: F.struct(F.lit(p).alias("position"), x.alias("item")))
    rows = t.select(F.inline(F.concat(at("initial", F.slice("g", 1, 1)), at("medial", middle), at("final", F.slice("g", -1, 1)))))
    return rows.groupBy("position", "item").agg(F.count("*").alias("n"))


def token_positions(lines: DataFrame) -> DataFrame:
    """(position, item, n): first, middle and last readable tokens of lines."""
    known = F.filter("tokens", readable)
    t = lines.select(F.transform(known, lambda x: F.array_join(x, "\x1f")).alias("g")).where("size(g) > 0")
    middle = F.when(F.size("g") > 2, F.slice("g", 2, F.size("g") - 2)).otherwise(F.array().cast("array<string>"))
    at = lambda p, g: F.transform(g, lambda x: F.struct(F.lit(p).alias("position"), x.alias("item")))
    rows = t.select(F.inline(F.concat(at("initial", F.slice("g", 1, 1)), at("medial", middle), at("final", F.slice("g", -1, 1)))))
    return rows.groupBy("position", "item").agg(F.count("*").alias("n"))


def divergences(counts: DataFrame, label: str, item: str = "item") -> DataFrame:
    """(a, b, jsd_bits) of every two labels (few) of rows (label, item, n): Jensen-Shannon divergence in bits."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(_by(label))).select(F.col(label).alias("l"), F.col(item).alias("i"), "p")
    labels = p.select("l").distinct()
    pairs = labels.select(F.col("l").alias("a")).join(labels.select(F.col("l").alias("b")), F.col("a") < F.col("b"))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("l")).join(p, "l")
    mixed = sides.groupBy("a", "b", "i").agg((F.sum("p") / 2).alias("m"), F.sum(_xlogx("p")).alias("x"))
    return mixed.groupBy("a", "b").agg((F.round(F.greatest(F.lit(0.0), F.sum(F.col("x") / 2 - _xlogx("m"))), 6) + 0.0).alias("jsd_bits"))


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def length_statistics(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, max, mean and linear-interpolated quantiles."""
    q = F.percentile(value, [0.25, 0.5, 0.75, 0.95])
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), q.alias("q"))
    names = ("p25", "median", "p75", "p95")
    return out.select(*keys, "n", "min", "max", "mean", *[F.round(F.get("q", F.lit(i)), 6).alias(x) for i, x in enumerate(names)])


def ranked_tokens(lines: DataFrame, top: int) -> DataFrame:
    """(tok, glyphs, n, rank): the most frequent readable tokens, ties by tok."""
    n = tokens(lines).where(readable(F.col("glyphs"))).groupBy("tok").agg(F.count("*").alias("n"), F.first("glyphs").alias("glyphs"))
    best = n.orderBy(F.desc("n"), "tok").limit(top)
    # `top` rows, so one task may number them
    return best.withColumn("rank", F.expr("row_number() over (order by n desc, tok)"))


def edit_neighbourhoods(lines: DataFrame, top: int = 300, cutoff: int = 2) -> DataFrame:
    """(a, b, distance): pairs of the top tokens at most `cutoff` glyph edits apart. Glyphs become single
    characters first, so the JVM's levenshtein counts glyphs."""
    best = ranked_tokens(lines, top)
    each = best.select("tok", "rank", F.posexplode("glyphs").alias("pos", "glyph"))
    code = each.select("glyph").distinct().withColumn("c", F.expr("decode(unhex(lpad(hex(19968 + row_number() over (order by glyph)), 4, '0')), 'UTF-16BE')"))
    spelled = each.join(F.broadcast(code), "glyph").groupBy("tok", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("s"))
    a, b = (spelled.select(F.col("tok").alias(x), F.col("rank").alias(f"r_{x}"), F.col("s").alias(f"s_{x}"), F.length("s").alias(f"l_{x}")) for x in "ab")
    near = a.join(F.broadcast(b), (F.abs(F.col("l_a") - F.col("l_b")) <= cutoff) & (F.col("r_a") < F.col("r_b")))  # top rows each
    return near.select("a", "b", F.levenshtein("s_a", "s_b", cutoff).alias("distance")).where("distance > 0")


def paragraph_tokens(lines: DataFrame) -> DataFrame:
    """(folio, paragraph, lines, tokens): a paragraph's tokens in the order of its lines."""
    own = lines.where("paragraph is not null").groupBy("folio", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "source_line_number", "record_id", "tokens"))).alias("l"))
    return own.select("folio", "paragraph", F.size("l").alias("lines"), F.flatten(F.transform("l", lambda x: x["tokens"])).alias("tokens"))


def segments(lines: DataFrame, *keep: str) -> DataFrame:
    """(record_id, keep…, segment, tokens): a token with an unknown glyph ends a segment and is dropped."""
    t = tokens(lines, *keep).withColumn("break", (~readable(F.col("glyphs"))).cast("int"))
    t = t.withColumn("part", F.sum("break").over(_by("record_id").orderBy("token_index"))).where("break = 0")
    own = t.groupBy("record_id", *keep, "part").agg(F.array_sort(F.collect_list(F.struct("token_index", "tok"))).alias("t"))
    number = F.expr("row_number() over (partition by record_id order by part) - 1")
    return own.select("record_id", *keep, number.alias("segment"), F.transform("t", lambda x: x["tok"]).alias("tokens"))


def corpus_measures(lines: DataFrame, *keys: str) -> DataFrame:
    """Type-token figures: tokens, types, type_token_ratio, hapax_ratio, top_share."""
    n = tokens(lines, *keys).groupBy(*keys, "tok").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return n.groupBy(*keys).agg(
        total.alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / total, 6).alias("type_token_ratio"),
        F.round(F.count_if(F.col("n") == 1) / F.count("*"), 6).alias("hapax_ratio"), F.round(F.max("n") / total, 6).alias("top_share"),
    )

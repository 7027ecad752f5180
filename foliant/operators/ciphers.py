"""Control texts: reversible ciphers of plain words, whose every choice is a SHA-256 draw, so that a run can be
repeated on any engine and partitioning. Words are (line, token, word); a cipher word is an array of glyphs.

Keys are small (an alphabet, a word list): they are checked, then folded into the plan as one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import plain_text
from foliant.operators.numbering import numbered_within
from foliant.operators.resample import draw

#: The most characters of an alphabet, and words of a code book, that a key may have.
MOST_KEYS = 10_000
CYCLE, COLUMNS = 16, 4
FAMILIES = ("mono", "homophonic", "verbose", "nulls", "nomenclator", "transposition", "syllabic")
VARIANTS = ("iid", "affix", "recurrence", "shuffled")


def plain_words(loci: DataFrame) -> DataFrame:
    """(line, token, word) of records' plain texts."""
    last = loci.groupBy("record_id").agg(F.max_by("text_normalized", F.struct("ingested_at", "text_normalized")).alias("t"))
    words = F.filter(F.split(plain_text(F.col("t")), " "), lambda w: w != "")
    return last.select(F.col("record_id").alias("line"), F.posexplode(words).alias("token", "word"))


def _characters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _key(items: DataFrame, seed: int) -> DataFrame:
    """One row: maps of each item to its number by hash, and back."""
    own = items.select(F.col(items.columns[0]).alias("x")).distinct().limit(MOST_KEYS + 1)
    ranked = own.withColumn("r", F.expr(f"row_number() over (order by sha2(concat_ws('|', '{seed}', x), 256), x) - 1"))  # MOST_KEYS rows
    pairs = ranked.agg(F.collect_list(F.struct("x", "r")).alias("p"))
    checked = F.when(F.size("p") <= MOST_KEYS, F.col("p")).otherwise(F.raise_error(F.lit("the key is too large")))
    back = F.map_from_entries(F.transform("p", lambda e: F.struct(e["r"], e["x"])))
    return pairs.withColumn("p", checked).select(F.map_from_entries("p").alias("number"), back.alias("item"))


def alphabet_key(words: DataFrame, seed: int) -> DataFrame:
    return _key(words.select(F.explode(_characters(F.col("word"))).alias("c")), seed)


def glyph(prefix: str, number: Column) -> Column:
    """The prefix and the number, in four digits or as many as it takes."""
    # the number is named once: it may hold a draw
    return F.regexp_replace(F.concat(F.lit(prefix + "000"), number.cast("string")), rf"^({re.escape(prefix)})0+(?=\d{{4}}$|[1-9]\d{{4,}}$)", "$1")


def number_of(g: Column) -> Column:
    return F.substring(g, 2, 10).cast("int")


def top_words(words: DataFrame, most: int) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")


def top_pairs(words: DataFrame, most: int, least: int = 3) -> list[str]:
    """The most frequent pairs of characters within words."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.substr("word", i, F.lit(2)))
    n = words.select(F.explode(at).alias("pair")).where("length(pair) = 2").groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r["pair"] for r in n.orderBy(F.desc("n"), "pair").limit(most).collect()]


def _spelled(times: int, f) -> Column:
    """What f makes of each number of a key's row, and of up to `times` as many: spelled once, not for each character."""
    return F.transform(F.sequence(F.lit(0), F.size("number") * times), f)


def encoded(words: DataFrame, family: str, seed: int = 0, key: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((line, token, word, cipher), the key's one row). key: the words' alphabet_key by this seed, if it is there already;
    a syllabic cipher has a key of its own."""
    if family == "transposition":
        return _transposed(words, seed, key)
    if family == "syllabic":
        # leftmost pairs first, else one character
        units = "|".join([*map(re.escape, top_pairs(words, 16)), "(?s:.)"])
        cut = F.regexp_extract_all("word", F.lit(f"({units})"), 1)
        key = _key(words.select(F.explode(cut).alias("c")), seed)
        rows = words.join(F.broadcast(key.withColumn("spelled", _spelled(1, lambda r: glyph("G", r)))))
        return rows.select("line", "token", "word", F.transform(cut, lambda u: F.get("spelled", F.col("number")[u])).alias("cipher")), key
    key = alphabet_key(words, seed) if key is None else key
    pair = lambda r: F.array(glyph("A", F.floor(r / 16)), glyph("B", r % 16))
    spelled = _spelled(1, pair) if family == "verbose" else _spelled(3, lambda r: glyph("G", r))
    rows = words.join(F.broadcast(key.withColumn("spelled", spelled)))
    chars, n = _characters(F.col("word")), lambda c: F.col("number")[c]
    mono = F.transform(chars, lambda c: F.get("spelled", n(c)))
    at = lambda i, what: draw(F.lit(seed), F.lit(what), "line", "token", i)
    if family == "mono":
        cipher = mono
    elif family == "homophonic":
        cipher = F.transform(chars, lambda c, i: F.get("spelled", (n(c) * 3 + at(i, "homophone") % 3).cast("int")))
    elif family == "verbose":
        cipher = F.flatten(F.transform(chars, lambda c: F.get("spelled", n(c))))
    elif family == "nulls":
        none = F.array().cast("array<string>")
        cipher = F.flatten(F.transform(mono, lambda g, i: F.concat(F.array(g), F.when(at(i, "null") % 10 < 2, F.array(glyph("N", at(i, "which") % 4))).otherwise(none))))
    elif family == "nomenclator":
        book = _key(top_words(words, 64), seed + 1).toDF("code", "coded")
        rows = rows.join(F.broadcast(book))
        key = key.join(book.drop("code"))
        cipher = F.when(F.map_contains_key("code", F.col("word")), F.array(glyph("W", F.col("code")[F.col("word")]))).otherwise(mono)
    else:
        raise ValueError(family)
    return rows.select("line", "token", "word", cipher.alias("cipher")), key


def decoded(cipher: DataFrame, key: DataFrame, family: str, *keep: str) -> DataFrame:
    """(line, token, keep…, restored) of cipher words (line, token, keep…, cipher)."""
    if family == "transposition":
        return _restored(cipher, key, *keep)
    items = F.transform(F.sort_array(F.map_entries("item")), lambda e: e["value"])  # numbers begin with 0: places of an array
    rows = cipher.join(F.broadcast(key.withColumn("item", items)))
    item = lambda number: F.get("item", number.cast("int"))
    each = lambda g, f: F.array_join(F.transform(g, f), "")
    c = F.col("cipher")
    if family == "homophonic":
        word = each(c, lambda g: item(F.floor(number_of(g) / 3).cast("int")))
    elif family == "verbose":
        at = F.sequence(F.lit(1), F.size(c) - 1, F.lit(2))
        word = each(at, lambda i: item(number_of(F.element_at(c, i)) * 16 + number_of(F.element_at(c, i + 1))))
    elif family == "nulls":
        word = each(F.filter(c, lambda g: ~g.startswith("N")), lambda g: item(number_of(g)))
    elif family == "nomenclator":
        word = each(c, lambda g: F.when(g.startswith("W"), F.col("coded")[number_of(g)]).otherwise(item(number_of(g))))
    else:
        word = each(c, lambda g: item(number_of(g)))
    return rows.select("line", "token", *keep, word.alias("restored"))


def _columns(n: Column, seed: int) -> list[tuple[int, Column, Column]]:
    """(column, its length, how many places are read out before it) of a line of n places, in the order of reading."""
    rank = sorted(range(COLUMNS), key=lambda k: (k * 7 + seed * 3) % COLUMNS)
    out, before = [], F.lit(0)
    for c in sorted(range(COLUMNS), key=lambda k: rank[k]):
        size = F.floor((n + (COLUMNS - 1 - c)) / COLUMNS).cast("int")
        out.append((c, size, before))
        before = before + size
    return out


def _order(n: Column, seed: int) -> Column:
    """Places of a line in the order in which its columns are read out."""
    none = F.array().cast("array<int>")
    return F.flatten(F.array(*[F.when(n > c, F.sequence(F.lit(c), n - 1, F.lit(COLUMNS))).otherwise(none) for c, _, _ in _columns(n, seed)]))


def _before(n: Column, seed: int) -> Column:
    """By column: how many places are read out before it."""
    return F.array(*[before for _, _, before in sorted(_columns(n, seed), key=lambda x: x[0])])


def _once(value: Column, f) -> Column:
    """f(value), where f names it within a lambda: else the planner may put its whole expression there, to run each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lengths(flat: Column, sizes: Column) -> Column:
    """A flat array cut into pieces of the given sizes."""
    upto = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    ends = F.arrays_zip(sizes.alias("s"), upto.alias("e"))
    return _once(flat, lambda own: F.transform(ends, lambda z: F.slice(own, z["e"] - z["s"] + 1, z["s"])))


def _by_line(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """(line, tokens: the line's (token, keep…) in order, l: the column's values in that order)."""
    own = rows.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("token", *keep, column))).alias("l"))
    return own.select("line", F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in ("token", *keep)])).alias("tokens"), F.transform("l", lambda x: x[column]).alias("l"))


def _by_token(lines: DataFrame, *keep: str) -> DataFrame:
    """(line, token, keep…, cipher) of lines (line, tokens, l)."""
    each = lines.select("line", F.inline(F.arrays_zip(F.col("tokens").alias("at"), F.col("l").alias("cipher"))))
    return each.select("line", *[F.col("at")[c].alias(c) for c in ("token", *keep)], "cipher")


def _transposed(words: DataFrame, seed: int, key: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    mono, key = encoded(words.repartition("line"), "mono", seed, alphabet_key(words, seed) if key is None else key)  # words move, not their glyphs
    lines = _by_line(mono, "cipher", "word").withColumn("flat", F.flatten("l")).withColumn("sizes", F.transform("l", F.size))
    moved = _once(F.col("flat"), lambda flat: F.transform(_order(F.size(flat), seed), lambda i: F.get(flat, i)))
    cut = lines.withColumn("moved", moved).withColumn("l", _lengths(F.col("moved"), F.col("sizes")))
    return _by_token(cut, "word"), key.withColumn("seed", F.lit(seed))


def _restored(cipher: DataFrame, key: DataFrame, *keep: str) -> DataFrame:
    seed = key.select("seed").first()["seed"]
    lines = _by_line(cipher, "cipher", *keep).withColumn("flat", F.flatten("l")).withColumn("sizes", F.transform("l", F.size))
    at = lambda flat, before: F.transform(flat, lambda _, i: F.get(flat, F.get(before, i % COLUMNS) + F.floor(i / COLUMNS).cast("int")))
    back = _once(F.col("flat"), lambda flat: _once(_before(F.size(flat), seed), lambda before: at(flat, before)))
    cut = lines.withColumn("back", back).withColumn("l", _lengths(F.col("back"), F.col("sizes")))
    return decoded(_by_token(cut, *keep), key.drop("seed"), "mono", *keep)


def variants(words: DataFrame, scheme: str, count: int = CYCLE, seed: int = 0) -> DataFrame:
    """(line, token, word, occurrence, variant): which of `count` surface forms a word takes. iid and affix draw by
    place; recurrence runs through one permutation of the word's over and over; shuffled takes a new one each cycle."""
    rows = numbered_within(words, "word", ("line", "token"), "occurrence")
    if scheme in ("iid", "affix"):
        variant = draw(F.lit(seed), "line", "token") % count
    else:
        turn = F.floor(F.col("occurrence") / count) if scheme == "shuffled" else F.lit(0).cast("long")
        rows = rows.withColumn("turn", turn)
        # one permutation for each word (and cycle), not for each token
        parts = ["word", "turn"] if scheme == "shuffled" else ["word"]
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda v: F.struct(draw(F.lit(seed), *parts, v).alias("d"), v.alias("v"))))
        orders = rows.select("word", "turn").distinct().withColumn("order", F.transform(order, lambda x: x["v"]))
        rows = rows.join(orders, ["word", "turn"])
        variant = F.element_at("order", (F.col("occurrence") % count + 1).cast("int"))
    return rows.select("line", "token", "word", "occurrence", variant.cast("int").alias("variant"))


def affixes(variant: Column, second: int) -> tuple[Column, Column]:
    """A variant as a pair of slots; `second` is the number of forms of the second."""
    return F.floor(variant / second).cast("int"), (variant % second).cast("int")


def variant_diagnostics(rows: DataFrame, *keys: str) -> DataFrame:
    """Tokens, words, repeated tokens' share, the chance of the same surface, and the variants' entropy."""
    n = rows.groupBy(*keys, "word", "variant").agg(F.count("*").alias("n"))
    w = n.groupBy(*keys, "word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    out = w.groupBy(*keys).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("words"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recurrence"),
        F.round(F.try_divide(F.sum("same"), F.sum(F.col("n") * (F.col("n") - 1))), 6).alias("same_surface"),
    )
    v = n.groupBy(*keys, "variant").agg(F.sum("n").alias("n"))
    e = v.groupBy(*keys).agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("variant_entropy"))
    return out.join(e, list(keys)) if keys else out.join(F.broadcast(e))


def stream_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: a hash of the rows in order of line and token, as a hash of the lines' hashes in order of line parts."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("token", *columns)])
    line = rows.groupBy("line").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token", text.alias("x")))), lambda e: e["x"]), "\n"), 256).alias("h"))
    part = line.groupBy(F.floor(F.col("line") / 4096).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "h"))), lambda e: e["h"]), "\n"), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda e: e["h"]), "\n"), 256).alias("sha256"))

"""Control texts with several surface forms for a word, and what they show.

A mechanism writes a word as its base form, a glyph for each character, and adds a variant: suffixes and pairs of affixes
drawn by place, suffixes handed out in turn within a word, or code words with related forms for the most frequent words.
Keys are fitted on train lines only; characters that these lack become code-point glyphs, so every word can be
written and read back. Reserved lines are never written. Every choice is a SHA-256 draw.

Words are rows (line, token, word, split), split being train, validation or reserved. A coded text has rows
(line, token, word, split, cipher array<string>, variant). Keys are one row or at most MOST_TARGETS rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.normalize import code_point_glyph, glyph_character
from foliant.operators.ciphers import _characters, alphabet_key, glyph, number_of, top_words
from foliant.operators.numbering import numbered_within
from foliant.operators.resample import draw

VARIANTS = 16
#: Suffixes of the small key, which begin the large one.
SMALL = 4
#: Forms of a pair's first and second place.
FACTORS = {"1x16": (1, 16), "2x8": (2, 8), "4x4": (4, 4)}
#: The most words with codes of their own: three places of sixteen symbols.
MOST_TARGETS = 4096
SCHEMES = ("recurrence", "shuffled", "iid")


def by_hash(names: Sequence[str], *parts: object) -> list[str]:
    """A few names in an order that depends on them and the parts only."""
    return sorted(names, key=lambda x: (hashlib.sha256("|".join(map(str, (*parts, x))).encode()).hexdigest(), x))


def suffixes(seed: int, count: int = VARIANTS) -> list[str]:
    """The suffix glyphs of a key. The first SMALL are a key of their own, so a text of SMALL variants is the same under
    either key."""
    small = by_hash([f"V{i:04d}" for i in range(1, SMALL + 1)], "suffix", seed)
    return [*small, *by_hash([f"V{i:04d}" for i in range(SMALL + 1, VARIANTS + 1)], "suffix", seed)][:count]


def slots(seed: int, factors: str) -> tuple[list[str], list[str]]:
    """The glyphs of a pair's two places."""
    first, second = FACTORS[factors]
    return by_hash([f"A{i:04d}" for i in range(1, 5)], "slot", seed)[:first], by_hash([f"B{i:04d}" for i in range(1, 17)], "slot", seed)[:second]


def train(words: DataFrame) -> DataFrame:
    return words.where("split = 'train'")


def with_base(words: DataFrame, seed: int, phases: Sequence[str] = ("train", "validation")) -> tuple[DataFrame, DataFrame]:
    """(words of the phases with `base`, the key's one row); the key is train's."""
    key = alphabet_key(train(words), seed)
    known = F.transform(_characters(F.col("word")), lambda c: F.coalesce(glyph("M", F.col("number")[c] + 1), code_point_glyph(c)))
    rows = words.where(F.col("split").isin(*phases)).join(F.broadcast(key))
    return rows.withColumn("base", known).drop("number", "item"), key


def base_word(base: Column) -> Column:
    """The word of a base form, beside the key's `item`."""
    return F.array_join(F.transform(base, lambda g: F.when(g.startswith("U"), glyph_character(g)).otherwise(F.col("item")[number_of(g) - 1])), "")


def _picked(names: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at)


def place_variant(seed: int, count: int) -> Column:
    """A variant by place alone: the word has no part in it."""
    return (draw(F.lit(seed), F.lit("place"), "line", "token") % count).cast("int")


def suffixed(words: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Base form and one of `count` suffixes, drawn by place."""
    rows, key = with_base(words, seed)
    rows = rows.withColumn("variant", place_variant(seed, count))
    return rows.withColumn("cipher", F.concat("base", F.array(_picked(suffixes(seed, count), F.col("variant"))))), key


def affixed(words: DataFrame, factors: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Base form and a pair of affixes that stands for one of sixteen variants, drawn as for suffixes."""
    rows, key = with_base(words, seed)
    first, second = slots(seed, factors)
    rows = rows.withColumn("variant", place_variant(seed, VARIANTS))
    pair = F.array(_picked(first, F.floor(F.col("variant") / len(second)).cast("int")), _picked(second, F.col("variant") % len(second)))
    return rows.withColumn("cipher", F.concat("base", pair)), key


def affix_variant(cipher: Column, factors: str, seed: int = 0) -> Column:
    """The variant that a word's last two glyphs stand for; null where they are no pair of the key."""
    first, second = slots(seed, factors)
    at = lambda names, g: F.nullif(F.array_position(F.array(*map(F.lit, names)), g), F.lit(0).cast("long")) - 1
    return (at(first, F.element_at(cipher, -2)) * len(second) + at(second, F.element_at(cipher, -1))).cast("int")


def suffix_variant(cipher: Column, seed: int = 0) -> Column:
    return (F.nullif(F.array_position(F.array(*map(F.lit, suffixes(seed))), F.element_at(cipher, -1)), F.lit(0).cast("long")) - 1).cast("int")


#: Lines that a phase may have before the next one's begin.
_PHASE = 1 << 48


def permutation(key: Column, seed: int, turn: Column) -> Column:
    """The sixteen variants in an order that belongs to a word (and turn)."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(VARIANTS - 1)), lambda v: F.struct(draw(F.lit(seed), F.lit("turn"), key, turn, v).alias("d"), v.alias("v"))))
    return F.transform(order, lambda x: x["v"])


def allocated(words: DataFrame, scheme: str = "recurrence", seed: int = 0, phases: Sequence[str] = ("train", "validation")) -> tuple[DataFrame, DataFrame]:
    """Base form and a suffix handed out by how often the word came before: in the word's own order over and over, in a
    new order each sixteen times, or drawn anew (iid). Counts run through the phases in their order, whatever the lines'
    numbers; lines of other splits are neither written nor counted."""
    rows, key = with_base(words, seed, phases)
    phase = F.array_position(F.array(*map(F.lit, phases)), F.col("split")) - 1
    rows = rows.withColumn("__at", F.col("line").cast("long") + phase * F.lit(_PHASE))
    rows = numbered_within(rows, "word", ("__at", "token"), "occurrence").drop("__at")
    turn = F.floor(F.col("occurrence") / VARIANTS) if scheme == "shuffled" else F.lit(0).cast("long")
    if scheme == "iid":
        variant = draw(F.lit(seed), F.lit("iid"), "word", "occurrence") % VARIANTS
    else:
        # one order for each word (and turn), not for each token
        rows = rows.withColumn("turn", turn)
        orders = rows.select("word", "turn").distinct().withColumn("order", permutation(F.col("word"), seed, F.col("turn")))
        rows = rows.join(orders, ["word", "turn"])
        variant = F.element_at("order", (F.col("occurrence") % VARIANTS + 1).cast("int"))
    rows = rows.withColumn("variant", variant.cast("int")).drop("turn", "order")
    return rows.withColumn("cipher", F.concat("base", F.array(_picked(suffixes(seed), F.col("variant"))))), key


def related_codes(words: DataFrame, seed: int = 0) -> DataFrame:
    """(word, rank, forms) of the 64 most frequent train words: two glyphs, of which the last is one of four. Which word
    has which code is drawn, which words have one is not."""
    symbols = F.array(*map(F.lit, by_hash([f"N{i:04d}" for i in range(1, 17)], "symbol", seed)))
    best = top_words(train(words), 64).withColumn("h", F.sha2(F.concat_ws("|", F.lit("code"), F.lit(seed), "word"), 256))
    ranked = best.withColumn("rank", F.expr("row_number() over (order by h, word) - 1"))  # 64 rows
    form = lambda k: F.array(F.get(symbols, F.floor(F.col("rank") / 4).cast("int")), F.get(symbols, (F.col("rank") % 4 * 4 + k).cast("int")))
    return ranked.select("word", "rank", F.array(*[form(k) for k in range(4)]).alias("forms"))


def master_codes(words: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """(word, rank, forms) of the `most` most frequent train words: three glyphs of the word's own and one of four last
    ones. A word's code doesn't depend on how many words are coded. Fewer words than asked for are an error."""
    if most > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} codes")
    symbols = F.array(*map(F.lit, by_hash([f"N{i:04d}" for i in range(1, 17)], "symbol", seed)))
    n = train(words).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    ranked = n.withColumn("rank", F.expr("row_number() over (order by n desc, word) - 1"))  # `most` rows
    held = ranked.agg(F.count("*").alias("held"))
    ranked = ranked.join(F.broadcast(held)).where(F.when(F.col("held") == most, True).otherwise(F.raise_error(F.concat(F.lit(f"{most} words to code, but train has "), "held")).cast("boolean")))
    h = int(hashlib.sha256(f"family|{seed}".encode()).hexdigest()[:8], 16)
    family = ((F.col("rank") * (2 * (h % 2048) + 1) + h // 4096) % MOST_TARGETS).cast("int")  # odd factor: one to one
    lasts = F.transform(F.array_sort(F.transform(symbols, lambda g: F.struct(draw(F.lit(seed), F.lit("last"), "word", g).alias("d"), g.alias("g")))), lambda x: x["g"])
    at = lambda k: F.get(symbols, (F.floor(F.col("family") / k) % 16).cast("int"))
    own = ranked.withColumn("family", family).withColumn("lasts", lasts)
    return own.select("word", "rank", F.transform(F.slice("lasts", 1, 4), lambda g: F.array(at(256), at(16), at(1), g)).alias("forms"))


def coded(words: DataFrame, codes: DataFrame, count: int, seed: int = 0, active: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Words with codes take one of their first `count` forms, drawn by place and word, the rest their base form.
    active: how many of the most frequent are coded."""
    rows, key = with_base(words, seed)
    own = codes if active is None else codes.where(F.col("rank") < active)
    rows = rows.join(F.broadcast(own.select("word", "forms")), "word", "left")  # at most MOST_TARGETS
    choice = (draw(F.lit(seed), F.lit("form"), "line", "token", "word") % count).cast("int")
    rows = rows.withColumn("variant", F.when(F.col("forms").isNotNull(), choice))
    return rows.withColumn("cipher", F.coalesce(F.get("forms", F.col("variant")), F.col("base"))).withColumn("targeted", F.col("forms").isNotNull()).drop("forms"), key


def decoded(cipher: DataFrame, key: DataFrame, drop: int) -> DataFrame:
    """cipher with `restored`, after `drop` glyphs at the end are taken off."""
    rows = cipher.join(F.broadcast(key))
    return rows.withColumn("restored", base_word(F.slice("cipher", F.lit(1), F.size("cipher") - drop))).drop("number", "item")


def decoded_codes(cipher: DataFrame, key: DataFrame, codes: DataFrame) -> DataFrame:
    """cipher with `restored`: by the codes' forms, else by the base form."""
    forms = codes.select(F.col("word").alias("__word"), F.explode("forms").alias("f")).select("__word", F.array_join("f", "-").alias("__text"))
    rows = cipher.withColumn("__text", F.array_join("cipher", "-")).join(F.broadcast(forms), "__text", "left").join(F.broadcast(key))
    return rows.withColumn("restored", F.coalesce("__word", base_word(F.col("cipher")))).drop("__text", "__word", "number", "item")


def surface_diagnostics(rows: DataFrame, *keys: str, only: str | None = None) -> DataFrame:
    """By keys: tokens, word types, cipher types, the share of repeated cipher tokens, glyphs in use, round trips, and of
    words (those of column `only`, if named) the forms in use, on average and at most, and the chance that two
    tokens of one word look alike."""
    n = rows.withColumn("__t", F.array_join("cipher", "-")).groupBy(*keys, "word", "__t").agg(F.count("*").alias("n"), F.bool_and(F.col(only) if only else F.lit(True)).alias("__on"))
    words = n.groupBy(*keys, "word").agg(F.sum("n").alias("n"), F.count("*").alias("forms"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.bool_and("__on").alias("on"))
    on = lambda c: F.when(F.col("on"), F.col(c))
    by_word = words.groupBy(*keys).agg(
        F.sum("n").alias("tokens"), F.count("*").alias("word_types"), F.sum(F.coalesce(on("n"), F.lit(0))).alias("targeted"), F.round(F.avg(on("forms")), 6).alias("mean_forms"), F.max(on("forms")).alias("most_forms"),
        F.round(F.try_divide(F.sum(on("same")), F.sum(on("n") * (on("n") - 1))), 6).alias("same_surface"),
    )
    by_text = n.groupBy(*keys, "__t").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count("*").alias("cipher_types"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("recurrence"))
    glyphs = n.select(*keys, F.explode(F.split("__t", "-")).alias("g")).distinct().groupBy(*keys).agg(F.count("*").alias("glyphs"))
    right = rows.groupBy(*keys).agg(F.count_if(F.col("restored") == F.col("word")).alias("restored"))
    out = by_word
    for part in (by_text, glyphs, right):
        out = out.join(part, list(keys)) if keys else out.join(F.broadcast(part))
    return out


def entropy_of(rows: DataFrame, value: Column, *keys: str, name: str) -> DataFrame:
    n = rows.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg((F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6) + 0.0).alias(name))


def slot_entropies(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys: bits of the first and second affix, of the pair, and of the variant."""
    a, b = F.element_at("cipher", -2), F.element_at("cipher", -1)
    out = entropy_of(rows, a, *keys, name="first_bits")
    for value, name in ((b, "second_bits"), (F.concat_ws("-", a, b), "pair_bits"), (F.col("variant"), "variant_bits")):
        out = out.join(entropy_of(rows, value, *keys, name=name), list(keys))
    return out


def allocation_checks(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(check, violations) of a text in turns: the schedule is kept, train uses as many forms of a word as it can, and
    neighbours within a cycle differ."""
    from foliant.operators.selection import checks, violations

    orders = rows.select("word").distinct().withColumn("__o", permutation(F.col("word"), seed, F.lit(0).cast("long")))
    off = rows.join(orders, "word").where(F.element_at("__o", (F.col("occurrence") % VARIANTS + 1).cast("int")) != F.col("variant"))
    forms = train(rows).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("variant").alias("v"))
    cycles = rows.groupBy("word", F.floor(F.col("occurrence") / VARIANTS).alias("cycle")).agg(F.count("*").alias("n"), F.count_distinct("variant").alias("v"))
    return checks(
        violations("schedule", off), violations("forms_in_train", forms.where(F.col("v") != F.least(F.col("n"), F.lit(VARIANTS)))), violations("repeats_within_a_cycle", cycles.where("v < n")),
        violations("round_trip", rows.where("not restored <=> word")),
    )


def continuation(rows: DataFrame) -> DataFrame:
    """One row of a text in turns: validation tokens whose form train need not have used, how many of these it did use,
    and how many others repeat a form of train."""
    used = train(rows).groupBy("word").agg(F.count("*").alias("seen"), F.collect_set("variant").alias("forms"))  # at most sixteen a word
    own = rows.where("split = 'validation'").join(used, "word", "left")
    seen, again = F.coalesce("seen", F.lit(0)), F.coalesce(F.array_contains("forms", F.col("variant")), F.lit(False))
    free = F.col("occurrence") < VARIANTS
    return own.agg(
        F.count("*").alias("tokens"), F.count_if(F.col("occurrence") < seen).alias("counter_breaks"), F.count_if(free).alias("avoidable"), F.count_if(free & again).alias("avoidable_reuses"), F.count_if(~free & again).alias("unavoidable_reuses")
    )


def control_lines(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(line, split, tokens, reserved_test_opaque): a row for each line, reserved ones without tokens. Nothing of a reserved
    line but its number comes out."""
    own = rows.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("token", "cipher"))).alias("t")).select("line", F.transform("t", lambda x: x["cipher"]).alias("tokens"))
    lines = words.groupBy("line").agg(F.first("split").alias("split"))
    return lines.join(own, "line", "left").select("line", "split", "tokens", (F.col("split") == "reserved").alias("reserved_test_opaque"))


def key_fingerprint(key: DataFrame, *extra: str) -> DataFrame:
    """One row: a hash of a key's characters and glyphs, in order, and of further parts."""
    entries = F.array_sort(F.transform(F.map_entries("number"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return key.select(F.sha2(F.array_join(F.concat(entries, F.array(*map(F.lit, extra)).cast("array<string>")), "\n"), 256).alias("fingerprint"))


def text_counts(rows: DataFrame, glyphs: Column, *keys: str) -> DataFrame:
    """By keys: lines, tokens, glyphs, distinct tokens and distinct glyphs of rows (line, …)."""
    own = rows.select(*keys, "line", glyphs.alias("g"))
    counts = own.groupBy(*keys).agg(F.count_distinct("line").alias("lines"), F.count("*").alias("tokens"), F.sum(F.size("g")).alias("glyphs"), F.count_distinct(F.array_join("g", "\x1f")).alias("unique_tokens"))
    alphabet = own.select(*keys, F.explode("g").alias("x")).groupBy(*keys).agg(F.count_distinct("x").alias("alphabet_size"))
    return counts.join(alphabet, list(keys)) if keys else counts.join(F.broadcast(alphabet))


def codewords(items: DataFrame, length: int, glyphs: list[str], seed: int = 0) -> DataFrame:
    """(item, codeword) of a few items (item): different words of `length` of the glyphs, drawn. The base is as small as
    the number of items allows."""
    n = items.count()
    base = next(k for k in range(2, n + 3) if k**length >= n)
    if base > len(glyphs):
        raise ValueError(f"{n} items need {base} glyphs")
    spark = items.sparkSession
    numbers = spark.range(base**length).withColumn("h", F.sha2(F.concat_ws("|", F.lit("codeword"), F.lit(seed), "id"), 256))
    ranked = numbers.withColumn("r", F.expr("row_number() over (order by h, id)")).where(F.col("r") <= n)  # a key: few
    digits = F.array(*[F.get(F.array(*map(F.lit, glyphs[:base])), (F.floor(F.col("id") / base**k) % base).cast("int")) for k in reversed(range(length))])
    own = items.select("item").withColumn("r", F.expr("row_number() over (order by item)"))
    return own.join(ranked.select("r", digits.alias("codeword")), "r").select("item", "codeword")

"""What meets at the boundaries of words, features of leaves, and scores by label.

Tokens are rows of ngram.token_sequences: readable ones, in segments that an unreadable one ends. A boundary lies
between neighbours of a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OVER = "over (partition by record_id, segment order by token_index)"


def boundaries(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, f, i, same): the last glyph before and the first glyph after each boundary, and whether the tokens are alike."""
    g = tokens.withColumn("__first", F.get("symbols", F.lit(0))).withColumn("__last", F.element_at("symbols", -2))  # the last symbol is the end
    own = g.select(*keys, F.col("__last").alias("f"), F.expr(f"lead(__first) {_OVER}").alias("i"), (F.expr(f"lead(tok) {_OVER}") == F.col("tok")).alias("same"))
    return own.where("i is not null")


def _bits(n: str = "n") -> Column:
    """Entropy of counts in bits."""
    return F.greatest(F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n), F.lit(0.0))


def boundary_anatomy(pairs: DataFrame, *keys: str) -> DataFrame:
    """By keys, of rows (keys, f, i): boundaries; entropies of last and first glyphs and of pairs, what each tells of the
    other, and the information they share; how many of each there are, in number and in effect; the share of possible
    pairs in use, of the commonest pair and of the five commonest; and Simpson's concentration."""
    n = pairs.groupBy(*keys, "f", "i").agg(F.count("*").alias("n"))
    ranked = n.withColumn("r", F.expr(f"row_number() over (partition by {', '.join(keys)} order by n desc, f, i)"))  # glyph pairs: few
    joint = ranked.groupBy(*keys).agg(
        F.sum("n").alias("boundaries"), _bits().alias("pair_bits"), F.count("*").alias("pairs"), F.max("n").alias("__max"), F.sum(F.when(F.col("r") <= 5, F.col("n"))).alias("__top"), F.sum(F.col("n") * F.col("n")).alias("__sq")
    )
    ends = {}
    for c, name in (("f", "final"), ("i", "initial")):
        one = n.groupBy(*keys, c).agg(F.sum("n").alias("n"))
        ends[name] = one.groupBy(*keys).agg(_bits().alias(f"{name}_bits"), F.count("*").alias(f"{name}_glyphs"))
    out = joint.join(ends["final"], list(keys)).join(ends["initial"], list(keys))
    f, i, p, b = (F.col(c) for c in ("final_bits", "initial_bits", "pair_bits", "boundaries"))
    shared = F.greatest(f + i - p, F.lit(0.0))
    simpson = F.col("__sq") / (b * b)
    figures = {
        "initial_given_final_bits": F.greatest(p - f, F.lit(0.0)), "final_given_initial_bits": F.greatest(p - i, F.lit(0.0)), "shared_bits": shared, "shared_fraction": F.when(p > 1e-12, shared / p).otherwise(0.0),
        "effective_finals": F.pow(F.lit(2.0), f), "effective_initials": F.pow(F.lit(2.0), i), "effective_pairs": F.pow(F.lit(2.0), p), "support": F.col("pairs") / (F.col("final_glyphs") * F.col("initial_glyphs")),
        "commonest": F.col("__max") / b, "five_commonest": F.col("__top") / b, "simpson": simpson, "effective_simpson_pairs": 1 / simpson, "final_bits": f, "initial_bits": i, "pair_bits": p,
    }
    return out.select(*keys, "boundaries", "pairs", "final_glyphs", "initial_glyphs", *[(F.round(v, 6) + 0.0).alias(k) for k, v in figures.items()])


def _transitions(pairs: DataFrame, name: str, *keys: str) -> DataFrame:
    """(keys, name_count, name_pairs, name_pair_bits, name_conditional_bits) of rows (keys, a, b)."""
    n = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    by = n.groupBy(*keys, "a").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.log2("n")).alias("x"), F.count("*").alias("k"))
    total = F.sum("c")
    return by.groupBy(*keys).agg(
        total.alias(f"{name}_count"), F.sum("k").alias(f"{name}_pairs"), F.greatest(F.log2(total) - F.sum("x") / total, F.lit(0.0)).alias(f"{name}_pair_bits"),
        F.greatest(F.sum(F.col("c") * F.log2("c") - F.col("x")) / total, F.lit(0.0)).alias(f"{name}_conditional_bits"),
    )


def leaf_features(tokens: DataFrame, unit: str) -> DataFrame:
    """By unit: segments, tokens, glyphs, their lengths, boundaries, types and how often they recur, repeats side by side,
    transitions within tokens and across boundaries, and the gaps between the two. Null where there is nothing."""
    own = tokens.withColumn("g", F.slice("symbols", 1, F.size("symbols") - 1))
    size = F.size("g")
    base = own.groupBy(unit).agg(
        F.count_distinct("record_id", "segment").alias("segments"), F.count("*").alias("tokens"), F.sum(size).alias("glyphs"), F.avg(size).alias("mean_length"), F.var_pop(size).alias("length_variance")
    )
    n = own.groupBy(unit, "tok").agg(F.count("*").alias("n"))
    types = n.groupBy(unit).agg(F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))
    b = boundaries(own, unit)
    met = b.groupBy(unit).agg(F.count("*").alias("boundaries"), F.avg(F.col("same").cast("int")).alias("adjacent_repeats"))
    steps = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(F.element_at("g", k).alias("a"), F.element_at("g", k + 1).alias("b")))
    within = own.where(size > 1).select(unit, F.inline(steps))
    across = b.select(unit, F.col("f").alias("a"), F.col("i").alias("b"))
    out = base.join(types, unit).join(met, unit, "left").join(_transitions(within, "within", unit), unit, "left").join(_transitions(across, "across", unit), unit, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    figures = {
        "mean_length": F.col("mean_length"), "length_variance": F.col("length_variance"), "boundary_density": zero("boundaries") / F.col("glyphs"), "type_token_ratio": F.col("types") / F.col("tokens"),
        "repeated_fraction": F.col("repeated") / F.col("tokens"), "singleton_fraction": F.col("once") / F.col("tokens"), "singleton_type_fraction": F.col("once") / F.col("types"), "adjacent_repeats": F.col("adjacent_repeats"),
        "within_pair_bits": F.col("within_pair_bits"), "within_conditional_bits": F.col("within_conditional_bits"), "across_pair_bits": F.col("across_pair_bits"), "across_conditional_bits": F.col("across_conditional_bits"),
        "conditional_gap": F.col("across_conditional_bits") - F.col("within_conditional_bits"), "pair_gap": F.col("across_pair_bits") - F.col("within_pair_bits"),
    }
    counts = [F.col(c) for c in ("segments", "tokens", "glyphs", "types")] + [zero(c).cast("long").alias(c) for c in ("boundaries", "within_count", "within_pairs", "across_count", "across_pairs")]
    return out.select(unit, *counts, *[(F.round(v, 6) + 0.0).alias(k) for k, v in figures.items()])


def by_label(scores: DataFrame, labels: DataFrame, unit: str, label: str) -> DataFrame:
    """scores (unit, competitor_bits, trigram_bits, events) by a label of the units: how many there are, bits an event of both,
    their difference as a ratio of sums, and in how many units the competitor is worse and better."""
    rows = scores.join(labels, unit)
    d = F.col("competitor_bits") - F.col("trigram_bits")
    per = lambda c: F.round(F.sum(c) / F.sum("events"), 6)
    return rows.groupBy(label).agg(
        F.count("*").alias("units"), F.array_join(F.array_sort(F.collect_list(unit)), "|").alias("members"), F.sum("events").alias("events"), per("competitor_bits").alias("competitor_bits_per_event"),
        per("trigram_bits").alias("trigram_bits_per_event"), (F.round(F.sum(d) / F.sum("events"), 6) + 0.0).alias("delta"), F.count_if(d > 0).alias("worse"), F.count_if(d < 0).alias("better"),
    )


def joined_views(first: DataFrame, second: DataFrame, unit: str, names: tuple[str, str]) -> DataFrame:
    """Two views' differences (unit, delta) side by side, with what the first has more (boost). A unit that one view lacks is
    an error when it is read."""
    a, b = (df.select(unit, F.col("delta").alias(f"{n}_delta"), F.lit(1).alias(f"__{n}")) for df, n in zip((first, second), names))
    both = a.join(b, unit, "full_outer")
    whole = F.col(f"__{names[0]}").isNotNull() & F.col(f"__{names[1]}").isNotNull()
    checked = F.when(whole, F.col(unit)).otherwise(F.raise_error(F.concat(F.lit("only one view has unit "), unit)))
    return both.select(checked.alias(unit), f"{names[0]}_delta", f"{names[1]}_delta", (F.col(f"{names[0]}_delta") - F.col(f"{names[1]}_delta")).alias("boost"))

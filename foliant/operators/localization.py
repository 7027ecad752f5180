"""Where one model of tokens does better than another: the bits of every held-out token under both, with what training
knows of the token and of the step to it, and sums of these by any fields.

Training counts are tables that are joined; all are left to the planner, as they grow with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.normalize import short_id
from foliant.operators import ngram as N
from foliant.session import written

START = "<TOKEN_BOS>"


def training_tables(steps: DataFrame) -> dict[str, DataFrame]:
    """Of steps (h1, s) the tables of tokens (s, current_frequency, current_rank), of pairs, of what follows a token and of
    what comes before one. Ranks go by frequency, ties by token; they are counted in parts by frequency."""
    steps = written(steps.groupBy("h1", "s").agg(F.count("*").alias("n")), "steps")
    tokens = steps.groupBy("s").agg(F.sum("n").alias("current_frequency"), F.count("*").alias("current_predecessors"))
    sizes = tokens.groupBy("current_frequency").agg(F.count("*").alias("k"))
    before = sizes.select("current_frequency", F.expr("sum(k) over (order by current_frequency desc) - k").alias("before"))  # a row for each frequency
    part = F.substring("s", 1, 2)
    own = tokens.withColumn("part", part)
    parts = own.groupBy("current_frequency", "part").agg(F.count("*").alias("k"))
    earlier = parts.select("current_frequency", "part", F.expr("sum(k) over (partition by current_frequency order by part) - k").alias("earlier"))
    ranked = own.withColumn("place", F.expr("row_number() over (partition by current_frequency, part order by s)")).join(earlier, ["current_frequency", "part"]).join(before, "current_frequency")
    ranked = ranked.withColumn("current_rank", F.col("before") + F.col("earlier") + F.col("place")).select("s", "current_frequency", "current_predecessors", "current_rank")
    out = steps.groupBy("h1").agg(F.sum("n").alias("outgoing_total"), F.count("*").alias("distinct_next"), F.max("n").alias("most_next"))
    return {"tokens": ranked, "pairs": steps.select("h1", "s", F.col("n").alias("pair_frequency")), "outgoing": out}


def transition_features(asked: DataFrame, tables: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """asked (…, h1, s) with what training knows: how often the token, the one before it and the pair occurred, the token's
    rank (0 if new), what follows the one before and how much of it is one token, and how many tokens come before it."""
    before = tables["tokens"].select(F.col("s").alias("h1"), F.col("current_frequency").alias("previous_frequency"))
    rows = asked.join(tables["tokens"], "s", "left").join(before, "h1", "left").join(tables["pairs"], ["h1", "s"], "left").join(tables["outgoing"], "h1", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("outgoing_total")), F.lit(0.0)), 9)
    counts = ("current_frequency", "current_rank", "previous_frequency", "pair_frequency", "outgoing_total", "distinct_next", "current_predecessors")
    return rows.select(*asked.columns, *[zero(c).alias(prefix + c) for c in counts], share("pair_frequency").alias(f"{prefix}conditional_probability"), share("most_next").alias(f"{prefix}concentration"))


def token_bits(train: DataFrame, test: DataFrame, order: int = 3) -> DataFrame:
    """The rows of test (token sequences) with h1, s, events, token_bits under one token of context and trigram_bits under a
    character model of `order`, delta_bits (the first less the second), and whether training has seen the token and its
    glyphs."""
    characters = N.counts(N.events(train, order), order)
    tables = N.counts(N.linked(train, 1), 2)
    spelled = test.select(F.col("tok").alias("s"), "symbols").distinct()
    each = N.probabilities(N.events(spelled.withColumnRenamed("s", "word"), order, "word"), characters)
    spelling = each.groupBy(F.col("word").alias("s")).agg(F.exp(F.sum(F.log(f"p{order}"))).alias("spelling"), F.count("*").alias("events"), F.count_if("oov").alias("strange_glyphs"), F.sum(-F.log2(f"p{order}")).alias("trigram_bits"))
    p = N.probabilities(N.linked(test, 1).join(spelling, "s"), tables, base="spelling")
    rows = p.withColumn("token_bits", -F.log2("p2")).withColumn("delta_bits", F.col("token_bits") - F.col("trigram_bits"))
    return rows.drop("spelling", "p1", "p2").withColumn("seen", ~F.col("oov")).drop("oov")


def contributions(train: DataFrame, test: DataFrame, order: int = 3) -> DataFrame:
    """token_bits with the features of each step and ids of its tokens."""
    rows = transition_features(token_bits(train, test, order), training_tables(N.linked(train, 1)))
    d = F.col("delta_bits")
    glyphs = F.slice("symbols", 1, F.size("symbols") - 1)
    previous = F.when(F.col("h1") == START, F.lit("BOS")).otherwise(short_id(F.split("h1", "\x1f")))
    return rows.withColumns({
        "delta_per_event": d / F.col("events"), "token_better": d < 0, "trigram_better": d > 0, "token_advantage": F.greatest(-d, F.lit(0.0)), "trigram_advantage": F.greatest(d, F.lit(0.0)),
        "token_id": short_id(glyphs), "previous_id": previous, "length": F.size(glyphs),
    })


def transitions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Steps between two tokens: line beginnings are left out, and columns chosen."""
    return rows.where("token_index > 0").select(*columns)


def summarised(rows: DataFrame, run: str, whole: list[str], *fields: str) -> DataFrame:
    """By fields of contributions: runs, tokens, events, the difference as a ratio of sums, its mean and spread over runs, how
    many tokens the token model is better on, the bits each model gains, and the share of all that the token model gains
    within `whole` (a part of the fields)."""
    runs = rows.groupBy(*fields, run).agg(
        F.count("*").alias("tokens"), F.sum("events").alias("events"), F.sum("delta_bits").alias("d"), F.count_if("token_better").alias("better"), F.sum("token_advantage").alias("ta"), F.sum("trigram_advantage").alias("ga")
    )
    by = runs.groupBy(*fields).agg(
        F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.sum("events").alias("events"), F.sum("d").alias("d"), F.avg(F.col("d") / F.col("events")).alias("mean"), F.stddev_pop(F.col("d") / F.col("events")).alias("sd"),
        F.sum("better").alias("better"), F.sum("ta").alias("ta"), F.sum("ga").alias("ga"),
    )
    total = by.groupBy(*whole).agg(F.sum("ta").alias("__all")) if whole else by.agg(F.sum("ta").alias("__all"))
    both = by.join(total, whole) if whole else by.join(F.broadcast(total))
    r = lambda c: F.round(c, 6) + 0.0
    return both.select(
        *fields, "runs", "tokens", "events", r(F.col("d")).alias("delta_bits"), r(F.col("d") / F.col("events")).alias("delta_per_event"), r(F.col("mean")).alias("mean_run_delta"), r(F.col("sd")).alias("sd_run_delta"),
        F.col("better").alias("tokens_better"), r(F.col("better") / F.col("tokens")).alias("better_share"), r(F.col("ta")).alias("token_advantage"), r(F.col("ga")).alias("trigram_advantage"),
        r(F.coalesce(F.try_divide(F.col("ta"), F.col("__all")), F.lit(0.0))).alias("share_of_advantage"),
    )


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys: tokens, events, and bits an event of both models and of their difference, which a relation over the same tokens
    must give, too."""
    per = lambda c: F.round(F.sum(c) / F.sum("events"), 9)
    figures = [F.count("*").alias("tokens"), F.sum("events").alias("events"), per("token_bits").alias("competitor"), per("trigram_bits").alias("trigram"), per("delta_bits").alias("delta")]
    return rows.groupBy(*keys).agg(*figures) if keys else rows.agg(*figures)


def metric_deltas(metrics: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """metrics (keys, metric, value) with the reference's value (metric, value), the difference and its size; null where the
    reference has none."""
    ref = reference.select("metric", F.col("value").alias("reference"))
    d = F.col("value") - F.col("reference")
    return metrics.join(ref, "metric", "left").select(*keys, "metric", "value", "reference", d.alias("difference"), F.abs(d).alias("distance"))


def unpivoted(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value): a row for each named column."""
    return rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def ranked_matches(wanted: DataFrame, offered: DataFrame, rules: list[Column], key: str, choice: str) -> DataFrame:
    """(key, choices, rule, outcome): for each wanted row the offered ones that the first rule with any match allows, rules being
    conditions on a pair from the strictest on. found where one matches, several where more do, none otherwise. The pairs
    that are tried are those of one `base`, a column of both."""
    pairs = wanted.join(offered.withColumnRenamed("base", "__base"), F.col("base") == F.col("__base"), "left")
    rule = F.when(F.col("__base").isNotNull(), F.coalesce(*[F.when(r, F.lit(i)) for i, r in enumerate(rules)]))
    rows = pairs.withColumn("rule", rule)
    best = rows.groupBy(key).agg(F.min("rule").alias("best"))
    chosen = rows.join(best, key).where("rule = best").groupBy(key).agg(F.array_sort(F.collect_set(choice)).alias("choices"), F.first("best").alias("rule"))
    out = best.select(key).join(chosen, key, "left")
    n = F.size("choices")
    return out.withColumn("outcome", F.when(F.col("choices").isNull(), "none").when(n == 1, "found").otherwise("several"))

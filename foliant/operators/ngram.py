"""Witten-Bell n-gram models as count tables, scored by joins; token models over a character model.

A sequence is an array of symbols. The unknown glyph ends a sequence and is dropped; word boundaries are symbols
of their own within a line, never at a sequence's ends. Histories are padded on the left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import UNKNOWN, readable, tokens
from foliant.session import written

BOS, BOUNDARY, END = "<BOS>", "<WB>", "<EOT>"
VIEWS = ("token_aware", "space_free")


def leaf_group(leaf: Column) -> Column:
    return F.coalesce(F.concat(F.lit("f"), leaf.cast("string")), F.lit("special"))


def line_sequences(lines: DataFrame, *keep: str, view: str = "token_aware") -> DataFrame:
    """(record_id, keep…, symbols): the sequences of each line, with word boundaries or, space_free, without."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}")
    padded = F.transform("tokens", lambda t: F.array_join(F.transform(t, lambda g: F.concat(F.lit(" "), g, F.lit(" "))), ""))
    parts = F.split(F.array_join(padded, f" {BOUNDARY} " if view == "token_aware" else ""), f" {UNKNOWN} ", -1)
    trimmed = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, rf"^( *{BOUNDARY} *)+|( *{BOUNDARY} *)+$", "")))
    own = lines.select("record_id", *keep, F.explode(F.filter(trimmed, lambda p: p != "")).alias("part"))
    return own.select("record_id", *keep, F.split("part", " +").alias("symbols"))


def token_sequences(lines: DataFrame, *keep: str) -> DataFrame:
    """(record_id, keep…, segment, token_index, tok, symbols): each readable token as a sequence of its own, with an end.
    An unreadable token ends a segment: no context reaches beyond it."""
    t = tokens(lines, *keep).withColumn("__break", (~readable(F.col("glyphs"))).cast("int"))
    t = t.withColumn("segment", F.expr("sum(__break) over (partition by record_id order by token_index)")).where("__break = 0")
    return t.select("record_id", *keep, "segment", "token_index", "tok", F.concat("glyphs", F.array(F.lit(END))).alias("symbols"))


def events(sequences: DataFrame, order: int, *keep: str) -> DataFrame:
    """(keep…, h1…, s): each symbol with the order - 1 before it, h1 the nearest."""
    padded = F.concat(F.array(*[F.lit(BOS)] * (order - 1)), F.col("symbols")) if order > 1 else F.col("symbols")
    rows = sequences.select(*keep, padded.alias("p"))
    each = rows.select(*keep, F.explode(F.transform(F.sequence(F.lit(order), F.size("p")), lambda i: F.slice("p", i - (order - 1), F.lit(order)))).alias("w"))
    return each.select(*keep, *[F.element_at("w", order - k).alias(f"h{k}") for k in range(1, order)], F.element_at("w", order).alias("s"))


def counts(train: DataFrame, order: int) -> list[DataFrame]:
    """Count tables by history length j: (h1…hj, s, c), all from one aggregation of the longest, which is written once:
    the tables are read again and again."""
    top = written(train.groupBy(*[f"h{k}" for k in range(1, order)], "s").agg(F.count("*").alias("c")), "counts")
    return [top if j == order - 1 else top.groupBy(*[f"h{k}" for k in range(1, j + 1)], "s").agg(F.sum("c").alias("c")) for j in range(order)]


def contexts(tables: Sequence[DataFrame]) -> DataFrame:
    """(history_length, contexts, transitions, distinct_edges) of the count tables."""
    out = None
    for j, t in enumerate(tables):
        own = t.groupBy(*[f"h{k}" for k in range(1, j + 1)]).agg(F.sum("c").alias("n"), F.count("*").alias("e"))
        row = own.agg(F.count("*").alias("contexts"), F.sum("n").alias("transitions"), F.sum("e").alias("distinct_edges")).withColumn("history_length", F.lit(j))
        out = row if out is None else out.unionByName(row)
    return out


def probabilities(asked: DataFrame, tables: Sequence[DataFrame], base: str | None = None) -> DataFrame:
    """asked (…, h1…, s) with p1…p_order, the probability by models of each order, and oov. The counts may be of any
    size: the joins are left to the planner. base: a column that stands for the share of unseen mass per symbol
    (a lower model's probability); without it, an unseen symbol takes that whole mass."""
    order = len(tables)
    out = asked
    for j, t in enumerate(tables):
        h = [f"h{k}" for k in range(1, j + 1)]
        own = t.withColumnRenamed("c", f"c{j}")
        out = out.join(own, [*h, "s"], "left")
        if j:
            out = out.join(t.groupBy(*h).agg(F.sum("c").alias(f"n{j}"), F.count("*").alias(f"t{j}")), h, "left")
    total = tables[0].agg(F.sum("c").alias("n0"), F.count("*").alias("t0"))
    out = out.join(F.broadcast(total))  # one row
    c0 = F.coalesce("c0", F.lit(0))
    if base:
        out = out.withColumn("p1", (c0 + F.col("t0") * F.col(base)) / (F.col("n0") + F.col("t0")))
    else:
        out = out.withColumn("p1", F.coalesce("c0", "t0") / (F.col("n0") + F.col("t0")))
    for j in range(1, order):
        mixed = (F.coalesce(f"c{j}", F.lit(0)) + F.col(f"t{j}") * F.col(f"p{j}")) / (F.col(f"n{j}") + F.col(f"t{j}"))
        out = out.withColumn(f"p{j + 1}", F.when(F.col(f"n{j}").isNull(), F.col(f"p{j}")).otherwise(mixed))
    return out.withColumn("oov", F.col("c0").isNull()).drop(*[f"{x}{j}" for x in "cnt" for j in range(order)])


def unit_scores(train: DataFrame, test: DataFrame, order: int, unit: str) -> DataFrame:
    """(unit, model_order, bits, events, oov) of test sequences under models of order 1 to `order` of train."""
    tables = counts(events(train, order), order)
    # equal events of a unit are scored once
    asked = events(test, order, unit).groupBy(unit, *[f"h{k}" for k in range(1, order)], "s").agg(F.count("*").alias("times"))
    p = probabilities(asked, tables)
    each = p.select(unit, "times", "oov", F.explode(F.array(*[F.struct(F.lit(k).alias("model_order"), (-F.log2(f"p{k}")).alias("b")) for k in range(1, order + 1)])).alias("m"))
    return each.groupBy(unit, F.col("m.model_order").alias("model_order")).agg(F.sum(F.col("times") * F.col("m.b")).alias("bits"), F.sum("times").alias("events"), F.sum(F.when(F.col("oov"), F.col("times")).otherwise(0)).alias("oov"))


def linked(rows: DataFrame, context: int) -> DataFrame:
    """Token rows as events (…, h1…, s) of up to `context` tokens before in the segment."""
    over = "over (partition by record_id, segment order by token_index)"
    return rows.withColumns({f"h{k}": F.expr(f"lag(tok, {k}, '<TOKEN_BOS>') {over}") for k in range(1, context + 1)}).withColumnRenamed("tok", "s")


def token_scores(train: DataFrame, test: DataFrame, order: int, context: int, *keys: str) -> DataFrame:
    """(keys, context_order, bits, tokens, events, oov_tokens, oov_glyphs) under token models of up to `context` tokens
    of context, whose unseen tokens are spelled by a character model of `order`. An event is a glyph or a token's end."""
    characters = counts(events(train, order), order)
    tables = counts(linked(train, context), context + 1)
    history = [f"h{k}" for k in range(1, context + 1)]
    asked = linked(test, context).groupBy(*keys, *history, "s").agg(F.count("*").alias("times"))
    spelled = test.select(F.col("tok").alias("s"), "symbols").distinct()
    each = probabilities(events(spelled.withColumnRenamed("s", "word"), order, "word"), characters)
    spelling = each.groupBy(F.col("word").alias("s")).agg(F.exp(F.sum(F.log(f"p{order}"))).alias("spelling"), F.count("*").alias("size"), F.count_if("oov").alias("strange"))
    p = probabilities(asked.join(spelling, "s"), tables, base="spelling")
    by = F.explode(F.array(*[F.struct(F.lit(k).alias("context_order"), (-F.log2(f"p{k + 1}")).alias("b")) for k in range(1, context + 1)]))
    rows = p.select(*keys, "times", "size", "strange", "oov", by.alias("m"))
    n = F.col("times")
    return rows.groupBy(*keys, F.col("m.context_order").alias("context_order")).agg(
        F.sum(n * F.col("m.b")).alias("bits"), F.sum("times").alias("tokens"), F.sum(n * F.col("size")).alias("events"), F.sum(F.when(F.col("oov"), n).otherwise(0)).alias("oov_tokens"),
        F.sum(n * F.col("strange")).alias("oov_glyphs"),
    )


def event_scores(train: DataFrame, test: DataFrame, order: int, *keys: str) -> DataFrame:
    """(keys, model_order, total_bits, total_events, glyph_bits, glyph_events, boundary_bits, boundary_events, oov_events)
    of test sequences under models of order 1 to `order` of train: bits of glyphs and of word boundaries apart."""
    tables = counts(events(train, order), order)
    asked = events(test, order, *keys).groupBy(*keys, *[f"h{k}" for k in range(1, order)], "s").agg(F.count("*").alias("times"))
    p = probabilities(asked, tables)
    each = p.select(*keys, "times", "oov", (F.col("s") == BOUNDARY).alias("at"), F.explode(F.array(*[F.struct(F.lit(k).alias("model_order"), (-F.log2(f"p{k}")).alias("b")) for k in range(1, order + 1)])).alias("m"))
    n, bits = F.col("times"), F.col("times") * F.col("m.b")
    only = lambda when, v: F.sum(F.when(when, v).otherwise(0))
    return each.groupBy(*keys, F.col("m.model_order").alias("model_order")).agg(
        F.sum(bits).alias("total_bits"), F.sum(n).alias("total_events"), only(~F.col("at"), bits).alias("glyph_bits"), only(~F.col("at"), n).alias("glyph_events"), only(F.col("at"), bits).alias("boundary_bits"),
        only(F.col("at"), n).alias("boundary_events"), only(F.col("oov"), n).alias("oov_events"),
    )


SUMS = ("total_bits", "total_events", "glyph_bits", "glyph_events", "boundary_bits", "boundary_events", "oov_events")


def three_levels(scores: DataFrame, model: str, unit: str, *line: str) -> DataFrame:
    """Sums and ratios of sums by line, unit and corpus: level says which, and columns finer than the level are null. The
    corpus' rows have bits saved and the share of bits saved against the model of order 1."""
    sets = [[model, unit, *line], [model, unit], [model]]
    s = scores.groupingSets(sets, model, unit, *line).agg(*[F.sum(c).alias(c) for c in SUMS], F.grouping(unit).alias("__u"), F.grouping(line[0]).alias("__l"))
    level = F.when(F.col("__u") == 1, "corpus").when(F.col("__l") == 1, "unit").otherwise("line")
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    s = s.withColumn("level", level).drop("__u", "__l").withColumn("bits_per_event", per("total_bits", "total_events"))
    s = s.withColumn("perplexity", F.pow(F.lit(2.0), "bits_per_event")).withColumn("glyph_bits_per_glyph", per("glyph_bits", "glyph_events")).withColumn("boundary_bits_per_boundary", per("boundary_bits", "boundary_events"))
    first = scores.where(F.col(model) == 1).agg((F.sum("total_bits") / F.sum("total_events")).alias("__b1"), F.sum("total_bits").alias("__t1"))
    s = s.join(F.broadcast(first))  # one row
    whole = F.col("level") == "corpus"
    s = s.withColumn("bits_saved", F.when(whole, F.col("__b1") - F.col("bits_per_event"))).withColumn("share_saved", F.when(whole, 1 - F.try_divide(F.col("total_bits"), F.col("__t1")))).drop("__b1", "__t1")
    names = ("total_bits", "glyph_bits", "boundary_bits", "bits_per_event", "perplexity", "glyph_bits_per_glyph", "boundary_bits_per_boundary", "bits_saved", "share_saved")
    return s.withColumns({c: F.round(c, 5) + 0.0 for c in names})


def corpus_rollup(scores: DataFrame, unit: str, *keys: str) -> DataFrame:
    """(keys, unit or null for all, bits_per_event, perplexity, events): ratios of sums at both levels."""
    total = F.sum("bits") / F.sum("events")
    sets = [[*keys, unit], [*keys]]
    return scores.groupingSets(sets, *keys, unit).agg(F.round(total, 6).alias("bits_per_event"), F.round(F.pow(2.0, total), 6).alias("perplexity"), F.sum("events").alias("events"))

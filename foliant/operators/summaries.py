"""Bins, position classes, summaries by family, and decisions by how often a result recurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upper_bound_bin(value: Column, bounds: Sequence[float], open_end: bool = True, strict: bool = False) -> Column:
    """The first bound that value doesn't exceed, as a label; beyond the last `>bound`, or null if not open_end.
    Null and negative values have none; strict: a negative value, or one beyond a closed end, is an error when it is read."""
    if any(b <= a for a, b in zip(bounds, bounds[1:])):
        raise ValueError("bounds must rise")
    if strict:
        bad = (value < 0) if open_end else (value < 0) | (value > bounds[-1])
        value = F.when(bad, F.raise_error(F.concat(F.lit("no bin for "), value.cast("string"))).cast("double")).otherwise(value)
    out = F.when(value.isNull() | (value < 0), None)
    for b in bounds:
        out = out.when(value <= b, f"<={b}")
    return out.otherwise(f">{bounds[-1]}" if open_end else None)


def position_class(index: Column, size: Column) -> Column:
    """singleton, initial, final or medial, of a place counted from 0."""
    return F.when(size == 1, "singleton").when(index == 0, "initial").when(index == size - 1, "final").otherwise("medial")


def by_family(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, population standard deviation (0 for one row), minimum, maximum and how many are above zero."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), (F.round(F.stddev_pop(v), 6) + 0.0).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v > 0).alias("positive")
    )


def replication(rows: DataFrame, group: str, strong: str, least: float) -> DataFrame:
    """(group, runs, strong_runs, replicated): whether at least that share of a group's runs is strong."""
    n = F.count_if(F.col(strong))
    return rows.groupBy(group).agg(F.count("*").alias("runs"), n.alias("strong_runs"), (n >= F.lit(least) * F.count("*")).alias("replicated"))


def top_shares(rows: DataFrame, group: str, item: str, weight: str, most: int) -> DataFrame:
    """The `most` items of each group by their share of its weight: a top-k report over few items a group."""
    n = rows.groupBy(group, item).agg(F.sum(weight).alias("w"))
    total = n.groupBy(group).agg(F.sum("w").alias("t"))
    shared = n.join(total, group).withColumn("share", F.round(F.col("w") / F.col("t"), 6))
    return shared.withColumn("place", F.expr(f"row_number() over (partition by {group} order by w desc, {item})")).where(F.col("place") <= most).select(group, item, "share", "place")


def monotone(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, steps, rising): whether value never falls along order; a group has few steps."""
    before = F.expr(f"lag({value}) over (partition by {group} order by {order})")
    s = rows.withColumn("__ok", F.coalesce(F.col(value) >= before, F.lit(True)))
    return s.groupBy(group).agg(F.count("*").alias("steps"), F.bool_and("__ok").alias("rising"))


def relation_summary(rows: DataFrame, value: str, strong: str, *keys: str) -> DataFrame:
    """By keys: runs, mean, median, population standard deviation, minimum and maximum of value, and how many runs are above
    zero and strong."""
    v = F.col(value)
    r = lambda c: F.round(c, 6) + 0.0
    return rows.groupBy(*keys).agg(
        F.count("*").alias("runs"), r(F.avg(v)).alias("mean"), r(F.percentile(value, 0.5)).alias("median"), r(F.stddev_pop(v)).alias("sd"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"), F.count_if(v > 0).alias("positive"),
        F.count_if(F.col(strong)).alias("strong"),
    )


def two_level_replication(rows: DataFrame, family: str, relation: str, language: str, strong: str, runs: int, least_runs: int, least_languages: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages, relations, families): a language replicates a relation if at least least_runs of its runs are strong; a
    relation is robust in a family if least_languages languages replicate it; a family holds the whole hierarchy if all
    its relations are robust. A language with another number of runs than `runs` is an error when it is read."""
    n = rows.groupBy(family, relation, language).agg(F.count("*").alias("runs"), F.count_if(F.col(strong)).alias("strong"))
    told = F.raise_error(F.concat(F.lit(f"not {runs} runs but "), F.col("runs"), F.lit(" of "), F.col(language))).cast("long")
    languages = n.withColumn("runs", F.when(F.col("runs") == runs, F.col("runs")).otherwise(told)).withColumn("replicated", F.col("strong") >= least_runs)
    relations = languages.groupBy(family, relation).agg(
        F.count_if("replicated").alias("languages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("replicated"), F.col(language)))), "|").alias("replicated_in"), (F.count_if("replicated") >= least_languages).alias("robust")
    )
    families = relations.groupBy(family).agg(F.count_if("robust").alias("robust_relations"), F.bool_and("robust").alias("whole_hierarchy"))
    return languages, relations, families


def changes(rows: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """By keys: runs, the means before and after, the mean change and its spread, and how many runs went down."""
    d = F.col(after) - F.col(before)
    r = lambda c: F.round(c, 6) + 0.0
    return rows.groupBy(*keys).agg(
        F.count("*").alias("runs"), r(F.avg(before)).alias("mean_before"), r(F.avg(after)).alias("mean_after"), r(F.avg(d)).alias("mean_change"), r(F.stddev_pop(d)).alias("sd_change"), F.count_if(d < 0).alias("reduced")
    )


def means(rows: DataFrame, values: Sequence[str], *keys: str) -> DataFrame:
    """By keys: runs and the mean of each value, over the rows that have it."""
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), *[F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values])


def flattened(rows: DataFrame, nested: str, prefix: str) -> DataFrame:
    """rows with the fields of a struct column as columns of their own, named by a prefix."""
    names = rows.schema[nested].dataType.names
    return rows.select(*[c for c in rows.columns if c != nested], *[F.col(f"{nested}.{n}").alias(f"{prefix}{n}") for n in names])


def exact_cycle(rates: DataFrame, cycle: int, tolerance: float, *keys: str) -> DataFrame:
    """By keys, of rates (lag, rate): whether the rate is 1 at `cycle` and 0 at every shorter lag, within the tolerance, and so
    the contrast 1. A lag that is missing is none."""
    far = lambda want: F.abs(F.col("rate") - want) <= tolerance
    good = F.count_if((F.col("lag") == cycle) & far(1.0)) + F.count_if((F.col("lag") < cycle) & (F.col("lag") >= 1) & far(0.0))
    contrast = F.max(F.when(F.col("lag") == cycle, F.col("rate"))) - F.avg(F.when(F.col("lag") < cycle, F.col("rate")))
    exact = (good == cycle) & (F.abs(contrast - 1.0) <= tolerance)
    return rates.groupBy(*keys).agg(F.coalesce(exact, F.lit(False)).alias("exact")) if keys else rates.agg(F.coalesce(exact, F.lit(False)).alias("exact"))

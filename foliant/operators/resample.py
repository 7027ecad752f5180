"""Resampling, leave-one-out and rank statistics over unit scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.numbering import prefix_sums
from foliant.session import written


def draw(*parts: Column | str) -> Column:
    """A draw from 0 to 2^32 - 1 that depends on its parts only, on any engine that has SHA-256."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def draw64(*parts: Column | str) -> Column:
    """A draw from 0 to 2^64 - 1, as a decimal: the first eight bytes of the parts' SHA-256."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


#: The most units that are sent to all tasks for replicates to look up; of more, equal draws are counted and joined.
MOST_UNITS = 200_000


def paired_bootstrap(deltas: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """deltas (unit, delta_bits, events) → (replicate, delta): ratio of sums over units drawn with replacement.
    Units are numbered in parts of a hash, so no task holds them all; draws meet units by number."""
    deltas = written(deltas.select("unit", "delta_bits", "events"), "deltas")
    parted = deltas.withColumn("part", F.substring(F.sha2(F.col("unit").cast("string"), 256), 1, 3))
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.expr("sum(n) over (order by part) - n").alias("before"))  # 4,096 rows at most
    numbered = parted.withColumn("own", F.expr("row_number() over (partition by part order by unit) - 1")).join(F.broadcast(before), "part")
    numbered = numbered.select((F.col("own") + F.col("before")).alias("number"), "delta_bits", "events")
    many = deltas.agg(F.count("*").alias("units"))
    spark = deltas.sparkSession
    reps = spark.range(replicates).select(F.col("id").alias("replicate")).join(F.broadcast(many))
    draws = reps.select("replicate", "units", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("i"))
    drawn = draws.select("replicate", (draw(F.lit(seed), "replicate", "i") % F.col("units")).alias("number"))
    if deltas.limit(MOST_UNITS + 1).count() <= MOST_UNITS:
        drawn, numbered = drawn.withColumn("w", F.lit(1)), F.broadcast(numbered)
    else:
        drawn = drawn.groupBy("replicate", "number").agg(F.count("*").alias("w"))
    return drawn.join(numbered, "number").groupBy("replicate").agg((F.sum(F.col("w") * F.col("delta_bits")) / F.sum(F.col("w") * F.col("events"))).alias("delta"))


def interval(replicates: DataFrame, value: str = "delta") -> DataFrame:
    """(replicates, mean, lower, upper, share_above_zero): the central 95 percent."""
    q = F.percentile(value, [0.025, 0.975])
    return replicates.agg(F.count("*").alias("replicates"), F.round(F.avg(value), 6).alias("mean"), F.round(F.get(q, F.lit(0)), 6).alias("lower"), F.round(F.get(q, F.lit(1)), 6).alias("upper"), F.round(F.avg((F.col(value) > 0).cast("double")), 6).alias("share_above_zero"))


def relation(name: str, competitor: DataFrame, trigram: DataFrame, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """One row of two models scored on the same units (unit, bits, events): bits an event of both, their difference
    (competitor less trigram) with its interval, the share of replicates in which the competitor is worse, and which way
    the interval points: worse, better or open. Units or events that only one side has are an error."""
    a, b = (x.select("unit", F.col("bits").alias(f"{n}_bits"), F.col("events").alias(f"{n}_events")) for x, n in ((competitor, "c"), (trigram, "t")))
    both = a.join(b, "unit", "full_outer")
    told = F.raise_error(F.concat(F.lit(f"{name}: not the same events in unit "), "unit")).cast("long")
    both = both.withColumn("events", F.when(F.col("c_events") == F.col("t_events"), F.col("c_events")).otherwise(told)).withColumn("delta_bits", F.col("c_bits") - F.col("t_bits"))
    both = written(both, "relation")
    sums = both.agg(F.count("*").alias("units"), F.sum("events").alias("events"), F.sum("c_bits").alias("c"), F.sum("t_bits").alias("t"))
    r = interval(paired_bootstrap(both, replicates, seed))
    per = lambda c: F.round(F.col(c) / F.col("events"), 6)
    way = F.when(F.col("lower") > 0, "worse").when(F.col("upper") < 0, "better").otherwise("open")
    return sums.join(r).select(
        F.lit(name).alias("relation"), "units", "events", per("c").alias("competitor_bits_per_event"), per("t").alias("trigram_bits_per_event"), F.round((F.col("c") - F.col("t")) / F.col("events"), 6).alias("delta"),
        "replicates", "lower", "upper", F.col("share_above_zero").alias("share_worse"), way.alias("direction"),
    )


def leave_one_out(deltas: DataFrame) -> DataFrame:
    """(unit, delta_without, influence): the ratio of sums without each unit."""
    total = deltas.agg(F.sum("delta_bits").alias("b"), F.sum("events").alias("e"))
    own = deltas.join(F.broadcast(total))  # one row
    without = F.try_divide(F.col("b") - F.col("delta_bits"), F.col("e") - F.col("events"))
    return own.select("unit", F.round(without, 6).alias("delta_without"), F.round(F.col("b") / F.col("e") - without, 6).alias("influence"))


def average_ranks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """rows with `<value>_rank`, ties sharing the mean of their ranks. Ranks go over counts of equal values, by key."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    r = prefix_sums(n, value, "__n", *keys, before="__b", total="__t").withColumn(f"{value}_rank", F.col("__b") + (F.col("__n") + 1) / 2).drop("__n", "__b", "__t")
    return rows.join(r, [*keys, value], "left")


def correlation(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, n_missing, r) over complete pairs; r is null for under two pairs or where a side doesn't vary."""
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(whole, F.col(c).cast("double")) for c in (x, y))
    varies = (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    cov = F.covar_pop(a, b)
    r = F.when(varies, cov / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.count_if(whole).alias("n"), F.count_if(~whole).alias("n_missing"), F.round(r, 6).alias("r"))


def percentile_rank(rows: DataFrame, value: str) -> DataFrame:
    """rows with `<value>_percentile`: (below + half of equal) / n."""
    n = rows.groupBy(value).agg(F.count("*").alias("__n"))
    r = prefix_sums(n, value, "__n", before="__b", total="__t").withColumn(f"{value}_percentile", F.round((F.col("__b") + F.col("__n") / 2) / F.col("__t"), 6)).drop("__n", "__b", "__t")
    return rows.join(r, value)


def against_others(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, value, others_mean, others_sd, z): each unit against all the others, from totals."""
    t = rows.agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    own = rows.join(F.broadcast(t))  # one row
    m = F.try_divide(F.col("s") - F.col(value), F.col("n") - 1)
    var = F.try_divide(F.col("q") - F.col(value) * F.col(value), F.col("n") - 1) - m * m
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return own.select(unit, value, F.round(m, 6).alias("others_mean"), F.round(sd, 6).alias("others_sd"), F.round(F.when(sd > 1e-9, (F.col(value) - m) / sd), 6).alias("z"))


def anomalies(rows: DataFrame, unit: str, *values: str) -> DataFrame:
    """(unit, feature, value, others_mean, others_sd, z, percentile, median): each unit against all the others in each of the
    values, with its place among all and the median of all. A unit without a value is left out of it."""
    out = None
    for v in values:
        own = rows.select(unit, F.col(v).cast("double").alias("value")).where("value is not null")
        median = own.agg(F.round(F.percentile("value", 0.5), 6).alias("median"))
        placed = percentile_rank(own, "value").select(unit, F.col("value_percentile").alias("percentile"))
        one = against_others(own, unit, "value").join(placed, unit).join(F.broadcast(median)).withColumn("feature", F.lit(v))  # one row
        out = one if out is None else out.unionByName(one)
    return out


def conditional_correlation(rows: DataFrame, x: str, y: str, condition: Column, *keys: str) -> DataFrame:
    """correlation over the rows that meet a condition, with how many don't (n_omitted); a key none of whose rows do comes out
    with no pairs."""
    meets = F.coalesce(condition, F.lit(False))
    kept = rows.withColumns({f"__{c}": F.when(meets, F.col(c)) for c in (x, y)})
    own = correlation(kept, f"__{x}", f"__{y}", *keys)
    omitted = kept.groupBy(*keys).agg(F.count_if(~meets).alias("n_omitted"))
    both = own.join(omitted, list(keys)) if keys else own.join(F.broadcast(omitted))
    return both.withColumn("n_missing", F.col("n_missing") - F.col("n_omitted"))

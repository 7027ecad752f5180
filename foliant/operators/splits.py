"""Deterministic splits, crops and cuts of ordered units, and profiles of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import page_name
from foliant.operators.numbering import prefix_sums


def largest_remainder(total: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers that add up to total, by share; left-over units go to the largest fractions, ties in order."""
    exact = {k: total * v for k, v in shares.items()}
    whole = {k: int(v) for k, v in exact.items()}
    order = sorted(shares, key=lambda k: whole[k] - exact[k])
    for k in order[: total - sum(whole.values())]:
        whole[k] += 1
    return whole


def hash_ranked_split(units: DataFrame, unit: str, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """(unit, split): units in order of a salted SHA-256, cut by largest remainder. The hash's first byte makes parts,
    so that ranks need no task with all units."""
    h = F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.col(unit).cast("string")), 256)
    rows = units.select(unit).distinct().select(unit, h.alias("h"), F.substring(h, 1, 2).alias("part"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.expr("sum(n) over (order by part) - n").alias("before"), F.expr("sum(n) over ()").alias("total"))
    ranked = rows.withColumn("own", F.expr(f"row_number() over (partition by part order by h, {unit}) - 1")).join(F.broadcast(before), "part")
    at, total = F.col("own") + F.col("before"), F.col("total")
    names = list(shares)
    # largest remainder in SQL, as the total is known only there
    exact = {k: total * F.lit(v) for k, v in shares.items()}
    frac = F.array(*[F.struct((F.floor(exact[k]) - exact[k]).alias("f"), F.lit(i).alias("i")) for i, k in enumerate(names)])
    extra = F.slice(F.transform(F.array_sort(frac), lambda x: x["i"]), F.lit(1), (total - sum((F.floor(exact[k]) for k in names), F.lit(0))).cast("int"))
    upto, split = F.lit(0), None
    for i, k in enumerate(names):
        upto = upto + F.floor(exact[k]) + F.array_contains(extra, i).cast("int")
        split = F.when(at < upto, k) if split is None else split.when(at < upto, k)
    return ranked.select(unit, split.otherwise(names[-1]).alias("split"))


def running(rows: DataFrame, order: str, weight: str, *keys: str) -> DataFrame:
    """rows with `before`, the sum of weight of all rows earlier in order (unique within keys), and `total`."""
    return prefix_sums(rows, order, weight, *keys)


def prefix(rows: DataFrame, order: str, weight: str, target: int, *keys: str) -> DataFrame:
    """The shortest prefix of whole rows that reaches the target."""
    return running(rows, order, weight, *keys).where(F.col("before") < target).drop("total")


def cropped(rows: DataFrame, order: str, items: str, target: int, *keys: str) -> DataFrame:
    """Exactly `target` items (or all): the last row's array is cut."""
    r = running(rows.withColumn("__n", F.size(items)), order, "__n", *keys).where(F.col("before") < target)
    return r.withColumn(items, F.slice(items, F.lit(1), F.least(F.col("__n"), F.lit(target) - F.col("before")).cast("int"))).drop("__n", "before", "total")


def closest_cut(rows: DataFrame, order: str, weight: str, share: float, *keys: str, least: int = 0) -> DataFrame:
    """(keys, cut, reached): the row after which the running sum is closest to its share of the total, with at least `least`
    rows on either side. A key of fewer than twice as many has none."""
    r = running(rows, order, weight, *keys).withColumn("upto", F.col("before") + F.col(weight))
    if least:
        r = prefix_sums(r.withColumnRenamed("total", "__total").withColumn("__one", F.lit(1)), order, "__one", *keys, before="__k", total="__n").withColumnRenamed("__total", "total")
        r = r.where((F.col("__k") + 1 >= least) & (F.col("__n") - F.col("__k") - 1 >= least))
    gap = F.abs(F.col("upto") - F.lit(share) * F.col("total"))
    return r.groupBy(*keys).agg(F.min_by(order, F.struct(gap, order)).alias("cut"), F.min_by("upto", F.struct(gap, order)).alias("reached"))


def closing_units(rows: DataFrame, order: str, weight: str, units: int, *keys: str) -> DataFrame:
    """rows with `unit`: contiguous units, each closed by the row that brings the sum to its share, one at a row, and early
    where as many rows are left as units. A key of fewer rows than units is an error.

    With t the shares that the sum has reached after a row, the units closed are the least, over earlier rows, of
    t there and the rows since; at least as many are closed as the rows that are left demand."""
    r = running(rows, order, weight, *keys).withColumn("__t", F.least(F.floor((F.col("before") + F.col(weight)) * units / F.col("total")), F.lit(units - 1).cast("long")))
    r = prefix_sums(r.drop("before", "total").withColumn("__one", F.lit(1)), order, "__one", *keys, before="__k", total="__n")
    over = f"over ({'partition by ' + ', '.join(keys) if keys else ''} order by {order})"
    place = F.col("__k") + 1
    free = F.least(place, place + F.expr(f"min(__t - (__k + 1)) {over}"))
    closed = F.least(F.greatest(free, units - (F.col("__n") - place)), F.lit(units - 1))
    r = r.withColumn("__c", closed).withColumn("unit", F.expr(f"coalesce(lag(__c) {over}, 0)").cast("int"))
    checked = F.when(F.col("__n") >= units, F.col("unit")).otherwise(F.raise_error(F.lit(f"fewer rows than {units} units")).cast("int"))
    return r.withColumn("unit", checked).drop("__t", "__k", "__n", "__c", "__one")


def balanced_units(rows: DataFrame, order: str, weight: str, units: int, *keys: str) -> DataFrame:
    """rows with `unit`: contiguous units of about equal weight, by where each row's middle lies."""
    r = running(rows, order, weight, *keys)
    middle = (F.col("before") + F.col(weight) / 2) / F.col("total")
    return r.withColumn("unit", F.least(F.floor(middle * units), F.lit(units - 1)).cast("int")).drop("before", "total")


def leaf_profiles(loci: DataFrame) -> DataFrame:
    """(leaf, locus_count, folios, section_presence, locus_type_counts): of records with a leaf, each once."""
    last = loci.where("physical_leaf is not null").groupBy("record_id").agg(F.max_by(F.struct("physical_leaf", "folio", "section", "locus_type"), "ingested_at").alias("r")).select("r.*")
    page = page_name(F.col("folio"))
    types = last.groupBy("physical_leaf", "locus_type").agg(F.count("*").alias("n")).groupBy("physical_leaf").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locus_type", "n")))).alias("locus_type_counts"))
    own = last.groupBy("physical_leaf").agg(F.count("*").alias("locus_count"), F.array_sort(F.collect_set(page)).alias("folios"), F.array_sort(F.collect_set(F.coalesce("section", F.lit("UNSET")))).alias("sections"))
    return own.join(types, "physical_leaf").withColumnRenamed("physical_leaf", "leaf")


def mixed_label(values: Column) -> Column:
    """One label for a set of values: UNKNOWN, the only one, or MIXED[a|b]."""
    v = F.array_sort(values)
    return F.when(F.size(v) == 0, "UNKNOWN").when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(F.concat(F.lit("MIXED["), F.array_join(v, "|"), F.lit("]")))


def coverage_gaps(rows: DataFrame, unit: str, category: str, split: str, least: int = 3) -> DataFrame:
    """(category, split, units): categories on `least` or more units that a split lacks or holds on few, with the
    number of units it has them on; a row for each pair, 0 where absent."""
    known = rows.groupBy(category).agg(F.count_distinct(unit).alias("all_units")).where(F.col("all_units") >= least).select(category)
    # categories and splits are labels, few by definition
    grid = known.join(F.broadcast(rows.select(split).distinct()))
    have = rows.groupBy(category, split).agg(F.count_distinct(unit).alias("units"))
    return grid.join(have, [category, split], "left").select(category, split, F.coalesce("units", F.lit(0)).alias("units"))

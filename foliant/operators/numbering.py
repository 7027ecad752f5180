"""Numbers and running sums within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written


def numbered_within(rows: DataFrame, key: str, order: tuple[str, ...], name: str, part_size: int = 65_536) -> DataFrame:
    """rows with `name`, 0, 1, 2, … within key by order (unique; its first column a whole number). A group is numbered
    in parts of part_size values of that column; only counts of parts meet in a window over the group."""
    cut = rows.withColumn("__part", F.floor(F.col(order[0]) / part_size))
    sizes = cut.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = sizes.select(key, "__part", F.expr(f"sum(__n) over (partition by {key} order by __part) - __n").alias("__before"))
    own = cut.withColumn("__own", F.expr(f"row_number() over (partition by {key}, __part order by {', '.join(order)}) - 1"))
    return own.join(before, [key, "__part"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def prefix_sums(rows: DataFrame, order: str, weight: str, *keys: str, before: str = "before", total: str = "total") -> DataFrame:
    """rows with the sum of weight of all rows earlier in order (unique within keys) and of all rows, by keys or over all.
    Rows are cut into ranges of (keys, order), each summed by itself; only the ranges' sums meet in a window, so neither
    a hot key nor the lack of keys brings rows together."""
    ranged = rows.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # the ranges are drawn from a sample: they are fixed once written
    by = ", ".join(keys)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(weight).alias("__sum"))
    over = f"partition by {by}" if keys else ""
    sums = sums.withColumn("__before", F.expr(f"sum(__sum) over ({over} order by __range) - __sum")).withColumn(total, F.expr(f"sum(__sum) over ({over})")).drop("__sum")
    own = ranged.withColumn("__own", F.expr(f"sum({weight}) over (partition by {', '.join([*keys, '__range'])} order by {order}) - {weight}"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = own.alias("a").join(F.broadcast(sums.alias("b")) if not keys else sums.alias("b"), (F.col("a.__range") == F.col("b.__range")) & same)
    return met.select("a.*", (F.col("a.__own") + F.col("b.__before")).alias(before), F.col(f"b.{total}").alias(total)).drop("__own", "__range")

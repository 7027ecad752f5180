"""Filling containers of fixed capacity with items of varying size, with little unused space.

Method: exact-complement hashing over the table of sizes. From the largest size down, the gap that an item
leaves is looked up among the single sizes, then the sums of two and of three sizes that are available; each
combination found is used as often as its scarcest size allows. What is left over is packed best fit, the
largest size that still fits first, again as often as the counts allow. An item larger than the capacity is
cut into full pieces and a rest.

The plan is made from counts, never from items: at most `capacity` sizes, and each step uses up a size, so
it has at most some thousand rows at any number of items. Items then find their containers by their rank within
their size. Ranks are counted in salted parts of each size, so a size that a third of all items share is
split over tasks like any other.

Defined cases: an item of no size (a null, empty or negative one too) takes no room: its container is null; items are
never dropped, and repeated ids are items of their own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written

CAPACITY = 2048
#: Items of one size that one task ranks, on average; a bound on the parts of a size.
PART_ITEMS, MOST_PARTS = 200_000, 10_000


def _pair(available: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two available sizes that add up to total, the most unequal ones first."""
    if total < 2:
        return None
    low = np.arange(1, total // 2 + 1)
    fits = (available[low] > 0) & (available[total - low] > 0)
    if total % 2 == 0 and available[total // 2] < 2:
        fits[-1] = False
    at = fits.argmax()
    return (total - int(low[at]), int(low[at])) if fits[at] else None


def _complement(available: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available sizes that exactly fill the gap."""
    if available[gap] > 0:
        return (gap,)
    if two := _pair(available, gap):
        return two
    for a in np.flatnonzero(available[: gap - 1])[::-1]:
        available[a] -= 1
        two = _pair(available, gap - int(a))
        available[a] += 1
        if two:
            return (int(a), *two)
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: how many in a container) and the number of containers of each. counts[s]: items of size s."""
    left, patterns = counts.astype(np.int64).copy(), []

    def use(sizes: list[int]) -> None:
        of = {s: sizes.count(s) for s in set(sizes)}
        times = min(int(left[s]) // n for s, n in of.items())
        for s, n in of.items():
            left[s] -= n * times
        patterns.append((of, times))

    if left[capacity]:
        use([capacity])
    for size in range(capacity - 1, 0, -1):
        while left[size]:
            left[size] -= 1
            found = _complement(left, capacity - size)
            left[size] += 1
            if not found:
                break
            use([size, *found])
    for size in range(capacity - 1, 0, -1):
        while left[size]:
            sizes, gap, spare = [], capacity, left.copy()
            at = size
            while gap:
                fits = np.flatnonzero(spare[1 : min(gap, at) + 1])
                if not len(fits):
                    break
                at = int(fits[-1]) + 1
                n = min(int(spare[at]), gap // at)
                sizes += [at] * n
                spare[at] -= n
                gap -= at * n
                at = min(at, gap) if gap else at
            use(sizes)
    return patterns


def _ranges(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, in order of rank: the first rank of each range, its first container, its items a container."""
    out: dict[int, list] = {}
    taken, container = np.zeros(capacity + 1, np.int64), 0
    for of, times in patterns:
        for s, n in of.items():
            out.setdefault(s, []).append((taken[s], container, n))
            taken[s] += n * times
        container += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def _placed(ranges: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = np.full(len(b), -1, np.int64)
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                first, base, n = ranges[int(s)]
                r = rank[own]
                k = np.searchsorted(first, r, side="right") - 1
                to[own] = base[k] + (r - first[k]) // n[k]
            yield b.assign(container=to)[["container", "item", "piece", "start", "size"]]

    return run


def packed(items: DataFrame, item: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container, item, piece, start, size): a row for each piece of each item."""
    spark = items.sparkSession
    # read four times below, and sizes may be dear to compute
    rows = written(items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("whole")), "sizes")
    some = rows.where("whole > 0")
    last = F.floor((F.col("whole") - 1) / capacity).cast("int")
    pieces = some.select("item", "whole", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("item", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece").cast("long") * capacity).alias("size"))
    counted = pieces.groupBy("size").agg(F.count("*").alias("n")).toPandas()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[counted["size"]] = counted["n"]
    ranges = spark.sparkContext.broadcast(_ranges(plan(counts, capacity), capacity))
    parts = int(min(MOST_PARTS, 1 + counts.max(initial=0) // PART_ITEMS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
    sums = pieces.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = sums.select("size", "part", F.expr("sum(n) over (partition by size order by part) - n").alias("before"))
    ranked = pieces.withColumn("own", F.expr("row_number() over (partition by size, part order by item, piece) - 1"))
    ranked = ranked.join(before, ["size", "part"]).select("item", "piece", "start", "size", (F.col("own") + F.col("before")).alias("rank"))
    schema = f"container long, item {dict(rows.dtypes)['item']}, piece int, start long, size long"
    placed = ranked.mapInPandas(lambda it: _placed(ranges.value)(it), schema)
    none = rows.where("whole <= 0").select(F.lit(None).cast("long").alias("container"), "item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))
    return placed.unionByName(none)

"""Stratified splits of leaves: profiles, units of linked leaves, how far a split is from the whole, and a search for one
that is close.

A profile is a row for each (leaf, family, category) with n: for most families whether the leaf has the category, for
types of loci how often. Distances are aggregations over these. The search swaps units of equal size at random
from many random starts; starts run as tasks of their own, each with all units, which are therefore checked to be at
most MOST_UNITS.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import UNSET
from foliant.operators.splits import largest_remainder

MOST_UNITS = 100_000
SPLITS = ("train", "validation", "test")
#: What each family counts for, and what a category that a split lacks costs.
WEIGHTS = {"currier": 1.0, "scribe": 1.0, "section": 1.0, "locus_type": 1.0}
LOCUS_WEIGHT, GAP = 0.75, 100.0
#: Families whose categories every split should have, if they stand on so many leaves.
COVERED, LEAST_LEAVES = ("currier", "scribe", "section"), 3


def profiles(records: DataFrame, leaf: str = "physical_leaf") -> DataFrame:
    """(leaf, family, category, n) of records with a leaf, and as family `loci` how many there are."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNSET))
    pairs = [F.struct(F.lit(f).alias("family"), known(f).alias("category")) for f in ("currier", "scribe", "section", "quire", "locus_type") if f in records.columns]
    each = records.where(F.col(leaf).isNotNull()).select(F.col(leaf).alias("leaf"), F.inline(F.array(*pairs, F.struct(F.lit("loci").alias("family"), F.lit("all").alias("category")))))
    n = each.groupBy("leaf", "family", "category").agg(F.count("*").alias("n"))
    return n.withColumn("n", F.when(F.col("family").isin("locus_type", "loci"), F.col("n")).otherwise(F.lit(1)))


def linked_units(own: DataFrame, special_pages: DataFrame) -> DataFrame:
    """profiles by unit: (unit, leaf_count, family, category, n). Leaves that a special page links are one unit, named after
    the smallest; every other leaf is its own. Links are pairs or few leaves, which don't overlap."""
    links = special_pages.select(F.array_min("linked_leaves").alias("unit"), F.explode("linked_leaves").alias("leaf")).groupBy("leaf").agg(F.min("unit").alias("unit"))
    rows = own.join(links, "leaf", "left").withColumn("unit", F.coalesce("unit", "leaf"))
    sizes = rows.groupBy("unit").agg(F.count_distinct("leaf").alias("leaf_count"))
    return rows.groupBy("unit", "family", "category").agg(F.sum("n").alias("n")).join(sizes, "unit")


def split_statistics(assigned: DataFrame) -> DataFrame:
    """(split, family, category, n) of rows (split, family, category, n, …), with 0 where a split lacks a category."""
    n = assigned.groupBy("split", "family", "category").agg(F.sum("n").alias("n"))
    # categories and splits are labels
    grid = n.select("family", "category").distinct().join(F.broadcast(n.select("split").distinct()))
    return grid.join(n, ["split", "family", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gaps(own: DataFrame, statistics: DataFrame) -> DataFrame:
    """(family, category, split): categories on LEAST_LEAVES leaves or more that a split lacks."""
    n = own.where(F.col("family").isin(*COVERED)).groupBy("family", "category").agg(F.count_distinct("leaf").alias("leaves"))
    return statistics.where("n = 0").join(n.where(F.col("leaves") >= LEAST_LEAVES), ["family", "category"]).select("family", "category", "split")


def objective(own: DataFrame, assigned: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """One row: the distance of a split (leaf, split) from the whole. For each family the squared differences of shares,
    weighted by the root of the whole's share, on average over categories; the squared differences of loci from the
    targets' shares; and GAP for each gap."""
    rows = own.join(assigned, "leaf")
    s = split_statistics(rows)
    total, local = s.groupBy("family", "category").agg(F.sum("n").alias("g")), s.groupBy("split", "family").agg(F.sum("n").alias("lt"))
    sums = total.groupBy("family").agg(F.sum("g").alias("gt"), F.count("*").alias("categories"))
    each = s.join(total, ["family", "category"]).join(local, ["split", "family"]).join(sums, "family")
    share, mine = F.col("g") / F.col("gt"), F.coalesce(F.try_divide(F.col("n"), F.col("lt")), F.lit(0.0))
    weight = F.coalesce(*[F.when(F.col("family") == f, F.lit(w)) for f, w in WEIGHTS.items()])
    kinds = each.where(F.col("family").isin(*WEIGHTS)).agg(F.sum(weight * F.sqrt(share) * F.pow(mine - share, 2) / F.col("categories")).alias("kinds"))
    spark = own.sparkSession
    wanted = spark.createDataFrame([(k, v / max(1, sum(targets.values()))) for k, v in targets.items()], "split string, want double")
    loci = each.where("family = 'loci'").join(wanted, "split").agg(F.sum(LOCUS_WEIGHT * F.pow(F.col("n") / F.col("gt") - F.col("want"), 2)).alias("loci"))
    missing = gaps(own, s).agg(F.count("*").alias("gaps"))
    one = kinds.join(loci).join(missing)  # one row each
    return one.select(F.round(F.col("kinds") + F.col("loci") + GAP * F.col("gaps"), 9).alias("objective"), F.round("kinds", 9).alias("kinds"), F.round("loci", 9).alias("loci"), "gaps")


class _Units:
    """All units as arrays, and the distance of an assignment from what its splits hold."""

    def __init__(self, rows: list, leaves: list, targets: Mapping[str, int]):
        self.ids = sorted({r["unit"] for r in rows})
        at = {u: i for i, u in enumerate(self.ids)}
        columns = sorted({(r["family"], r["category"]) for r in rows if r["family"] in WEIGHTS})
        place = {c: i for i, c in enumerate(columns)}
        self.holds, self.loci, self.size = np.zeros((len(at), len(columns))), np.zeros(len(at)), np.ones(len(at), np.int64)
        for r in rows:
            i = at[r["unit"]]
            self.size[i] = r["leaf_count"]
            if r["family"] == "loci":
                self.loci[i] += r["n"]
            elif r["family"] in WEIGHTS:
                self.holds[i, place[r["family"], r["category"]]] += r["n"]
        self.targets = np.array([targets[s] for s in SPLITS])
        self.want = self.targets / max(1, self.targets.sum())
        family = [f for f, _ in columns]
        self.spans = [(f, np.flatnonzero([x == f for x in family])) for f in dict.fromkeys(family)]
        whole = self.holds.sum(0)
        self.share = np.zeros(len(columns))
        for _, own in self.spans:
            self.share[own] = whole[own] / max(1.0, whole[own].sum())
        enough = {(r["family"], r["category"]) for r in leaves}
        self.asked = np.array([c in enough for c in columns], bool)

    def distance(self, stats: np.ndarray, loci: np.ndarray) -> float:
        out = LOCUS_WEIGHT * ((loci / max(1.0, loci.sum()) - self.want) ** 2).sum()
        for f, own in self.spans:
            n = stats[:, own]
            mine = n / np.maximum(n.sum(1, keepdims=True), 1)
            out += WEIGHTS[f] * (np.sqrt(self.share[own]) * (mine - self.share[own]) ** 2).sum() / max(1, len(own))
        return float(out + GAP * (stats[:, self.asked] == 0).sum())

    def start(self, rng: np.random.Generator) -> np.ndarray | None:
        """A random assignment that meets the targets, the largest units first."""
        for _ in range(100):
            left, of = self.targets.copy(), np.full(len(self.size), -1)
            for u in sorted(rng.permutation(len(self.size)), key=lambda u: -self.size[u]):
                room = np.where(left >= self.size[u], left, 0)
                if not room.any():
                    break
                of[u] = rng.choice(len(left), p=room / room.sum())
                left[of[u]] -= self.size[u]
            else:
                if not left.any():
                    return of
        return None

    def search(self, seed: int, proposals: int) -> tuple[float, list[int]] | None:
        rng = np.random.default_rng(seed)
        of = self.start(rng)
        if of is None:
            return None
        stats = np.stack([self.holds[of == k].sum(0) for k in range(len(SPLITS))])
        loci = np.array([self.loci[of == k].sum() for k in range(len(SPLITS))])
        best = self.distance(stats, loci)
        for _ in range(proposals):
            a, b = rng.choice(len(SPLITS), 2, replace=False)
            ours, theirs = np.flatnonzero(of == a), np.flatnonzero(of == b)
            ours = ours[np.isin(self.size[ours], self.size[theirs])]
            if not len(ours):
                continue
            u = rng.choice(ours)
            v = rng.choice(theirs[self.size[theirs] == self.size[u]])
            moved, change = stats.copy(), self.holds[v] - self.holds[u]
            moved[a] += change
            moved[b] -= change
            swapped = loci.copy()
            swapped[a] += self.loci[v] - self.loci[u]
            swapped[b] -= self.loci[v] - self.loci[u]
            now = self.distance(moved, swapped)
            if now < best - 1e-15:
                best, stats, loci = now, moved, swapped
                of[u], of[v] = b, a
        return best, of.tolist()


def optimised(own: DataFrame, special_pages: DataFrame, shares: Mapping[str, float], restarts: int = 48, proposals: int = 500, seed: int = 0) -> tuple[DataFrame, float]:
    """((leaf, split), distance): of `restarts` searches the closest, of equals the first in order of its assignment. Numbers
    of leaves follow the shares by largest remainder."""
    spark = own.sparkSession
    rows = linked_units(own, special_pages)
    if rows.select("unit").distinct().count() > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units: the search holds them all in each task")
    held = rows.collect()  # at most MOST_UNITS units by their few categories
    n = own.where(F.col("family").isin(*COVERED)).groupBy("family", "category").agg(F.count_distinct("leaf").alias("leaves")).where(F.col("leaves") >= LEAST_LEAVES)
    targets = largest_remainder(sum({r["unit"]: r["leaf_count"] for r in held}.values()), shares)
    units = spark.sparkContext.broadcast(_Units(held, n.collect(), targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for k in b.column("id").to_pylist() if (x := units.value.search(seed * 1_000_003 + k, proposals))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], ["distance", "splits"])

    best = spark.range(restarts, numPartitions=min(restarts, 64)).mapInArrow(run, "distance double, splits array<int>").orderBy(F.round("distance", 12), "splits").first()
    if best is None:
        raise RuntimeError("no assignment meets the targets")
    of = spark.createDataFrame([(u, SPLITS[k]) for u, k in zip(units.value.ids, best["splits"])], "unit int, split string")
    leaves = own.select("leaf").distinct()
    links = special_pages.select(F.array_min("linked_leaves").alias("unit"), F.explode("linked_leaves").alias("leaf")).groupBy("leaf").agg(F.min("unit").alias("unit"))
    named = leaves.join(links, "leaf", "left").withColumn("unit", F.coalesce("unit", "leaf"))
    return named.join(of, "unit").select("leaf", "split"), float(best["distance"])

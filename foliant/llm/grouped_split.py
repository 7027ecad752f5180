"""Splits that keep related records together.

Method: random-mate contraction. Vertices are leaves, edges tie them. Each round every vertex draws a coin; a
tail with a head among its neighbours collapses into the smallest such head, and the edges follow. Rounds go on
until no edge is left (about log n of them), then the collapses are unwound to labels, halving the way each time, and the
components are split by cumulative weight. Every step is a join or an aggregation over edges; no component is ever gathered,
and each round's edges are written to the shared folder, which cuts the lineage.

Ties are emitted as stars around a row's smallest leaf, never as all pairs of a row.

Defined cases: null leaves, pages and arrays tie nothing; repeated rows and items are one tie; a page without a
leaf that is not special ties nothing and is a group of its own in the split, as are records without a page;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import page_leaf, page_name
from foliant.session import bounded, written


def leaf_ties(units: DataFrame, profiles: DataFrame, special_pages: DataFrame) -> DataFrame:
    """(u, v), u < v: the tied leaves, as stars."""
    special = special_pages.select(page_name(F.col("folio")).alias("page"), page_leaf(F.col("folio")).alias("own"), F.coalesce("linked_leaves", F.array().cast("array<int>")).alias("linked"))
    linked = special.select(F.concat("linked", F.array("own")).alias("leaves"))
    # pages without a leaf in their name belong to their linked leaves; special pages are broadcast as long as they are few
    homeless = bounded(special.where("own is null").select("page", "linked"))

    def pages_of(rows: DataFrame, key: str, pages: str) -> DataFrame:
        """(key, leaf) of each page that a row names."""
        each = rows.select(key, F.explode(pages).alias("folio")).select(key, page_name(F.col("folio")).alias("page"), page_leaf(F.col("folio")).alias("own"))
        found = each.join(homeless, "page", "left")
        return found.select(key, F.explode(F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.col("linked"))).alias("leaf"))

    def star(members: DataFrame, key: str) -> DataFrame:
        centre = members.where("leaf is not null").groupBy(key).agg(F.min("leaf").alias("u"))
        return members.join(centre, key).select("u", F.col("leaf").alias("v"))

    by_leaves = units.select(F.array_min("leaves").alias("u"), F.explode("leaves").alias("v"))
    # a unit's pages tie to its smallest leaf, or to each other where it names no leaf
    unit_pages = pages_of(units.withColumn("__u", F.struct(F.coalesce("unit_id", F.lit("")), F.array_min("leaves").alias("least"))), "__u", "special_pages")
    by_pages = unit_pages.where("__u.least is not null").select(F.col("__u.least").alias("u"), F.col("leaf").alias("v"))
    pages_only = star(unit_pages.where("__u.least is null"), "__u")
    by_profile = pages_of(profiles, "leaf", "folios").toDF("u", "v")
    by_link = linked.select(F.array_min("leaves").alias("u"), F.explode("leaves").alias("v"))
    ties = by_leaves.union(by_pages).union(pages_only).union(by_profile).union(by_link).where("u is not null and v is not null and u <> v")
    return ties.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame, seed: int = 0, most_rounds: int = 200) -> DataFrame:
    """(vertex, root) of every vertex of edges (u, v); root is the smallest vertex of the component."""
    left = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    vertices = left.select(F.col("u").alias("vertex")).union(left.select("v")).distinct()
    collapsed: list[DataFrame] = []

    def head(vertex: str, turn: int) -> Column:
        return F.xxhash64(F.col(vertex), F.lit(seed), F.lit(turn)) % 2 == 0

    for turn in range(most_rounds):
        if left.isEmpty():
            break
        both = left.union(left.select("v", "u"))
        # drawn by hash from this round's written edges, so the same whenever they are asked for
        mates = both.where(~head("u", turn) & head("v", turn)).groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("into"))
        collapsed.append(mates)
        moved = left.join(mates.select(F.col("vertex").alias("u"), F.col("into").alias("u2")), "u", "left")
        moved = moved.join(mates.select(F.col("vertex").alias("v"), F.col("into").alias("v2")), "v", "left")
        moved = moved.select(F.coalesce("u2", "u").alias("a"), F.coalesce("v2", "v").alias("b")).where("a <> b")
        left = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if not collapsed:
        return vertices.select("vertex", F.col("vertex").alias("root"))
    # every vertex collapses once at most, so what it collapsed into makes a forest no deeper than the rounds; each
    # turn halves the way to the last one
    labels = written(reduce(DataFrame.unionByName, collapsed), "labels")
    while True:
        later = labels.select(F.col("vertex").alias("into"), F.col("into").alias("after"))
        jumped = labels.join(later, "into", "left").select("vertex", F.coalesce("after", "into").alias("into"), F.col("after").isNotNull().alias("moved"))
        jumped = written(jumped, "labels")
        labels = jumped.select("vertex", "into")
        if jumped.where("moved").isEmpty():
            break
    whole = vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("into", "vertex").alias("at"))
    least = whole.groupBy("at").agg(F.min("vertex").alias("root"))
    return whole.join(least, "at").select("vertex", "root")


def split_by_weight(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """groups (group, weight) with the split of each: groups lie along a line, the heaviest classes of weight first
    and in hashed order within a class; each split takes its share of the line, a group goes where its middle lies.
    The sums go over at most 64 x 1024 parts of the line, then within each part, so no task sees all groups."""
    h = F.xxhash64(F.col("group"), F.lit(seed))
    line = groups.where("weight > 0").select("group", "weight", (-F.floor(F.log2("weight"))).alias("class"), F.pmod(h, F.lit(1024)).alias("slice"), h.alias("h"))
    parts = line.groupBy("class", "slice").agg(F.sum("weight").alias("w"))
    before = parts.select("class", "slice", F.expr("sum(w) over (order by class, slice) - w").alias("before"), F.expr("sum(w) over ()").alias("total"))
    own = F.expr("sum(weight) over (partition by class, slice order by h, `group`) - weight")
    placed = line.withColumn("own", own).join(before, ["class", "slice"])
    middle = (F.col("before") + F.col("own") + F.col("weight") / 2) / F.col("total")
    upto, split = 0.0, None
    for name, share in shares.items():
        upto += share
        split = F.when(middle <= upto, name) if split is None else split.when(middle <= upto, name)
    return placed.select("group", "weight", split.otherwise(list(shares)[-1]).alias("split"))


SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def page_groups(loci: DataFrame, ties: DataFrame, special_pages: DataFrame) -> DataFrame:
    """(record_id, group) of every record: its leaf's component, or its page where it has no leaf."""
    found = components(ties).select(F.col("vertex").alias("leaf"), "root")
    special = special_pages.select(page_name(F.col("folio")).alias("page"), F.array_min("linked_leaves").alias("linked"))
    last = loci.groupBy("record_id").agg(F.max_by("folio", F.struct("ingested_at", "folio")).alias("folio"))
    rows = last.select("record_id", page_name(F.col("folio")).alias("page"), page_leaf(F.col("folio")).alias("own"))
    rows = rows.join(bounded(special), "page", "left").withColumn("leaf", F.coalesce("own", "linked").cast("long"))
    rows = rows.join(found, "leaf", "left")
    return rows.select("record_id", F.coalesce(F.concat(F.lit("leaf "), F.coalesce("root", "leaf")), F.concat(F.lit("page "), "page"), F.lit("none")).alias("group"))


def assigned(loci: DataFrame, ties: DataFrame, special_pages: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(record_id, group, split) of every record of loci."""
    rows = written(page_groups(loci, ties, special_pages), "groups")
    splits = split_by_weight(rows.groupBy("group").agg(F.count("*").alias("weight")), shares)
    return rows.join(splits.select("group", "split"), "group")

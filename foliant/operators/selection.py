"""Choosing records by lists of leaves, and checks as tables.

A check is a row (check, violations); a data set is sound when every count is 0. Checks are DataFrames like any other:
they can be written, compared, or enforced, which reads their few rows on the driver and raises what they found.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import page_name
from foliant.session import bounded


def violations(name: str, rows: DataFrame) -> DataFrame:
    """The check `name`, violated by every row of rows."""
    return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(found: DataFrame, label: str = "check") -> None:
    """Raise where a check is violated; found holds a row a check."""
    bad = {r["check"]: r["violations"] for r in found.where("violations > 0").collect()}
    if bad:
        raise ValueError(f"{label}: " + ", ".join(f"{k} ({n})" for k, n in sorted(bad.items())))


def leaf_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(leaf, problem) of every line that isn't blank: problem is `invalid` where it is not f and digits, `duplicate`
    where the leaf stands in several lines, else null."""
    rows = lines.select(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")).alias("v")).where("v <> ''")
    leaf = F.when(F.col("v").rlike(r"^f\d+$"), F.expr("try_cast(substr(v, 2) as int)"))
    n = rows.select(leaf.alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    # one row for each leaf and for each line that is none
    return n.select("leaf", F.when(F.col("leaf").isNull(), "invalid").when(F.col("n") > 1, "duplicate").alias("problem"), "n")


def leaf_ids(lines: DataFrame, label: str, value: str = "value") -> DataFrame:
    """(leaf): the leaves of a list; a line that is no leaf, or a leaf named twice, is an error when it is read."""
    rows = leaf_lines(lines, value)
    told = F.raise_error(F.concat(F.lit(f"{label}: "), F.col("problem"), F.lit(" leaf id "), F.coalesce(F.col("leaf").cast("string"), F.lit(""))))
    return rows.select(F.when(F.col("problem").isNull(), F.col("leaf")).otherwise(told.cast("int")).alias("leaf"))


def _pages(special_pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """(page, linked, chosen): how many leaves each special page links, and how many of these are among leaves."""
    each = special_pages.select(page_name(F.col("folio")).alias("page"), F.explode("linked_leaves").alias("leaf")).where("leaf is not null").distinct()
    marked = each.join(leaves.select("leaf").distinct().withColumn("__in", F.lit(1)), "leaf", "left")
    return marked.groupBy("page").agg(F.count("*").alias("linked"), F.count("__in").alias("chosen"))


def select_by_leaves(records: DataFrame, leaves: DataFrame, special_pages: DataFrame, leaf: str = "physical_leaf", folio: str = "folio") -> DataFrame:
    """The records of the leaves, and of special pages all of whose linked leaves are among them. No other split is
    looked at. What is wrong with such a choice is told by selection_checks."""
    by_leaf = records.where(F.col(leaf).isNotNull()).join(leaves.select(F.col("leaf").alias(leaf)), leaf, "left_semi").select(*records.columns)
    whole = _pages(special_pages, leaves).where("linked = chosen").select("page")
    # special pages are those without a leaf of their own: a side of a few rows, which the planner sees
    extra = records.where(F.col(leaf).isNull()).withColumn("__page", page_name(F.col(folio))).join(whole.withColumnRenamed("page", "__page"), "__page", "left_semi")
    return by_leaf.unionByName(extra.select(*records.columns))


def selection_checks(records: DataFrame, leaves: DataFrame, special_pages: DataFrame, leaf: str = "physical_leaf", folio: str = "folio") -> DataFrame:
    """linked_leaves_apart: special pages of which only some leaves are chosen; no_rule: records with neither a leaf nor
    a special page; missing_leaf: chosen leaves without records; leaked_leaf: selected records of other leaves."""
    pages = _pages(special_pages, leaves)
    stray = records.where(F.col(leaf).isNull()).select(page_name(F.col(folio)).alias("page")).join(pages, "page", "left_anti")
    chosen = select_by_leaves(records, leaves, special_pages, leaf, folio).where(F.col(leaf).isNotNull()).select(F.col(leaf).alias("leaf"))
    own = leaves.select("leaf").distinct()
    return checks(
        violations("linked_leaves_apart", pages.where("chosen > 0 and chosen < linked")), violations("no_rule", stray),
        violations("missing_leaf", own.join(chosen, "leaf", "left_anti")), violations("leaked_leaf", chosen.join(own, "leaf", "left_anti")),
    )


def selected(records: DataFrame, leaves: DataFrame, special_pages: DataFrame, split: str, **names: str) -> DataFrame:
    """select_by_leaves, once its checks hold."""
    enforce(selection_checks(records, leaves, special_pages, **names), split)
    return select_by_leaves(records, leaves, special_pages, **names)


def leaf_groups(records: DataFrame, special_pages: DataFrame, leaf: str = "physical_leaf", folio: str = "folio") -> DataFrame:
    """records with `leaf_group`: the leaf, or all leaves that a special page links (f85+f86), for these leaves and the page
    itself; null for a record with neither a leaf nor a special page."""
    linked = F.array_sort(F.array_distinct(F.filter("linked_leaves", lambda x: x.isNotNull())))
    label = F.array_join(F.transform(linked, lambda x: F.concat(F.lit("f"), x.cast("string"))), "+")
    pages = special_pages.select(page_name(F.col("folio")).alias("__page"), label.alias("__of_page"), linked.alias("__l")).dropDuplicates(["__page"])
    leaves = pages.select(F.explode("__l").alias(leaf), F.col("__of_page").alias("__of_leaf")).groupBy(leaf).agg(F.min("__of_leaf").alias("__of_leaf"))
    rows = records.withColumn("__page", page_name(F.col(folio))).join(bounded(pages.drop("__l")), "__page", "left").join(bounded(leaves), leaf, "left")
    group = F.coalesce("__of_leaf", F.when(F.col(leaf).isNotNull(), F.concat(F.lit("f"), F.col(leaf).cast("string"))), "__of_page")
    return rows.withColumn("leaf_group", group).select(*records.columns, "leaf_group")


def cover_checks(parts: DataFrame, whole: DataFrame, part: str = "part", item: str = "item") -> DataFrame:
    """parts (part, item) against whole (item): foreign items, items in two parts, items in none."""
    own = parts.select(part, item).distinct()
    twice = own.groupBy(item).agg(F.count("*").alias("n")).where("n > 1")
    return checks(
        violations("out_of_range", own.select(item).distinct().join(whole, item, "left_anti")), violations("overlap", twice),
        violations("not_covered", whole.select(item).distinct().join(own, item, "left_anti")),
    )


def line_range(spark: SparkSession, lines: int) -> DataFrame:
    return spark.range(1, lines + 1).toDF("item")


def assignment_checks(assigned: DataFrame, observed: DataFrame, targets: Mapping[str, int], ties: DataFrame) -> DataFrame:
    """assigned (leaf, split) against observed (leaf), leaves wanted in each split, and tied leaves (u, v)."""
    spark = assigned.sparkSession
    wanted = spark.createDataFrame(list(targets.items()), "split string, wanted long")
    sizes = assigned.groupBy("split").agg(F.count_distinct("leaf").alias("n"))
    wrong = wanted.join(sizes, "split", "full_outer").where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("wanted", F.lit(0))))
    side = lambda c: assigned.select(F.col("leaf").alias(c), F.col("split").alias(f"s_{c}"))
    apart = ties.join(side("u"), "u").join(side("v"), "v").where("s_u <> s_v")
    cover = cover_checks(assigned.select(F.col("split").alias("part"), F.col("leaf").alias("item")), observed.select(F.col("leaf").alias("item")))
    return checks(violations("split_size", wrong), cover, violations("tied_leaves_apart", apart))


def parity(found: DataFrame, expected: DataFrame, keys: list[str], fields: Mapping[str, float]) -> DataFrame:
    """(keys, field, expected_value, found_value, difference, tolerance, pass): a row for each key of either side and each
    field, compared within its tolerance; a value or key that only one side has does not pass."""
    a, b = (df.select(*keys, F.lit(1).alias(f"__{x}"), *[F.col(f).cast("double").alias(f"__{x}_{f}") for f in fields]) for df, x in ((found, "f"), (expected, "e")))
    both = a.join(b, keys, "full_outer")

    def row(f: str, tolerance: float) -> Column:
        got, want = F.col(f"__f_{f}"), F.col(f"__e_{f}")
        same = F.col("__f").isNotNull() & F.col("__e").isNotNull() & (F.abs(got - want) <= tolerance) | F.col("__f").isNotNull() & F.col("__e").isNotNull() & got.isNull() & want.isNull()
        return F.struct(
            F.lit(f).alias("field"), want.alias("expected_value"), got.alias("found_value"), (got - want).alias("difference"), F.lit(float(tolerance)).alias("tolerance"), F.coalesce(same, F.lit(False)).alias("pass")
        )

    return both.select(*keys, F.inline(F.array(*[row(f, t) for f, t in fields.items()])))


def parity_checks(rows: DataFrame) -> DataFrame:
    """The rows of parity that don't pass, by field."""
    return rows.groupBy(F.col("field").alias("check")).agg(F.count_if(~F.col("pass")).alias("violations"))


def frozen(spark: SparkSession, found: Mapping[str, object], expected: Mapping[str, object]) -> DataFrame:
    """Checks of settings: one for each expected key, violated where the value differs in any way or is missing; other
    keys of found are free. The same test serves files by their hashes, keys by their fields, and published counts."""
    rows = [(str(k), int(k not in found or found[k] != v or type(found[k]) is not type(v))) for k, v in expected.items()]
    return spark.createDataFrame(rows, "check string, violations long")


def readiness_checks(spark: SparkSession, summary: Mapping[str, object], confirmed: bool = False) -> DataFrame:
    """Whether a split may be frozen: quality control passed, published counts were matched, and the samples were looked
    over, on record or by `confirmed`."""
    ready = summary.get("freeze_readiness") or {}
    looked = ready.get("manual_cross_transcription_spotcheck_complete") is True and ready.get("ready_to_generate_locked_split") is True
    found = {"overall_qc": summary.get("overall_qc"), "published_counts": ready.get("published_count_validation_complete") is True, "samples_looked_over": looked or confirmed}
    return frozen(spark, found, {"overall_qc": "PASS", "published_counts": True, "samples_looked_over": True})


def lineage_checks(keys: DataFrame, parents: DataFrame, fields: list[str]) -> DataFrame:
    """Each field in which keys (one row) differ from parents (one row)."""
    a, b = keys.select(*[F.to_json(F.struct(f)).alias(f) for f in fields]), parents.select(*[F.to_json(F.struct(f)).alias(f"__{f}") for f in fields])
    both = a.join(F.broadcast(b))  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(f).alias("check"), F.when(F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("violations")) for f in fields])))


def count_convention(reports: DataFrame, codewise: str, semantic: str, expected: str, lossy: Column) -> DataFrame:
    """reports with (validation, status): which way of counting meets the published count. A lossy report has no such
    count; one that does have it, one without it that isn't lossy, and one that meets it neither way are mismatches."""
    want = F.col(expected)
    validation = (
        F.when(lossy & want.isNull(), "lossy").when(lossy | want.isNull(), "error")
        .when(F.col(codewise) == want, "exact codewise").when(F.col(semantic) == want, "exact semantic").otherwise("error")
    )
    status = F.when(F.col("validation") == "lossy", "PASS WITH LIMITATION").when(F.col("validation") == "error", "MISMATCH").otherwise("PASS")
    return reports.withColumn("validation", validation).withColumn("status", status)


def forbidden_paths(paths: DataFrame, parts: list[str], path: str = "path") -> DataFrame:
    """The paths that hold one of the parts."""
    return paths.where(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.col(path), p)))

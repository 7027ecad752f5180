"""Rows that fail to parse: delimited lines are split into cells, cells meet a table of rules, and rows
come out typed where valid and otherwise with the first reason they fail.

Method: the cells of each line are exploded to (row, column, value), joined to the rule table, judged, and
the failures aggregated per row; the valid rows are those without a failure (anti-join).

Defined cases: a null line is an empty line and fails with column_count; a null or unknown feed fails with
column_count unless its quoting fails; repeated rows are judged each by its own id, while rows with the same
id get one result (the earliest reason of them); rows with a null id share one result; an empty table gives
an empty result; further columns of the input are ignored, whatever their names. Lines may be of any length:
no pattern backtracks over a whole line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In the order in which they apply.
REASONS = ("quoting", "column_count", "invalid_value")

COLUMNS = {
    "loci": {"transcription_id": "string", "folio": "string", "locus": "string", "line": "int", "text_raw": "string", "original": "string"},
    "counts": {
        "characters": "bigint", "characters_ivtff_semantic": "bigint", "ivtff_semantic_valid": "boolean", "ivtff_semantic_error": "string",
        "characters_collapsed_unknown_runs": "bigint", "unknown_collapse_delta": "bigint", "native_alphabet": "string", "rule_file": "string",
        "rule_sha256": "string", "loci_counted": "bigint",
    },
}


def split_delimited(line: Column) -> tuple[Column, Column]:
    """(the line's quoting holds, its fields). A field is quoted only if it begins with a quote, a doubled
    quote stands for one, and line breaks may stand anywhere. Linear in the line's length: the line is cut at
    its quotes, which makes every second piece the inside of a quoted field, or, where empty, a doubled quote."""
    def shape(pieces: Column) -> Column:
        # after each step in a lambda only what is bound before it is used: nothing is computed again per piece
        def each(x: Column, i: Column, n: Column) -> Column:
            inner, last = i % 2 == 1, i == n - 1
            return inner | ((x == "") | F.when(i == 0, last | x.endswith(",")).when(last, x.startswith(",")).otherwise(x.startswith(",") & x.endswith(",")))

        return _let(F.size(pieces), lambda n: (n % 2 == 1) & F.forall(F.transform(pieces, lambda x, i: each(x, i, n)), lambda ok: ok))

    def cells(pieces: Column) -> Column:
        def each(x: Column, i: Column, n: Column) -> Column:
            doubled = (x == "") & (i > 0) & (i < n - 1)
            return F.when(i % 2 == 1, x).when(doubled, F.lit('"')).otherwise(F.regexp_replace(x, ",", "\u0001s"))

        marked = _let(F.size(pieces), lambda n: F.transform(pieces, lambda x, i: each(x, i, n)))
        return F.transform(F.split(F.array_join(marked, ""), "\u0001s", -1), lambda x: F.regexp_replace(x, "\u0001e", "\u0001"))

    # U+0001 marks the separators; one that the line itself holds is escaped first
    pieces = F.split(F.regexp_replace(line, "\u0001", "\u0001e"), '"', -1)
    return _let(pieces, shape), _let(pieces, cells)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """A cell of `column` is valid if holds(value, cells) is true; cells(name) is another cell of its row."""

    feed: str
    column: str
    name: str
    holds: Callable[[Column, Callable[[str], Column]], Column]


def _is(pattern: str) -> Callable:
    return lambda v, c: v.rlike(rf"(?s)\A(?:{pattern})\z")


def _number(v: Column) -> Column:
    return v.try_cast("decimal(38,0)")


_DIGITS = "[0-9]+"


def _brackets_hold(v: Column) -> Column:
    """'<' and '>' pair, and outside of them each '[' … ']' holds a ':' and no other bracket."""
    text = F.regexp_replace(v, "<[^<>]*>", "")
    return ~text.rlike("[<>]") & ~F.regexp_replace(text, r"\[[^\[\]:]*:[^\[\]]*\]", "").rlike(r"[\[\]]")


def _with_validity(v: Column, valid: Column, when: str) -> Column:
    """v is present exactly where `valid` reads `when`."""
    return (v != "") == (valid == when)


#: The checks of TESTDATA's two feeds; another feed brings columns and rules of its own.
RULES = (
    Rule("loci", "transcription_id", "code", _is("[A-Z]{2}[0-9][a-z]")),
    Rule("loci", "folio", "page name", _is("fRos|f[0-9]+[rv][0-9]*")),
    Rule("loci", "line", "whole number from 1", _is("0*[1-9][0-9]*")),
    Rule("loci", "locus", "page and line", lambda v, c: v.startswith(F.concat(c("folio"), F.lit("."), c("line"), F.lit(",")))),
    Rule("loci", "locus", "type", lambda v, c: F.substr(v, F.length(c("folio")) + F.length(c("line")) + 3).rlike(r"(?s)\A.[A-Z][a-z0-9]\z")),
    Rule("loci", "text_raw", "not blank", lambda v, c: v.rlike(r"\S")),
    Rule("loci", "text_raw", "readable", lambda v, c: ~v.contains("????")),
    Rule("loci", "text_raw", "brackets", lambda v, c: _brackets_hold(v)),
    Rule("loci", "original", "begins with locus", lambda v, c: v.startswith(F.concat(F.lit("<"), c("locus"), F.lit(">")))),
    Rule("counts", "characters", "count", _is(_DIGITS)),
    Rule("counts", "characters_ivtff_semantic", "count", _is("[0-9]*")),
    Rule("counts", "characters_ivtff_semantic", "only if valid", lambda v, c: _with_validity(v, c("ivtff_semantic_valid"), "true")),
    Rule("counts", "ivtff_semantic_valid", "boolean", _is("true|false")),
    Rule("counts", "ivtff_semantic_error", "only if not valid", lambda v, c: _with_validity(v, c("ivtff_semantic_valid"), "false")),
    Rule("counts", "characters_collapsed_unknown_runs", "count", _is(_DIGITS)),
    Rule("counts", "unknown_collapse_delta", "count", _is(_DIGITS)),
    Rule("counts", "unknown_collapse_delta", "difference", lambda v, c: _number(c("characters")) - _number(c("characters_collapsed_unknown_runs")) == _number(v)),
    Rule("counts", "native_alphabet", "not empty", lambda v, c: v != ""),
    Rule("counts", "rule_file", "ending", lambda v, c: v.endswith(".bit")),
    Rule("counts", "rule_sha256", "digest", _is("[0-9a-f]{64}")),
    Rule("counts", "loci_counted", "count above 0", _is("0*[1-9][0-9]*")),
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES, columns: dict[str, dict[str, str]] = COLUMNS) -> DataFrame:
    """(feed, column_index, rule): as many rows as there are rules, so it may be broadcast."""
    rows = [(r.feed, list(columns[r.feed]).index(r.column), i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "feed string, column_index int, rule int")


def parsed(rows: DataFrame, id_column: str = "raw_id", line: str = "raw_line") -> DataFrame:
    """(id, feed, quoting_holds, cells) of each row."""
    text = F.coalesce(F.col(line), F.lit(""))
    holds, fields = split_delimited(text)
    return rows.select(F.col(id_column).alias("id"), "feed", holds.alias("quoting_holds"), fields.alias("cells"))


def failures(rows: DataFrame, id_column: str = "raw_id", line: str = "raw_line", rules: tuple[Rule, ...] = RULES, columns: dict[str, dict[str, str]] = COLUMNS) -> DataFrame:
    """(id, reason, failed_rules) of each row that fails; failed_rules names `column: rule` of its cells."""
    p = parsed(rows, id_column, line)
    width = F.coalesce(*[F.when(F.col("feed") == f, F.size("cells") == len(c)) for f, c in columns.items()], F.lit(False))
    p = p.withColumn("width_holds", width)
    # a row of broken shape has one pseudo-cell, which no rule meets
    shaped = F.col("quoting_holds") & F.col("width_holds")
    cells = p.select("id", "feed", "quoting_holds", "width_holds", "cells", F.posexplode(F.when(shaped, F.col("cells")).otherwise(F.array(F.lit("")))).alias("column_index", "value"))
    judged = cells.join(F.broadcast(rule_table(rows.sparkSession, rules, columns)), ["feed", "column_index"], "left")

    def broken(i: int, r: Rule) -> Column:
        names = list(columns[r.feed])
        return F.when(F.col("rule") == i, ~F.coalesce(r.holds(F.col("value"), lambda n: F.get("cells", F.lit(names.index(n)))), F.lit(False)))

    breaks = F.coalesce(*[broken(i, r) for i, r in enumerate(rules)], F.lit(False))
    rank = F.when(~F.col("quoting_holds"), 0).when(~F.col("width_holds"), 1).when(breaks, 2)
    found = judged.select("id", rank.alias("rank"), F.when(rank == 2, F.col("rule")).alias("rule")).where("rank is not null")
    names = F.array(*[F.lit(f"{r.column}: {r.name}") for r in rules])
    return found.groupBy("id").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_set("rule")).alias("broken")).select(
        "id", F.get(F.array(*map(F.lit, REASONS)), F.col("rank")).alias("reason"), F.transform("broken", lambda i: F.get(names, i)).alias("failed_rules")
    )


def valid_rows(rows: DataFrame, feed: str, id_column: str = "raw_id", line: str = "raw_line", rules: tuple[Rule, ...] = RULES, columns: dict[str, dict[str, str]] = COLUMNS) -> DataFrame:
    """The typed columns of the feed's valid rows, after the id."""
    own = rows.where(F.col("feed") == feed)
    bad = failures(own, id_column, line, rules, columns).select(F.col("id").alias("bad_id"))
    good = parsed(own, id_column, line).join(bad, F.expr("id <=> bad_id"), "left_anti")
    typed = [F.nullif(F.get("cells", F.lit(i)), F.lit("")).cast(t).alias(c) for i, (c, t) in enumerate(columns[feed].items())]
    return good.select(F.col("id").alias(id_column), *typed)

"""Frequency of every distinct term, or run of up to n terms, and in how many records it occurs.

Method: suffix-sorted n-gram counting. Each position of a record gives one suffix, truncated to the longest
run asked for, with the length of its longest prefix that began earlier in the record too. Equal suffixes are
added up before anything moves; the rest is routed by first term, sorted in reverse lexicographic order, so
that a suffix comes before its prefixes, and a stack adds up the counts and record counts of all prefixes in
one pass. Record sets are never held: a suffix counts for the records of those of its prefixes that are new
in its record.

A hot first term is split by its second term; only the counts of single terms are then added up once more.

Defined cases: null records, null and empty terms give nothing (terms beside one that is dropped are not
adjacent for it: runs go over the terms that stay); a term counts once a record for `records`; an empty table
gives an empty result; a run of terms is an array, so no separator can clash; records may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import plain_text

#: Partitions that one first term may be spread over.
SPREAD = 32
_SUFFIX = "field string, suffix array<string>, known int"
_OUT = "field string, terms array<string>, occurrences long, records long"


def _suffixes(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple, int] = {}
            for field, terms in zip(b.column("field").to_pylist(), b.column("terms").to_pylist()):
                seen: set[tuple] = set()
                for i in range(len(terms)):
                    s = tuple(terms[i : i + longest])
                    known = 0
                    while known < len(s) and s[: known + 1] in seen:
                        known += 1
                    seen.update(s[:k] for k in range(known + 1, len(s) + 1))
                    k = (field, s, known)
                    count[k] = count.get(k, 0) + 1
            if count:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in count]), pa.array([list(k[1]) for k in count], pa.list_(pa.string())), pa.array([k[2] for k in count], pa.int32()), pa.array(count.values(), pa.int64())],
                    ["field", "suffix", "known", "n"],
                )

    return run


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in reverse order, by field: the stack holds the current suffix' terms with the occurrences and
    records gathered for each of its prefixes; a prefix is done once the next suffix no longer begins with it."""
    field, terms, occ, rec = None, [], [], []
    out: list[tuple] = []

    def pop_to(depth: int) -> None:
        while len(terms) > depth:
            n, r = occ.pop(), rec.pop()
            out.append((field, list(terms), n, r))
            terms.pop()
            if terms:
                occ[-1] += n

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["field", "terms", "occurrences", "records"])

    for b in batches:
        for f, s, known, n in zip(b.column("field").to_pylist(), b.column("suffix").to_pylist(), b.column("known").to_pylist(), b.column("n").to_pylist()):
            same = 0
            if f == field:
                while same < len(terms) and same < len(s) and terms[same] == s[same]:
                    same += 1
            pop_to(same)
            field = f
            for t in s[same:]:
                terms.append(t)
                occ.append(0)
                rec.append(0)
            occ[-1] += n
            for k in range(known, len(s)):
                rec[k] += n
        if out:
            yield flush()
    pop_to(0)
    if out:
        yield flush()


def term_counts(records: DataFrame, longest: int = 1) -> DataFrame:
    """(field, terms, occurrences, records) of every run of 1 to `longest` terms of records (field, terms)."""
    terms = F.filter("terms", lambda t: t.isNotNull() & (t != ""))
    rows = records.select("field", terms.alias("terms")).where("field is not null and size(terms) > 0")
    suffixes = rows.mapInArrow(_suffixes(longest), _SUFFIX + ", n long")
    once = suffixes.groupBy("field", "suffix", "known").agg(F.sum("n").alias("n"))
    # a truncated suffix of two terms or more lies whole in one partition, and so do all its runs of two or more
    spread = F.pmod(F.xxhash64(F.get("suffix", F.lit(1))), F.lit(SPREAD))
    routed = once.repartition("field", F.get("suffix", F.lit(0)), spread).sortWithinPartitions("field", F.desc("suffix"))
    counted = routed.mapInArrow(_stack, _OUT)
    if longest == 1:
        return counted
    single = counted.where("size(terms) = 1").groupBy("field", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted.where("size(terms) > 1").unionByName(single)


def marked(counts: DataFrame, totals: DataFrame, rare_below: int = 3, common_above: float = 0.08) -> DataFrame:
    """counts with `mark`: rare in fewer than rare_below records, common in more than that share of the field's
    records; else null. totals: (field, total), a row for each field."""
    share = F.col("records") > F.lit(common_above) * F.col("total") + 1e-9
    return counts.join(F.broadcast(totals), "field").withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(share, "common"))


def text_terms(loci: DataFrame) -> DataFrame:
    """(record_id, field, terms): words of the plain text without those holding '?'."""
    last = loci.groupBy("record_id").agg(F.max_by("text_normalized", F.struct("ingested_at", "text_normalized")).alias("text"))
    words = F.filter(F.split(plain_text(F.col("text")), " "), lambda w: ~w.contains("?"))
    return last.select("record_id", F.lit("text_normalized").alias("field"), words.alias("terms"))


def token_terms(analytical: DataFrame) -> DataFrame:
    """(record_id, field, terms): tokens as their joined codes, without those holding Z1."""

    def joined(t: Column) -> Column:
        return F.array_join(F.filter(t, lambda g: g.isNotNull()), "")

    last = analytical.groupBy("record_id").agg(F.max_by("tokens", F.struct("built_at", "tokens")).alias("tokens"))
    tokens = F.filter("tokens", lambda t: t.isNotNull() & ~F.coalesce(F.exists(t, lambda g: F.coalesce(g, F.lit("")) == "Z1"), F.lit(False)))
    return last.select("record_id", F.lit("tokens").alias("field"), F.transform(tokens, joined).alias("terms"))


def totals(records: DataFrame) -> DataFrame:
    """(field, total): the number of records of each field."""
    return records.groupBy("field").agg(F.count("*").alias("total"))

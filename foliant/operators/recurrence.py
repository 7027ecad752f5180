"""Recurrence of last glyphs within families of tokens that share all but the last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import readable, tokens
from foliant.operators.numbering import numbered_within
from foliant.session import written


def family_occurrences(lines: DataFrame) -> DataFrame:
    """(base, suffix, occurrence): tokens of two glyphs or more as family and last glyph, numbered within the
    family in reading order (record, token)."""
    t = tokens(lines).where(readable(F.col("glyphs")) & (F.size("glyphs") > 1))
    rows = t.select(F.array_join(F.slice("glyphs", 1, F.size("glyphs") - 1), "\x1f").alias("base"), F.element_at("glyphs", -1).alias("suffix"), "record_id", "token_index")
    return numbered_within(rows, "base", ("record_id", "token_index"), "occurrence").select("base", "suffix", "occurrence")


def lag_rates(occurrences: DataFrame, most: int, least: int = 2) -> DataFrame:
    """(lag, pairs, matches, rate) pooled over families of `least` or more occurrences: an occurrence meets the one
    `lag` on by its number, so no family is gathered."""
    big = occurrences.groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("base")
    own = occurrences.join(big, "base", "left_semi")
    later = own.select("base", F.col("suffix").alias("s2"), F.col("occurrence").alias("at"))
    asked = own.select("base", "suffix", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"), "occurrence").withColumn("at", F.col("occurrence") + F.col("lag"))
    p = asked.join(later, ["base", "at"])
    return p.groupBy("lag").agg(F.count("*").alias("pairs"), F.count_if(F.col("suffix") == F.col("s2")).alias("matches")).withColumn("rate", F.round(F.col("matches") / F.col("pairs"), 6))


def rate_at(occurrences: DataFrame, lag: int) -> DataFrame:
    """One row (families, pairs, rate): equal suffixes `lag` occurrences apart, pooled over families of more than `lag`; the
    rate is null without pairs."""
    big = occurrences.groupBy("base").agg(F.count("*").alias("n")).where(F.col("n") > lag).select("base")
    own = occurrences.join(big, "base", "left_semi")
    later = own.select("base", F.col("suffix").alias("s2"), (F.col("occurrence") - lag).alias("occurrence"))
    p = own.join(later, ["base", "occurrence"])
    rate = p.agg(F.count("*").alias("pairs"), F.round(F.try_divide(F.count_if(F.col("suffix") == F.col("s2")), F.count("*")), 6).alias("rate"))
    return big.agg(F.count("*").alias("families")).join(rate)  # one row each


def cycle_contrast(rates: DataFrame, cycle: int) -> DataFrame:
    """One row: the rate at `cycle` less the mean rate at shorter lags."""
    return rates.agg(F.round(F.max(F.when(F.col("lag") == cycle, F.col("rate"))) - F.avg(F.when(F.col("lag") < cycle, F.col("rate"))), 6).alias("contrast"))


def family_inventory(occurrences: DataFrame) -> DataFrame:
    """(base, occurrences, suffixes, same_surface): the chance that two draws of the family are the same."""
    n = occurrences.groupBy("base", "suffix").agg(F.count("*").alias("n"))
    same = F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)), F.sum("n") * (F.sum("n") - 1))
    return n.groupBy("base").agg(F.sum("n").alias("occurrences"), F.count("*").alias("suffixes"), F.round(same, 6).alias("same_surface"))


def _matches(counts: list[int], rows: int, lag: int, rng: np.random.Generator) -> np.ndarray:
    """Equal pairs at lags 1 to `lag` (rows, lag) of `rows` random orders of a family of these suffix counts. Where one
    suffix prevails only the places of the others are drawn: what they leave is equal."""
    counts = sorted(counts, reverse=True)
    n, m = sum(counts), sum(counts[1:])
    kinds = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    out = np.empty((rows, lag), np.int64)
    if 4 * m > n:
        x = rng.permuted(np.tile(kinds.astype(np.min_scalar_type(len(counts))), (rows, 1)), axis=1)
        for k in range(1, lag + 1):
            out[:, k - 1] = np.count_nonzero(x[:, k:] == x[:, :-k], axis=1)
        return out
    kinds, row = np.tile(kinds[n - m :], rows), np.repeat(np.arange(rows), m)
    width = n + lag
    cells, place, names = np.zeros(rows * width, np.int32), rng.integers(n, size=rows * m), np.arange(1, rows * m + 1, dtype=np.int32)
    # two that drew one place: the later keeps it, the other draws again; no place is preferred, so all orders are equally likely
    todo = np.arange(rows * m)
    while len(todo):
        spot = row[todo] * width + place[todo]
        free = cells[spot] == 0
        cells[spot[free]] = names[todo[free]]
        todo = todo[cells[spot] != names[todo]]
        place[todo] = rng.integers(n, size=len(todo))
    spot = row * width + place
    cells[spot] = kinds
    for k in range(1, lag + 1):
        later = cells[spot + k]
        twice = (later > 0).astype(np.int8) + (later == kinds)
        ends = (place < n - k).astype(np.int8) + (place >= k)
        out[:, k - 1] = n - k + (twice - ends).reshape(rows, m).sum(1, dtype=np.int64)
    return out


def permuted_matches(counts: DataFrame, lag: int, replicates: int, seed: int = 0, block: int = 250) -> DataFrame:
    """(replicate, matches): equal pairs at lags 1 to `lag`, summed over families of (counts array<long>), whose
    suffixes are put in random orders. Orders depend on seed, replicate and counts only. Families of equal counts are
    drawn together; a task takes blocks of replicates."""
    alike = counts.groupBy("counts").agg(F.count("*").alias("families"))
    blocks = -(-replicates // block)
    each = alike.select("counts", "families", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(blocks, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for own, families, number in zip(*(b.column(c).to_pylist() for c in ("counts", "families", "block"))):
                size = min(block, replicates - number * block)
                rng = np.random.default_rng([seed, number, *own])
                sums = total.setdefault(number, np.zeros((size, lag), np.int64))
                at_once = max(1, 2_000_000 // (sum(own) + lag))
                for start in range(0, size * families, at_once):
                    rows = np.arange(start, min(start + at_once, size * families))
                    np.add.at(sums, rows // families, _matches(own, len(rows), lag, rng))
        for number, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)) + number * block, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["replicate", "matches"])

    return each.mapInArrow(run, "replicate long, matches array<long>")


def permutation_test(occurrences: DataFrame, lag: int, replicates: int, seed: int = 0) -> DataFrame:
    """One row, none without families of more than `lag`: the observed rate at `lag`, the mean of the shuffled, and the
    Monte Carlo p of as much or more; and the same of the contrast, which is the rate at `lag` less the mean rate at
    shorter lags (null for lag 1). Families of one suffix are the same in any order and are not shuffled. The
    driver receives `replicates` times `lag` sums."""
    n = occurrences.groupBy("base", "suffix").agg(F.count("*").alias("n"))
    families = n.groupBy("base").agg(F.sort_array(F.collect_list("n")).alias("counts"), F.sum("n").alias("n")).where(F.col("n") > lag)
    families = written(families, "families")
    alone = F.size("counts") == 1
    size = families.agg(F.sum("n"), F.count("*"), F.sum(F.when(alone, F.col("n"))), F.count_if(alone)).first()
    schema = "observed double, null_mean double, p double, contrast double, contrast_null_mean double, contrast_p double"
    spark = occurrences.sparkSession
    if not size[1]:
        return spark.createDataFrame([], schema)
    lags = np.arange(1, lag + 1)
    pairs, fixed = size[0] - size[1] * lags, (size[2] or 0) - size[3] * lags
    varied = families.where(~alone)
    found = {r["lag"]: r["matches"] for r in lag_rates(occurrences.join(varied, "base", "left_semi"), lag, lag + 1).collect()}
    null = np.zeros((replicates, lag), np.int64)
    for r in permuted_matches(varied.select("counts"), lag, replicates, seed).toLocalIterator():
        null[r["replicate"]] = r["matches"]
    seen, rates = (np.array([found.get(k, 0) for k in lags.tolist()]) + fixed) / pairs, (null + fixed) / pairs

    def tested(observed: float, shuffled: np.ndarray) -> list[float]:
        return [round(float(x), 6) for x in (observed, shuffled.mean(), (np.count_nonzero(shuffled >= observed - 1e-12) + 1) / (replicates + 1))]

    contrast = tested(seen[-1] - seen[:-1].mean(), rates[:, -1] - rates[:, :-1].mean(1)) if lag > 1 else [None] * 3
    return spark.createDataFrame([(*tested(seen[-1], rates[:, -1]), *contrast)], schema)

"""Differences between two copies of data, row by row and field by field.

Method: each side's current version of every row becomes an item (key hash, row hash) in the invertible Bloom
lookup table of its key's bucket. Both sides' tables are built in one aggregation with opposite signs, which
subtracts them: equal rows cancel, and do so where their hashes meet, before a cell is filled. Each bucket's cells
are peeled, which reveals the keys that differ; a bucket that holds more differences than its cells can give back is
taken whole, so that the result is exact at any rate of differences. Only rows of revealed keys are then fetched, and
compared field by field.

What moves: versions of a key are combined on the map side, then hashes of every key move once, as its versions must
meet; items only of rows that differ; whole rows only where they differ. However many versions a key has, a task
sends one, and buckets hold keys by hash, so no key, source or bucket can grow beyond its share.

Defined cases: a null in a key field equals an empty string there; strings are compared trimmed of U+0020, and
empty equals null; repeated rows and versions of a key count once, the last by version (ties: the greatest row
by hash); an empty side makes every key of the other missing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import blank_as_null
from foliant.session import written

#: Keys a bucket holds on average, and cells of its table in each of the three hash ranges.
BUCKET_KEYS, RANGE_CELLS = 256, 32
_LOW = (1 << 31) - 1


def _clean(df: DataFrame, names: Sequence[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [blank_as_null(F.col(n)).alias(n) if kinds[n] == "string" else F.col(n).alias(n) for n in names]


def _side(df: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str) -> DataFrame:
    rows = df.select(*_clean(df, [*keys, *fields]), F.col(version).alias("__version"))
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k, t in rows.dtypes if k in keys and t == "string"})


def _hashed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], side: int, buckets: int) -> DataFrame:
    key = F.xxhash64(*[F.col(k) for k in keys])
    # a null and its absence must differ in the row hash, whose function skips nulls
    shape = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    return rows.select(
        key.alias("kh"), F.xxhash64(F.lit("second"), *[F.col(k) for k in keys]).alias("kh2"), F.lit(side).cast("byte").alias("side"),
        F.struct("__version", F.xxhash64(*[F.col(k) for k in keys], *[F.col(f) for f in fields], shape).alias("rh")).alias("v"),
    ).withColumn("bucket", F.pmod("kh", F.lit(buckets)))


def _check(h: Column) -> Column:
    """Not linear in XOR, so a cell of several items doesn't pass for one."""
    return F.bitwise_not(h).bitwiseAND(F.lit(_LOW)) * F.shiftright(h, 33).bitwiseAND(F.lit(_LOW))


def _cells(h: Column) -> Column:
    """One cell in each of the three ranges."""
    return F.array(*[F.pmod(F.shiftrightunsigned(h, 20 * i), F.lit(RANGE_CELLS)) + RANGE_CELLS * i for i in range(3)])


def _peel(cells: pd.DataFrame) -> tuple[set[int], bool]:
    """Keys that one bucket's subtracted table reveals, and whether it is empty then."""
    n = np.zeros(3 * RANGE_CELLS, np.int64)
    kx, rx, cx = (np.zeros(3 * RANGE_CELLS, np.int64) for _ in range(3))
    at = cells["cell"].to_numpy()
    n[at], kx[at], rx[at], cx[at] = cells["n"], cells["kx"], cells["rx"], cells["cx"]
    found, queue = set(), list(range(3 * RANGE_CELLS))
    while queue:
        c = queue.pop()
        if abs(n[c]) != 1:
            continue
        h, k, check, sign = int(rx[c]), int(kx[c]), int(cx[c]), int(n[c])
        u = h & ((1 << 64) - 1)
        if check != (~h & _LOW) * ((h >> 33) & _LOW):
            continue
        own = [(u >> (20 * i)) % RANGE_CELLS + RANGE_CELLS * i for i in range(3)]
        # Spark's pmod takes the shifted value as signed, which only the unshifted one can be
        own[0] = h % RANGE_CELLS
        if c not in own:
            continue
        found.add(k)
        for x in own:
            n[x] -= sign
            kx[x] ^= k
            rx[x] ^= h
            cx[x] ^= check
        queue += own
    return found, not (n.any() or kx.any() or rx.any() or cx.any())


def _reveal(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    found, done = _peel(cells)
    if not done:
        return pd.DataFrame({"bucket": [key[0]], "kh": pd.array([None], "Int64")})
    return pd.DataFrame({"bucket": key[0], "kh": pd.array(sorted(found), "Int64")})


def differing_keys(left: DataFrame, right: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kh) of hashed rows that differ; kh is null for a bucket to be taken whole."""
    last = lambda side: F.max(F.when(F.col("side") == side, F.col("v")))
    current = left.union(right).groupBy("bucket", "kh", "kh2").agg(last(1).alias("l"), last(-1).alias("r")).where(~F.col("l.rh").eqNullSafe(F.col("r.rh")))
    both = F.filter(F.array(F.struct(F.lit(1).alias("side"), F.col("l.rh").alias("rh")), F.struct(F.lit(-1).alias("side"), F.col("r.rh").alias("rh"))), lambda x: x["rh"].isNotNull())
    items = current.select("bucket", "kh", F.inline(both)).repartition("bucket")  # one exchange for cells and peeling
    cells = items.select("bucket", "side", "kh", "rh", F.explode(_cells(F.col("rh"))).alias("cell"))
    table = cells.groupBy("bucket", "cell").agg(
        F.sum("side").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("rh").alias("rx"), F.bit_xor(_check(F.col("rh"))).alias("cx")
    )
    left_over = table.where("n <> 0 or kx <> 0 or rx <> 0 or cx <> 0")
    return left_over.groupBy("bucket").applyInPandas(_reveal, "bucket long, kh long")


def differences(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], left_version: str, right_version: str, names: tuple[str, str] = ("left", "right"), buckets: int | None = None
) -> DataFrame:
    """(keys, field, left_value, right_value): field is missing_in_<name> or a field that differs, as text.
    buckets: of the tables; by default as many as the larger side's rows need."""
    a, b = _side(left, keys, fields, left_version), _side(right, keys, fields, right_version)
    if buckets is None:
        buckets = max(1, -(-max(left.count(), right.count()) // BUCKET_KEYS))
    differ = written(differing_keys(_hashed(a, keys, fields, 1, buckets), _hashed(b, keys, fields, -1, buckets), buckets), "differing")
    revealed, whole = differ.where("kh is not null").select(F.col("kh").alias("__kh")).distinct(), differ.where("kh is null").select(F.col("bucket").alias("__b"))

    def fetched(side: DataFrame) -> DataFrame:
        h = side.withColumn("__kh", F.xxhash64(*[F.col(k) for k in keys]))
        # a bucket comes out either whole or by its keys, so no row is fetched twice
        rows = h.join(revealed, "__kh", "left_semi").unionByName(h.withColumn("__b", F.pmod("__kh", F.lit(buckets))).join(whole, "__b", "left_semi").drop("__b"))
        # of versions with one time, the same row as in the tables
        shape = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
        rh = F.xxhash64(*[F.col(k) for k in keys], *[F.col(f) for f in fields], shape)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("__version", rh)).alias("row"))
        return last

    x, y = fetched(a).withColumnRenamed("row", "__a"), fetched(b).withColumnRenamed("row", "__b")
    both = x.join(y, list(keys), "full_outer")

    def entry(field: str, when: Column, one: Column | None = None, two: Column | None = None) -> Column:
        value = lambda v: F.lit(None).cast("string") if v is None else v.cast("string")
        return F.when(when, F.struct(F.lit(field).alias("field"), value(one).alias("left_value"), value(two).alias("right_value")))

    there = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    entries = [entry(f"missing_in_{names[1]}", F.col("__b").isNull()), entry(f"missing_in_{names[0]}", F.col("__a").isNull())]
    entries += [entry(f, there & ~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.col(f"__a.{f}"), F.col(f"__b.{f}")) for f in fields]
    return both.select(*keys, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))

"""Consensus from several annotators' labels that are sequences of symbols (a line's glyphs as read).

Method: community confusion model. Annotators belong to a few types; a type has one confusion matrix of symbols,
with dropped and added ones, shared by its annotators, so that one with few labels is judged by its type's
matrix and not by its own few errors. Variational updates go between the truth of each item, whose candidates
are its distinct labels, each annotator's type, and the types' matrices, until the bits of an item settle.

Before the updates, an item's labels are laid out in columns: each is aligned once with the label that most
annotators gave, and symbols it adds take columns of their own after the symbol they follow. A column holds few
distinct symbols, so an update takes time in proportion to labels x columns, never to pairs of labels, and runs in
arrays over whole batches of items. Everything here behaves alike for items and labels of any size.

What reaches the driver in each update is (annotator, confusion) sums: annotators are checked to be at most
MOST_ANNOTATORS. The MOST_SYMBOLS most frequent symbols have confusions of their own; rarer ones share theirs, while
they stay distinct: one read as another is an error like any. Items stay where they are. An item has
at most one label of each annotator, which bounds it by MOST_ANNOTATORS labels.

Defined cases: an annotator's last label of an item counts (ties: the greater id); null, empty and blank labels
are none, also where an earlier one was not; runs of blanks are one blank; rows without item or annotator are left
out; items of fewer than `least` annotators get no consensus but still count for reliability; of labels that the
model holds equally likely the one with more votes wins, then the first in order; empty tables give an empty result;
labels may be of any length (beyond their common ends, two of n and m symbols take n * m steps); further columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import squeezed
from foliant.session import shuffle_parts, written

MOST_ANNOTATORS, MOST_SYMBOLS = 10_000, 500
#: Types, the most updates, and the change in bits an item at which they end.
COMMUNITIES, UPDATES, SETTLED = 4, 50, 1e-4


def _trimmed(truth: list[int], read: list[int]) -> list[tuple[int, int]]:
    """_alignment in forward order, of what lies between the common beginning and the common end."""
    most = min(len(truth), len(read))
    a = 0
    while a < most and truth[a] == read[a]:
        a += 1
    z = 0
    while z < most - a and truth[-1 - z] == read[-1 - z]:
        z += 1
    n, m = len(truth) - z, len(read) - z
    if a == n:
        middle = [(0, r) for r in read[a:m]]
    elif a == m:
        middle = [(t, 0) for t in truth[a:n]]
    elif n - a == m - a == 1:
        middle = [(truth[a], read[a])]
    else:
        middle = _alignment(truth[a:n], read[a:m])[::-1]
    return [*zip(truth[:a], read[:a]), *middle, *zip(truth[n:], read[m:])]


def _alignment(truth: list[int], read: list[int]) -> list[tuple[int, int]]:
    """Pairs of symbols of a shortest edit script; 0 is no symbol. Of the rows of the distance table every step-th is
    kept, and those between are computed again on the way back, so that memory grows with n ** 0.5 * m."""
    n, m = len(truth), len(read)
    out: list[tuple[int, int]] = []
    while n and m and truth[n - 1] == read[m - 1]:  # the way back begins with equal last symbols
        n, m = n - 1, m - 1
        out.append((truth[n], read[m]))
    a, b, at = np.array(truth[:n], np.int64), np.array(read[:m], np.int64), np.arange(m + 1, dtype=np.int32)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        """Row i of the table from the row before."""
        best = row + 1
        np.minimum(best[1:], row[:-1] + (b != a[i - 1]), out=best[1:])
        return np.minimum.accumulate(best - at) + at

    step = max(1, int(n**0.5))
    kept, row = [at], at
    for i in range(1, n + 1):
        row = below(row, i)
        if i % step == 0:
            kept.append(row)
    i, j, first, rows = n, m, n + 1, []
    while i or j:
        if i and i <= first:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for k in range(first + 1, i + 1):
                rows.append(below(rows[-1], k))
        if i and j and rows[i - first][j] == rows[i - first - 1][j - 1] + (truth[i - 1] != read[j - 1]):
            i, j = i - 1, j - 1
            out.append((truth[i], read[j]))
        elif i and rows[i - first][j] == rows[i - first - 1][j] + 1:
            i -= 1
            out.append((truth[i], 0))
        else:
            j -= 1
            out.append((0, read[j]))
    return out


_ITEMS = "item string, labels array<string>, votes array<int>, people array<int>, chosen array<int>, columns int, cells array<int>, slots array<int>"


def _laid_out(coded: list[list[int]], votes: list[int]) -> list[list[int]]:
    """The labels' symbols by column, 0 for none: a column for each symbol of the label with the most votes, and for
    the k-th symbol that others add after it."""
    pivot = coded[max(range(len(coded)), key=lambda k: votes[k])]
    pairs = [None if x is pivot else _trimmed(pivot, x) for x in coded]
    extra: dict[int, int] = {}
    for p in pairs:
        at = run = 0
        for t, _ in p or ():
            if t:
                at, run = at + 1, 0
            else:
                run += 1
                if run > extra.get(at, 0):
                    extra[at] = run
    if not extra:
        return [pivot if p is None else [r for _, r in p] for p in pairs]
    first, column = [0] * (len(pivot) + 1), extra.get(0, 0)
    for i in range(1, len(pivot) + 1):
        first[i] = column  # of the pivot's i-th symbol
        column += 1 + extra.get(i, 0)
    out = []
    for x, p in zip(coded, pairs):
        row, at, k = [0] * column, 0, 0
        for t, r in p if p is not None else ((s, s) for s in x):
            if t:
                at, k = at + 1, 0
                row[first[at]] = r
            else:
                row[first[at] + 1 + k if at else k] = r
                k += 1
        out.append(row)
    return out


def _items(symbols: dict[str, int]):
    """For each item: its distinct labels with their votes, who chose which, and the labels' cells by column. A cell
    is a slot of its column (one for each distinct symbol there); `slots` holds (column, symbol) of each. Symbols
    beyond the known ones are numbered from the last code on, item by item."""
    known = len(symbols) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, given in zip(b.column("item").to_pylist(), b.column("votes").to_pylist()):
                count = Counter(v["label"] for v in given)
                labels = sorted(count)
                rare: dict[str, int] = {}
                coded = [[symbols.get(s) or known + rare.setdefault(s, len(rare)) for s in x.split(" ")] for x in labels]
                grid = _laid_out(coded, [count[x] for x in labels])
                number: dict[tuple[int, int], int] = {}
                cells = [number.setdefault((c, s), len(number)) for row in grid for c, s in enumerate(row)]
                place = {x: k for k, x in enumerate(labels)}
                order = sorted((v["annotator"], place[v["label"]]) for v in given)
                rows.append((item, labels, [count[x] for x in labels], [a for a, _ in order], [c for _, c in order], len(grid[0]), cells, [v for key in number for v in key]))
            if rows:
                ints = pa.list_(pa.int32())
                kinds = (pa.string(), pa.list_(pa.string()), ints, ints, ints, pa.int32(), ints, ints)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["item", "labels", "votes", "people", "chosen", "columns", "cells", "slots"])

    return run


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 … n - 1 of each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Batch:
    """A batch of items in flat arrays: labels, votes and slots are numbered through all its items."""

    def __init__(self, b: pa.RecordBatch, size: int):
        def parts(name: str) -> tuple[np.ndarray, np.ndarray]:
            c = b.column(name)
            return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

        self.votes, self.labels = parts("votes")
        self.people, many = parts("people")
        columns = b.column("columns").to_numpy(zero_copy_only=False).astype(np.int64)
        cells, self.cells = parts("cells")
        pairs, ends = parts("slots")
        slots = ends // 2
        self.items = len(columns)
        before = np.cumsum(self.labels) - self.labels
        self.item_of = np.repeat(np.arange(self.items), self.labels)
        self.chosen = parts("chosen")[0] + np.repeat(before, many)
        self.voters = many
        self.slot = cells + np.repeat(np.cumsum(slots) - slots, self.cells)  # of each cell
        self.width = columns[self.item_of]  # of each label
        self.cell_label = np.repeat(np.arange(len(self.item_of)), self.width)
        column, self.symbol = pairs[::2] + np.repeat(np.cumsum(columns) - columns, slots), pairs[1::2]
        # every two slots of a column, the first as truth and the second as read
        order = np.argsort(column, kind="stable")
        share = np.bincount(column, minlength=int(columns.sum()))
        first = np.cumsum(share) - share
        reads = share[column]  # partners of each slot
        self.truth = np.repeat(np.arange(len(column)), reads)
        self.read = order[np.repeat(first[column], reads) + _ranges(reads)]
        t, r = self.symbol[self.truth], self.symbol[self.read]
        code = np.minimum(t, size - 1).astype(np.int64) * size + np.minimum(r, size - 1)
        self.confusion = np.where((t != r) & (t >= size - 1) & (r >= size - 1), size * size, code)
        self.slots = len(column)


class _Model:
    """The state of the updates: log confusions by type, and each annotator's share in the types. Confusions are
    truth * size + read; 0 is no symbol, the last code all rarer ones, and size * size one of these for another."""

    def __init__(self, annotators: int, frequency: list[int], rarer: tuple[int, int], communities: int):
        self.size, self.m = len(frequency) + 2, communities
        # how common each symbol is in labels: a truth's symbols are drawn by it
        seen = np.array([0.0, *frequency, rarer[0] / max(1, rarer[1])]) + 0.5
        self.common = np.log(seen / seen.sum())
        self.common[0] = 0.0
        self.kinds = np.full((annotators, communities), 1.0 / communities)
        self.logs: np.ndarray | None = None  # before the first update, an item's truth is its vote shares

    def fit(self, sums: pd.DataFrame) -> None:
        """From expected confusions (annotator, confusion, n) to matrices and types."""
        a, f, n = (sums[c].to_numpy() for c in ("annotator", "confusion", "n"))
        if self.logs is None:
            # annotators are ordered by how often they differ; the types begin as neighbouring groups of them
            wrong = (f // self.size != f % self.size).astype(float)
            people = len(self.kinds)
            rate = (np.bincount(a, n * wrong, people) + 0.02) / (np.bincount(a, n, people) + 1)
            place = np.empty(people)
            place[np.argsort(rate, kind="stable")] = (np.arange(people) + 0.5) / people * self.m - 0.5
            near = np.exp(-np.abs(place[:, None] - np.arange(self.m)))
            self.kinds = near / near.sum(1, keepdims=True)
        for _ in range(3):
            self._matrices(a, f, n)
            self._types(a, f, n)

    def _matrices(self, a, f, n) -> None:
        size = self.size
        total = np.stack([np.bincount(f, n * self.kinds[a, m], size * size + 1) for m in range(self.m)])
        shared = total.sum(0)
        t, r = np.divmod(np.arange(size * size + 1), size)
        t[-1], r[-1] = size - 1, 0
        # prior: what all types do together, and a little of everything; a symbol is mostly read as itself
        prior = np.where(t == r, 20.0, 0.4 / size) + 10 * shared / np.maximum(np.bincount(t, shared, size)[t], 1)
        counts = total + prior
        rows = np.stack([np.bincount(t, c, size) for c in counts])
        logs = np.log(counts / rows[:, t])
        # symbols added: among all positions, not among those where one was added
        read = np.stack([np.bincount(t, c, size)[1:].sum() for c in total])[:, None]
        added = t == 0
        logs[:, added] = np.log((total[:, added] + 0.02 / size) / (read + 20))
        logs[:, 0] = 0.0  # no symbol where the truth has none
        self.logs = logs

    def _types(self, a, f, n) -> None:
        people = len(self.kinds)
        share = np.log((self.kinds.sum(0) + 1) / (people + self.m))
        fit = share + np.stack([np.bincount(a, n * self.logs[m, f], people) for m in range(self.m)], axis=1)
        fit = np.exp(fit - fit.max(1, keepdims=True))
        self.kinds = fit / fit.sum(1, keepdims=True)

    def truth(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """(how likely each label is its item's truth, each item's log likelihood)."""
        labels = len(b.item_of)
        if self.logs is None:
            return b.votes / b.voters[b.item_of], np.zeros(b.items)
        score = np.zeros(b.slots)
        for m in range(self.m):
            chose = np.bincount(b.chosen, self.kinds[b.people, m], labels)
            weight = np.bincount(b.slot, chose[b.cell_label], b.slots)
            score += np.bincount(b.truth, weight[b.read] * self.logs[m][b.confusion], b.slots)
        score += self.common[np.minimum(b.symbol, self.size - 1)]
        q = np.bincount(b.cell_label, score[b.slot], labels)
        first = np.cumsum(b.labels) - b.labels
        top = np.maximum.reduceat(q, first)
        q = np.exp(q - top[b.item_of])
        total = np.add.reduceat(q, first)
        return q / total[b.item_of], top + np.log(total)


def _expected(model: _Model):
    """Sums of (annotator, confusion, n), and as annotator -1 the log likelihood and the number of items."""
    span = model.size * model.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, fit = np.zeros(0, np.int64), np.zeros(0), np.zeros(2)
        for rows in batches:
            if not rows.num_rows:
                continue
            b = _Batch(rows, model.size)
            q, own = model.truth(b)
            fit += [own.sum(), b.items]
            likely = np.bincount(b.slot, q[b.cell_label], b.slots)
            some = np.flatnonzero((likely[b.truth] > 1e-4) & (b.confusion > 0))
            truth, read, confusion = b.truth[some], b.read[some], b.confusion[some]
            # each vote's cells, and each cell's confusions
            order = np.argsort(read, kind="stable")
            many = np.bincount(read, minlength=b.slots)
            first = np.cumsum(many) - many
            start = np.cumsum(b.width) - b.width
            wide = b.width[b.chosen]
            slot = b.slot[np.repeat(start[b.chosen], wide) + _ranges(wide)]
            person = np.repeat(b.people, wide)
            k = order[np.repeat(first[slot], many[slot]) + _ranges(many[slot])]
            key = np.repeat(person, many[slot]).astype(np.int64) * span + confusion[k]
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, likely[truth[k]]]), len(keys))
        a, f = np.divmod(keys, span)
        a, f, n = np.concatenate([a, [-1, -1]]), np.concatenate([f, [0, 1]]), np.concatenate([sums, fit])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(f, pa.int32()), pa.array(n)], ["annotator", "confusion", "n"])

    return run


def _chosen(model: _Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            b = _Batch(rows, model.size)
            q, _ = model.truth(b)
            first = np.cumsum(b.labels) - b.labels
            # likeliest first, then the most votes, then the first in order
            order = np.lexsort((np.arange(len(q)), -b.votes, -np.round(q, 9), b.item_of))
            best = order[first]
            label = rows.column("labels").flatten().take(pa.array(best))
            agree = (b.chosen == np.repeat(best, b.voters)).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(b.voters)]).astype(np.int32))
            columns = [
                rows.column("item"), label, pa.array(b.voters.astype(np.int32)), pa.array(b.votes[best] / b.voters), pa.array(q[best]),
                pa.ListArray.from_arrays(ends, pa.array(b.people, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(agree)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item", "label", "readers", "agreement", "probability", "annotators", "agree"])

    return run


def last_labels(readings: DataFrame, item: str, annotator: str, label: str, at: str, tie: str) -> DataFrame:
    """(item, annotator, label): each annotator's last label of each item, where it is one."""
    rows = readings.where(F.col(item).isNotNull() & F.col(annotator).isNotNull())
    last = rows.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(F.max_by(F.col(label), F.struct(at, tie)).alias("label"))
    return last.select("item", "annotator", squeezed(F.col("label")).alias("label")).where("label is not null")


def consensus(labels: DataFrame, least: int = 3, communities: int = COMMUNITIES, updates: int = UPDATES, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """From (item, annotator, label): (item, label, readers, agreement, probability) of each item that `least` or
    more annotators labelled, and (annotator, items, reliability, right_rate, community) of each annotator, where
    reliability is the share of the items labelled as the consensus, and right_rate the share of symbols
    that the annotator's type reads right."""
    spark = labels.sparkSession
    labels = written(labels.select("item", "annotator", "label"), "labels")
    names = labels.select("annotator").distinct().orderBy("annotator").limit(MOST_ANNOTATORS + 1).toPandas()["annotator"].tolist()
    if len(names) > MOST_ANNOTATORS:
        raise ValueError(f"more than {MOST_ANNOTATORS} annotators: raise MOST_ANNOTATORS if the driver holds their confusions")
    seen = labels.select(F.explode(F.split("label", " ")).alias("g")).groupBy("g").count()
    glyphs = seen.orderBy(F.desc("count"), "g").limit(MOST_SYMBOLS).toPandas()
    rarer = seen.agg(F.sum("count"), F.count("*")).first() if len(glyphs) == MOST_SYMBOLS else (0, 0)
    rarer = (int(rarer[0] - glyphs["count"].sum()), int(rarer[1] - len(glyphs))) if rarer[1] else (0, 0)
    people = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "annotator string, number int")
    numbered = labels.join(F.broadcast(people), "annotator").select("item", F.col("number").alias("annotator"), "label")
    grouped = numbered.repartition(shuffle_parts(spark), "item").groupBy("item").agg(F.collect_list(F.struct("annotator", "label")).alias("votes"))
    items = written(grouped.mapInArrow(_items({g: i + 1 for i, g in enumerate(glyphs["g"])}), _ITEMS), "items")
    model = _Model(len(names), glyphs["count"].tolist(), rarer, communities)
    before = None
    for _ in range(updates if names else 0):
        sums = items.mapInArrow(_expected(model), "annotator int, confusion int, n double").groupBy("annotator", "confusion").agg(F.sum("n").alias("n"))
        sums = sums.toPandas().sort_values(["annotator", "confusion"])
        fit, count = sums["n"].to_numpy()[:2]
        now = fit / max(1.0, count) / np.log(2)
        if before is not None and model.logs is not None and abs(now - before) < settled:
            break
        before = now if model.logs is not None else None
        model.fit(sums[sums["annotator"] >= 0])
    chosen = items.mapInArrow(_chosen(model), "item string, label string, readers int, agreement double, probability double, annotators array<int>, agree array<int>")
    found = chosen.where(F.col("readers") >= least).select("item", "label", "readers", "agreement", "probability")
    each = chosen.select(F.explode(F.arrays_zip("annotators", "agree")).alias("v")).groupBy(F.col("v.annotators").alias("number"))
    trust = each.agg(F.count("*").alias("items"), F.avg("v.agree").alias("reliability"))
    right = np.zeros(len(names))
    if model.logs is not None:
        diagonal = np.exp(model.logs[:, (np.arange(model.size) * (model.size + 1))[1:]]).mean(1)
        right = model.kinds @ diagonal
    types = [(i, float(right[i]), int(model.kinds[i].argmax())) for i in range(len(names))]
    trust = trust.join(F.broadcast(spark.createDataFrame(types, "number int, right_rate double, community int")), "number").join(F.broadcast(people), "number")
    return found, trust.select("annotator", "items", "reliability", "right_rate", "community")

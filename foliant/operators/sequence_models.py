"""Sequence models fitted by expectation-maximisation over distributed sequences.

Each iteration is one pass: a task turns its sequences into expected counts by the current parameters, the counts are
summed on the way to the driver, and the driver normalises. What the driver holds is parameters, whose size is set by
states, slots and the alphabet and not by the corpus. Equal sequences are counted once, with their frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.corpus import readable
from foliant.session import shuffle_parts, written

UNKNOWN_SYMBOL = "<UNK>"
MOST_SYMBOLS = 5_000
#: Glyphs of the longest token that token models take; a longer one is refused.
LONGEST = 64
PSEUDOCOUNT = 0.5


def vocabulary(sequences: DataFrame) -> list[str]:
    """The symbols of sequences, with the unknown one last."""
    found = sequences.select(F.explode("symbols").alias("s")).distinct().orderBy("s").limit(MOST_SYMBOLS + 1).toPandas()["s"].tolist()
    if len(found) > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} symbols")
    return [*found, UNKNOWN_SYMBOL]


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(symbols, n): written once, as every iteration reads them, in enough parts for all cores however small."""
    own = sequences.where("size(symbols) > 0").groupBy("symbols").agg(F.count("*").alias("n"))
    return written(own.repartition(shuffle_parts(sequences.sparkSession)), "sequences")


def _summed(rows: DataFrame, step: Callable[[pa.Array, np.ndarray], dict[str, np.ndarray]], shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """The sum over tasks of the arrays that step returns for its sequences. Tasks send whole arrays, which are as
    large as the parameters, and these are added up in a tree of tasks before the driver sees one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for b in batches:
            if b.num_rows:
                for k, v in step(b.column("symbols"), b.column("n").to_numpy()).items():
                    total[k] += v
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(v.ravel()[at])], ["name", "at", "v"])

    found = rows.mapInArrow(run, "name string, at long, v double").groupBy("name", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {k: np.zeros(int(np.prod(s))) for k, s in shapes.items()}
    for k, own in found.groupby("name"):
        out[k][own["at"].to_numpy()] = own["v"].to_numpy()
    return {k: v.reshape(shapes[k]) for k, v in out.items()}


def _iterated(rows: DataFrame, models: list[HiddenMarkov | SlotGrammar], shapes: dict[str, tuple[int, ...]], iterations: int, least: int, tolerance: float, smoothing: float) -> list[list[float]]:
    """Improve models of the same shapes, each until its bits change by less than tolerance after `least` passes, or for
    `iterations`; the traces are of the bits before each update. What is counted last is not applied once a model has
    converged. All that go on share each pass."""
    traces: list[list[float]] = [[] for _ in models]
    going = list(range(len(models)))
    for _ in range(iterations):
        if not going:
            break

        def step(batch: pa.Array, times: np.ndarray, own: list = [(k, models[k]) for k in going]) -> dict[str, np.ndarray]:
            return {f"{k} {name}": v for k, m in own for name, v in m._step(batch, times).items()}

        c = _summed(rows, step, {f"{k} {name}": shape for k in going for name, shape in shapes.items()})
        for k in list(going):
            trace, own = traces[k], {name: c[f"{k} {name}"] for name in shapes}
            trace.append(float(own["bits"][0] / max(1.0, own["bits"][1])))
            if len(trace) >= max(2, least) and abs(trace[-1] - trace[-2]) < tolerance:
                going.remove(k)
                continue
            for name in shapes.keys() - {"bits"}:
                setattr(models[k], name, (own[name] + smoothing) / (own[name] + smoothing).sum(-1, keepdims=True))
    return traces


def best_of(make: Callable[[int], HiddenMarkov | SlotGrammar], rows: DataFrame, restarts: int, **settings) -> HiddenMarkov | SlotGrammar:
    """Of models begun from `restarts` seeds, the one that training sequences are likeliest under, the first of equals.
    Held-out sequences have no part in the choice."""
    best, least = None, np.inf
    models = [make(seed) for seed in range(restarts)]
    for model, trace in zip(models, type(models[0]).fit_all(models, rows, **settings)):
        bits = trace[-1]
        if bits < least - 1e-12:
            best, least = model, bits
    return best


class HiddenMarkov:
    """A hidden Markov model by Baum-Welch, in scaled probabilities."""

    def __init__(self, states: int, symbols: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.code = {s: i for i, s in enumerate(symbols)}
        self.start = np.full(states, 1 / states)
        self.move = rng.dirichlet(np.ones(states), states)
        self.emit = rng.dirichlet(np.ones(len(symbols)), states)

    def _coded(self, batch: list[list[str]] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all sequences' codes one after the other, where each begins, its length)."""
        batch = batch if isinstance(batch, pa.Array) else pa.array(batch, pa.list_(pa.string()))
        flat = pc.index_in(batch.flatten(), value_set=pa.array(list(self.code), pa.string())).fill_null(len(self.code) - 1)
        n = pc.list_value_length(batch).to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n) - n, n

    def _padded(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes by place and sequence, each sequence's length) of some sequences."""
        flat, at, n = coded
        n = n[own]
        place = np.arange(int(n.max()))[:, None]
        on = place < n
        codes = np.zeros(on.shape, np.int64)
        codes[on] = flat[(at[own] + place)[on]]
        return codes, n

    def _forward(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward chances and scales; beyond a sequence's end they are those of its last place, and 1."""
        alpha, scale = np.empty((*codes.shape, len(self.start))), np.ones(codes.shape)
        a = np.broadcast_to(self.start, (codes.shape[1], len(self.start)))
        for i, c in enumerate(codes):
            now = (a if i == 0 else a @ self.move) * self.emit[:, c].T
            total = now.sum(1)
            on = (i < n)[:, None]
            a = np.where(on, now / total[:, None], a)
            scale[i] = np.where(on[:, 0], total, 1.0)
            alpha[i] = a
        return alpha, scale

    def _step(self, batch: list[list[str]] | pa.Array, times: np.ndarray) -> dict[str, np.ndarray]:
        start, move, emit, bits = np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit), np.zeros(2)
        # sequences of about one length go together, at most some million numbers at a time
        coded = self._coded(batch)
        order = np.argsort(coded[2], kind="stable")
        while len(order):
            size = max(1, 2_000_000 // (int(coded[2][order[-1]]) * len(self.start)))
            own, order = order[-size:], order[:-size]
            codes, n = self._padded(coded, own)
            w = np.asarray(times)[own].astype(float)
            alpha, scale = self._forward(codes, n)
            bits += [-(w * np.log2(scale).sum(0)).sum(), (w * n).sum()]
            beta = np.ones((len(own), len(self.start)))
            for i in range(len(codes) - 1, -1, -1):
                on = (i < n)[:, None]
                gamma = np.where(on, alpha[i] * beta, 0.0) * w[:, None]
                for z in range(len(self.start)):
                    emit[z] += np.bincount(codes[i], gamma[:, z], emit.shape[1])
                if i:
                    back = np.where(on, self.emit[:, codes[i]].T * beta / scale[i][:, None], 0.0)
                    move += self.move * ((alpha[i - 1] * w[:, None]).T @ back)
                    beta = np.where(on, back @ self.move.T, beta)
                else:
                    start += gamma.sum(0)
        return {"start": start, "move": move, "emit": emit, "bits": bits}

    def fit(self, rows: DataFrame, iterations: int = 50, smoothing: float = PSEUDOCOUNT, least: int = 5, tolerance: float = 1e-5) -> list[float]:
        """Bits per event before each update, which never rise but for smoothing."""
        return self.fit_all([self], rows, iterations, smoothing, least, tolerance)[0]

    @staticmethod
    def fit_all(models: list[HiddenMarkov], rows: DataFrame, iterations: int = 50, smoothing: float = PSEUDOCOUNT, least: int = 5, tolerance: float = 1e-5) -> list[list[float]]:
        """fit() of models of one size, which share each pass."""
        m = models[0]
        shapes = {"start": m.start.shape, "move": m.move.shape, "emit": m.emit.shape, "bits": (2,)}
        return _iterated(rows, models, shapes, iterations, least, tolerance, smoothing)

    def scores(self, batch: list[list[str]]) -> np.ndarray:
        """The bits of each sequence."""
        out = np.empty(len(batch))
        coded = self._coded(batch)
        order = np.argsort(coded[2], kind="stable")
        while len(order):
            size = max(1, 2_000_000 // (max(1, int(coded[2][order[-1]])) * len(self.start)))
            own, order = order[-size:], order[:-size]
            out[own] = -np.log2(self._forward(*self._padded(coded, own))[1]).sum(0)
        return out

    def bits(self, symbols: list[str]) -> float:
        return float(self.scores([symbols])[0])


def _by_length(batch: list[list[str]], code: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, their codes as one array) of the sequences of each length."""
    sizes = np.array([len(s) for s in batch])
    if len(sizes) and sizes.max() > LONGEST:
        raise ValueError(f"a token of more than {LONGEST} glyphs")
    unknown = len(code) - 1
    for n in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == n)
        yield own, np.array([[code.get(s, unknown) for s in batch[k]] for k in own])


class SlotGrammar:
    """Tokens as templates: P(length) x the mixture over templates of each slot's glyph; a token's glyphs lie evenly
    over the slots. Templates begin near the glyphs' own frequencies."""

    def __init__(self, templates: int, slots: int, symbols: list[str], seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.code = {s: i for i, s in enumerate(symbols)}
        self.slots, self.templates = slots, templates
        self.length = np.full(LONGEST, 1 / LONGEST)
        self.mix = self.rng.dirichlet(np.ones(templates))
        self._begin(np.zeros(len(symbols)))

    def _begin(self, counts: np.ndarray) -> None:
        share = (counts + PSEUDOCOUNT) / (counts + PSEUDOCOUNT).sum()
        self.emit = self.rng.dirichlet(20.0 * share + 0.05, (self.templates, self.slots))
        self.emit = np.maximum(self.emit, 1e-300)

    def places(self, n: int) -> np.ndarray:
        return np.array([self.slots // 2]) if n == 1 else np.rint(np.linspace(0, self.slots - 1, n)).astype(int)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        """Log chances of tokens of one length with each template."""
        at = self.places(codes.shape[1])
        return np.log(self.mix) + sum(np.log(self.emit[:, s, codes[:, i]]).T for i, s in enumerate(at))

    def _step(self, batch: list[list[str]], times: np.ndarray) -> dict[str, np.ndarray]:
        batch = batch.to_pylist() if isinstance(batch, pa.Array) else batch
        length, mix, emit, bits = np.zeros_like(self.length), np.zeros_like(self.mix), np.zeros_like(self.emit), np.zeros(2)
        for own, codes in _by_length(batch, self.code):
            n, w, logs = codes.shape[1], np.asarray(times)[own].astype(float), self._logs(codes)
            top = logs.max(1)
            q = np.exp(logs - top[:, None])
            total = q.sum(1)
            bits += [(w * (-np.log2(total) - top / np.log(2) - np.log2(self.length[n - 1]))).sum(), w.sum()]
            q *= (w / total)[:, None]
            length[n - 1] += w.sum()
            mix += q.sum(0)
            for i, s in enumerate(self.places(n)):
                for z in range(self.templates):
                    emit[z, s] += np.bincount(codes[:, i], q[:, z], emit.shape[2])
        return {"length": length, "mix": mix, "emit": emit, "bits": bits}

    def fit(self, rows: DataFrame, iterations: int = 50, smoothing: float = PSEUDOCOUNT, least: int = 5, tolerance: float = 1e-5) -> list[float]:
        """Bits per token before each update."""
        found = rows.select("n", F.explode("symbols").alias("s")).groupBy("s").agg(F.sum("n").alias("n")).toPandas()  # symbols
        counts = np.zeros(len(self.code))
        np.add.at(counts, [self.code.get(s, len(self.code) - 1) for s in found["s"]], found["n"])
        self._begin(counts)
        sizes = rows.groupBy(F.size("symbols").alias("k")).agg(F.sum("n").alias("n")).toPandas()
        if len(sizes) and sizes["k"].max() > LONGEST:
            raise ValueError(f"a token of more than {LONGEST} glyphs")
        length = np.full(LONGEST, smoothing)
        length[sizes["k"] - 1] += sizes["n"]
        self.length = length / length.sum()
        shapes = {"length": self.length.shape, "mix": self.mix.shape, "emit": self.emit.shape, "bits": (2,)}
        return _iterated(rows, [self], shapes, iterations, least, tolerance, smoothing)[0]

    @staticmethod
    def fit_all(models: list[SlotGrammar], rows: DataFrame, **settings) -> list[list[float]]:
        return [m.fit(rows, **settings) for m in models]

    def scores(self, batch: list[list[str]]) -> np.ndarray:
        out = np.zeros(len(batch))
        for own, codes in _by_length(batch, self.code):
            out[own] = -np.logaddexp.reduce(self._logs(codes), axis=1) / np.log(2) - np.log2(self.length[codes.shape[1] - 1])
        return out

    def bits(self, symbols: list[str]) -> float:
        return float(self.scores([symbols])[0])


def edit_operations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols shortest edit scripts keep, replace, drop and add, for pairs of sequences (pairs, n) and
    (pairs, m). Of equally short ways to a place the one over a kept or replaced symbol goes first, then a dropped one."""
    pairs, n = a.shape
    m = b.shape[1]
    d = np.zeros((pairs, m + 1), np.int32) + np.arange(m + 1, dtype=np.int32)
    ops = np.zeros((pairs, m + 1, 4), np.int32)
    ops[:, :, 3] = np.arange(m + 1)
    for i in range(n):
        last, before = d, ops
        d, ops = np.empty_like(last), np.empty_like(before)
        d[:, 0], ops[:, 0] = i + 1, before[:, 0]
        ops[:, 0, 2] += 1
        for j in range(m):
            same = a[:, i] == b[:, j]
            diagonal, up, left = last[:, j] + ~same, last[:, j + 1] + 1, d[:, j] + 1
            d[:, j + 1] = np.minimum(np.minimum(diagonal, up), left)
            way = np.where(d[:, j + 1] == diagonal, 0, np.where(d[:, j + 1] == up, 1, 2))
            ops[:, j + 1] = np.where((way == 0)[:, None], before[:, j], np.where((way == 1)[:, None], before[:, j + 1], ops[:, j]))
            kind = np.where(way == 0, np.where(same, 0, 1), way + 1)
            ops[np.arange(pairs), j + 1, kind] += 1
    return ops[:, m]


def alignment_counts(a: list[str], b: list[str]) -> dict[str, int]:
    """Symbols kept (M), replaced (S), dropped (D) and added (I) between two sequences."""
    code = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    found = edit_operations(np.array([[code[x] for x in a]], int).reshape(1, len(a)), np.array([[code[x] for x in b]], int).reshape(1, len(b)))[0]
    return dict(zip("MSDI", found.tolist()))


def copy_sources(tokens: DataFrame, window: int) -> DataFrame:
    """The readable ones of tokens (record_id, token_index, glyphs) with `history`, the up to `window` tokens before in the
    line, nearest first. An unreadable token ends what can be copied: none after it looks beyond it."""
    t = tokens.withColumn("__break", (~readable(F.col("glyphs"))).cast("int"))
    t = t.withColumn("__part", F.expr("sum(__break) over (partition by record_id order by token_index)")).where("__break = 0")
    frame = f"over (partition by record_id, __part order by token_index rows between {window} preceding and 1 preceding)"
    return t.withColumn("history", F.reverse(F.expr(f"collect_list(glyphs) {frame}"))).drop("__break", "__part")


class CopyEdit:
    """A token is new, or an edited copy of a recent one. Between the source's symbols others are added, as many as a
    geometric chance gives; each of its symbols is dropped, or kept, or drawn anew; what is added or drawn follows the
    glyphs' frequencies. Chances are pooled from alignments with the nearest source. How far back sources lie is
    learned from these, too; with fewer tokens before, the chances of their distances are scaled up to 1."""

    def __init__(self, symbols: list[str], window: int = 4):
        self.code = {s: i for i, s in enumerate(symbols)}
        self.symbol = np.full(len(symbols), 1 / len(symbols))
        self.length = np.full(LONGEST, 1 / LONGEST)
        self.distance = np.full(window, 1 / window)
        self.insert, self.delete, self.keep, self.rho = 0.05, 0.05, 0.9, 0.5

    def _pairs(self, tokens: list[list[str]], histories: list[list[list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(token's number, distance from 0, sources' codes, tokens' codes) of pairs of tokens with what came before, those
        of equal lengths together."""
        unknown, window = len(self.code) - 1, len(self.distance)
        codes = [[self.code.get(s, unknown) for s in t] for t in tokens]
        if any(len(c) > LONGEST for c in codes):
            raise ValueError(f"a token of more than {LONGEST} glyphs")
        alike: dict[tuple[int, int], list[tuple[int, int, list[int]]]] = {}
        for k, history in enumerate(histories):
            for back, source in enumerate(history[:window]):
                alike.setdefault((len(source), len(codes[k])), []).append((k, back, [self.code.get(s, unknown) for s in source]))
        for (n, m), rows in alike.items():
            for start in range(0, len(rows), 20_000):
                some = rows[start : start + 20_000]
                own = np.array([r[0] for r in some])
                yield own, np.array([r[1] for r in some]), np.array([r[2] for r in some], int).reshape(-1, n), np.array([codes[k] for k in own], int).reshape(-1, m)

    def new(self, tokens: list[list[str]]) -> np.ndarray:
        """The chance of each token as a new one."""
        out = np.zeros(len(tokens))
        for own, codes in _by_length(tokens, self.code):
            out[own] = self.length[codes.shape[1] - 1] * self.symbol[codes].prod(1)
        return out

    def copied(self, source: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The chance that the edit channel makes tokens (pairs, m) of sources (pairs, n), over all scripts, given that it
        makes something."""
        pairs, m = token.shape
        g = self.symbol[token]
        # added[p, i, j]: that a gap adds symbols i to j and then stops
        added = np.zeros((pairs, m + 1, m + 1))
        for i in range(m + 1):
            added[:, i, i] = 1 - self.insert
            for j in range(i, m):
                added[:, i, j + 1] = added[:, i, j] * self.insert * g[:, j]
        p = np.zeros((pairs, m + 1))
        p[:, 0] = 1
        for i in range(source.shape[1]):
            gap = np.einsum("pi,pij->pj", p, added)
            p = gap * self.delete
            p[:, 1:] += gap[:, :m] * (1 - self.delete) * (self.keep * (token == source[:, i : i + 1]) + (1 - self.keep) * g)
        total = np.einsum("pi,pi->p", p, added[:, :, m])
        nothing = ((1 - self.insert) * self.delete) ** source.shape[1] * (1 - self.insert)
        return total / max(1e-300, 1 - nothing)

    def mixed(self, tokens: list[list[str]], histories: list[list[list[str]]]) -> np.ndarray:
        """The chance of each token as a copy of one of its history, nearest first, by their distances; 0 without any."""
        out = np.zeros(len(tokens))
        upto = np.cumsum(self.distance)[np.minimum([max(len(h), 1) for h in histories], len(self.distance)) - 1] if tokens else out
        for own, back, source, token in self._pairs(tokens, histories):
            np.add.at(out, own, self.distance[back] / upto[own] * self.copied(source, token))
        return out

    def sources(self, tokens: list[list[str]], histories: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(distance from 0 of each token's source, or -1; kept, replaced, dropped, added, and symbols of the source): the
        nearest by share of edits, then edits, then recency."""
        best = np.full((len(tokens), 3), np.inf)
        ops = np.zeros((len(tokens), 5), np.int64)
        for own, back, source, token in self._pairs(tokens, histories):
            found = edit_operations(source, token)
            edits = found[:, 1:].sum(1)
            rank = np.stack([edits / max(source.shape[1], token.shape[1], 1), edits, back], axis=1)
            for k, r, o in zip(own, rank, found):
                if tuple(r) < tuple(best[k]):
                    best[k], ops[k, :4], ops[k, 4] = r, o, source.shape[1]
        return np.where(np.isfinite(best[:, 2]), best[:, 2], -1).astype(int), ops

    def fit(self, rows: DataFrame, iterations: int = 100, tolerance: float = 1e-10) -> None:
        """rows (glyphs, history)."""
        size, window = len(self.code), len(self.distance)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            length, symbol, back, ops = np.zeros(LONGEST), np.zeros(size), np.zeros(window), np.zeros(6)
            for b in batches:
                tokens, histories = b.column("glyphs").to_pylist(), b.column("history").to_pylist()
                for own, codes in _by_length(tokens, self.code):
                    length[codes.shape[1] - 1] += len(own)
                    symbol += np.bincount(codes.ravel(), minlength=size)
                at, found = self.sources(tokens, histories)
                back += np.bincount(at[at >= 0], minlength=window)
                ops += [*found.sum(0), (at >= 0).sum()]
            names = [*(f"L{i}" for i in range(LONGEST)), *(f"G{i}" for i in range(size)), *(f"W{i}" for i in range(window)), *(f"E{i}" for i in range(6))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([length, symbol, back, ops]))], ["k", "v"])

        found = rows.mapInArrow(counted, "k string, v double").groupBy("k").agg(F.sum("v").alias("v"))
        c = {r["k"]: r["v"] for r in found.collect()}  # parameters
        some = lambda name, n: np.array([c.get(f"{name}{i}", 0.0) for i in range(n)])
        share = lambda x: (x + PSEUDOCOUNT) / (x + PSEUDOCOUNT).sum()
        self.length, self.symbol, self.distance = share(some("L", LONGEST)), share(some("G", size)), share(some("W", window))
        kept, replaced, dropped, added, symbols, pairs = some("E", 6)
        self.insert = (added + PSEUDOCOUNT) / (added + symbols + pairs + 2 * PSEUDOCOUNT)
        self.delete = (dropped + PSEUDOCOUNT) / (symbols + 2 * PSEUDOCOUNT)
        self.keep = (kept + PSEUDOCOUNT) / (kept + replaced + 2 * PSEUDOCOUNT)
        likelihood = written(rows.where("size(history) > 0").mapInArrow(self._likelihoods, "new double, copied double"), "likelihoods")
        for _ in range(iterations):
            q = F.col("copied") * self.rho / (F.col("copied") * self.rho + F.col("new") * (1 - self.rho))
            total, n = likelihood.agg(F.sum(q), F.count("*")).first()
            if not n:
                break
            rho, before = (total + PSEUDOCOUNT) / (n + 2 * PSEUDOCOUNT), self.rho
            self.rho = float(rho)
            if abs(rho - before) < tolerance:
                break

    def _likelihoods(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, histories = b.column("glyphs").to_pylist(), b.column("history").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(self.new(tokens)), pa.array(self.mixed(tokens, histories))], ["new", "copied"])

    def scores(self, tokens: list[list[str]], histories: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(bits, the chance that it is a copy) of each token."""
        new = self.new(tokens)
        has = np.array([bool(h) for h in histories], bool)
        copy = self.mixed(tokens, histories) * self.rho
        total = np.maximum(np.where(has, copy + new * (1 - self.rho), new), 1e-300)
        return -np.log2(total), np.where(has, copy / total, 0.0)

    def score(self, token: list[str], history: list[list[str]]) -> tuple[float, float]:
        bits, copy = self.scores([token], [history])
        return float(bits[0]), float(copy[0])


def unit_bits(rows: DataFrame, unit: str, model: HiddenMarkov | SlotGrammar, column: str = "symbols") -> DataFrame:
    """(unit, bits, events, sequences, oov) of sequences under a fitted model, scored in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_pylist()
            if own:
                strange = [sum(s not in model.code for s in x) for x in own]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(own)), pa.array([len(x) for x in own], pa.int64()), pa.array(strange, pa.int64())], [unit, "bits", "events", "oov"])

    each = rows.select(unit, column).mapInArrow(run, f"{unit} string, bits double, events long, oov long")
    return each.groupBy(unit).agg(F.sum("bits").alias("bits"), F.sum("events").alias("events"), F.count("*").alias("sequences"), F.sum("oov").alias("oov"))


def copy_scores(rows: DataFrame, model: CopyEdit, unit: str) -> DataFrame:
    """(unit, bits, events, tokens, oov, copies, contextual) of tokens (unit, glyphs, history): copies are the summed chances
    of being one, of the contextual tokens that have something before them. An event is a glyph or a token's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, histories = b.column(1).to_pylist(), b.column(2).to_pylist()
            if tokens:
                bits, copy = model.scores(tokens, histories)
                columns = [pa.array(bits), pa.array([len(t) + 1 for t in tokens], pa.int64()), pa.array([sum(s not in model.code for s in t) for t in tokens], pa.int64()), pa.array(copy), pa.array([int(bool(h)) for h in histories], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [unit, "bits", "events", "oov", "copy", "has"])

    each = rows.select(unit, "glyphs", "history").mapInArrow(run, f"{unit} string, bits double, events long, oov long, copy double, has long")
    return each.groupBy(unit).agg(
        F.sum("bits").alias("bits"), F.sum("events").alias("events"), F.count("*").alias("tokens"), F.sum("oov").alias("oov"), F.sum("copy").alias("copies"), F.sum("has").alias("contextual")
    )


def parameters(model: HiddenMarkov | SlotGrammar | CopyEdit) -> dict[str, list]:
    """A model's parameters and symbols as plain lists."""
    held = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(model).items() if isinstance(v, (np.ndarray, float, int))}
    return held | {"symbols": list(model.code), "kind": type(model).__name__}


def save_model(spark, model: HiddenMarkov | SlotGrammar | CopyEdit, path: str, **facts: object) -> None:
    """Write a model's parameters, with facts about its fit, as one row of JSON text."""
    import json

    spark.createDataFrame([(json.dumps(parameters(model)), json.dumps(facts))], "parameters string, facts string").coalesce(1).write.parquet(path)


def load_model(spark, path: str) -> tuple[HiddenMarkov | SlotGrammar | CopyEdit, dict]:
    """(model, facts) that save_model wrote."""
    import json

    row = spark.read.parquet(path).first()
    held = json.loads(row["parameters"])
    kind, symbols = held.pop("kind"), held.pop("symbols")
    model = {"HiddenMarkov": HiddenMarkov, "SlotGrammar": SlotGrammar, "CopyEdit": CopyEdit}[kind].__new__({"HiddenMarkov": HiddenMarkov, "SlotGrammar": SlotGrammar, "CopyEdit": CopyEdit}[kind])
    model.code = {s: i for i, s in enumerate(symbols)}
    for k, v in held.items():
        setattr(model, k, np.array(v) if isinstance(v, list) else v)
    return model, json.loads(row["facts"])

"""Same or near-same records across splits.

Method: the evaluation records' n-gram hashes are partitioned, the training records are scanned for hits, and
each hit pair gets the containment of the evaluation record in the training record and an exact check. The
n-grams are of characters, not words, since edits may touch most words of a record (see README): of a record
of length n, at most n // 9 edits lie between it and a partner, so of that many plus one disjoint n-grams at
least one stands unedited in the partner, displaced by no more than the edits. Each training record therefore
probes with its n // 9 + 1 disjoint n-grams only, and those are chosen to be the rarest, which keeps hot
n-grams out of the join wherever a record has others; the index holds every n-gram of every evaluation record.
No pair is lost: records shorter than the least length are no case, and every longer one has enough n-grams.

A table of the frequencies of the index' n-grams, as large as the index needs up to 2 ** MOST_BITS slots, chooses the
probes and drops those that hit nothing; where it is full it still tells frequent n-grams from rare ones. N-grams meet
by a 64-bit hash. Every entry carries a 128-bit mark of its text's character pairs; one edit changes at most four of its
bits, so most pairs that share an n-gram by chance end in the join itself. Long texts are cut into stretches
of about STRETCH characters, each of which picks its share of the probes. The entries of an n-gram that the
index holds more than HOT times are dealt out by text, and the few probes with it meet all of these parts; the
join has as many partitions as its entries need.

Copies of one text are one entry of the join, known by 128 bits of hash and numbered once written; their pairs come
out where the records are joined back.

Defined cases: null, empty and short texts take no part; records of unknown pages or splits take no part;
repeated deliveries count once (the last); ties at exactly a tenth count; texts may be of any length; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import page_leaf, page_name, plain_text
from foliant.session import bounded, written

#: Characters in an n-gram: the largest n for which n // 9 + 1 disjoint ones fit into n // 9 * 9 + 8 or fewer
#: characters from MIN_LENGTH on.
GRAM = 7
MIN_LENGTH = 40
#: Log2 of the slots of the table of n-gram frequencies, at least and at most: four slots for each n-gram between.
LEAST_BITS, MOST_BITS = 12, 18
#: Entries of one n-gram that one part takes, about, and entries of one partition of the join.
HOT, PART = 20_000, 500_000
#: Characters of a stretch, a multiple of 9; the last one of a text is half to one and a half times as long.
STRETCH = 1800
_MIX = np.uint64(0x9E3779B97F4A7C15)


def page_splits(leaf_split: DataFrame, special_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((leaf, split), (page, split)): the split of each leaf, and of each special page by its linked leaves
    (of several splits the first of the smallest leaf)."""
    split = F.nullif(F.lower(F.regexp_replace("split", r"\s+", "")), F.lit(""))
    leaves = leaf_split.select("leaf", split.alias("split")).where("leaf is not null and split is not null").groupBy("leaf").agg(F.min("split").alias("split"))
    linked = special_pages.select(page_name(F.col("folio")).alias("page"), F.explode("linked_leaves").alias("leaf")).join(leaves, "leaf")
    return leaves, linked.groupBy("page").agg(F.min_by("split", "leaf").alias("split"))


def with_split(loci: DataFrame, leaf_split: DataFrame, special_pages: DataFrame) -> DataFrame:
    """(record_id, transcription_id, split, text) of each record whose page has a split."""
    leaves, pages = page_splits(leaf_split, special_pages)
    last = loci.groupBy("record_id").agg(F.max_by(F.struct("transcription_id", "folio", "text_normalized"), F.struct("ingested_at", "text_normalized")).alias("r"))
    rows = last.select("record_id", "r.transcription_id", plain_text(F.col("r.text_normalized")).alias("text"), page_name(F.col("r.folio")).alias("page"), page_leaf(F.col("r.folio")).alias("leaf"))
    # special pages are broadcast as long as they are few; leaves grow with the corpus and are left to the planner
    rows = rows.join(bounded(pages.withColumnRenamed("split", "page_split")), "page", "left").join(leaves, "leaf", "left")
    return rows.select("record_id", "transcription_id", F.coalesce("page_split", "split").alias("split"), "text").where("split is not null")


def _grams(codes: np.ndarray) -> np.ndarray:
    """The hash of the n-gram beginning at each position of the concatenated texts."""
    h = np.zeros(max(len(codes) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        h = (h ^ codes[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes at every position of the batch's text, start of each text, its length, code points)."""
    texts = batch.column("text").to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return _grams(codes), np.cumsum(n) - n, n, codes


def _marks(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of 128 classes of character pairs each text holds, as two words of bits."""
    text = np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))
    at = np.repeat(start, np.maximum(n - 1, 0)) + np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(n - 1, 0)) - np.maximum(n - 1, 0), np.maximum(n - 1, 0))
    pair = ((codes[at] * np.uint64(0x10001) + codes[at + 1]) * _MIX) >> np.uint64(57)
    held = np.zeros((len(n), 128), bool)
    held[text, pair.astype(np.int64)] = True
    words = np.packbits(held, axis=1).view(np.int64)
    return words[:, 0], words[:, 1]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _rows(side: str, g: np.ndarray, ids: np.ndarray, pos: np.ndarray, n: np.ndarray, marks: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> pa.RecordBatch:
    """Entries of n-grams g at pos of the texts numbered `text`; place holds the position and the text's length."""
    place = (pos.astype(np.int64) << 32) | n[text]
    columns = [g.view(np.int64), ids[text], place, marks[0][text], marks[1][text]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", *[f"{side}_{c}" for c in ("id", "place", "m0", "m1")]])


def _every(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many n-grams each text has, the position in its text of each)."""
    many = np.maximum(n - GRAM + 1, 0)
    return many, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _parts(counts: np.ndarray) -> np.ndarray:
    """How many parts the entries of each slot are dealt out to."""
    return (counts // HOT + 1).astype(np.int64)


def _salted(g: np.ndarray, part: np.ndarray) -> np.ndarray:
    return g + part.astype(np.uint64) * _MIX


def _index(counts: np.ndarray, bits: int):
    """Every n-gram of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(counts)
        for b in batches:
            if b.num_rows:
                h, start, n, codes = _texts(b)
                many, pos = _every(start, n)
                text = np.repeat(np.arange(len(n)), many)
                g, ids = h[start[text] + pos], b.column("text_id").to_numpy()
                yield _rows("eval", _salted(g, ids[text] % parts[_slot(g, bits)]), ids, pos, n, _marks(codes, start, n), text)

    return run


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            if b.num_rows:
                h, start, n, _ = _texts(b)
                many, pos = _every(start, n)
                total += np.bincount(_slot(h[np.repeat(start, many) + pos], bits), minlength=1 << bits)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "n"])

    return run


def _stretches(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, length) of the stretches of texts of n characters."""
    many = np.maximum((n - STRETCH // 2) // STRETCH, 0) + 1
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k * STRETCH, np.where(k == many[text] - 1, n[text] - k * STRETCH, STRETCH)


def _rarest(cost: np.ndarray, picks: int) -> np.ndarray:
    """For texts of one length (a row of costs each), the starts of `picks` disjoint n-grams of least total cost."""
    rows, width = cost.shape
    best = np.zeros((rows, width + GRAM))
    taken = []
    for _ in range(picks):
        # best[:, p] is the least cost so far of n-grams that all end before p
        now = np.full((rows, width + GRAM), np.inf)
        now[:, GRAM:] = best[:, :width] + cost
        now = np.minimum.accumulate(now, axis=1)
        taken.append(now)
        best = now
    starts = np.empty((rows, picks), np.int64)
    end = np.full(rows, width + GRAM - 1)
    for k in reversed(range(picks)):
        now = taken[k]
        target = now[np.arange(rows), end]
        # the first place that reaches the least cost is where the k-th n-gram ends
        first = (now == target[:, None]).argmax(axis=1)
        starts[:, k] = first - GRAM
        end = starts[:, k]
    return starts


def _probes(counts: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost_of, parts = counts + np.float32(1), _parts(counts)  # the sum over a text's n-grams is the number of hits it will have
        for b in batches:
            if not b.num_rows:
                continue
            h, start, n, codes = _texts(b)
            ids, marks = b.column("text_id").to_numpy(), _marks(codes, start, n)
            text, first, length = _stretches(n)
            last = first + length == n[text]
            # stretches of one length go together; a last one picks one n-gram more than the ninth of its length
            for size, final in np.unique(np.stack([length, last]), axis=1).T.tolist():
                own = np.flatnonzero((length == size) & (last == final))
                picks, width = size // 9 + final, size - GRAM + 1
                step = max(1, 4_000_000 // (picks * width))  # the tables of the choice take picks x width x rows
                for some in np.split(own, range(step, len(own), step)):
                    at = start[text[some]] + first[some]
                    starts = _rarest(cost_of[_slot(h[at[:, None] + np.arange(width)], bits)], picks)
                    g = h[at[:, None] + starts].ravel()
                    # where the table is empty, so is the index; a hot n-gram asks each part
                    asks = np.where(counts[_slot(g, bits)] > 0, parts[_slot(g, bits)], 0)
                    part = np.arange(asks.sum()) - np.repeat(np.cumsum(asks) - asks, asks)
                    hits = np.repeat(np.arange(len(g)), asks)
                    yield _rows("train", _salted(g[hits], part), ids, (starts + first[some][:, None]).ravel()[hits], n, marks, np.repeat(text[some], picks)[hits])

    return run


def near_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id, train_text, eval_text, edits) of all pairs of texts (text_id, text) of MIN_LENGTH or
    more characters whose edit distance is at most a tenth of the longer one's length."""
    spark = train.sparkSession
    grams = evaluation.agg(F.sum(F.length("text"))).first()[0] or 0
    probed = train.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = max(1, -(-(grams + probed // 9) // PART))
    bits = min(MOST_BITS, max(LEAST_BITS, int(4 * grams).bit_length()))
    found = evaluation.select("text").mapInArrow(_counts(bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = found.toPandas()  # at most 2 ** MOST_BITS rows
    counts = np.zeros(1 << bits, np.float32)
    counts[found["slot"]] = found["n"]
    frequencies = spark.sparkContext.broadcast(counts)
    schema = "gram long, {0}_id long, {0}_place long, {0}_m0 long, {0}_m1 long"
    probes = train.select("text_id", "text").mapInArrow(lambda it: _probes(frequencies.value, bits)(it), schema.format("train"))
    index = evaluation.select("text_id", "text").mapInArrow(lambda it: _index(frequencies.value, bits)(it), schema.format("eval"))
    at, size = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    longer = F.greatest(size("eval_place"), size("train_place"))
    apart = F.bit_count(F.col("eval_m0").bitwiseXOR(F.col("train_m0"))) + F.bit_count(F.col("eval_m1").bitwiseXOR(F.col("train_m1")))
    hits = index.repartition(partitions, "gram").join(probes.repartition(partitions, "gram"), "gram").where(
        (F.abs(at("eval_place") - at("train_place")) * 10 <= longer) & (F.abs(size("eval_place") - size("train_place")) * 10 <= longer) & (apart <= 4 * F.floor(longer / 10))
    )
    pairs = hits.select("train_id", "eval_id").distinct()
    texts = pairs.join(train.select(F.col("text_id").alias("train_id"), F.col("text").alias("train_text")), "train_id")
    texts = texts.join(evaluation.select(F.col("text_id").alias("eval_id"), F.col("text").alias("eval_text")), "eval_id")
    # -1 beyond the limit; the time is in proportion to length x limit
    edits = F.expr("levenshtein(train_text, eval_text, cast(greatest(length(train_text), length(eval_text)) div 10 as int))")
    return texts.withColumn("edits", edits).where("edits >= 0")


def containment(of: str, within: str, words: int = 5):
    """Share of the distinct word n-grams of one text that stand in another; the whole text where it is shorter."""

    def grams(c: str):
        w = F.split(F.col(c), " ")
        n = F.least(F.lit(words), F.size(w))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))

    own = grams(of)
    return F.size(F.array_intersect(own, grams(within))) / F.size(own)


def cross_split_overlaps(loci: DataFrame, leaf_split: DataFrame, special_pages: DataFrame) -> DataFrame:
    """(train_record, eval_record, split, transcription_id, edits, containment): every pair of a train record
    and a validation or test record whose plain texts are the same or nearly so."""
    rows = with_split(loci, leaf_split, special_pages).where(F.length("text") >= MIN_LENGTH)
    known_by = ("h1", "h2")
    rows = written(rows.select("record_id", "transcription_id", "split", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")), "split-texts")
    train, evaluation = rows.where("split = 'train'"), rows.where("split in ('validation', 'test')")
    texts = rows.groupBy(*known_by, (F.col("split") == "train").alias("train")).agg(F.first("text").alias("text"))
    # the numbers are fixed once they are written
    texts = written(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")
    near = near_pairs(texts.where("train"), texts.where("not train")).select("train_id", "eval_id", "edits", containment("eval_text", "train_text").alias("containment"))

    def named(pairs: DataFrame, side: str, records: DataFrame) -> DataFrame:
        """pairs with the records that hold the texts of one side."""
        hashes = texts.where("train" if side == "train" else "not train").select(F.col("text_id").alias(f"{side}_id"), *known_by)
        return pairs.join(hashes, f"{side}_id").join(records, list(known_by)).drop(f"{side}_id", *known_by)

    pairs = named(near, "train", train.select(*known_by, F.col("record_id").alias("train_record")))
    pairs = named(pairs, "eval", evaluation.select(*known_by, F.col("record_id").alias("eval_record"), "split", "transcription_id"))
    return pairs.select("train_record", "eval_record", "split", "transcription_id", "edits", "containment")

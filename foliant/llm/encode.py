"""Encoding of a whole corpus with a public byte-level tokenizer, and decoding.

Method: texts are cut into pre-tokens with positions; the distinct words are shuffled over the whole corpus
and each is encoded once; the ids are joined back and the texts reassembled by position. Decoding joins the
tokenizer's token-byte table.

What keeps the shuffle small: a block of neighbouring texts numbers its distinct words, so each text is an
array of word numbers (its positions), which goes nowhere but to its block's reassembly, and a word is sent once
a block and not once an occurrence. A word in every block is as many rows as there are blocks, each of which
may lie in another task: no hot word, source or text gathers more than one block's rows. Exchanges have as many
partitions as the blocks need, so tasks stay as large whatever the input. The vocabulary is read once, by the
driver, and sent to the executors; its size is the tokenizer's and not the corpus'.

Defined cases: a null or empty text gives an empty list; a blank text its ids; special tokens' strings are
ordinary text; repeated rows and null ids come out as often as they came in; texts may be of any length (a
block ends with the text that fills it); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters and texts that end a block.
BLOCK_CHARS, BLOCK_TEXTS = 2_000_000, 4_000
#: Blocks that one task of an exchange takes.
TASK_BLOCKS = 2


@functools.cache
def _encoding_of(vocabulary: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(vocabulary), special_tokens={})


def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}


def _read(spark: SparkSession, vocabulary: str) -> bytes:
    """The vocabulary's file: the driver's, or at an address that Spark reads."""
    if "://" in vocabulary:
        return bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()["content"])
    with open(vocabulary, "rb") as f:
        return f.read()


def _encoding(vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:
        return _encoding_of(f.read(), pattern)


@functools.cache
def _cutter(pattern: str):
    import regex

    return regex.compile(pattern).findall


_BLOCKS = "block long, doc_id long, codes array<int>, words array<string>, texts int"


def _cut(pattern: str):
    """Rows of texts (doc_id, the numbers of its pre-tokens) and, after each block's texts, one of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block = _cutter(pattern), TaskContext.get().partitionId() << 32
        number: dict[str, int] = {}
        ids, codes, chars = [], [], 0

        def ended() -> pa.RecordBatch:
            words = pa.array([None] * len(ids) + [list(number)], pa.list_(pa.string()))
            texts = pa.array([None] * len(ids) + [len(ids)], pa.int32())
            columns = [pa.array(np.full(len(ids) + 1, block)), pa.array([*ids, None], pa.int64()), pa.array([*codes, None], pa.list_(pa.int32())), words, texts]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "codes", "words", "texts"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                codes.append([number.setdefault(w, len(number)) for w in cut(text or "")])
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_TEXTS:
                    yield ended()
                    block += 1
                    number, ids, codes, chars = {}, [], [], 0
        if ids:
            yield ended()

    return run


def _encode_words(vocabulary, pattern: str):
    """Rows come sorted by word, so each distinct word of the corpus is encoded once. vocabulary: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding_of(vocabulary.value, pattern)._core_bpe.encode_single_piece
        last, ids = None, []
        for b in batches:
            out = []
            for w in b.column("word").to_pylist():
                if w != last:
                    last, ids = w, encode(w.encode())
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("code"), pa.array(out, pa.list_(pa.int32()))], ["block", "code", "ids"])

    return run


def _measure_words(vocabulary, pattern: str):
    """As _encode_words, with the number of ids in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _encode_words(vocabulary, pattern)(batches):
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("code"), b.column("ids").value_lengths()], ["block", "code", "n"])

    return run


def _add_up(texts: pa.Table, words: pa.Table) -> pa.Table:
    n = words.combine_chunks().sort_by("code").column("n").to_numpy()
    total = [int(n[c].sum()) if c else 0 for c in texts.column("codes").to_pylist()]
    return pa.table({"doc_id": texts.column("doc_id"), "tokens": pa.array(total, pa.int64())})


def _reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    texts, words = texts.combine_chunks(), words.combine_chunks().sort_by("code")

    def parts(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(all values, length of each list)"""
        c = table.column(name).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        return c.flatten().to_numpy(zero_copy_only=False), np.asarray(c.value_lengths().fill_null(0))

    if texts.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    codes, sizes = parts(texts, "codes")
    if len(codes) == 0:
        return pa.table({"doc_id": texts.column("doc_id"), "ids": pa.array([[]] * texts.num_rows, pa.list_(pa.int32()))})
    ids, n = parts(words, "ids")
    first, many = (np.cumsum(n) - n)[codes], n[codes].astype(np.int64)
    ends = np.cumsum(many)
    at = np.repeat(first - (ends - many), many) + np.arange(ends[-1])
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.table({"doc_id": texts.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids[at].astype(np.int32)))})


def _pieces(documents: DataFrame, pattern: str, id_column: str, text: str) -> tuple[int, DataFrame, DataFrame]:
    """(partitions of the exchanges, (block, doc_id, codes), the distinct words of each block: (block, code, word),
    gathered by word)."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(rows.mapInArrow(_cut(pattern), _BLOCKS), "pretokens")
    n = max(1, -(-blocks.where("texts is not null").count() // TASK_BLOCKS))
    words = blocks.where("texts is not null").select("block", F.posexplode("words").alias("code", "word"))
    return n, blocks.where("texts is null").select("block", "doc_id", "codes"), words.repartition(n, "word").sortWithinPartitions("word")


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of documents."""
    n, texts, words = _pieces(documents, pattern, id_column, text)
    sent = documents.sparkSession.sparkContext.broadcast(_read(documents.sparkSession, vocabulary))
    ids = words.mapInArrow(_encode_words(sent, pattern), "block long, code int, ids array<int>")
    return texts.repartition(n, "block").groupBy("block").cogroup(ids.repartition(n, "block").groupBy("block")).applyInArrow(_reassemble, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row of documents, without moving the ids themselves."""
    n, texts, words = _pieces(documents, pattern, id_column, text)
    sent = documents.sparkSession.sparkContext.broadcast(_read(documents.sparkSession, vocabulary))
    sizes = words.mapInArrow(_measure_words(sent, pattern), "block long, code int, n int")
    return texts.repartition(n, "block").groupBy("block").cogroup(sizes.repartition(n, "block").groupBy("block")).applyInArrow(_add_up, "doc_id long, tokens long")


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, bytes): a row for each token of the vocabulary."""
    ranks = _ranks(_read(spark, vocabulary))
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def _token_hex(spark: SparkSession, vocabulary: str) -> Column:
    """The bytes of each id as hex text, at the id's place in one constant array; empty where there is no such id."""
    ranks = _ranks(_read(spark, vocabulary))
    at = [""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        at[i] = token.hex()
    return F.split(F.lit(",".join(at)), ",")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row (doc_id, ids), each joined with the token-byte table within its row, so nothing
    moves; repeated rows come out as often as they came in. An id outside the vocabulary makes the text null; null
    ids are an empty text."""
    table = _token_hex(ids.sparkSession, vocabulary)
    pieces = F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.when(i >= 0, F.nullif(F.get(table, i), F.lit(""))))
    whole = ids.select("doc_id", pieces.alias("p"))
    known = F.forall("p", lambda x: x.isNotNull())
    return whole.select("doc_id", F.when(known, F.decode(F.unhex(F.array_join("p", "")), "UTF-8")).alias("text"))

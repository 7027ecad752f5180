"""Per-document text statistics, and what the lines of a document are: prose, list, table or junk.

Method: three measures of layout decide between prose, lists and tables, none of which knows a language.
* Vertical delimiter alignment: a line with as many of the same delimiter as its neighbours, or with cells that begin
  at the same columns, is a table's.
* Periodicity of beginnings and forms: a line whose beginning (indent and marker) or whole form (letters, digits and
  signs, each run as one) comes again a few lines on is a list's entry, if it is short.
* Line lengths that follow each other: where lines end because the next word would not have fitted, running
  text was wrapped; such runs are prose.
Word, symbol and punctuation ratios decide the rest: sentences that end, lines of many words, signs and codes. Whether
letters make words is judged by their order within the document and by their script: vowels and consonants take turns
in scripts that have both, capitals begin words and stops end them. No list of words takes part, so a language that is
rare in the corpus is treated like any other. A document is of the kind that fills most of its non-blank lines; running
sentences are prose however they are laid out.

Common words are those in most documents, counted over all documents, for the share that is reported; the list is at
most COMMON_WORDS long, so it may be sent to every task. A document is judged by itself, in one pass over its own lines.

Defined cases: null and blank texts have no kind and zero counts; ratios of nothing are 0; repeated rows and
null ids come out as often as they came in; texts may be of any length; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMON_WORDS, COMMON_SHARE = 2_000, 0.005
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLOSERS = " \t\"'”’»)]"
_MARKER = re.compile(r"\s*(?:[-*•·–—+>▪◦‣]|\[[ xX]?\]|\(?\d{1,4}[.)]|\(?[A-Za-z]{1,2}[.)]|[ivxlcIVXLC]{1,6}[.)])\s+\S")
_RULE = re.compile(r"[\s|+\-=:¦_]*[-=_+|¦]{2}[\s|+\-=:¦_]*$")
_GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_SPACE = re.compile(r"\s+")
_SENTENCES = re.compile(r"[^\W\d_][.!?…][\"'”’»)]*\s+\S")
_ENDS = frozenset(".!?…。！？؟।")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{2,8}[: ]\s*)+[0-9A-Fa-f]{2,8}$")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
#: Vowels, accents taken off, of the scripts that write vowels and consonants as letters alike: these are the letters
#: below FIRST_OTHER.
_VOWELS = frozenset("aeiouyæœøıаеёиоуыэюяєіїαεηιουω")
FIRST_OTHER = 0x530
_CELL = re.compile(r"[;|¦\t,]")


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    n: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                n.update(set(_WORD.findall(text.lower())))
        if len(n) > 500_000:
            yield rows(n)
            n = Counter()
    if n:
        yield rows(n)


def common_words(documents: DataFrame, text: str = "text") -> list[str]:
    """At most COMMON_WORDS words of two letters or more, in the most documents and in COMMON_SHARE of all."""
    counts = documents.select(text).mapInArrow(_word_sets, "word string, n long").where("length(word) > 1").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(2, int(documents.count() * COMMON_SHARE))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    return top.toPandas()["word"].tolist()


def _autocorrelation(x: np.ndarray, lag: int) -> float:
    """Of a series with itself `lag` on; 1 for a series that doesn't vary."""
    if len(x) <= lag + 1:
        return 0.0
    x = x - x.mean()
    var = float(x @ x)
    return 1.0 if var < 1e-9 else float(x[:-lag] @ x[lag:]) / var


def _aligned(lines: list[str]) -> tuple[float, list[bool]]:
    """(share of lines in a table's columns, which lines). A line is in columns if a neighbour up to two lines
    away has as many of the same delimiter, or begins a cell after a gap at the same place."""
    n, text = len(lines), "\n".join(lines)
    best = [False] * n
    if n == 1:
        return 0.0, best
    for d in ("\t", "|", "¦", ";", ","):
        if d not in text:
            continue
        counts = [x.count(d) for x in lines]
        for i, c in enumerate(counts):
            if c and not best[i] and (c in counts[max(0, i - 2) : i] or c in counts[i + 1 : i + 3]):
                # words after a delimiter and a blank are clauses, not cells
                if d in ";," and (lines[i].count(d + " ") * 2 > c or lines[i].rstrip(_CLOSERS)[-1:] in _ENDS):
                    continue
                best[i] = c > 1 or d not in ";,|¦" or lines[i].count(" ") <= 4
    if "  " in text or "\t" in text:
        starts, even = [], []
        for x in lines:
            gaps = list(_GAP.finditer(x)) if "  " in x or "\t" in x else []
            starts.append({m.end() for m in gaps})
            # the same gap after each word is a way to write words, not columns
            even.append(len(gaps) > 2 and len({m.end() - m.start() for m in gaps}) == 1 and len(gaps) >= len(_SPACE.findall(x.strip())))
        for i, s in enumerate(starts):
            if s and not best[i] and not even[i] and len(_SPACE.findall(lines[i].strip())) <= 2 * len(s) + 1:
                near = set().union(*starts[max(0, i - 3) : i], *starts[i + 1 : i + 4])
                best[i] = len(s & near) >= max(1, 0.6 * len(s))
    return sum(best) / n, best


#: Classes of characters.
_LETTER, _DIGIT, _STRANGE, _VOWEL, _SPACES, _CAPITAL, _UNSPACED, _STOP, _JOINER = (1 << k for k in range(9))
_CLASSES = 128  # of the first seven, which are counted by line
_WITH = {bit: np.array([c for c in range(_CLASSES) if c & bit]) for bit in (1, 2, 4, 8, 16, 32, 64)}
_ORDINARY = frozenset(".,;:!?'\"“”‘’«»()[]{}<>-–—_/|¦&%@*+=#…·•°§~^$€£\\")


@functools.cache
def _classes() -> np.ndarray:
    """The classes of each code point; those beyond the last are letters or strange as Python has them."""
    table = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            table[i] = _SPACES
        elif c.isalpha():
            table[i] = _LETTER | (_VOWEL if i < 0x2000 and unicodedata.normalize("NFD", c.lower())[0] in _VOWELS else 0) | (_CAPITAL if c.isupper() else 0)
            if 0xE00 <= i < 0x1100 or 0x1780 <= i < 0x1800 or i >= 0x2E80:  # scripts without blanks between words
                table[i] |= _UNSPACED
        elif c.isdigit():
            table[i] = _DIGIT
        elif i > 0xFF and unicodedata.category(c)[0] == "M":  # signs that make letters whole
            table[i] = _LETTER
        else:
            table[i] = (_STOP if c in ".,;:!?" else 0) | (_JOINER if c in "'’@.()_" else 0) if c in _ORDINARY or c == "@" or i > 0x5FF and unicodedata.category(c)[0] == "P" and not 0x2000 <= i < 0x2E80 else _STRANGE
    return table


def _words(codes: np.ndarray, of: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(where words begin, where they end, how many each line has): runs of letters, with single apostrophes inside."""
    letter = np.zeros(len(of) + 2, bool)
    letter[1:-1] = (of & _LETTER) > 0
    inner = np.flatnonzero((codes == 0x27) | (codes == 0x2019)) + 1
    inner = inner[letter[inner - 1] & letter[inner + 1]]
    letter[inner] = True
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    return edges[::2], edges[1::2], np.bincount(line[edges[::2]], minlength=lines).tolist()


def _common_share(text: str, starts: np.ndarray, ends: np.ndarray, common: frozenset) -> float:
    """Share of the words of two letters or more that are common ones."""
    if not common:
        return 0.0
    lower = text.lower() if len(text.lower()) == len(text) else None
    spans = zip(starts.tolist(), ends.tolist())
    words = [lower[a:b] for a, b in spans] if lower else [text[a:b].lower() for a, b in spans]
    return sum(map(common.__contains__, words)) / max(1, int((ends - starts > 1).sum()))


def _distinct(ascending: np.ndarray) -> int:
    return int((ascending[1:] != ascending[:-1]).sum()) + 1 if len(ascending) else 0


def _repeats(codes: np.ndarray) -> bool:
    """Whether a text is one short bit over and over."""
    return len(codes) >= 24 and len(set(codes.tolist())) <= 24 and any((codes[p:] == codes[:-p]).mean() > 0.93 for p in range(1, 13))


class Words:
    """The common words."""

    def __init__(self, common: list[str] | frozenset):
        self.common = frozenset(common)


#: Share of vowels below which letters make no words, and the shares, added up, of words of one letter, of words with a
#: capital or stop inside, and of words with four vowels or consonants in a row, beyond which they stand in no order.
LEAST_VOWELS, MOST_DISORDER = 0.25, 0.33


def _disordered(codes: np.ndarray, of: np.ndarray, on: np.ndarray) -> bool:
    """Whether the letters of the characters that are `on` make no words. Only scripts of vowels and consonants can
    tell. A capital after a small letter, a stop between letters and a letter that stands alone and numbers nothing are
    out of order."""
    letter = np.concatenate([[False], ((of & _LETTER) > 0) & on, [False] * 3])
    starts = letter[1:] & ~letter[:-1]
    words, letters = int(starts.sum()), int(letter.sum())
    if words < 4 or letters < 20 or (codes[letter[1:-3]] >= FIRST_OTHER).mean() > 0.2:
        return False
    of = np.concatenate([[0], of, [0] * 3])
    vowel = (of & _VOWEL) > 0
    if vowel[letter].mean() < LEAST_VOWELS:
        return True
    # runs of four of one sort within a word
    word = np.concatenate([[0], np.cumsum(starts)])
    whole = letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]
    run = whole & (vowel[:-3] == vowel[1:-2]) & (vowel[1:-2] == vowel[2:-1]) & (vowel[2:-1] == vowel[3:])
    clustered = max(0, _distinct(word[:-3][run]) - 2) / max(1, _distinct(word[:-3][whole]))
    capital = (of & _CAPITAL) > 0
    inner = (letter[:-1] & ~capital[:-1] & letter[1:] & capital[1:]).sum() + (letter[:-2] & ((of[1:-1] & _STOP) > 0) & letter[2:]).sum()
    near = letter | ((of & (_DIGIT | _JOINER)) > 0)
    inner += (letter[1:-1] & ~near[:-2] & ~near[2:]).sum()
    return bool(clustered + inner / words > MOST_DISORDER)


def _forms(codes: np.ndarray, of: np.ndarray) -> list[str]:
    """The form of each line: runs of letters as a, of digits as 0, of blanks as one, other characters as they are."""
    sort = codes.copy()
    sort[(of & _LETTER) > 0], sort[(of & _DIGIT) > 0], sort[((of & _SPACES) > 0) & (codes != 10)] = map(ord, "a0 ")
    keep = np.ones(len(sort), bool)
    keep[1:] = (sort[1:] != sort[:-1]) | ((of[1:] & (_LETTER | _DIGIT | _SPACES)) == 0) | (sort[1:] == 10)
    return sort[keep].tobytes().decode("utf-32-le", "surrogatepass").split("\n")


def _wrapped(lines: list[str], sizes: list[int], marked: list[bool], ends: list[bool]) -> list[bool]:
    """Lines of runs that were wrapped: the lengths of the lines follow from the width and the next line's first word.
    A line's run is told by the lines up to four away that neither begin with a marker nor end a sentence."""
    n = len(lines)
    most = max(sizes)
    width = [most] * n if n < 9 else [max(sizes[max(0, i - 8) : i + 9]) for i in range(n)]
    full, asked = np.zeros(n + 1), np.zeros(n + 1)
    for i in range(n - 1):
        if not ends[i] and not marked[i + 1]:
            first = lines[i + 1].split(None, 1)
            asked[i + 1] = 1
            full[i + 1] = sizes[i] + 1 + (len(first[0]) if len(first) > 1 else 2) > width[i]
    full, asked = np.cumsum(full), np.cumsum(asked)
    low, high = np.maximum(np.arange(n) - 4, 0), np.minimum(np.arange(n) + 5, n)
    all_, some = asked[high] - asked[low], full[high] - full[low]
    return ((all_ > 0) & (some >= 0.7 * all_) & (np.array(width) >= 20)).tolist()


def _again(of: list[str | None]) -> list[bool]:
    """Which items come again up to three places away."""
    return [x is not None and (x in of[max(0, i - 3) : i] or x in of[i + 1 : i + 4]) for i, x in enumerate(of)]


FIELDS = (
    ("words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("lines", pa.int64()), ("lines_ending_in_punctuation", pa.float64()), ("common_word_share", pa.float64()),
    ("delimiter_alignment", pa.float64()), ("indent_periodicity", pa.float64()), ("length_autocorrelation", pa.float64()), ("kind", pa.string()),
)
SCHEMA = "doc_id long, words long, mean_word_length double, symbol_ratio double, lines long, lines_ending_in_punctuation double, common_word_share double, delimiter_alignment double, indent_periodicity double, length_autocorrelation double, kind string"


_NOTHING = (0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None)


def measured(text: str | None, words_of: Words) -> tuple:
    """The FIELDS of one text."""
    lines = [x for x in (text or "").replace("\ufeff", "").splitlines() if x.strip()]
    if not lines:
        return _NOTHING
    common, n = words_of.common, len(lines)
    whole = "\n".join(lines)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    of = _classes()[codes]
    sizes = [len(x) for x in lines]
    line = np.repeat(np.arange(n), [k + 1 for k in sizes])[:-1]
    per = np.bincount(line * _CLASSES + (of & (_CLASSES - 1)), minlength=_CLASSES * n).reshape(n, _CLASSES)
    letters, digits, strange, wide = (per[:, _WITH[bit]].sum(1).tolist() for bit in (_LETTER, _DIGIT, _STRANGE, _UNSPACED))
    bare = (per.sum(1) - per[:, _WITH[_SPACES]].sum(1)).tolist()
    starts, stops, count = _words(codes, of, line, n)

    marks = [_MARKER.match(x) for x in lines]
    last = [x.rstrip(_CLOSERS)[-1:] for x in lines]
    ends = [c != "" and c in _ENDS for c in last]
    alignment, columns = _aligned(lines)
    widths = np.array(sizes, float)
    forms = _forms(codes, of)
    many = [max(k, w / 2) for k, w in zip(count, wide)]
    begins = [None if m is None else form_of[: max(1, len(form_of) - len(form_of.lstrip()) + 2)] for m, form_of in zip(marks, forms)]
    entry = [a or b and k < 7 for a, b, k in zip(_again(begins), _again(forms), many)] if n > 1 else [m is not None for m in marks]
    period = sum(entry) / n
    wrapped = _wrapped(lines, sizes, [m is not None for m in marks], ends)

    kinds: list[str | None] = []
    for i, x in enumerate(lines):
        k = bare[i]
        if (i and columns[i - 1] or i + 1 < n and columns[i + 1]) and _RULE.fullmatch(x.strip()):
            kinds.append("table")
        elif strange[i] > 0.3 * k or letters[i] + digits[i] < 0.35 * k and k >= 8:
            kinds.append("junk")
        elif k >= 12 and (digits[i] and _HEX.fullmatch(x.strip()) or len(set(x[:16])) <= 4 and len(set(x) - {" "}) <= 3):
            kinds.append("junk")
        elif k >= 32 and count[i] <= 0.12 * k and wide[i] < 0.5 * k and _coded(x, k):
            kinds.append("junk")
        elif entry[i] and marks[i] and not (many[i] >= 12 and _SENTENCES.search(x)):
            kinds.append("list")
        elif columns[i]:
            kinds.append("table")
        elif ends[i] and many[i] >= 3:
            kinds.append("prose")
        elif entry[i] and not marks[i]:
            kinds.append("list")
        elif wrapped[i] and many[i] >= 2 or many[i] >= 7 or many[i] == 0 and k < 3:
            kinds.append("prose")
        else:
            kinds.append(None)
    # short lines with nothing of their own go with the ones around them: a heading or a paragraph's last line with
    # running text, any other with the entries
    running = kinds.count("prose") > kinds.count("list")
    kinds = [k or ("prose" if running else "list") for k in kinds]

    total, chars = sum(count), int((stops - starts).sum())
    share = _common_share(whole, starts, stops, common)
    found = Counter(kinds)
    if found["table"] * 2 <= n:
        own = [i for i, k in enumerate(kinds) if k != "table"]
        if len(own) == n >= 12 and len(set(lines)) * 8 <= n or len(set(whole)) <= 32 and _repeats(codes[(of & _SPACES) == 0]) or _disordered(codes, of, np.array([k != "table" for k in kinds])[line]):
            found = Counter(junk=len(own), table=n - len(own))
    kind = max(("prose", "list", "table", "junk"), key=lambda k: found[k])
    punctuated = sum(c != "" and c in ".!?…:;" for c in last) / n
    symbols = 1 - (sum(letters) + sum(digits)) / max(1, sum(bare))
    return total, chars / max(1, total), symbols, n, punctuated, share, alignment, period, _autocorrelation(widths, 1), kind


def _coded(line: str, bare: int) -> bool:
    """Mostly long runs that mix capitals, small letters and digits."""
    runs = [r for r in _LONG_RUN.findall(line) if not (r.islower() or r.isupper() or r.isalpha() and r.istitle())]
    return sum(map(len, runs)) > 0.6 * bare


def statistics(documents: DataFrame, common: list[str] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the FIELDS) of every row of documents. common: the common words, else those of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(Words(common_words(documents, text) if common is None else common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measured(t, shared.value) for t in b.column(1).to_pylist()]
            if rows:
                cols = [pa.array(c, k) for c, (_, k) in zip(zip(*rows), FIELDS)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *[f for f, _ in FIELDS]])

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)

import datetime
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import consensus, encode, grouped_split, overlap, packing, term_counts, text_quality

T0 = datetime.datetime(2024, 1, 1)


# 1. overlaps
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LOCI = "record_id long, transcription_id string, folio string, text_normalized string, ingested_at timestamp, text string, split int, leaf string, gram int"


def overlaps(spark, loci):
    rows = spark.createDataFrame([(i, "A", f, t, T0, "clash", 1, "x", 2) for i, f, t in loci], LOCI)
    leaves = spark.createDataFrame([(1, " Train"), (1, "train "), (2, "VALIDATION"), (3, "test"), (None, "train"), (4, None)], "leaf int, split string")
    special = spark.createDataFrame([("fRos", [3, 2])], "folio string, linked_leaves array<int>")
    return sorted((r["train_record"], r["eval_record"], r["edits"]) for r in overlap.cross_split_overlaps(rows, leaves, special).collect())


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeoü") for _ in range(rng.randint(2, 8))) for _ in range(25)]
    text = lambda: ".".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 18)))

    def edited(t, share):
        t = list(t)
        for _ in range(int(len(t) * share)):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", "z", t[k] + "y"])
        return "".join(t)

    loci, i = [], 0
    for _ in range(240):
        t = text()
        for page in ["f1r", rng.choice(["F2V", " f3r1", "fRos", "f9r"])]:
            loci.append((i, page, edited(t, rng.choice([0, 0.02, 0.05, 0.08]))))
            i += 1
    loci += [(1000, "f1r", "same." * 30), (1001, "f2r", "same." * 30), (1002, "f2r", "same." * 30), (1003, "f1v", None), (1004, "f2r", ""), (1005, None, "x" * 50), (1000, "f1r", "same." * 30)]
    loci += [(1006, "f1r", "long." * 3000 + "end"), (1007, "f3r", "long." * 3000 + "and")]
    side = {"f1r": 0, "f1v": 0, "F2V": 1, "f2r": 1, " f3r1": 1, "f3r": 1, "fRos": 1}
    plain = {i: (side[f], " ".join(t.replace(".", " ").split())) for i, f, t in loci if f in side and t}
    plain = {i: v for i, v in plain.items() if len(v[1]) >= 40}
    expected = []
    for a, (s, x) in plain.items():
        for b, (u, y) in plain.items():
            if s == 0 and u == 1 and abs(len(x) - len(y)) * 10 <= max(len(x), len(y)) and max(len(x), len(y)) < 1000:
                d = edit_distance(x, y)
                if 10 * d <= max(len(x), len(y)):
                    expected.append((a, b, d))
    assert overlaps(spark, loci) == sorted([*expected, (1006, 1007, 1)]) and len(expected) > 30


def test_overlaps_with_hot_ngrams(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 3)
    same = "the order of the lines and the root of the plant"
    loci = [(i, "f1r", f"{same} {i}") for i in range(20)] + [(100 + i, "f2r", f"{same} {i}") for i in range(20)]
    got = overlaps(spark, loci)
    assert got == sorted((i, 100 + j, edit_distance(str(i), str(j))) for i in range(20) for j in range(20))


def test_overlaps_of_long_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000)).replace("  ", " a").strip()
    edits = list(text)
    for k in range(0, len(text), 12):
        edits[k] = "z"
    far = list(text)
    for k in range(0, len(text), 8):
        far[k] = "z"
    assert overlap._stretches(np.array([40, 2699, 2700, 9000]))[2].tolist() == [40, 2699, 1800, 900, 1800, 1800, 1800, 1800, 1800]
    assert [(a, b) for a, b, _ in overlaps(spark, [(1, "f1r", text), (2, "f2r", "".join(edits)), (3, "f3r", "".join(far))])] == [(1, 2)]


def test_overlaps_of_nothing(spark):
    assert overlaps(spark, []) == [] and overlaps(spark, [(1, "f1r", "a" * 60)]) == []


# 2. term counts
@pytest.mark.parametrize("longest", [1, 3])
def test_term_counts_against_counters(spark, longest):
    rng = random.Random(2)
    records = [("f", [rng.choice(["a", "b", "c", "a b", "ü", "", None]) for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [("g", ["a"] * 3000), ("f", None), (None, ["a"])]
    rows = spark.createDataFrame([(*r, 7, "clash") for r in records], "field string, terms array<string>, n int, suffix string")
    occ, rec = Counter(), Counter()
    for f, terms in records:
        if f and terms:
            t = [x for x in terms if x]
            runs = [(f, *t[i : i + n]) for n in range(1, longest + 1) for i in range(len(t) - n + 1)]
            occ.update(runs)
            rec.update(set(runs))
    got = {(r["field"], *r["terms"]): (r["occurrences"], r["records"]) for r in term_counts.term_counts(rows, longest).collect()}
    assert got == {k: (occ[k], rec[k]) for k in occ}
    assert term_counts.term_counts(rows.limit(0), longest).count() == 0


def test_marks_at_the_bounds(spark):
    counts = spark.createDataFrame([("f", ["a"], 9, 8), ("f", ["b"], 9, 9), ("f", ["c"], 2, 2), ("f", ["d"], 3, 3)], "field string, terms array<string>, occurrences long, records long")
    totals = spark.createDataFrame([("f", 100)], "field string, total long")
    assert {r["terms"][0]: r["mark"] for r in term_counts.marked(counts, totals).collect()} == {"a": None, "b": "common", "c": "rare", "d": None}


# 5. consensus
READ = "locus string, transcription_id string, canonical_glyph_text string, read_at timestamp, reading_id long, item string, votes int"


def test_last_labels(spark):
    at = [T0 + datetime.timedelta(days=d) for d in range(3)]
    rows = [("l", "A", " x  y ", at[0], 1), ("l", "A", "z", at[1], 2), ("l", "A", "z ", at[1], 3), ("l", "B", "x", at[0], 4), ("l", "B", " ", at[1], 5), ("l", "C", None, at[0], 6), (None, "C", "x", at[0], 7), ("l", None, "x", at[0], 8)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], READ)
    got = consensus.last_labels(df, "locus", "transcription_id", "canonical_glyph_text", "read_at", "reading_id")
    assert [tuple(r) for r in got.collect()] == [("l", "A", "z")]


def test_consensus_sees_through_a_confused_majority(spark):
    rng = random.Random(4)
    glyphs = [f"{a}{k}" for a in "ABCD" for k in range(1, 4)]
    careful, loose = ["c1", "c2", "c3"], ["l1", "l2", "l3", "l4"]
    truth, rows = {}, []
    for i in range(300):
        t = [rng.choice(glyphs) for _ in range(6)]
        truth[f"i{i}"] = " ".join(t)
        # all loose annotators read A1 as A2, now and then each errs
        for who in (*rng.sample(careful, 2), *rng.sample(loose, 3)):
            read = ["A2" if g == "A1" and who in loose else g for g in t]
            if rng.random() < 0.05:
                read[rng.randrange(6)] = rng.choice(glyphs)
            rows.append((f"i{i}", who, " ".join(read)))
    labels = spark.createDataFrame(rows, "item string, annotator string, label string")
    found, trust = consensus.consensus(labels)
    right = np.mean([truth[r["item"]] == r["label"] for r in found.collect()])
    votes = defaultdict(Counter)
    for i, _, x in rows:
        votes[i][x] += 1
    majority = np.mean([v.most_common(1)[0][0] == truth[i] for i, v in votes.items()])
    assert right > 0.95 > majority
    reliability = {r["annotator"]: r["reliability"] for r in trust.collect()}
    assert min(reliability[c] for c in careful) > max(reliability[x] for x in loose)


def test_consensus_edges(spark):
    schema = "item string, annotator string, label string"
    rows = [("few", "A", "x"), ("few", "B", "x"), ("tie", "A", "y"), ("tie", "B", "x"), ("tie", "C", "z"), ("long", "A", "x " * 5000 + "y"), ("long", "B", "x"), ("long", "C", "x")]
    found, _ = consensus.consensus(spark.createDataFrame(rows, schema), updates=3)
    assert {r["item"]: r["readers"] for r in found.collect()} == {"tie": 3, "long": 3}
    empty, trust = consensus.consensus(spark.createDataFrame([], schema))
    assert empty.count() == 0 and trust.count() == 0


def test_consensus_of_long_labels_goes_to_the_majority(spark):
    rng = random.Random(8)
    rows = []
    for k in range(6):
        right = [rng.choice("ABCD") for _ in range(500 + 100 * k)]
        wrong = [("E" if rng.random() < 0.02 else g) for g in right]
        wrong[0] = "E"
        first, second = sorted((" ".join(right), " ".join(wrong)))
        # the majority takes now the label first in order, now the other
        majority, minority = (first, second) if k % 2 else (second, first)
        rows += [(f"i{k}", a, majority) for a in "abc"] + [(f"i{k}", "d", minority)]
        rows += [(f"short{k}", a, "A B") for a in "abcd"]
    found, _ = consensus.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    got = {r["item"]: r["label"] for r in found.collect()}
    assert {i: got[i] == x for i, a, x in rows if a == "a"} == {i: True for i, _, _ in rows}


def test_alignment_of_long_labels():
    rng = random.Random(9)
    for n, m in ((3000, 3000), (900, 1), (0, 700), (600, 450)):
        a, b = ([rng.randint(1, 5) for _ in range(k)] for k in (n, m))
        pairs = consensus._alignment(a, b)
        assert [t for t, _ in pairs if t][::-1] == a and [r for _, r in pairs if r][::-1] == b
        if n * m < 300_000:
            assert sum(t != r for t, r in pairs) == edit_distance(a, b)


def test_consensus_of_rare_symbols_goes_to_the_majority(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MOST_SYMBOLS", 50)
    rng, rows = random.Random(11), []
    for k in range(400):
        words = [f"w{rng.randrange(3000)}" for _ in range(6)]
        other = [*words[:2], f"w{rng.randrange(3000)}x", *words[3:]]
        a, b = (" ".join(words), " ".join(other)) if k % 2 else (" ".join(other), " ".join(words))
        rows += [(f"i{k}", x, a) for x in "abc"] + [(f"i{k}", "d", b)]
    found, _ = consensus.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    got = {r["item"]: (r["label"], r["agreement"]) for r in found.collect()}
    assert got == {i: (x, 0.75) for i, a, x in rows if a == "a"}


def test_consensus_of_an_item_with_many_labels(spark):
    rng = random.Random(12)
    right = [rng.choice("ABCDEFGH") for _ in range(40)]
    rows = [("cold", f"p{k}", "A B C") for k in range(1500)]
    for k in range(1500):  # nearly every annotator's label is of its own
        read = [rng.choice("ABCDEFGH") if rng.random() < 0.08 else g for g in right if rng.random() > 0.02]
        rows.append(("hot", f"p{k}", " ".join(read if k % 50 else right)))
    found, _ = consensus.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    assert {r["item"]: r["label"] for r in found.collect()} == {"hot": " ".join(right), "cold": "A B C"}


def test_columns_of_labels():
    grid = consensus._laid_out([[1, 2, 3], [1, 9, 2, 3], [2, 3, 7, 8], [5, 1, 2, 3]], [3, 1, 1, 1])
    assert grid == [[0, 1, 0, 2, 3, 0, 0], [0, 1, 9, 2, 3, 0, 0], [0, 0, 0, 2, 3, 7, 8], [5, 1, 0, 2, 3, 0, 0]]


# 6. splits
def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1120)] + [(5, 5)]
    edges += [(2000, k) for k in range(2001, 2200)] + edges[:20]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = grouped_split.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["vertex"]: r["root"] for r in got.collect()} == {x: find(x) for x in parent}
    assert grouped_split.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ties_of_leaves(spark):
    units = spark.createDataFrame([("a", [3, None, 2, 2], ["f9v", None]), ("b", None, ["f20r", " F21v1"]), ("c", [], None), ("a", [2, 3], []), (None, [50], ["fRos"])], "unit_id string, leaves array<int>, special_pages array<string>")
    profiles = spark.createDataFrame([(5, ["f5r", "F6 V", "x"]), (None, ["f7r"]), (8, None)], "leaf int, folios array<string>")
    special = spark.createDataFrame([("fRos", [85, 86]), ("f74v2", [74, 75])], "folio string, linked_leaves array<int>")
    got = grouped_split.components(grouped_split.leaf_ties(units, profiles, special)).collect()
    assert {r["vertex"]: r["root"] for r in got} == {2: 2, 3: 2, 9: 2, 20: 20, 21: 20, 5: 5, 6: 5, 50: 50, 85: 50, 86: 50, 74: 74, 75: 74}


def test_split_by_weight_keeps_shares_and_heavy_groups(spark):
    groups = spark.createDataFrame([(f"g{i}", 1 + i % 5) for i in range(2000)] + [("huge", 3000)], "`group` string, weight long")
    got = grouped_split.split_by_weight(groups, grouped_split.SHARES)
    share = {r["split"]: r["w"] for r in got.groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    total = sum(share.values())
    assert got.count() == 2001 and all(abs(share[k] / total - v) < 0.01 for k, v in grouped_split.SHARES.items())
    assert got.where("`group` = 'huge'").first()["split"] == "train"


# 7. encoding, 8. packing
TEXTS = [None, "", " ", "a\n\n  b", "don't we'll 123 4ü€😀", "<|endoftext|>", "kun " * 5, "\x00\x01  ﻿", "x" * 30_000, "A b " * 20_000, "kun " * 5]


def documents(spark, texts):
    return spark.createDataFrame([(i if i else None, t, i, "clash", [i]) for i, t in enumerate(texts)], "doc_id long, text string, block long, word string, codes array<int>")


def test_encoding_against_the_library(spark, monkeypatch):
    enc = encode._encoding(encode.VOCABULARY, encode.PATTERN)
    got = {r["doc_id"]: r["ids"] for r in encode.encoded(documents(spark, TEXTS)).collect()}
    assert got == {i if i else None: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["tokens"] for r in encode.token_counts(documents(spark, TEXTS)).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    back = {r["doc_id"]: r["text"] for r in encode.decoded(encode.encoded(documents(spark, TEXTS))).collect()}
    assert back == {i if i else None: t or "" for i, t in enumerate(TEXTS)}
    assert encode.encoded(documents(spark, [])).count() == 0
    bad = spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>")
    assert encode.decoded(bad).first()["text"] is None


def check_packing(rows, sizes, capacity):
    fill, whole = Counter(), Counter()
    for r in rows:
        assert (r["container"] is None) == (r["size"] == 0)
        if r["size"]:
            fill[r["container"]] += r["size"]
        whole[r["item"]] += r["size"]
    assert max(fill.values(), default=0) <= capacity
    assert whole == Counter({k: max(v or 0, 0) for k, v in sizes.items()}) or all(whole[k] == max(v or 0, 0) for k, v in sizes.items())
    return fill


def test_packing(spark):
    rng = random.Random(6)
    sizes = {i: rng.choice([rng.randint(1, 100), 33, 33, 67]) for i in range(2000)} | {5000: None, 5001: 0, 5002: 1234, 5003: -1}
    df = spark.createDataFrame([(k, v, "clash", 1, 2) for k, v in sizes.items()], "doc_id long, tokens int, item string, piece int, container int")
    fill = check_packing(packing.packed(df, capacity=100).collect(), sizes, 100)
    assert len(fill) <= 1.02 * sum(max(v or 0, 0) for v in sizes.values()) / 100 + 1
    assert packing.packed(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[100], [60, 40], [50, 30, 20], [25, 25, 25, 25], [99, 99, 1], [34] * 7])
def test_plans_use_every_item(sizes):
    counts = np.bincount(sizes, minlength=101)
    used = Counter()
    for of, times in packing.plan(counts, 100):
        assert sum(s * n for s, n in of.items()) <= 100
        for s, n in of.items():
            used[s] += n * times
    assert used == Counter(sizes)


def test_parts_of_a_hot_size_meet_every_slot_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 50)
    df = spark.createDataFrame([(i % 400, 30) for i in range(1000)], "doc_id long, tokens int")
    fill = Counter(r["container"] for r in packing.packed(df, capacity=100).collect())
    assert len(fill) == 334 and set(fill.values()) == {3, 1}


# 9. text quality
PROSE = "The reader follows the order of the lines. It is hard to decide between the two, and the scribe keeps the habit of the first hand."
COMMON = [w for w in set(text_quality._WORD.findall(PROSE.lower())) if len(w) > 1] + ["zhoul", "keim", "dund", "stavr", "page", "number"]


@pytest.mark.parametrize("text, kind", [
    (None, None), ("", None), (" \n\t\n", None), (PROSE, "prose"), (PROSE.replace(". ", ".\n"), "prose"), (PROSE.replace(" ", "  "), "prose"), ("It is hard.", "prose"),
    ("The reader follows the order\nof the lines. It is hard to\ndecide between the two, and\nthe scribe keeps the habit\nof the first hand.", "prose"),
    ("zhoul, see f4v\nkeim, see f5r\ndund, see f6r", "list"), ("[x] the order of the lines\n[ ] the first hand\n[x] the reader", "list"), ("a) zhoul\nb) keim\nc) dund", "list"),
    (PROSE + "\n" + "\n".join(f"zhoul {i}r" for i in range(9)), "list"), ("page;number;hand\nzhoul;1;keim\ndund;2;zhoul\nkeim;;dund", "table"), ("page\tnumber\nzhoul\t1\nkeim\t2", "table"),
    ("| page | number |\n|---|---|\n| zhoul | 1 |\n| keim | 2 |", "table"), ("page      number    hand\nzhoul     1         keim\ndund                zhoul", "table"),
    ("8f f7 00 a9 60 e3\n80 9f 80 35 06 da\n8a aa 4d 22 74 a1", "junk"), ("ha" * 60, "junk"), ("ok\n" * 40, "junk"), ("+_^&%-~#_>+-_\\=*^^-&+%_=@+-/&/|~^>%@", "junk"),
    ("┘⠙┱⠢▪⠎⠯⠆⠫┚⠰" * 4, "junk"), ("kxyxa4gqxO5sEgevjdB7IFfVpz9isHAzhTrnC0CGh9ssMrxY59C1JlCzTNM84IYdz3h", "junk"), ("zbxwbhsfhqb zjxpzclc wnx njbxckkkpws pqjghh tpqplpvrk", "junk"),
])
def test_kinds(text, kind):
    assert text_quality.measured(text, text_quality.Words(COMMON))[-1] == kind


SCRIPTS = {
    "el": "Ο αναγνώστης ακολουθεί τη σειρά των γραμμών. Είναι δύσκολο να αποφασίσει κανείς ανάμεσα στα δύο. Ο γραφέας κρατά τη συνήθεια του πρώτου χεριού.",
    "ru": "Читатель следует порядку строк. Трудно выбрать между двумя, и писец сохраняет привычку первой руки. На этой странице видны следы стёртой строки.",
    "zh": "读者按照行的顺序阅读。在两者之间很难作出决定。抄写员保留了第一只手的习惯。这一页上可以看到被擦去的一行的痕迹。",
    "pl": "Czytelnik podąża za kolejnością wierszy. Trudno zdecydować między nimi, a skryba zachowuje zwyczaj pierwszej ręki. Na tej stronie widać ślady startego wiersza.",
    "fi": "Lukija seuraa rivien järjestystä. On vaikea päättää näiden kahden välillä, ja kirjuri säilyttää ensimmäisen käden tavan. Sivulla näkyy jälkiä poistetusta rivistä.",
    "ar": "يتبع القارئ ترتيب السطور. من الصعب الاختيار بين الاثنين، ويحافظ الناسخ على عادة اليد الأولى. تظهر في هذه الصفحة آثار سطر ممحو.",
    "hi": "पाठक पंक्तियों के क्रम का पालन करता है। दोनों के बीच निर्णय लेना कठिन है। लिपिक पहले हाथ की आदत रखता है।",
    "he": "הקורא עוקב אחר סדר השורות. קשה להחליט בין השניים, והסופר שומר על הרגל היד הראשונה. בדף זה נראים עקבות של שורה מחוקה.",
    "ja": "読者は行の順序に従う。二つのうちどちらかを決めるのは難しい。書記は最初の手の習慣を守る。このページには消された行の跡が見える。",
    "th": "ผู้อ่านตามลำดับของบรรทัด ยากที่จะตัดสินใจระหว่างสองอย่าง ผู้คัดลอกรักษานิสัยของมือแรก",
    "cs": "Čtenář sleduje pořadí řádků. Je těžké rozhodnout mezi oběma, a písař zachovává zvyk první ruky. Na této stránce jsou vidět stopy vymazaného řádku.",
    "ko": "독자는 줄의 순서를 따른다. 둘 사이에서 결정하기 어렵다. 필경사는 첫 번째 손의 습관을 지킨다. 이 면에는 지워진 줄의 흔적이 보인다.",
}


@pytest.mark.parametrize("text", SCRIPTS.values(), ids=SCRIPTS)
def test_prose_of_any_script_is_prose(text):
    """Without one common word known: in one line, a sentence a line, and wrapped."""
    wrapped = "\n".join(text[i : i + 24] for i in range(0, len(text), 24)) if " " not in text[:20] else textwrap.fill(text, 34)
    for t in (text, text.replace(". ", ".\n").replace("。", "。\n"), wrapped, text.lower()):
        assert text_quality.measured(t, text_quality.Words([]))[-1] == "prose"


@pytest.mark.parametrize("name", ["el", "ru", "pl", "fi", "cs"])
def test_letters_in_no_order_are_junk(name):
    text = list(SCRIPTS[name] * 2)
    random.Random(1).shuffle(text)
    assert text_quality.measured("".join(text), text_quality.Words([]))[-1] == "junk"


def test_kinds_follow_from_layout_and_not_from_words():
    """Invented words, in the four layouts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(400)]
    kind = lambda t: text_quality.measured(t, text_quality.Words([]))[-1]
    assert kind(textwrap.fill(" ".join(words), 60)) == "prose"
    assert kind("\n".join(f"- {a} {b}" for a, b in zip(words, words[1:]))) == "list"
    assert kind("\n".join(f"{a:<12}{b:<12}{c}" for a, b, c in zip(words, words[1:], words[2:]))) == "table"
    assert kind("\n".join(f"{a},{b},{c}" for a, b, c in zip(words, words[1:], words[2:]))) == "table"


def test_statistics(spark):
    rows = [(1, "The two hands - the scribe.\nkeim"), (2, None), (2, None), (None, "x " * 100_000 + "."), (4, "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kind string, words int")
    got = {r["doc_id"]: r for r in text_quality.statistics(df, COMMON).collect()}
    one = got[1]
    assert (one["words"], one["lines"], one["lines_ending_in_punctuation"]) == (6, 2, 0.5) and one["common_word_share"] == pytest.approx(5 / 6)
    assert one["mean_word_length"] == 4 and one["symbol_ratio"] == pytest.approx(2 / 26)
    assert got[2]["kind"] is None and got[2]["words"] == 0 and got[None]["words"] == 100_000
    assert text_quality.statistics(df).count() == 5 and text_quality.statistics(df.limit(0)).count() == 0

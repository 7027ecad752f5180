import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import anatomy as A
from foliant.operators import leaf_split as X
from foliant.operators import localization as L
from foliant.operators import ngram as N
from foliant.operators import resample as R
from foliant.operators import review as V
from foliant.operators import summaries as S

LINES = "record_id long, unit string, tokens array<array<string>>, tok string"


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    token = lambda: [rng.choice("abcd") for _ in range(rng.randint(1, 3))]
    rows = [(i, f"u{i % 4}", [["Z1"] if rng.random() < 0.1 else token() for _ in range(6)], "clash") for i in range(60)]
    return spark.createDataFrame(rows, LINES).cache()


def test_views_and_segments(spark):
    df = spark.createDataFrame([(1, "u", [["a", "b"], ["c", "Z1", "d"], ["e"]], "x")], LINES)
    got = lambda view: sorted(r["symbols"] for r in N.line_sequences(df, view=view).collect())
    assert got("token_aware") == [["a", "b", "<WB>", "c"], ["d", "<WB>", "e"]] and got("space_free") == [["a", "b", "c"], ["d", "e"]]
    t = N.token_sequences(df.withColumn("tokens", F.expr("array(array('a'), array('b'), array('c', 'Z1'), array('d'), array('e'))")), "unit")
    linked = {r["s"]: (r["h1"], r["h2"]) for r in N.linked(t, 2).collect()}
    # nothing reaches beyond the unreadable token
    assert linked == {"a": (L.START, L.START), "b": ("a", L.START), "d": (L.START, L.START), "e": ("d", L.START)}
    with pytest.raises(ValueError):
        N.line_sequences(df, view="other")


def test_token_model_by_hand(spark):
    """p(b | a) = (1 + 1 * p0(b)) / (1 + 1), p0(b) = (1 + 2 * spelling) / (2 + 2), with a, b seen once each."""
    df = spark.createDataFrame([(1, "u", [["a"], ["b"]], "x")], LINES)
    t = N.token_sequences(df, "unit")
    got = {r["context_order"]: r for r in N.token_scores(t, t, 1, 1, "unit").collect()}[1]
    spelling = (1 / 4 * 3 / 7 + 0) and ((1 / 7) * (2 / 7))  # counts a 1, b 1, end 2; four events and three types
    p0 = (1 + 2 * spelling) / 4
    assert abs(got["bits"] + 2 * math.log2((1 + p0) / 2)) < 1e-9 and (got["tokens"], got["events"], got["oov_tokens"], got["oov_glyphs"]) == (2, 4, 0, 0)


def test_levels_add_up(lines):
    s = N.line_sequences(lines, "unit")
    levels = N.three_levels(N.event_scores(s.where("unit <> 'u0'"), s.where("unit in ('u0', 'u1')"), 2, "unit", "record_id"), "model_order", "unit", "record_id").cache()
    for order in (1, 2):
        by = {k: levels.where(f"model_order = {order} and level = '{k}'").agg(F.sum("total_events"), F.sum("total_bits")).first() for k in ("line", "unit", "corpus")}
        assert by["line"][0] == by["unit"][0] == by["corpus"][0] and abs(by["line"][1] - by["corpus"][1]) < 0.01
    one = levels.where("level = 'corpus' and model_order = 1").first()
    assert one["bits_saved"] == 0 and one["total_events"] == one["glyph_events"] + one["boundary_events"]


def test_relations(spark):
    a = spark.createDataFrame([("x", 10.0, 5), ("y", 30.0, 10)], "unit string, bits double, events long")
    b = a.withColumn("bits", F.col("bits") - 1)
    r = R.relation("r", a, b, 200).first()
    assert r["delta"] == round(2 / 15, 6) and r["direction"] == "worse" and r["share_worse"] == 1.0 and r["units"] == 2
    assert R.relation("r", b, a, 50).first()["direction"] == "better" and R.relation("r", a, a, 50).first()["direction"] == "open"
    with pytest.raises(Exception, match="not the same events"):
        R.relation("r", a, b.limit(1), 10).collect()


def test_contributions_against_counts(lines):
    t = N.token_sequences(lines, "unit")
    train, test = t.where("unit <> 'u0'"), t.where("unit = 'u0'")
    c = L.contributions(train, test).cache()
    assert c.count() == test.count()
    pairs = {}
    for r in N.linked(train, 1).collect():
        pairs[r["h1"], r["s"]] = pairs.get((r["h1"], r["s"]), 0) + 1
    freq, follow = {}, {}
    for (h, s), n in pairs.items():
        freq[s] = freq.get(s, 0) + n
        follow.setdefault(h, []).append(n)
    ranks = {s: i + 1 for i, s in enumerate(sorted(freq, key=lambda s: (-freq[s], s)))}
    for r in c.collect():
        assert r["current_frequency"] == freq.get(r["s"], 0) and r["pair_frequency"] == pairs.get((r["h1"], r["s"]), 0) and r["current_rank"] == ranks.get(r["s"], 0)
        assert r["outgoing_total"] == sum(follow.get(r["h1"], [])) and r["distinct_next"] == len(follow.get(r["h1"], [])) and r["seen"] == (r["s"] in freq)
        assert abs(r["token_advantage"] - r["trigram_advantage"] + r["delta_bits"]) < 1e-9 and (r["previous_id"] == "BOS") == (r["h1"] == L.START)
    s = L.summarised(c.withColumn("all", F.lit("x")), "unit", ["all"], "all", "token_better").collect()
    assert abs(sum(r["share_of_advantage"] for r in s) - 1) < 1e-5 and sum(r["tokens"] for r in s) == c.count()
    assert L.transitions(c, ["token_id"]).count() == c.where("token_index > 0").count()


def test_boundaries_by_hand(spark):
    df = spark.createDataFrame([(1, "u", [["a", "b"], ["c"], ["c"], ["Z1"], ["b"], ["c"]], "x")], LINES)
    t = N.token_sequences(df, "unit")
    assert sorted((r["f"], r["i"], r["same"]) for r in A.boundaries(t, "unit").collect()) == [("b", "c", False), ("b", "c", False), ("c", "c", True)]
    r = A.boundary_anatomy(A.boundaries(t, "unit"), "unit").first()
    h = -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))
    assert (r["boundaries"], r["pairs"], r["final_glyphs"], r["initial_glyphs"]) == (3, 2, 2, 1) and r["pair_bits"] == round(h, 6) and r["initial_bits"] == 0 and r["shared_bits"] == 0 and r["support"] == 1
    f = A.leaf_features(t, "unit").first()
    assert (f["segments"], f["tokens"], f["glyphs"], f["types"], f["boundaries"], f["within_count"]) == (2, 5, 6, 3, 3, 1) and f["adjacent_repeats"] == round(1 / 3, 6)
    alone = A.leaf_features(N.token_sequences(df.withColumn("tokens", F.expr("array(array('a'))")), "unit"), "unit").first()
    assert alone["boundaries"] == 0 and alone["adjacent_repeats"] is None and alone["conditional_gap"] is None
    with pytest.raises(Exception, match="only one view"):
        d = spark.createDataFrame([("u", 1.0)], "unit string, delta double")
        A.joined_views(d, d.limit(0), "unit", ("x", "y")).collect()


def test_split_search_beats_its_start_and_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, leaf, rng.choice("AB"), str(rng.randint(1, 3)), rng.choice(["h", "b"]), 1, rng.choice("PL")) for i, leaf in enumerate(sorted(rng.choices(range(1, 41), k=200)) + list(range(1, 41)))]
    own = X.profiles(spark.createDataFrame(rows, "record_id long, physical_leaf int, currier string, scribe string, section string, quire int, locus_type string")).cache()
    special = spark.createDataFrame([("fRos", [8, 9])], "folio string, linked_leaves array<int>")
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    of, best = X.optimised(own, special, shares, restarts=6, proposals=60)
    again, same = X.optimised(own, special, shares, restarts=6, proposals=60)
    got = {r["leaf"]: r["split"] for r in of.collect()}
    assert best == same and got == {r["leaf"]: r["split"] for r in again.collect()} and got[8] == got[9]
    assert sorted(map(list(got.values()).count, shares)) == [6, 6, 28]
    assert X.objective(own, of, {"train": 28, "validation": 6, "test": 6}).first()["objective"] == pytest.approx(best, abs=1e-6)
    assert best <= X.optimised(own, special, shares, restarts=6, proposals=0)[1]


def test_review_samples_against_plain_greed(spark):
    rng = random.Random(5)
    rows = [(f"l{i}", f"p{rng.randint(1, 6)}", i, rng.random() < 0.1, rng.random() < 0.4, float(rng.randint(0, 900))) for i in range(60)]
    rows = [(k, p, i, m, e and not m, pr) for k, p, i, m, e, pr in rows]
    df = spark.createDataFrame(rows, "line_key string, page string, place int, mandatory boolean, exact boolean, priority double")
    key = lambda r: (-r[5], r[2])
    chosen = sorted([r for r in rows if r[3]], key=key)
    used = {}
    for r in chosen:
        used[r[1]] = used.get(r[1], 0) + 1
    want = max(15, len(chosen))
    rest = sorted([r for r in rows if not r[3] and not r[4]], key=key)
    for capped in (True, False):
        for r in rest:
            if len(chosen) < want and r not in chosen and (not capped or used.get(r[1], 0) < 2):
                chosen.append(r)
                used[r[1]] = used.get(r[1], 0) + 1
    pages = {r[1] for r in chosen}
    controls = []
    for fresh in (True, False):
        for r in sorted([r for r in rows if r[4]], key=lambda r: r[2]):
            if len(controls) < 8 and r not in controls and (not fresh or r[1] not in pages):
                controls.append(r)
                pages.add(r[1])
    got = [r["line_key"] for r in V.recommended(df, 15, 8, 2).orderBy("review_rank").collect()]
    assert got == [r[0] for r in [*chosen, *controls]]


def test_three_way_classes(spark):
    ab, ba = [["A1", "B1"], ["C1"]], [["A1"], ["B1", "C1"]]
    far = [["D1", "D2", "D3"]]
    cases = {
        "others_agree_against_primary": (far, ab, ab), "others_agree_on_glyphs_against_primary": (far, ab, ba), "low_agreement": (ab, ab, far), "boundaries_only": (ab, ba, ab), "exact": (ab, ab, ab),
        "primary_supported_by_one": ([["A1"] * 40], [["A1"] * 40], [["A1"] * 39 + ["B1"]]), "moderate_agreement": ([["A1"] * 10], [["A1"] * 10], [["A1"] * 9 + ["B1"]]),
        "high_but_not_exact": ([["A1"] * 40], [["A1"] * 39 + ["C1"]], [["A1"] * 39 + ["B1"]]),
    }
    rows = [(k, c, t, 0, 0, 0) for k, three in cases.items() for c, t in zip("PQR", three)] + [("exact_with_doubts", c, ab, 0, 1, 0) for c in "PQR"] + [("missing", "P", ab, 0, 0, 0)]
    df = spark.createDataFrame(rows, "line_key string, corpus string, tokens array<array<string>>, unknown int, doubtful_spaces int, alternatives int")
    got = {r["line_key"]: r for r in V.classified(V.three_way(df, "PQR")).collect()}
    assert {k: r["class"] for k, r in got.items()} == {k: k for k in [*cases, "exact_with_doubts"]}
    assert got["boundaries_only"]["mandatory"] and got["exact_with_doubts"]["priority"] == 43 and not got["exact"]["mandatory"]


def test_verdicts_and_replication(spark):
    status = lambda *x: spark.createDataFrame([(s,) for s in x], "status string")
    verdict = lambda *x: V.review_verdict(status("OK"), status(*x)).first()["verdict"]
    assert [verdict("OK"), verdict("OK", " "), verdict("UNRESOLVED"), verdict("PARSER_OR_ALIGNMENT_ISSUE", "UNRESOLVED")] == ["PASS", "INCOMPLETE", "INCOMPLETE_UNRESOLVED", "FAIL"]
    assert V.qc_summary(status("PASS", "PASS WITH LIMITATION")).first()["overall"] == "PASS" and V.qc_summary(status("MISMATCH")).first()["overall"] == "MISMATCH"
    rows = [("f", "r", lang, k, k < n) for lang, n in (("a", 5), ("b", 4), ("c", 3), ("d", 4)) for k in range(5)]
    df = spark.createDataFrame(rows, "f string, r string, l string, k int, strong boolean")
    relations = S.two_level_replication(df, "f", "r", "l", "strong", 5, 4, 3)[1].first()
    assert relations["languages"] == 3 and relations["replicated_in"] == "a|b|d" and relations["robust"]
    with pytest.raises(Exception, match="not 5 runs"):
        S.two_level_replication(df.where("k < 4"), "f", "r", "l", "strong", 5, 4, 3)[0].collect()
    rates = lambda last: spark.createDataFrame([(k, 0.0) for k in range(1, 16)] + last, "lag int, rate double")
    assert [S.exact_cycle(rates(x), 16, 1e-9).first()["exact"] for x in ([(16, 1.0)], [(16, 0.9)], [])] == [True, False, False]


def test_ranked_matches(spark):
    wanted = spark.createDataFrame([("f1r1", "f1r", "1"), ("f2v", "f2v", ""), ("f3r", "f3r", "")], "page string, base string, panel string")
    offered = spark.createDataFrame([("c1", "f1r", "f1r"), ("c2", "f2v", "f2v1"), ("c3", "f2v", "f2v2")], "id string, base string, label string")
    rules = [F.col("label") == F.col("page"), F.col("panel") == "", F.col("label") == F.col("base")]
    got = {r["page"]: (r["outcome"], r["choices"]) for r in L.ranked_matches(wanted, offered, rules, "page", "id").collect()}
    assert got == {"f1r1": ("found", ["c1"]), "f2v": ("several", ["c2", "c3"]), "f3r": ("none", None)}

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import ciphers as K
from foliant.operators import corpus as C
from foliant.operators import ngram as N
from foliant.operators import recurrence as Q
from foliant.operators import resample as R
from foliant.operators import splits as S

META = "folio string, physical_leaf int, section string, currier string, scribe string, locus string, locus_type string, paragraph int, line int, source_line_number int"


def lines(spark, *token_lists):
    rows = [(i, "f1r", 1, None, "A", None, f"f1r.{i},@P0", "P", 1, i, i, t, i) for i, t in enumerate(token_lists)]
    return C.analytical_lines(spark.createDataFrame(rows, f"record_id long, {META}, tokens array<array<string>>, built_at long"))


def test_entropy_of_two_equal_counts_is_one_bit(spark):
    n = spark.createDataFrame([("x", 2), ("y", 2)], "g string, n long")
    assert C.entropy(n, []).first()["entropy_bits"] == 1.0


def test_alternating_glyphs_have_no_conditional_entropy(spark):
    r = C.conditional_entropy(lines(spark, [["A1", "B1", "A1", "B1"]]), 1).first()
    assert (r["entropy_bits"], r["observations"], r["contexts"]) == (0.0, 3, 2)


def test_mutual_information_of_alternation_is_one_bit(spark):
    p = C.glyph_pairs(lines(spark, [["A1", "B1"] * 2], [["B1", "A1"] * 2]), 1)
    assert C.mutual_information(p, "distance").first()["mi_bits"] == 1.0


@pytest.mark.parametrize("other, bits", [("A", 0.0), ("B", 1.0)])
def test_divergence(spark, other, bits):
    n = spark.createDataFrame([("x", "A", 10), ("y", other, 7)], "l string, item string, n long")
    assert C.divergences(n, "l").first()["jsd_bits"] == bits


def test_unknown_glyphs_null_pieces_and_empty_lines(spark):
    own = lines(spark, [["A1", "Z1", None, ""], [], None, ["B1"]], [], None)
    assert [r["n"] for r in C.window_counts(own, 1).orderBy("window").collect()] == [1, 1]
    assert [(r["segment"], r["tokens"]) for r in C.segments(own).collect()] == [(0, ["B1"])]
    assert C.tokens(own).count() == 2


def test_edit_distance_counts_glyphs(spark):
    near = C.edit_neighbourhoods(lines(spark, [["A1", "B1"], ["A1", "C2"], ["A1"], ["D1", "E1", "F1", "G1"]]))
    assert {(r["a"], r["b"]): r["distance"] for r in near.collect()}[("A1\x1fB1", "A1\x1fC2")] == 1
    assert all("D1" not in r["a"] + r["b"] for r in near.collect())


def test_witten_bell_probabilities_add_up_to_one(spark):
    s = spark.createDataFrame([("u", ["A", "B", "A"]), ("u", ["A", "C"])], "unit string, symbols array<string>")
    tables = N.counts(N.events(s, 3), 3)
    asked = spark.createDataFrame([("A", h2, x) for h2 in ("<BOS>", "B") for x in ("A", "B", "C", "<UNK>")], "h1 string, h2 string, s string")
    p = N.probabilities(asked, tables)
    for r in p.groupBy("h2").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in (1, 2, 3)]).collect():
        assert all(math.isclose(r[f"p{k}"], 1, abs_tol=1e-9) for k in (1, 2, 3))


def test_a_repeated_pattern_is_learned(spark):
    s = spark.createDataFrame([("u", ["A", "B"] * 50)], "unit string, symbols array<string>")
    bits = {r["model_order"]: r["bits"] / r["events"] for r in N.unit_scores(s, s, 2, "unit").collect()}
    assert bits[2] < 0.2 < 0.9 < bits[1]


def test_line_sequences(spark):
    got = N.line_sequences(lines(spark, [["A1"], ["B1", "Z1", "C1"], ["Z1"], ["D1"]]))
    assert sorted(r["symbols"] for r in got.collect()) == [["A1", "<WB>", "B1"], ["C1"], ["D1"]]


def test_ranks_and_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (2.0, 4.0), (None, 1.0)], "x double, y double")
    assert sorted(r["x_rank"] for r in R.average_ranks(rows, "x").collect() if r["x"]) == [1, 2.5, 2.5]
    assert R.correlation(rows, "x", "y").first().asDict() == {"n": 3, "n_missing": 1, "r": 1.0}
    assert R.correlation(rows.withColumn("x", F.lit(1.0)), "x", "y").first()["r"] is None
    assert R.correlation(rows.limit(0), "x", "y").first()["n"] == 0


def test_bootstrap_of_equal_units_has_no_spread(spark):
    d = spark.createDataFrame([(f"u{i}", 3.0, 2) for i in range(20)], "unit string, delta_bits double, events long")
    r = R.interval(R.paired_bootstrap(d, 50)).first()
    assert (r["mean"], r["lower"], r["upper"], r["replicates"]) == (1.5, 1.5, 1.5, 50)


def test_bootstrap_query_draws_as_often_as_the_reference(spark):
    import __spark_entry__ as e

    assert e.queries()["paired_bootstrap"](spark, "/root/testdata/sf0.001").first()["replicates"] == 10_000


def test_splits(spark):
    assert S.largest_remainder(10, {"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 5, "b": 3, "c": 2}
    u = spark.createDataFrame([(i,) for i in range(10)] * 2, "u int")
    n = {r["split"]: r["n"] for r in S.hash_ranked_split(u, "u", {"a": 0.5, "b": 0.25, "c": 0.25}).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 5, "b": 3, "c": 2}
    assert S.hash_ranked_split(u.limit(0), "u", {"a": 1.0}).count() == 0


def test_crop_cuts_the_last_line(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d", "e"]), (3, ["f"])], "i int, w array<string>")
    assert [r["w"] for r in S.cropped(rows, "i", "w", 4).orderBy("i").collect()] == [["a", "b"], ["c", "d"]]


def words(spark, *texts):
    return spark.createDataFrame([(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(t.split())], "line long, token int, word string")


@pytest.mark.parametrize("family", K.FAMILIES)
def test_ciphers_decode(spark, family):
    own = words(spark, "kun wat kun ünd", "a", "hal bose kun wat " * 10)
    cipher, key = K.encoded(own, family)
    got = {(r["line"], r["token"]): r["restored"] for r in K.decoded(cipher.select("line", "token", "cipher"), key, family).collect()}
    assert got == {(r["line"], r["token"]): r["word"] for r in own.collect()}


def test_recurrence_takes_every_form_once_a_cycle(spark):
    rows = K.variants(words(spark, "kun " * 32), "recurrence").orderBy("occurrence").collect()
    v = [r["variant"] for r in rows]
    assert sorted(v[:16]) == list(range(16)) and v[:16] == v[16:]


def test_lag_profile_of_a_cycle(spark):
    occ = spark.createDataFrame([("b", str(i % 4), i) for i in range(40)], "base string, suffix string, occurrence long")
    rate = {r["lag"]: r["rate"] for r in Q.lag_rates(occ, 5).collect()}
    assert rate == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}
    p = Q.permutation_test(occ, 4, 20).first()
    assert p["observed"] == 1.0 and p["p"] < 0.1


def test_permutation_p_of_a_strong_cycle_is_under_a_thousandth(spark):
    cycle = [(f"b{f}", str(i % 16), i) for f in range(3) for i in range(80)]
    rare = [(f"r{f}", "x" if i % 16 == f else "y", i) for f in range(3) for i in range(90)]
    occ = spark.createDataFrame(cycle + rare + [("one", "z", i) for i in range(50)] + [("few", str(i), i) for i in range(16)], "base string, suffix string, occurrence long")
    p = Q.permutation_test(occ, 16, 10_000).first()
    assert p["observed"] == 1.0 and p["p"] == p["contrast_p"] == round(1 / 10_001, 6)
    flat = Q.permutation_test(occ.where("base = 'one'"), 16, 200).first()
    assert (flat["observed"], flat["null_mean"], flat["p"], flat["contrast"], flat["contrast_p"]) == (1.0, 1.0, 1.0, 0.0, 1.0)
    assert Q.permutation_test(occ.where("base = 'few'"), 16, 10).count() == 0


@pytest.mark.parametrize("counts", [[6, 1, 1], [2, 3, 1], [9, 2]])
def test_shuffled_orders_are_equally_likely(counts):
    letters = [k for k, n in enumerate(sorted(counts, reverse=True)) for _ in range(n)]
    orders = set(itertools.permutations(letters)) if len(letters) < 9 else {tuple(int(i in c) for i in range(11)) for c in itertools.combinations(range(11), 2)}
    exact = Counter(tuple(sum(x == y for x, y in zip(o, o[k:])) for k in (1, 2, 3)) for o in orders)
    got = Counter(map(tuple, Q._matches(counts, 60_000, 3, np.random.default_rng(1)).tolist()))
    assert set(got) == set(exact)
    assert all(abs(got[k] / 60_000 - n / len(orders)) < 0.01 for k, n in exact.items())


def test_every_query_has_a_name_and_sql_names_a_query():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_cipher_round_trips_reads_words_once(spark, tmp_path):
    from foliant.plans.cipher_queries import cipher_round_trips

    rows = [(1, "daiin.shedy", 0), (None, "qokeedy.ol", 0), (2, "chol", 0)]
    spark.createDataFrame(rows, "record_id long, text_normalized string, ingested_at long").write.parquet(str(tmp_path / "loci.parquet"))
    out = cipher_round_trips(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "loci.parquet" not in plan and "SortMergeJoin" not in plan  # neither parsed anew nor joined by each family
    assert {(r["family"], r["tokens"], r["restored"]) for r in out.collect()} == {(f, 5, 5) for f in K.FAMILIES}

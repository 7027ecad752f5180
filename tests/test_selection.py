import pytest
from pyspark.sql import functions as F

from foliant.functions import normalize as Z
from foliant.operators import selection as S

RECORDS = "record_id long, folio string, physical_leaf int, page string, leaf int, split string"


def records(spark, rows):
    return spark.createDataFrame([(i, f, leaf, "clash", 9, "clash") for i, (f, leaf) in enumerate(rows)], RECORDS)


def found(checks):
    return {r["check"]: r["violations"] for r in checks.collect()}


def test_leaf_ids(spark):
    good = spark.createDataFrame([(" f12",), ("",), ("f3 ",), ("  ",)], "value string")
    assert sorted(r["leaf"] for r in S.leaf_ids(good, "train").collect()) == [3, 12]
    for bad in ("F3", "f", "3", "f3r", "f12"):
        with pytest.raises(Exception, match="leaf id"):
            S.leaf_ids(good.union(spark.createDataFrame([(bad,)], "value string")), "train").collect()
    assert S.leaf_ids(good.limit(0), "train").count() == 0


def test_selection_follows_linked_leaves(spark):
    rows = records(spark, [("f1r", 1), ("f2r", 2), ("fRos ", None), ("f85r", 85), ("f86r", 86), ("f1v", 1)])
    special = spark.createDataFrame([("fRos", [85, 86]), ("FROS", [86, None])], "folio string, linked_leaves array<int>")
    leaves = lambda *x: spark.createDataFrame([(i,) for i in x], "leaf int")
    got = lambda *x: sorted(r["record_id"] for r in S.select_by_leaves(rows, leaves(*x), special).collect())
    assert got(1) == [0, 5] and got(1, 85) == [0, 3, 5] and got(85, 86, 86) == [2, 3, 4] and got() == []
    assert found(S.selection_checks(rows, leaves(1, 85, 7), special)) == {"linked_leaves_apart": 1, "no_rule": 0, "missing_leaf": 1, "leaked_leaf": 0}
    stray = rows.union(records(spark, [("f?", None)]))
    assert found(S.selection_checks(stray, leaves(1), special))["no_rule"] == 1
    with pytest.raises(ValueError, match="linked_leaves_apart"):
        S.selected(rows, leaves(85), special, "train")
    assert S.selected(rows, leaves(85, 86), special, "train").count() == 3


def test_covers_and_assignments(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 9), ("b", 9)], "part string, item long")
    assert found(S.cover_checks(parts, S.line_range(spark, 3))) == {"out_of_range": 1, "overlap": 1, "not_covered": 1}
    of = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "leaf int, split string")
    ties = spark.createDataFrame([(2, 3), (1, 2)], "u int, v int")
    got = found(S.assignment_checks(of, of, {"train": 2, "test": 0, "validation": 1}, ties))
    assert got["split_size"] == 2 and got["tied_leaves_apart"] == 1 and got["not_covered"] == 0


def test_parity_and_gates(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0), ("only", 1.0, 1.0)], "k string, v double, w double")
    b = spark.createDataFrame([("x", 1.0 + 1e-10, None), ("y", 2.1, None)], "k string, v double, w double")
    got = {(r["k"], r["field"]): r["pass"] for r in S.parity(a, b, ["k"], {"v": 1e-9, "w": 0}).collect()}
    assert got == {("x", "v"): True, ("x", "w"): True, ("y", "v"): False, ("y", "w"): False, ("only", "v"): False, ("only", "w"): False}
    assert found(S.frozen(spark, {"a": 1, "b": [2], "more": 0}, {"a": 1, "b": [2, 3], "c": None, "d": True})) == {"a": 0, "b": 1, "c": 1, "d": 1}
    assert found(S.frozen(spark, {"a": True}, {"a": 1})) == {"a": 1}
    ok = {"overall_qc": "PASS", "freeze_readiness": {"published_count_validation_complete": True}}
    assert found(S.readiness_checks(spark, ok)) == {"overall_qc": 0, "published_counts": 0, "samples_looked_over": 1}
    assert sum(found(S.readiness_checks(spark, ok, confirmed=True)).values()) == 0 and found(S.readiness_checks(spark, {}))["overall_qc"] == 1
    key = spark.createDataFrame([({"a": 1}, ["x"], 1)], "m map<string,int>, s array<string>, n int")
    assert found(S.lineage_checks(key, key.withColumn("n", F.lit(2)), ["m", "s", "n"])) == {"m": 0, "s": 0, "n": 1}


def test_count_conventions(spark):
    rows = [("exact", 5, 9, 5), ("semantic", 4, 5, 5), ("off", 4, 6, 5), ("missing", 4, 5, None), ("lossy", 4, 5, None), ("lossy", 4, 5, 5)]
    df = spark.createDataFrame(rows, "kind string, c int, s int, e int")
    got = [r["status"] for r in S.count_convention(df, "c", "s", "e", F.col("kind") == "lossy").collect()]
    assert got == ["PASS", "PASS", "MISMATCH", "MISMATCH", "PASS WITH LIMITATION", "MISMATCH"]


def test_normalisation(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(Z.letters(F.lit("Ｆｕｌｌ-width ﬁne 3x É_é"))) == ["full", "width", "fine", "x", "é", "é"]
    assert one(Z.letter_lines(F.lit("A b\r\n12\n c"))) == [["a", "b"], ["c"]] and one(Z.letter_lines(F.lit(""))) == []
    tokens = {"’Tis": "tis", "-a-b-": "a-b", "l’a": "l'a", "x1": None, "a_b": None, "--": None, "é": "é", "": None, "q̃": "q̃"}
    assert {t: one(Z.canonical_token(Z.nfc(F.lit(t)))) for t in tokens} == tokens
    assert one(Z.line_tokens(F.lit("‘L’arbre’, v2 and rock-n-roll!"))) == ["l'arbre", "and", "rock-n-roll"]
    assert one(Z.glyph_character(Z.code_point_glyph(F.lit("😀")))) == "😀" and one(Z.code_point_glyph(F.lit("€"))) == "U000020AC"
    assert one(Z.short_id(F.array(F.lit("A"), F.lit('é"')))) == "a0cf80c5e0a93a54" or len(one(Z.short_id(F.array(F.lit("A"))))) == 16
    v = F.array(*[F.split(F.lit(x), "") for x in ("ab", "ac", "bb")])
    assert abs(one(Z.pairwise_hamming(v)) - 4 / 3) < 1e-12 and one(Z.pairwise_hamming(F.slice(v, 1, 1))) is None
    for bad in (F.slice(v, 1, 1), F.array(F.split(F.lit("ab"), ""), F.split(F.lit("abc"), ""))):
        with pytest.raises(Exception, match="variants"):
            one(Z.mean_hamming(bad))
    assert one(Z.json_texts(F.lit('{"label":{"en":["1r",2]},"id":"no","x":[{"height":3},null,true]}'))) == ["1r", "2", "True"]
    with pytest.raises(Exception, match="empty source line"):
        one(Z.source_tokens(F.lit("  ")))

import pytest
from pyspark.sql import functions as F

from foliant.operators import ciphers as K
from foliant.operators import mechanisms as M

WORDS = "line long, token int, word string, split string"


@pytest.fixture(scope="module")
def words(spark):
    text = ["aba", "cab", "ba", "abc", "aba", "aba"]
    rows = [(i, k, text[(i * 7 + k * k) % 6], "train" if i < 30 else "validation" if i < 40 else "reserved") for i in range(50) for k in range(5)]
    rows += [(35, 9, "zoë😀", "validation")]  # characters that train lacks
    return spark.createDataFrame(rows, WORDS).cache()


def all_restored(rows):
    return rows.where("not restored <=> word").count() == 0


def test_suffixes_restore_and_small_keys_begin_large_ones(words):
    assert M.suffixes(3, 4) == M.suffixes(3)[:4] and len(set(M.suffixes(3))) == 16
    texts = {}
    for count in (1, 2, 4, 16):
        rows, key = M.suffixed(words, count, 3)
        assert all_restored(M.decoded(rows, key, 1))
        assert rows.where(F.size("cipher") != F.size("base") + 1).count() == 0 and rows.where("split = 'reserved'").count() == 0
        texts[count] = {(r["line"], r["token"]): r["cipher"] for r in rows.collect()}
    assert all(t[:-1] == texts[16][k][:-1] for k, t in texts[4].items())
    # the variant hangs on the place, not on the word
    other = M.suffixed(words.withColumn("word", F.lit("a")), 16, 3)[0]
    assert {(r["line"], r["token"]): r["cipher"][-1] for r in other.collect()} == {k: t[-1] for k, t in texts[16].items()}


@pytest.mark.parametrize("factors", M.FACTORS)
def test_affixes_restore_word_and_variant(words, factors):
    rows, key = M.affixed(words, factors, 5)
    assert all_restored(M.decoded(rows, key, 2))
    assert rows.where(~M.affix_variant(F.col("cipher"), factors, 5).eqNullSafe(F.col("variant"))).count() == 0
    assert rows.select(M.affix_variant(F.array(F.lit("M0001"), F.lit("?"), F.lit("B0001")), factors, 5)).first()[0] is None


def test_turns_continue_from_train_to_validation(words):
    rows, key = M.allocated(words)
    right = M.decoded(rows, key, 1)
    assert all(r["violations"] == 0 for r in M.allocation_checks(right).collect())
    c = M.continuation(rows).first()
    assert c["counter_breaks"] == 0 and c["avoidable_reuses"] == 0 and c["unavoidable_reuses"] > 0 and c["tokens"] == 51
    broken = right.withColumn("variant", F.lit(0))
    assert {r["check"] for r in M.allocation_checks(broken).where("violations > 0").collect()} >= {"schedule", "forms_in_train", "repeats_within_a_cycle"}
    assert M.continuation(rows.withColumn("occurrence", F.lit(0).cast("long"))).first()["counter_breaks"] > 0
    iid = M.allocated(words, "iid")[0]
    assert {r["check"] for r in M.allocation_checks(M.decoded(iid, key, 1)).where("violations > 0").collect()} >= {"schedule"}


def test_codes_restore_and_are_nested(words):
    related = M.related_codes(words)
    for count in (1, 2, 4):
        rows, key = M.coded(words, related, count)
        assert all_restored(M.decoded_codes(rows, key, related)) and rows.where("targeted").agg(F.max("variant")).first()[0] < count
    codes = M.master_codes(words, 4)
    few = {r["word"]: r["forms"] for r in M.master_codes(words, 2).collect()}
    many = {r["word"]: r["forms"] for r in codes.collect()}
    assert len(few) == 2 and all(many[w] == f for w, f in few.items()) and len({tuple(x) for f in many.values() for x in f}) == 16
    rows, key = M.coded(words, codes, 4, active=2)
    assert all_restored(M.decoded_codes(rows, key, codes)) and rows.where("targeted").select("word").distinct().count() == 2
    with pytest.raises(Exception, match="words to code"):
        M.master_codes(words, 100).collect()


def test_diagnostics_and_lines(words):
    rows, key = M.suffixed(words, 4)
    d = {r["split"]: r for r in M.surface_diagnostics(M.decoded(rows, key, 1), "split").collect()}
    assert d["train"]["tokens"] == 150 == d["train"]["restored"] and d["train"]["word_types"] == 4 and d["train"]["most_forms"] == 4
    lines = {r["line"]: r for r in M.control_lines(rows, words).collect()}
    assert len(lines) == 50 and lines[45]["tokens"] is None and lines[45]["reserved_test_opaque"] and len(lines[35]["tokens"]) == 6
    c = {r["split"]: r for r in M.text_counts(rows, F.col("cipher"), "split").collect()}
    assert c["train"]["lines"] == 30 and c["train"]["tokens"] == 150
    assert M.surface_diagnostics(M.decoded(rows, key, 1).limit(0), "split").count() == 0


def test_codewords(spark):
    items = spark.createDataFrame([(f"w{i}",) for i in range(9)], "item string")
    got = [tuple(r["codeword"]) for r in M.codewords(items, 2, ["x", "y", "z"]).collect()]
    assert len(set(got)) == 9 and all(len(c) == 2 for c in got)
    with pytest.raises(ValueError):
        M.codewords(items, 1, ["x", "y"])


def test_glyph_numbers_of_any_width(spark):
    rows = spark.createDataFrame([(1, i, chr(0x4E00 + i)) for i in range(4000)], "line long, token int, word string")
    cipher, key = K.encoded(rows, "homophonic")
    back = K.decoded(cipher, key, "homophonic").join(rows, ["line", "token"])
    assert back.where("restored <> word").count() == 0 and back.count() == 4000

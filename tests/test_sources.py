import itertools
import random
import zipfile


import numpy as np
import pytest
from pyspark.sql import functions as F
from foliant.operators import sequence_models as Z
from foliant.sources import files, rules
from foliant.sources import transcription as T
from foliant.streaming import events

TEXT = """#=IVTFF Qor- 2.0 M 2
# a comment/
<f1r>      <! $Q=A $P=B $I=H $L=@ $H=1 $H=2>
<f1r.1,@P0>   <%>ab.cd/
/ef<@H=5>.gh
<f1r.2,+P0;V>  ij<$>
<f1r.3,@Lf>    kl
<f2v1>     <! $Q=Z $I=X>
<f2v1.1,@P0>   mn
"""


def numbered(spark, text):
    return spark.createDataFrame([("x", i + 1, line) for i, line in enumerate(text.split("\n"))], "file string, n int, text string")


def test_transcription(spark):
    a, b, c, d = T.parse(numbered(spark, TEXT)).orderBy("source_line_number").collect()
    assert a["text_normalized"] == "<%>ab.cdef<@H=5>.gh" and a["text_raw"] == "<%>ab.cd/\n/ef<@H=5>.gh" and a["source_line_numbers"] == [4, 5]
    assert (a["quire"], a["section"], a["currier"], a["scribe"]) == (1, "herbal", None, "5") and a["text_tags"] == {"H": "5"}
    assert (a["paragraph"], b["paragraph"], c["paragraph"], d["paragraph"]) == (1, 1, None, None)
    assert (b["transcriber"], b["locus"], b["scribe"], b["paragraph_end"]) == ("V", "f1r.2,+P0;V", "5", True)
    assert (d["physical_leaf"], d["recto_verso"], d["foldout_panel"], d["section"], d["quire"], d["scribe"]) == (2, "v", 1, "unknown_X", None, None)
    assert T.issues(numbered(spark, TEXT)).count() == 0


def test_transcription_issues(spark):
    bad = "#=IVTFF a b\n<f1r.1,@P0> x\n<f1r>\n/lost\nwhat\n<f2r.1,@P0> <%>y\n<f1r.2,@P0> <%>z<$>\n<f1r.3,@P0> <$>"
    got = {(r["n"], r["issue"]) for r in T.issues(numbered(spark, bad)).collect()}
    assert {(2, "line before any page"), (4, "orphan continuation"), (5, "unrecognised line"), (6, "line of another page"), (7, "nested paragraph start")} <= got


def test_rules_replace_in_order_and_are_not_read_again(spark):
    own = spark.createDataFrame([("A1", "e'", 0), ("B1", "ee", 1), ("C1", "sh", 2), ("D1", "e", 3), ("E1", "A1", 4), ("Z1", "?", 5)], "target string, source string, ord int")
    order = rules.ordered(own)
    df = spark.createDataFrame([("shee'",), ("ee",), ("x",), ("e?.<x>e??",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.converted(F.col("t"), order)).collect()] == ["C1D1A1", "B1", None, "D1Z1.D1Z1Z1", None]
    got = df.select(rules.semantic_count(F.lit("e???e??"), order), rules.semantic_count(F.lit("e????"), order), rules.glyph_count(F.lit("D1Z1Z1.Z1"), True)).first()
    assert tuple(got) == (5, None, 3)
    tokens = spark.range(1).select(rules.glyph_tokens(F.lit("e,ee.[sh:e].sh<!note>e<->e"), order)).first()[0]
    assert tokens == [["D1"], ["B1"], ["C1"], ["C1", "D1"], ["D1"]]


def test_files(spark, tmp_path):
    (tmp_path / "r.bit").write_text("##BIT STA1 Qor-\n# note\nA1 o\nB1C1 x\n")
    assert [tuple(r) for r in rules.read_rules(spark, str(tmp_path / "r.bit")).collect()] == [("A1", "o", 2), ("B1C1", "x", 3)]
    (tmp_path / "c.jsonl").write_text('{"line_index": 1, "tokens": [["a"]]}\n\n{"line_index": 2, "reserved_test_opaque": true}\n{"line_index": 3, "tokens": []}\n')
    assert [r["line_index"] for r in files.read_control_lines(spark, str(tmp_path / "c.jsonl")).collect()] == [1]
    (tmp_path / "s.conllu").write_text("# x\n1-2\tab\n1\ta\n2\tb\n2.1\tc\n\n1\td\n")
    assert [r["forms"] for r in files.read_conllu(spark, str(tmp_path / "s.conllu")).orderBy("sentence").collect()] == [["a", "b"], ["d"]]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("t.xml", "<t><s><w>a</w><w n='1'>b</w></s><s><w>c</w></s></t>")
    x = files.read_xml_archives(spark, str(tmp_path / "a.zip"))
    assert x.select(files.xml_words(F.col("xml"))).first()[0] == [["a", "b"], ["c"]]


def test_pages(spark):
    df = spark.createDataFrame([('<p>a <b>b</b></p><script>x</script><a href="/wiki/q">l</a><li>c</li>',), (None,)], "h string")
    assert [r[0] for r in df.select(files.html_text("h")).collect()] == ["a b\nc", None]
    assert df.select(files.links(F.col("h"))).first()[0] == ["/wiki/q"]
    assert spark.range(1).select(files.folio_labels(F.lit("68r1, r2 and 70v"))).first()[0] == ["f68r1", "f68r2", "f70v"]
    m = '{"sequences":[{"canvases":[{"@id":"a","label":"1r"}]}]}'
    assert spark.range(1).select(files.canvases(F.lit(m))).first()[0][0]["id"] == "a"


def test_models_learn(spark):
    s = spark.createDataFrame([(["A", "B"] * 20,)] * 3 + [(["C"] * 5,)], "symbols array<string>")
    rows, v = Z.distinct_sequences(s), Z.vocabulary(s)
    for model in (Z.HiddenMarkov(3, v), Z.SlotGrammar(2, 4, v)):
        trace = model.fit(rows, 8)
        assert trace[-1] < trace[0] and model.bits(["A", "B"]) < model.bits(["B", "B", "C"])
    assert Z.alignment_counts(list("kitten"), list("sitting")) == {"M": 4, "S": 2, "D": 0, "I": 1}
    assert Z.alignment_counts([], list("ab")) == {"M": 0, "S": 0, "D": 0, "I": 2} and Z.alignment_counts(list("ab"), [])["D"] == 2
    c = Z.CopyEdit(v)
    c.fit(spark.createDataFrame([(["A", "B"], [["A", "B"]]), (["C", "A"], [])], "glyphs array<string>, history array<array<string>>"))
    assert c.score(["A", "B"], [["A", "B"]])[0] < c.score(["A", "B"], [])[0]


def test_models_iterate_until_they_converge(spark):
    rng = random.Random(2)
    s = spark.createDataFrame([(["A" if rng.random() < (0.8 if i % 2 else 0.3) else rng.choice("BC") for _ in range(12)],) for i in range(60)], "symbols array<string>")
    rows, v = Z.distinct_sequences(s), Z.vocabulary(s)
    for make in (lambda: Z.HiddenMarkov(2, v), lambda: Z.SlotGrammar(2, 4, v)):
        trace = make().fit(rows)
        steps = [abs(a - b) for a, b in zip(trace, trace[1:])]
        assert len(trace) == 50 or steps[-1] < 1e-5
        assert 10 < len(trace) and all(x >= 1e-5 for x in steps[3:-1])
        assert len(make().fit(rows, tolerance=1e9)) == 5 and len(make().fit(rows, tolerance=0.0)) == 50


def test_copies_by_distance_and_within_readable_segments(spark):
    t = spark.createDataFrame([(1, i, g) for i, g in enumerate([["A"], ["B"], ["C", "Z1"], ["D"], ["E"], ["F"]])], "record_id long, token_index int, glyphs array<string>")
    got = {r["token_index"]: r["history"] for r in Z.copy_sources(t, 2).collect()}
    assert got == {0: [], 1: [["A"]], 3: [], 4: [["D"]], 5: [["E"], ["D"]]}
    # every token repeats the one before the last
    a, b, x = ["A"] * 4, ["B"] * 4, ["C"] * 4
    rows = spark.createDataFrame([(a, [b, a]), (b, [a, b]), (x, [a, x])] * 20, "glyphs array<string>, history array<array<string>>")
    c = Z.CopyEdit(["A", "B", "C", Z.UNKNOWN_SYMBOL], 2)
    c.fit(rows)
    assert abs(c.distance[1] - 60.5 / 61) < 1e-9
    assert c.score(a, [b, a])[0] < c.score(a, [a, b])[0] - 3
    new, copied = c.new([a])[0], c.mixed([a], [[b, a]])[0]
    q = copied * c.rho / (copied * c.rho + new * (1 - c.rho))
    assert abs((60 * q + 0.5) / 61 - c.rho) < 1e-8


def test_edit_channel_against_all_scripts(spark):
    """The chances of all tokens of up to five symbols add up to 1, and each is the sum over its scripts."""
    c = Z.CopyEdit(["A", "B", Z.UNKNOWN_SYMBOL])
    c.symbol, c.insert, c.delete, c.keep = np.array([0.5, 0.3, 0.2]), 0.1, 0.2, 0.7

    def scripts(source, token):
        """Chance of token from what is left of source: at a gap."""
        stop = 1 - c.insert
        out = stop * (float(not token) if not source else c.delete * scripts(source[1:], token) + ((1 - c.delete) * (c.keep * (source[0] == token[0]) + (1 - c.keep) * c.symbol[token[0]]) * scripts(source[1:], token[1:]) if token else 0))
        return out + (c.insert * c.symbol[token[0]] * scripts(source, token[1:]) if token else 0)

    nothing = scripts((0, 1), ())
    tokens = [t for n in range(1, 6) for t in itertools.product(range(3), repeat=n)]
    got = {t: c.copied(np.array([[0, 1]]), np.array([t]))[0] for t in tokens}
    assert all(abs(got[t] - scripts((0, 1), t) / (1 - nothing)) < 1e-12 for t in tokens[:60]) and 0.99 < sum(got.values()) < 1
    with pytest.raises(ValueError):
        c.scores([["A"] * 65], [[]])


def test_models_are_saved_and_chosen_by_training(spark, tmp_path):
    rng = random.Random(4)
    s = spark.createDataFrame([([rng.choice("AB" if i % 2 else "CD") for _ in range(8)],) for i in range(40)], "symbols array<string>")
    rows, v = Z.distinct_sequences(s), Z.vocabulary(s)
    for name, make in (("h", lambda seed: Z.HiddenMarkov(2, v, seed)), ("s", lambda seed: Z.SlotGrammar(2, 4, v, seed))):
        each = [make(k) for k in range(3)]
        ends = [m.fit(rows, 12)[-1] for m in each]
        best = Z.best_of(make, rows, 3, iterations=12)
        assert best.bits(["A", "B"]) == each[int(np.argmin(ends))].bits(["A", "B"])
        Z.save_model(spark, best, str(tmp_path / name), restarts=3)
        again, facts = Z.load_model(spark, str(tmp_path / name))
        assert facts == {"restarts": 3} and again.bits(["A", "Q", "D"]) == best.bits(["A", "Q", "D"])
        assert [tuple(r)[2:] for r in Z.unit_bits(s.selectExpr("'u' as unit", "concat(symbols, array('Q')) as symbols"), "unit", best).collect()] == [(360, 40, 40)]


def test_streams(spark, tmp_path):
    src, n = str(tmp_path / "in"), 40
    spark.sql(f"select id as event_id, timestamp_seconds(id * 600) as ts, id % 2 as user_id, 'a' as event_type, 1.0D as value, '' as props from range({n})").write.parquet(src)

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("t").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("t").collect()

    assert sum(r["n"] for r in run(events.windowed_counts(events.read_events(spark, src)), "complete")) == n
    assert sorted(r["occurrence"] for r in run(events.occurrence_numbers(events.read_events(spark, src)), "append")) == sorted([*range(20), *range(20)])


def test_sessions_of_several_batches_stay_off_the_driver(spark, tmp_path):
    """The third batch has events days before the first's; a session goes on from one batch to the next, but not over a gap
    of just 30 minutes."""
    import os
    from datetime import datetime, timedelta

    from foliant.plans.stream_queries import stream_sessions

    at = lambda minutes: datetime(2024, 1, 9) + timedelta(minutes=minutes)
    rows = [[(1, at(0), 1), (2, at(10), 1), (3, at(60), 1), (4, at(0), 2)], [(5, at(35), 1), (7, at(30), 2)], [(6, at(-5000), 2)]]
    (tmp_path / "events.parquet").mkdir()
    for k, some in enumerate(rows):
        one = spark.createDataFrame([(i, t, u, "view", 1.0, "") for i, t, u in some], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        one.toPandas().to_parquet(tmp_path / "events.parquet" / f"part-{k}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "events.parquet" / f"part-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    out = stream_sessions(spark, str(tmp_path))
    assert "LocalRelation" not in out._jdf.queryExecution().optimizedPlan().toString() and "memory" not in out._jdf.queryExecution().analyzed().toString().lower()
    n = sorted((r["user_id"], r["n"]) for r in out.collect())
    assert n == [(1, 4), (2, 1), (2, 1), (2, 1)]
    assert not [r for r in out.collect() if r["user_id"] == 1 and r["end"] - r["start"] != timedelta(minutes=90)]


def test_starts_share_each_pass(spark, monkeypatch):
    from foliant.operators import sequence_models as Z

    s = spark.createDataFrame([(["A", "B"] * 4,), (["C", "D", "C"],), (["B"],)], "symbols array<string>")
    rows, v = Z.distinct_sequences(s), Z.vocabulary(s)
    passes, summed = [], Z._summed
    monkeypatch.setattr(Z, "_summed", lambda *a: passes.append(1) or summed(*a))
    Z.best_of(lambda seed: Z.HiddenMarkov(2, v, seed), rows, 3, iterations=4, tolerance=0.0)
    assert len(passes) == 4

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import corpus_tables, mechanisms
from foliant.sources import files, rules


def test_numbered_lines_of_cut_files(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3001 and all(r["text"] == f"{r['file'].rsplit('/', 1)[-1]} line {r['line_index']}" for r in rows)
    wanted = spark.createDataFrame([("a.txt", 2), ("b.txt", 0), ("b.txt", 7)], "file string, line_index long")
    assert sorted(r["text"] for r in files.read_selected_lines(spark, str(tmp_path), wanted).collect()) == ["a.txt line 2", "b.txt line 0"]


def test_source_lines_and_control_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a  b\nc\n")
    assert [(r["line"], r["tokens"]) for r in files.read_source_lines(spark, str(tmp_path / "s.txt")).orderBy("line").collect()] == [(1, ["a", "b"]), (2, ["c"])]
    at = str(tmp_path / "c.jsonl")
    rows = [{"line_index": 1, "tokens": [["A"]]}, {"line_index": 2, "reserved_test_opaque": True}, {"line_index": 3, "tokens": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert files.read_control_lines(spark, at, 3).count() == 1
    with pytest.raises(ValueError, match="expected"):
        files.read_control_lines(spark, at, 4)
    (tmp_path / "c.jsonl").write_text(json.dumps(rows[1]))
    with pytest.raises(ValueError, match="no lines"):
        files.read_control_lines(spark, at)


def test_tables_with_manifest_and_checksums(spark, tmp_path):
    lines = spark.createDataFrame([(1, [["a", "b"], ["a"]], "s"), (2, [["b", "a"], ["a"], ["c", "Z1"]], "s")], "record_id long, tokens array<array<string>>, section string")
    own = corpus_tables.tables(lines, 2, 2)
    out = str(tmp_path / "out")
    files.write_tables(spark, out, {"tokens": 5, "deep": {"x": 1.5}}, {k: own[k] for k in ("token_frequency", "conditional_entropy", "top_tokens")}, {"by": "test"})
    manifest = json.loads((tmp_path / "out" / "run_manifest.json").read_text())
    assert manifest["artifacts"] == ["conditional_entropy.csv", "summary.json", "token_frequency.csv", "top_tokens.csv"]
    sums = (tmp_path / "out" / "SHA256SUMS").read_text().splitlines()
    assert {x.split("  ")[1].split("/")[0] for x in sums} >= {"summary.json", "run_manifest.json", "token_frequency.csv"} and sums == sorted(sums, key=lambda x: x.split("  ")[1])
    m = files.read_metrics(spark, out, {"tokens": "tokens", "x": "deep.x"}, {"conditional_entropy": ("order", "entropy_bits")})
    assert {r["metric"] for r in m.collect()} == {"tokens", "x", "conditional_entropy_1", "conditional_entropy_2"} and m.where("metric = 'x'").first()["value"] == 1.5
    digest = next(x for x in sums if x.endswith("  summary.json")).split("  ")[0]
    gate = {r["check"]: r["violations"] for r in files.hash_gate(spark, out, {"summary.json": digest, "run_manifest.json": "0", "none": "0"}).collect()}
    assert gate == {"summary.json": 0, "run_manifest.json": 1, "none": 1}
    files.write_csv([], str(tmp_path / "empty"), spark)
    assert spark.read.text(str(tmp_path / "empty")).count() == 0


def test_control_runs(spark, tmp_path):
    rows = [(i, k, "ab", "train" if i < 3 else "reserved" if i < 5 else "validation") for i in range(6) for k in range(2)]
    words = spark.createDataFrame(rows, "line long, token int, word string, split string")
    cipher, key = mechanisms.suffixed(words, 4)
    good = mechanisms.decoded(cipher, key, 1)
    files.write_control_run(spark, str(tmp_path / "run"), good, {"b": 1, "a": "é"}, {"tokens": 8}, {"source_sha256": "x"})
    assert (tmp_path / "run" / "key.json").read_text().index('"a"') < (tmp_path / "run" / "key.json").read_text().index('"b"')
    assert files.read_control_lines(spark, str(tmp_path / "run" / "corpus.jsonl")).count() == 4 and len((tmp_path / "run" / "SHA256SUMS").read_text().splitlines()) >= 4
    with pytest.raises(ValueError, match="round_trip"):
        files.write_control_run(spark, str(tmp_path / "bad"), good.withColumn("restored", F.lit("?")), {}, {}, {})
    assert not (tmp_path / "bad").exists()
    lines = words.groupBy("line").agg(F.first("split").alias("split"), F.collect_list(F.array("word")).alias("tokens"))
    files.write_confirmatory(spark, str(tmp_path / "conf"), lines, {}, {})
    back = {r["line_index"]: r for r in spark.read.json(str(tmp_path / "conf" / "corpus.jsonl")).collect()}
    assert back[5]["tokens"] is None and back[5]["split"] is None and back[5]["opaque"] and back[4]["tokens"] == [["ab"], ["ab"]]
    with pytest.raises(Exception, match="no split"):
        files.write_confirmatory(spark, str(tmp_path / "conf2"), lines.withColumn("split", F.lit("other")), {}, {})


def test_readers_and_rules(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny ""q"""\n,2\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x\ny "q"'), (None, "2")]
    (tmp_path / "c.yaml").write_text("a: [1, 2]\n")
    (tmp_path / "c.json").write_text("[1]")
    assert files.load_config(str(tmp_path / "c.yaml")) == {"a": [1, 2]}
    with pytest.raises(ValueError, match="mapping"):
        files.load_config(str(tmp_path / "c.json"))
    html = '<div class="navbox"><p>no<br>no</p></div><p>yes <span class="reference">[1]</span>it</p><table><tr><td><p>no</table><li>is'
    assert spark.createDataFrame([(html,)], "h string").select(files.html_text("h")).first()[0] == "yes it\nis"
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    deep = "[" * 7 + "a" + ":b]" * 7
    assert one(rules.first_alternatives(F.lit(deep))) == "a" and one(rules.first_alternatives(F.lit("x[a"), False)) == "x[a"
    with pytest.raises(Exception, match="unpaired bracket"):
        one(rules.first_alternatives(F.lit("x[a"), True))
    assert rules.rule_file("v101", "/r/") == "/r/STA-v101_def.bit"
    with pytest.raises(ValueError):
        rules.rule_file("?", "/r")
    assert one(rules.glyph_stream(F.lit("ab.a"), [("a", "A1"), ("b", "B1")])) == ["A1", "B1", None, "A1"]

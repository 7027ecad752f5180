import pytest

from foliant.operators import row_check as R

SCHEMA = "raw_id long, feed string, raw_line string, cells string, value int"
GOOD = 'KW1a,f1r,"f1r.1,@P0",1,"ab.cd","<f1r.1,@P0> ab.cd"'
COUNT = "10,9,true,,8,2,QorX,a.bit," + "0" * 64 + ",3"


def reasons(spark, lines):
    rows = spark.createDataFrame([(i, f, x, "clash", 0) for i, (f, x) in enumerate(lines)], SCHEMA)
    return {r["id"]: r["reason"] for r in R.failures(rows).collect()}


@pytest.mark.parametrize("feed, line, reason", [
    ("loci", GOOD, None), ("counts", COUNT, None), ("loci", None, "column_count"), ("loci", "", "column_count"), (None, GOOD, "column_count"), ("other", GOOD, "column_count"),
    ("loci", 'a"b,c', "quoting"), ("loci", '"a"b,c', "quoting"), ("loci", '"a,b', "quoting"), ("loci", '"a""b",c', "column_count"), ("loci", ' "a",b', "quoting"), ("loci", '""",a', "quoting"),
    ("loci", GOOD.replace("KW1a", "kW1a"), "invalid_value"), ("loci", GOOD.replace(",1,", ",0,"), "invalid_value"), ("loci", GOOD.replace('"ab.cd"', '" "'), "invalid_value"),
    ("loci", GOOD.replace('"ab.cd"', '"a[b:c]<-[>d"'), None), ("loci", GOOD.replace('"ab.cd"', '"a[bc]"'), "invalid_value"), ("loci", GOOD.replace('"ab.cd"', '"a[b:[c:d]]"'), "invalid_value"),
    ("loci", GOOD.replace('"ab.cd"', '"a????b"'), "invalid_value"), ("loci", GOOD.replace('"ab.cd"', '"a>b<"'), "invalid_value"), ("loci", GOOD.replace('"<f1r.1,@P0> ab', '"<f1r.2,@P0> ab'), "invalid_value"),
    ("counts", COUNT.replace(",2,", ",3,"), "invalid_value"), ("counts", COUNT.replace("true", "false"), "invalid_value"), ("counts", COUNT.replace(",3", ",0"), "invalid_value"), ("counts", COUNT + "\n", "invalid_value"),
])
def test_reasons(spark, feed, line, reason):
    assert reasons(spark, [(feed, line)]).get(0) == reason


def test_separators_inside_fields(spark):
    rows = spark.createDataFrame([(1, "x", 'a\u0001s,"b,\u0001""\nc",')], "raw_id long, feed string, raw_line string")
    assert R.parsed(rows).first()["cells"] == ["a\u0001s", 'b,\u0001"\nc', ""]


def test_long_line_and_empty_table(spark):
    long = GOOD.replace("ab.cd", "ab." * 200_000 + '""' * 20_000)
    assert reasons(spark, [("loci", long), ("loci", long[:-1])]) == {1: "quoting"}
    assert reasons(spark, []) == {}


def test_valid_rows_are_typed(spark):
    rows = spark.createDataFrame([(1, "loci", GOOD), (1, "loci", GOOD), (2, "loci", "x"), (3, "counts", COUNT)], "raw_id long, feed string, raw_line string")
    got = R.valid_rows(rows, "loci").collect()
    assert [r["line"] for r in got] == [1, 1] and got[0]["locus"] == "f1r.1,@P0"
    assert R.valid_rows(rows, "counts").first()["characters"] == 10

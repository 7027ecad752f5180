import random

import pytest

from foliant.operators.reconcile import differences

SCHEMA = "k string, j int, a string, b int, at long, cell string, bucket int"


def run(spark, left, right, buckets=None):
    make = lambda rows: spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = differences(make(left), make(right), ["k", "j"], ["a", "b"], "at", "at", ("x", "y"), buckets)
    return sorted((r["k"], r["j"], r["field"]) for r in got.collect())


def expected(left, right):
    def last(rows):
        out = {}
        for k, j, a, b, at in sorted(rows, key=lambda r: r[4]):
            out[(k or "").strip(" "), j] = ((a or "").strip(" ") or None, b)
        return out

    x, y = last(left), last(right)
    out = [(*k, "missing_in_y") for k in x.keys() - y.keys()] + [(*k, "missing_in_x") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        out += [(*k, f) for f, p, q in zip("ab", x[k], y[k]) if p != q]
    return sorted(out)


@pytest.mark.parametrize("rate, buckets", [(0.02, None), (0.9, None), (0.5, 1)])
def test_against_a_dictionary(spark, rate, buckets):
    rng = random.Random(1)
    left = [(f"k{i // 3}", i % 3, rng.choice(["u", " u", "", None, "long" * 50]), rng.choice([1, 2, None]), i) for i in range(900)]
    right = [r if rng.random() > rate else (r[0], r[1], rng.choice(["w", "u ", None]), 3, r[4]) for r in left if rng.random() > rate / 3]
    left += [(r[0], r[1], "older", 9, -1) for r in left[:50]] + left[:20]
    right += [("only", 0, "z", 1, 5)]
    assert run(spark, left, right, buckets) == expected(left, right)


def test_empty_sides(spark):
    rows = [("a", 1, "x", 1, 1), (None, 1, None, None, 1)]
    assert run(spark, rows, []) == [("", 1, "missing_in_y"), ("a", 1, "missing_in_y")]
    assert run(spark, [], []) == [] and run(spark, rows, rows) == []
    assert run(spark, [("", 1, " ", None, 1)], [(None, 1, "", None, 2)]) == []

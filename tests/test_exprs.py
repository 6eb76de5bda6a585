import math
import random

from pyspark.sql import functions as F

from ohmsieve.functions import exprs as E

INF, NAN = float("inf"), float("nan")


def one(spark, schema, rows, **cols):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(k) for k, c in cols.items()]).collect()]


def test_guarded_divide_and_flags(spark):
    rows = [(1.0, 0.0), (1.0, 1e-7), (1.0, 1e-6), (1.0, 2e-6), (None, 2.0), (NAN, 2.0), (INF, 2.0), (3.0, -2.0)]
    got = one(spark, "n double, d double", rows, q=E.sdiv(F.col("n"), F.col("d")), f=E.fin(F.col("n")))
    assert [r["q"] for r in got] == [None, None, None, 1.0 / 2e-6, None, None, None, -1.5]
    assert [r["f"] for r in got] == [True] * 4 + [False] * 3 + [True]


def test_finiteness_is_one_comparison(spark):
    """Wide frames ask for it hundreds of times a row."""
    rows = [(None,), (NAN,), (INF,), (-INF,), (0.0,), (-1.5,), (1.7976931348623157e308,)]
    x = F.col("x")
    df = spark.createDataFrame(rows, "x double").select(E.ok(x).alias("o"), E.fin(x).alias("f"), E.finite(x).alias("v"))
    assert [tuple(r) for r in df.collect()] == [(None, False, None)] + [(False, False, None)] * 3 + [(True, True, v[0]) for v in rows[4:]]
    plan = df.select("f", "v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "isnan" not in plan and "isnotnull" not in plan


def test_close_and_tolerance(spark):
    rows = [(1.0, 1.00001), (1.0, 1.0001), (0.0, 1e-8), (None, 1.0), (INF, INF)]
    got = one(spark, "a double, b double", rows, c=E.close(F.col("a"), F.col("b")), t=E.tolerance(50, 0.02, F.col("a")))
    assert [r["c"] for r in got] == [True, False, True, False, False]
    assert got[3]["t"] == 50.0


def test_bucketize_half_even(spark):
    rows = [(0.5,), (-0.5,), (1.5,), (2.5,), (None,), (NAN,)]
    got = one(spark, "x double", rows, b=E.bucketize(F.col("x")), c=E.bucketize(F.col("x"), fill=0, rounded=False))
    assert [r["b"] for r in got] == [0, 0, 2, 2, -1, -1]
    assert [r["c"] for r in got] == [0, 0, 1, 2, 0, 0]


def test_curve_index(spark):
    rows = [(None,), (0.0,), (1.0,), (3.0,), (4.0,), (1.9,), (-3.0,)]
    assert [r["i"] for r in one(spark, "x double", rows, i=E.curve_index(F.col("x"), 3))] == [0, 0, 0, 2, 0, 0, 0]


def test_joined_and_pattern(spark):
    got = one(spark, "a string, b string", [("x", None), (None, None)], j=E.joined([F.col("a"), F.col("b")]), p=E.pattern([F.col("a"), F.col("b")]))
    assert [(r["j"], r["p"]) for r in got] == [("x|<NA>", 2), ("<NA>|<NA>", 3)]


def scalar_interp(x, xs, ys):
    ok = [i for i in range(len(xs)) if xs[i] is not None and ys[i] is not None]
    if x is None or not ok:
        return None
    for i in range(len(xs) - 1):
        if i in ok and i + 1 in ok and abs(xs[i + 1] - xs[i]) > 1e-6 and min(xs[i], xs[i + 1]) <= x <= max(xs[i], xs[i + 1]):
            return ys[i] + (x - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i])
    a, b = ok[0], ok[-1]
    if x <= min(xs[a], xs[b]):
        return ys[a]
    return ys[b] if x >= max(xs[a], xs[b]) else None


def test_interpolate_against_scalar_model(spark):
    random.seed(3)
    rows = []
    for _ in range(600):
        xs = [None if random.random() < 0.2 else float(random.randint(0, 6)) for _ in range(4)]
        ys = [None if random.random() < 0.1 else float(random.randint(-5, 5)) for _ in range(4)]
        rows.append((None if random.random() < 0.05 else random.randint(-2, 16) / 2, *xs, *ys))
    c = [F.col(f"c{i}") for i in range(9)]
    got = one(spark, ", ".join(f"c{i} double" for i in range(9)), rows, v=E.interpolate(E.finite(c[0]), *E.paired(c[1:5], c[5:])), n=E.pair_count(c[1:5], c[5:]))
    for row, r in zip(rows, got, strict=True):
        want = scalar_interp(row[0], row[1:5], row[5:])
        assert (r["v"] is None) == (want is None) and (want is None or math.isclose(r["v"], want, abs_tol=1e-12)), row


def test_row_reducers_skip_nonfinite(spark):
    rows = [(1.0, INF, None), (NAN, None, None)]
    c = [F.col(x) for x in "abc"]
    got = one(spark, "a double, b double, c double", rows, lo=E.row_min(c), hi=E.row_max(c), m=E.row_mean(c))
    assert [tuple(r.values()) for r in got] == [(1.0, 1.0, 1.0), (None, None, None)]


def test_var_pct(spark):
    got = one(spark, "v double, i double, a double", [(5.0, 10.0, 20.0), (-5.0, 10.0, 20.0), (None, 10.0, 20.0)], p=E.var_pct(F.col("v"), F.col("i"), F.col("a")))
    assert [r["p"] for r in got] == [50.0, -25.0, None]

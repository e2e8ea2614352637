"""Distribution columns: known values, and integrals by the trapezoid rule."""
import math
import random

import pytest
from pyspark.sql import functions as F

from ranklab.functions import stats as ST


def value(spark, fn, *args):
    row = spark.createDataFrame([tuple(float(a) for a in args)], [f"c{i}" for i in range(len(args))])
    return row.select(fn(*[F.col(c) for c in row.columns])).first()[0]


def test_t_two_sided(spark):
    assert value(spark, ST.t_pvalue, 2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert value(spark, ST.t_pvalue, 0.0, 5) == pytest.approx(1.0)
    assert value(spark, ST.t_pvalue, 2.0, 0) is None
    assert value(spark, ST.t_pvalue, 1e200, 3) == pytest.approx(0.0)


def test_f_upper_tail(spark):
    # d1 = 2 has the closed form (1 + d1·f/d2)^(-d2/2)
    assert value(spark, ST.f_pvalue, 3.0, 2, 10) == pytest.approx(1.6 ** -5, abs=1e-12)


def test_t_quantile(spark):
    assert value(spark, ST.t_crit, 0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert value(spark, ST.t_crit, 0.0005, 1) == pytest.approx(-636.6192, abs=1e-3)
    assert value(spark, ST.t_crit, 0.5, 7) == pytest.approx(0.0, abs=1e-7)
    assert value(spark, ST.t_crit, 1.0, 7) is None


def test_betainc_by_integration(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.5, 1.0, 2.5, 30.0, 200.0]), rng.choice([0.5, 1.0, 7.5, 100.0]), rng.random()) for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, x double")
    got = {r.i: r.v for r in df.select("i", ST.betainc(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect()}
    for i, (a, b, x) in enumerate(rows):
        top, n = math.asin(math.sqrt(x)), 4000
        f = lambda t: math.sin(t) ** (2 * a - 1) * math.cos(t) ** (2 * b - 1)
        area = sum(f(top * (j + 0.5) / n) for j in range(n)) * top / n
        assert got[i] == pytest.approx(2 * area * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)), abs=1e-6)


def test_all_pairs_without_python_or_self_join(spark):
    rng = random.Random(9)
    ev = spark.createDataFrame([(s, "m", q, rng.random() + k / 4) for k, s in enumerate("abcd") for q in range(30)]
                               + [("e", "m", q, 1.0) for q in range(30)] + [("f", "m", q, 1.0) for q in range(30)],
                               "system string, metric string, qid long, value double")
    for correction in ("holm", "bonferroni"):
        out = ST.all_pairs_ttest(ev, correction)
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Join" not in plan
        rows = sorted((r for r in out.collect()), key=lambda r: (r.p is None, r.p))
        assert len(rows) == 15 and rows[-1].p is None and (rows[-1].sys_a, rows[-1].sys_b) == ("e", "f")
        top = 0.0
        for i, r in enumerate(rows[:-1]):
            want = min(1.0, r.p * (15 - i if correction == "holm" else 15))
            top = max(top, want) if correction == "holm" else want
            assert r.p_adj == pytest.approx(top) and r.reject == (top < 0.05)


def test_ntile_folds(spark):
    from ranklab.operators.cv import assign_folds
    q = spark.range(43).withColumnRenamed("id", "qid")
    sizes = sorted(r["count"] for r in assign_folds(q, 5).groupBy("fold").count().collect())
    assert sizes == [8, 8, 9, 9, 9]

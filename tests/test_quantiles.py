"""Exact quantiles by refinement, box rows and percentile heights."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranklab.operators import quantiles as Q
from ranklab.operators import reports as RP
from ranklab.operators import select as S


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [1, 4096])
def test_quantiles_equal_numpy(spark, few):
    rng = random.Random(few)
    groups = {"wide": [rng.uniform(-1e308, 1e308) for _ in range(60)], "same": [2.5] * 40, "one": [7.0],
              "ties": [rng.choice([0.0, 1.0, 1.0, 5.0]) for _ in range(200)], None: [10.0 ** rng.randint(-200, 200) for _ in range(80)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("same", None), ("gone", None), ("ties", float("nan"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in Q.quantiles(df, "v", probs, ["g"], bins=16, few=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g == "wide":       # numpy's own interpolation overflows here
            for p, x in zip(probs, got[g]):
                s = sorted(vs)
                a = p * (len(s) - 1)
                assert s[int(np.floor(a))] <= x <= s[int(np.ceil(a))]
        else:
            assert got[g] == pytest.approx([float(np.percentile(vs, p * 100)) for p in probs], rel=1e-9)


def test_quantiles_without_groups_and_empty(spark):
    df = spark.range(0, 1001).select(F.col("id").alias("v"))
    assert [r.q for r in Q.quantiles(df, "v", [0.5, 0.999], few=10).collect()] == [[500.0, pytest.approx(999.0)]]
    assert Q.quantiles(df.where("v < 0"), "v", [0.5]).count() == 0


def test_boxes_tails_and_heights(spark):
    rng = random.Random(5)
    vals = [rng.gauss(0, 1) for _ in range(300)] + [9.0, -9.0]
    ev = spark.createDataFrame([("a", "m", i, v) for i, v in enumerate(vals)], "system string, metric string, qid long, value double")
    q1, q2, q3 = (float(np.percentile(vals, p)) for p in (25, 50, 75))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    b = RP.box_stats(ev).first()
    assert (b.q1, b.median, b.q3) == pytest.approx((q1, q2, q3))
    inside = [v for v in vals if lo <= v <= hi]
    assert (b.whisker_lo, b.whisker_hi, b.n_outliers) == (min(inside), max(inside), len(vals) - len(inside))
    out = {(r.value, r.side) for r in RP.box_outliers(ev).collect()}
    assert out == {(v, "low" if v < q1 else "high") for v in vals if not lo <= v <= hi}
    kept = S.remove_tail(ev, "value", 90, ["system", "metric"])
    assert sorted(r.value for r in kept.collect()) == sorted(v for v in vals if v < np.percentile(vals, 90))
    a = RP.percentile_annotations(ev, "value", [50, 95], ("system",), bins=7).first()
    heights, edges = np.histogram(vals, bins=7)
    for q, p, h in ((50, a.p50, a.h50), (95, a.p95, a.h95)):
        assert p == pytest.approx(np.percentile(vals, q))
        assert h == heights[(edges - p > 0).nonzero()[0][0] - 1]
    for df in (kept, RP.box_stats(ev)):
        assert "percentile(" not in _plan(df)

"""Significance tests, effect sizes and intervals.

The sufficient statistics (n, means, variances, sums of squares) are Spark
aggregations over the per-query values; the distribution functions are columns, too:
the regularised incomplete beta function is an ``aggregate`` over the steps of its
continued fraction, quantiles an ``aggregate`` over the steps of a bisection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- distributions as columns -------------------------------------------------
LN_SQRT_2PI = 0.9189385332046727
BISECTIONS = 200


def _lgamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 10, and back by the recurrence."""
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    product = x
    for i in range(1, 10):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + LN_SQRT_2PI + series - F.log(product)


def _fraction_step(s: Column, m: Column) -> Column:
    """Two convergents further: with the odd and even coefficients
    o = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1)) and
    e = (m + 1)(b - m - 1) x / ((a + 2m + 1)(a + 2m + 2)), numerators p and
    denominators q of the last two convergents, rescaled to q = 1."""
    a, b, x = s["a"], s["b"], s["x"]
    odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    even = (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
    p_odd, q_odd = s["p1"] + odd * s["p0"], s["q1"] + odd * s["q0"]
    p, q = p_odd + even * s["p1"], q_odd + even * s["q1"]
    scale = F.when(q == 0, 1.0).otherwise(q)
    value = p / scale
    return F.when(s["done"], s).otherwise(F.struct(
        a.alias("a"), b.alias("b"), x.alias("x"), (p_odd / scale).alias("p0"), value.alias("p1"), (q_odd / scale).alias("q0"), (q / scale).alias("q1"),
        (F.abs(value - s["p1"]) <= F.abs(value) * 1e-15).alias("done")))


def betainc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for a, b > 0. Its fraction needs on the
    order of sqrt(max(a, b)) steps; the job fails if it doesn't settle."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    turned = x >= (a + 1) / (a + b + 2)
    one = F.lit(1.0)
    start = F.struct(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), F.when(turned, 1 - x).otherwise(x).alias("x"),
                     F.lit(0.0).alias("p0"), one.alias("p1"), one.alias("q0"), one.alias("q1"), F.lit(False).alias("done"))
    steps = F.transform(F.sequence(F.lit(0), (100 + 40 * F.sqrt(F.greatest(a, b))).cast("int")), lambda m: m.cast("double"))
    settled = lambda s: F.when(s["done"], s["p1"] / s["a"]).otherwise(F.raise_error(F.lit("incomplete beta function doesn't settle")).cast("double"))
    tail = F.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * F.log(x) + b * F.log1p(-x)) * F.aggregate(steps, start, _fraction_step, settled)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull(), F.when(turned, 1 - tail).otherwise(tail))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; null without a t or degrees of freedom."""
    return F.when(t.isNotNull() & ~F.isnan(t) & (df > 0), betainc(df / 2, F.lit(0.5), df / (df + t * t)))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution; null without an F or degrees of freedom."""
    known = f.isNotNull() & ~F.isnan(f) & (d1 > 0) & (d2 > 0)
    return F.when(known & (f <= 0), 1.0).when(known, betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_crit(prob: Column, df: Column) -> Column:
    """Quantile of Student's t, by bisection of x = df / (df + t²); null without
    degrees of freedom or for a probability outside (0, 1)."""
    mass = 2 * F.least(prob, 1 - prob)               # beyond ±t
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        still = (mid <= s["lo"]) | (mid >= s["hi"])
        return F.when(still, s).when(betainc(df / 2, F.lit(0.5), mid) > mass, F.struct(s["lo"].alias("lo"), mid.alias("hi"))) \
            .otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: s["hi"])
    return F.when((df > 0) & (prob > 0) & (prob < 1), F.signum(prob - 0.5) * F.sqrt(df * (1 - x) / x))


# -- tests ---------------------------------------------------------------------

def _paired(evals: DataFrame, a: str, b: str) -> DataFrame:
    x = evals.where(F.col("system") == a).select("metric", "qid", F.col("value").alias("x"))
    y = evals.where(F.col("system") == b).select("metric", "qid", F.col("value").alias("y"))
    return x.join(y, ["metric", "qid"])


def paired_stats(paired: DataFrame, keys=("metric",)) -> DataFrame:
    """n, means, sample SDs and the SD of the difference, per key."""
    d = F.col("y") - F.col("x")
    return paired.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"),
        F.stddev_samp("x").alias("sd_a"), F.stddev_samp("y").alias("sd_b"),
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))


def t_statistic() -> Column:
    """Paired t of (a − b): mean(a − b) / (sd/√n); null where all differences
    are equal."""
    return F.try_divide(-F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n")))


def cohen_d_col() -> Column:
    """T4: (mean_a − mean_b) / pooled SD (ddof 1)."""
    pooled = F.sqrt(F.try_divide((F.col("n") - 1) * F.col("sd_a") ** 2 + (F.col("n") - 1) * F.col("sd_b") ** 2,
                                 2 * F.col("n") - 2))
    return F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)


def paired_ttest(evals: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """T1 (+T4): per metric, paired two-sided t-test of system a against b
    on their common queries, with Cohen's d."""
    st = paired_stats(_paired(evals, a, b))
    out = st.select("metric", "n", "mean_a", "mean_b", t_statistic().alias("t"), cohen_d_col().alias("cohen_d"))
    if with_p:
        out = out.withColumn("p", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
    return out


def all_pairs_ttest(evals: DataFrame, correction: str = "holm", alpha: float = 0.05) -> DataFrame:
    """Every unordered pair of systems, per metric; Bonferroni or Holm
    adjusted p-values and the reject decision at ``alpha``. Equal systems have
    no t and no p; they count among the tests, and come last."""
    # All systems' values of a query in one array; its pairs go into partial sums.
    one = F.struct(F.col("system").alias("s"), F.col("value").alias("v"))
    rows = evals.groupBy("metric", "qid").agg(F.array_sort(F.collect_list(one)).alias("_v"))
    each = F.transform("_v", lambda x: F.transform(F.filter("_v", lambda y: y["s"] > x["s"]), lambda y: F.struct(
        x["s"].alias("sys_a"), y["s"].alias("sys_b"), x["v"].alias("x"), y["v"].alias("y"))))
    pairs = rows.select("metric", F.explode(F.flatten(each)).alias("p")).select("metric", "p.*")
    st = paired_stats(pairs, ("metric", "sys_a", "sys_b"))
    out = st.select("metric", "sys_a", "sys_b", "n", t_statistic().alias("t"), cohen_d_col().alias("cohen_d"))
    out = out.withColumn("p", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))
    wm = Window.partitionBy("metric")
    m = F.count("*").over(wm)
    if correction == "bonferroni":
        adj = F.least(F.lit(1.0), F.col("p") * m)
    else:
        wo = Window.partitionBy("metric").orderBy(F.col("p").asc_nulls_last(), "sys_a", "sys_b")
        step = F.least(F.lit(1.0), (m - F.row_number().over(wo) + 1) * F.col("p"))
        out = out.withColumn("_step", step)
        adj = F.max("_step").over(wo.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("p_adj", adj).withColumn("reject", F.col("p_adj") < alpha)
    return out.drop("_step") if "_step" in out.columns else out


def one_way_anova(evals: DataFrame) -> DataFrame:
    """Per metric, F statistic and p over all systems."""
    g = evals.groupBy("metric", "system").agg(F.count("*").alias("ni"), F.avg("value").alias("mi"),
                                               F.var_samp("value").alias("vi"))
    tot = evals.groupBy("metric").agg(F.avg("value").alias("m"), F.count("*").alias("N"))
    j = g.join(tot, "metric")
    s = j.groupBy("metric").agg(
        F.sum(F.col("ni") * (F.col("mi") - F.col("m")) ** 2).alias("ssb"),
        F.sum(F.coalesce((F.col("ni") - 1) * F.col("vi"), F.lit(0.0))).alias("ssw"),
        F.count("*").alias("k"), F.first("N").alias("N"))
    fstat = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("k")))
    out = s.select("metric", "k", "N", fstat.alias("F"))
    return out.withColumn("p", f_pvalue(F.col("F"), (F.col("k") - 1).cast("double"),
                                        (F.col("N") - F.col("k")).cast("double")))


def confint_mean(evals: DataFrame, alpha: float = 0.05, keys=("system", "metric"),
                 cols=("value",)) -> DataFrame:
    """T5: t interval of the mean per key, for every value column (e.g.
    RBP value and residual)."""
    aggs = [F.count("*").alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    st = evals.groupBy(*keys).agg(*aggs)
    st = st.withColumn("_t", t_crit(F.lit(1 - alpha / 2), (F.col("n") - 1).cast("double")))
    for c in cols:
        half = F.col("_t") * F.col(f"{c}_sd") / F.sqrt("n")
        st = st.withColumn(f"{c}_lo", F.col(f"{c}_mean") - half).withColumn(f"{c}_hi", F.col(f"{c}_mean") + half)
    return st.drop("_t")


def diff_confint(evals: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """T5: t interval of the paired difference a − b per metric."""
    p = _paired(evals, a, b).withColumn("value", F.col("x") - F.col("y")).withColumn("system", F.lit(f"{a}-{b}"))
    return confint_mean(p, alpha)

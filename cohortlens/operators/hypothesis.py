"""Hypothesis tests on distributed aggregates.

Each test first reduces the data to sufficient statistics with one
``groupBy().agg()`` (n, mean, variance or successes per arm), then applies a
closed form on the single remaining row.  Output columns are rounded to
``dp`` places so results are stable across engines and summation orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.common import round_half_up
from cohortlens.functions.stats import (
    newcombe_diff_ci, norm_cdf, norm_ppf, proportion_effectsize, t_sf,
)


def arm_stats(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row: n, mean and sample variance of ``value`` for arms a and b."""
    x = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    g = x.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                             F.var_samp(value).alias("v"))

    def pick(arm, c):
        return F.max(F.when(F.col(group) == arm, F.col(c)))

    return g.agg(pick(a, "n").alias("n_a"), pick(a, "m").alias("mean_a"), pick(a, "v").alias("var_a"),
                 pick(b, "n").alias("n_b"), pick(b, "m").alias("mean_b"), pick(b, "v").alias("var_b"))


def _p_value(stat: Column, tail_fn, alternative: str) -> Column:
    """tail_fn(x) = P(X > x) for the null distribution."""
    if alternative in ("two-sided", "two_sided"):
        return 2.0 * tail_fn(F.abs(stat))
    if alternative in ("larger", "greater"):
        return tail_fn(stat)
    if alternative in ("smaller", "less"):
        return 1.0 - tail_fn(stat)
    raise ValueError(alternative)


def ttest_from_stats(st: DataFrame, equal_var: bool = True, alternative: str = "two-sided",
                     alpha: float = 0.05, dp: int = 6) -> DataFrame:
    """Two-sample t-test (pooled or Welch) from ``arm_stats`` output."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.col("var_a"), F.col("var_b")
    diff = F.col("mean_a") - F.col("mean_b")
    # try_divide throughout: zero variance or a one-row arm gives null
    # statistics instead of an ANSI division error.
    dv = F.try_divide
    if equal_var:
        dof = na + nb - 2.0
        sp2 = dv((na - 1.0) * va + (nb - 1.0) * vb, dof)
        t = dv(diff, F.sqrt(sp2 * (dv(F.lit(1.0), na) + dv(F.lit(1.0), nb))))
    else:
        sa, sb = dv(va, na), dv(vb, nb)
        t = dv(diff, F.sqrt(sa + sb))
        dof = dv(F.pow(sa + sb, 2), dv(F.pow(sa, 2), na - 1.0) + dv(F.pow(sb, 2), nb - 1.0))
    x = st.select("mean_a", "mean_b", t.alias("t"), dof.alias("df"))
    p = _p_value(F.col("t"), lambda s: t_sf(s, F.col("df")), alternative)
    x = x.withColumn("p_value", p)
    return x.select(round_half_up("mean_a", dp).alias("mean_a"), round_half_up("mean_b", dp).alias("mean_b"),
                    round_half_up("t", dp).alias("t"), round_half_up("df", dp).alias("df"),
                    round_half_up("p_value", dp).alias("p_value"),
                    (F.col("p_value") < alpha).alias("significant"))


def ttest_ind(df: DataFrame, group: str, value: str, a, b, equal_var: bool = True,
              alternative: str = "two-sided", alpha: float = 0.05, dp: int = 6) -> DataFrame:
    """scipy-style ``ttest_ind(x[a], x[b])`` on a long DataFrame."""
    return ttest_from_stats(arm_stats(df, group, value, a, b), equal_var, alternative, alpha, dp)


def proportions_ztest(counts: DataFrame, alternative: str = "larger", alpha: float = 0.05,
                      dp: int = 6) -> DataFrame:
    """Pooled two-proportion z-test; ``counts`` has s1, n1, s2, n2 (arm 1 vs arm 2)."""
    s1, n1 = F.col("s1").cast("double"), F.col("n1").cast("double")
    s2, n2 = F.col("s2").cast("double"), F.col("n2").cast("double")
    dv = F.try_divide
    p1, p2 = dv(s1, n1), dv(s2, n2)
    pool = dv(s1 + s2, n1 + n2)
    z = dv(p1 - p2, F.sqrt(pool * (1.0 - pool) * (dv(F.lit(1.0), n1) + dv(F.lit(1.0), n2))))
    x = counts.select(p1.alias("p1"), p2.alias("p2"), z.alias("z"))
    # Upper tail as Phi(-z): Hart's formula evaluates the tail directly, so
    # small p-values keep their precision (no 1 - Phi cancellation).
    x = x.withColumn("p_value", _p_value(F.col("z"), lambda v: norm_cdf(-v), alternative))
    return x.select(round_half_up("p1", dp).alias("p1"), round_half_up("p2", dp).alias("p2"),
                    round_half_up("z", dp).alias("z"), round_half_up("p_value", dp).alias("p_value"),
                    (F.col("p_value") < alpha).alias("significant"))


def lift_confint(counts: DataFrame, alpha: float = 0.05, dp: int = 6) -> DataFrame:
    """Newcombe hybrid-score interval for p1 - p2 (s1, n1, s2, n2 columns)."""
    d, lo, hi = newcombe_diff_ci("s1", "n1", "s2", "n2", alpha)
    return counts.select(round_half_up(d, dp).alias("diff"), round_half_up(lo, dp).alias("ci_low"),
                         round_half_up(hi, dp).alias("ci_high"))


def required_sample_size(baselines: DataFrame, mde: float = 0.03, relative: bool = True,
                         alpha: float = 0.05, power: float = 0.8, rounding: str = "floor",
                         dp: int = 6) -> DataFrame:
    """Users per group to detect ``baseline -> baseline + mde`` (two-sided).

    ``baselines`` has columns segment, baseline.  n = 2 ((z_{1-a/2} + z_power) / h)^2
    with Cohen's h; ``rounding`` reproduces ``int()`` (floor), ``round`` or ``ceil``.
    """
    zsum = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    p = F.col("baseline").cast("double")
    target = p * (1.0 + mde) if relative else p + F.lit(mde)
    h = proportion_effectsize(p, target)
    n = 2.0 * F.pow(F.try_divide(F.lit(zsum), h), 2)
    rn = {"floor": F.floor(n), "ceil": F.ceil(n), "round": F.round(n, 0)}[rounding]
    return baselines.select("segment", round_half_up(p, dp).alias("baseline"),
                            round_half_up(h, dp).alias("effect_size"),
                            rn.cast("long").alias("n_per_group"))

"""Scalar scores and labels as Catalyst expressions.

All are pure column expressions: they fuse into one whole-stage-codegen projection with
whatever operator uses them. NULL handling follows the documented decisions: pandas NaN
propagation becomes NULL propagation; JS "falsy" inputs become NULL results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.functions.rounding import round_js


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(c: Column, lo: float, hi: float) -> Column:
    """pandas ``clip``: NULL stays NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


def recovery_score(sleep="sleep_hours", hrv="hrv_ms", soreness="soreness_score",
                   rest="rest_days") -> Column:
    """Weighted 0-1 recovery score."""
    s, h, so, r = _c(sleep), _c(hrv), _c(soreness), _c(rest)
    return (F.lit(0.3) * (clip(s, 4.0, 10.0) - 4.0) / 6.0
            + F.lit(0.3) * (clip(h, 20.0, 100.0) - 20.0) / 80.0
            + F.lit(0.25) * (F.lit(1.0) - clip(so, 0.0, 10.0) / 10.0)
            + F.lit(0.15) * clip(r.cast("double"), 0.0, 3.0) / 3.0)


def risk_label(p="injury_probability") -> Column:
    """Right-closed bins (-0.01,.30], (.30,.60], (.60,1.01]; outside / NULL -> NULL."""
    p = _c(p)
    return (F.when((p > -0.01) & (p <= 0.30), "LOW")
            .when((p > 0.30) & (p <= 0.60), "MEDIUM")
            .when((p > 0.60) & (p <= 1.01), "HIGH"))


def fallback_score(intensity="weekly_intensity_score", soreness="soreness_score",
                   priors="prior_injuries") -> Column:
    """min(1, intensity/10*.4 + soreness/10*.3 + (priors>0 ? .2 : .05))."""
    return F.least(F.lit(1.0),
                   _c(intensity) / 10.0 * 0.4 + _c(soreness) / 10.0 * 0.3
                   + F.when(_c(priors) > 0, F.lit(0.2)).otherwise(F.lit(0.05)))


def fallback_label(score: Column) -> Column:
    """E7 label on the JS-rounded percent: >=60 HIGH, >=30 MEDIUM, else LOW."""
    pct = round_js(score * 100.0)
    return F.when(pct >= 60, "HIGH").when(pct >= 30, "MEDIUM").otherwise("LOW")


def _hrv_part(hrv: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (hrv - 20.0) / 80.0 * 100.0))


def _rhr_part(rhr: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.lit(100.0) - rhr) / 60.0 * 100.0))


def _sleep_part(s: Column) -> Column:
    return (F.when(s >= 9, F.lit(100.0))
            .when(s >= 7, F.lit(75.0) + (s - 7.0) / 2.0 * 25.0)
            .when(s >= 5, (s - 5.0) / 2.0 * 75.0)
            .otherwise(F.lit(0.0)))


def _falsy(c: Column) -> Column:
    return c.isNull() | (c == 0)


def readiness3(hrv="hrv", rhr="rhr", sleep="sleep_hours") -> Column:
    """.4 HRV + .3 RHR + .3 sleep, JS-rounded; any falsy input -> NULL."""
    h, r, s = _c(hrv).cast("double"), _c(rhr).cast("double"), _c(sleep).cast("double")
    score = _hrv_part(h) * 0.4 + _rhr_part(r) * 0.3 + _sleep_part(s) * 0.3
    return F.when(_falsy(h) | _falsy(r) | _falsy(s), F.lit(None).cast("bigint")).otherwise(
        round_js(score).cast("bigint"))


def readiness4(hrv="hrv", rhr="rhr", sleep="sleep_hours", soreness="soreness_score") -> Column:
    """.35 HRV + .25 RHR + .25 sleep + .15 (100 - 10*soreness), JS-rounded."""
    h, r, s = _c(hrv).cast("double"), _c(rhr).cast("double"), _c(sleep).cast("double")
    so = _c(soreness).cast("double")
    score = (_hrv_part(h) * 0.35 + _rhr_part(r) * 0.25 + _sleep_part(s) * 0.25
             + F.greatest(F.lit(0.0), F.lit(100.0) - so * 10.0) * 0.15)
    return round_js(score).cast("bigint")


def rule_risk(readiness="readiness", acwr="ratio") -> Column:
    """Rule risk from readiness and ACWR."""
    r, a = _c(readiness), _c(acwr)
    null_branch = F.when(a > 1.5, "High").when(a > 1.3, "Medium").otherwise("Low")
    main = (F.when((r < 45) | (a > 1.6), "High")
            .when((r < 65) | (a > 1.3) | (a < 0.7), "Medium")
            .otherwise("Low"))
    return F.when(r.isNull(), null_branch).otherwise(main)


def acwr_zone(ratio_pct: Column) -> Column:
    """E12 label from the ratio in hundredths (exact integer comparisons)."""
    (u, _), (o, _), (c, _), (d, _) = fixed.ACWR_ZONES
    return (F.when(ratio_pct < 80, u).when(ratio_pct <= 130, o)
            .when(ratio_pct <= 150, c).otherwise(d))


def acwr_zone_hint(ratio_pct: Column) -> Column:
    (_, u), (_, o), (_, c), (_, d) = fixed.ACWR_ZONES
    return (F.when(ratio_pct < 80, u).when(ratio_pct <= 130, o)
            .when(ratio_pct <= 150, c).otherwise(d))


def readiness_label(score="readiness") -> Column:
    """E13."""
    s = _c(score)
    expr = F.when(s.isNull(), fixed.READINESS_NONE)
    for lo, label in fixed.READINESS_LABELS:
        expr = expr.when(s >= lo, label)
    return expr.otherwise(fixed.READINESS_LOW)


def recovery_tips(readiness="readiness", acwr="ratio", risk="risk") -> Column:
    """Ordered list of tip titles (conditional ones first, three constants last)."""
    r, a, k = _c(readiness), _c(acwr), _c(risk)
    t = fixed
    return F.array_compact(F.array(
        F.when(r.isNull() | (r == 0) | (r < 65), F.lit(t.TIP_SLEEP[0])),
        F.when(a > 1.3, F.lit(t.TIP_REDUCE[0])),
        F.when((a < 0.8) & (a > 0), F.lit(t.TIP_INCREASE[0])),
        F.when(k == "High", F.lit(t.TIP_ICE[0])),
        F.when(k == "High", F.lit(t.TIP_REST[0])),
        F.lit(t.TIP_HYDRATION[0]), F.lit(t.TIP_MOBILITY[0]), F.lit(t.TIP_NUTRITION[0]),
    ))


def prior_from_rule(model_p: Column, rule: Column) -> Column:
    """Model probability if present, else .72/.45/.18 from the rule label."""
    (h, ph), (m, pm), (_, pl) = fixed.PRIOR_FROM_RULE
    return F.coalesce(model_p, F.when(rule == h, F.lit(ph)).when(rule == m, F.lit(pm))
                      .otherwise(F.lit(pl)))


def injury_history_flags(priors="prior_injuries", days="days_since_last_injury") -> list[Column]:
    """priors>=3, days<30 (NULL compare -> 0), log1p(days)."""
    p, d = _c(priors), _c(days)
    return [F.coalesce(p >= 3, F.lit(False)).cast("int").alias("high_injury_history"),
            F.coalesce(d < 30, F.lit(False)).cast("int").alias("recent_injury"),
            F.log1p(d).alias("log_days_since_injury")]

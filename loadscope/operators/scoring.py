"""Rule-based scoring.

The multiplier dictionaries are fixed-size (11 sports, 31 positions), so the lookups are
compiled into CASE expressions: no join, no shuffle, fused into the projection. The
position fallback keeps the studied system's first-match order (D9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions import fixed, scores


def exact_lookup(c: Column, pairs, default: float = 1.0) -> Column:
    """Exact match, default when absent."""
    expr = None
    for k, v in pairs:
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return F.coalesce(expr, F.lit(default)) if expr is not None else F.lit(default)


def substring_lookup(c: Column, pairs) -> Column:
    """First entry (in order) whose key contains the value or is contained in it,
    case-insensitive. NULL when nothing matches."""
    low = F.lower(c)
    expr = None
    for k, v in pairs:
        kl = F.lit(k.lower())
        cond = F.contains(low, kl) | F.contains(kl, low)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def position_multiplier(position: Column, pairs=None) -> Column:
    pairs = fixed.POSITION_MULTIPLIERS if pairs is None else pairs
    p = F.trim(position)
    exact = exact_lookup(p, pairs)
    fallback = F.coalesce(substring_lookup(p, pairs), exact)
    return F.when((exact == 1.0) & p.isNotNull() & (p != ""), fallback).otherwise(exact)


def sport_multiplier(sport: Column, pairs=None) -> Column:
    return exact_lookup(F.trim(sport), fixed.SPORT_MULTIPLIERS if pairs is None else pairs)


def attach_multipliers(df: DataFrame, sport_col: str = "sport", position_col: str = "position",
                       sport_pairs=None, position_pairs=None) -> DataFrame:
    """J1 + J2 -> ``sport_mult``, ``position_mult``."""
    return df.withColumn("sport_mult", sport_multiplier(F.col(sport_col), sport_pairs)) \
             .withColumn("position_mult", position_multiplier(F.col(position_col), position_pairs))


def _col_or(df: DataFrame, name: str) -> Column:
    """Formula defaults apply only to absent columns (D10); NULL stays NULL."""
    if name in df.columns:
        return F.col(name)
    return F.lit(fixed.FORMULA_DEFAULTS[name])


def score_formula(df: DataFrame, out: str = "injury_probability") -> DataFrame:
    """E5 calibrated probability (4 dp, half-even) + E6 label."""
    vol = _col_or(df, "weekly_volume_hrs").cast("double")
    inten = _col_or(df, "weekly_intensity_score").cast("double")
    sleep = _col_or(df, "sleep_hours").cast("double")
    hrv = _col_or(df, "hrv_ms").cast("double")
    sore = _col_or(df, "soreness_score").cast("double")
    rest = _col_or(df, "rest_days").cast("int").cast("double")
    priors = _col_or(df, "prior_injuries").cast("int").cast("double")
    days = _col_or(df, "days_since_last_injury").cast("double")
    sport = _col_or(df, "sport").cast("string")
    pos = _col_or(df, "position").cast("string")

    workload = (F.least(F.lit(2.0), vol / 14.0) * 0.35 + inten / 10.0 * 0.50
                + F.greatest(F.lit(0.0), (F.lit(2.0) - rest) / 2.0) * 0.15)
    deficit = F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                      F.greatest(F.lit(0.0), (F.lit(8.0) - sleep) / 8.0) * 0.35
                      + F.greatest(F.lit(0.0), (F.lit(70.0) - hrv) / 70.0) * 0.35
                      + sore / 10.0 * 0.30))
    history = F.least(F.lit(1.0), (priors * 0.15) * (F.lit(0.4) + F.exp(-days / 90.0) * 0.6))
    # Precomputed multipliers (``attach_multipliers``) are reused when present.
    sm = F.col("sport_mult") if "sport_mult" in df.columns else sport_multiplier(sport)
    pm = F.col("position_mult") if "position_mult" in df.columns else position_multiplier(pos)
    bio = sm * pm - 1.0
    z = workload * 2.2 + deficit * 2.0 + history * 1.5 + bio * 2.0 - 2.2
    # NULL inputs propagate (least/greatest would skip them): guard explicitly.
    inputs_ok = (vol.isNotNull() & inten.isNotNull() & sleep.isNotNull() & hrv.isNotNull() & sore.isNotNull()
                 & rest.isNotNull() & priors.isNotNull() & days.isNotNull())
    p = F.when(inputs_ok, F.bround(F.lit(1.0) / (F.exp(-z) + 1.0), 4))
    return df.withColumn(out, p).withColumn("injury_risk_label", scores.risk_label(F.col(out)))


def fallback_risk(df: DataFrame) -> DataFrame:
    """Dashboard fallback score, percent and label."""
    s = scores.fallback_score()
    return df.withColumn("fallback_score", s) \
             .withColumn("fallback_pct", F.floor(F.col("fallback_score") * 100.0 + 0.5).cast("bigint")) \
             .withColumn("fallback_label", scores.fallback_label(F.col("fallback_score")))


def _f1(c: Column) -> Column:
    return F.format_string("%.1f", c)


def top_factors(df: DataFrame, n: int = 3, out: str = "top_contributing_factors") -> DataFrame:
    """The first ``n`` rule hits in rule order; a default pair when none fires."""
    pos, sport = F.trim(F.col("position")), F.trim(F.col("sport"))
    low = F.lower(pos)
    hit = F.lit(False)
    for w in fixed.HIGH_IMPACT_POSITION_WORDS:
        hit = hit | F.contains(low, F.lit(w.lower()))
    inten, vol = F.col("weekly_intensity_score"), F.col("weekly_volume_hrs")
    sleep, sore = F.col("sleep_hours"), F.col("soreness_score")
    rest, priors, days = F.col("rest_days"), F.col("prior_injuries"), F.col("days_since_last_injury")
    rules = F.array(
        F.when(hit, F.format_string("High-Impact Sport Position (%s in %s)", pos, sport)),
        F.when(inten >= 7.5, F.format_string("High Weekly Intensity (%s/10)", _f1(inten)))
         .when(inten >= 5.0, F.format_string("Moderate Training Exertion (%s/10)", _f1(inten))),
        F.when(vol >= 14.0, F.format_string("Elevated Weekly Volume (%s hrs)", _f1(vol))),
        F.when(sleep < 7.0, F.format_string("Sleep Deficit (%s hrs/night)", _f1(sleep))),
        F.when(sore >= 5.0, F.format_string("High Muscle Soreness (%s/10)", _f1(sore))),
        F.when(rest <= 1, F.format_string("Insufficient Rest (%s rest days)", rest.cast("string"))),
        F.when((priors > 0) & (days < 90), F.format_string("Recent Injury History (%s prior, %sd ago)",
                                                            priors.cast("string"), days.cast("bigint").cast("string"))),
    )
    hits = F.array_compact(rules)
    default = F.array(*[F.lit(x) for x in fixed.DEFAULT_FACTORS])
    return df.withColumn(out, F.slice(F.when(F.size(hits) == 0, default).otherwise(hits), 1, n))


def check_position(df: DataFrame, sport_col: str = "sport", position_col: str = "position") -> DataFrame:
    """Resolve sport (unknown -> Football) and position (not in the sport's list ->
    its first position); ``position_valid`` tells whether the given one was legal."""
    m = F.create_map(*[x for s, ps in fixed.SPORT_POSITIONS for x in (F.lit(s), F.array(*[F.lit(p) for p in ps]))])
    sport = F.col(sport_col)
    known = F.coalesce(F.map_contains_key(m, sport), F.lit(False))
    res_sport = F.when(known, sport).otherwise(F.lit("Football"))
    lst = F.element_at(m, res_sport)
    valid = F.coalesce(F.array_contains(lst, F.col(position_col)), F.lit(False))
    return df.withColumn("sport_resolved", res_sport) \
             .withColumn("position_valid", valid) \
             .withColumn("position_resolved", F.when(valid, F.col(position_col)).otherwise(F.element_at(lst, 1)))


_SCENARIO_COLS = ["weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms", "soreness_score",
                  "rest_days", "prior_injuries", "days_since_last_injury"]


def what_if(df: DataFrame, scenarios=None) -> DataFrame:
    """Every record re-scored under each preset (a 3-element array exploded per row —
    no join); ``scenario`` = 'baseline' keeps the record as is."""
    scenarios = fixed.SCENARIOS if scenarios is None else scenarios
    structs = [F.struct(F.lit("baseline").alias("scenario"),
                        *[F.lit(None).cast("double").alias(c) for c in _SCENARIO_COLS])]
    for name, *vals in scenarios:
        structs.append(F.struct(F.lit(name).alias("scenario"),
                                *[F.lit(float(v)).alias(c) for c, v in zip(_SCENARIO_COLS, vals)]))
    # Lookups do not depend on the scenario: resolve them once per record, then explode.
    base = attach_multipliers(df) if "sport_mult" not in df.columns else df
    x = base.withColumn("_sc", F.explode(F.array(*structs)))
    sel = [F.col(c) for c in base.columns if c not in _SCENARIO_COLS]
    sel.append(F.col("_sc.scenario").alias("scenario"))
    for c in _SCENARIO_COLS:
        base = F.col(c)
        sel.append(F.coalesce(F.col(f"_sc.{c}").cast(df.schema[c].dataType), base).alias(c))
    return score_formula(x.select(*sel))


def fill_prediction(df: DataFrame, model_p: str = "injury_probability", rule: str = "risk") -> DataFrame:
    """E19."""
    mp = F.col(model_p) if model_p in df.columns else F.lit(None).cast("double")
    return df.withColumn("prior_probability", scores.prior_from_rule(mp, F.col(rule))) \
             .withColumn("prior_label", F.upper(F.coalesce(F.col(rule), F.lit("Low"))))

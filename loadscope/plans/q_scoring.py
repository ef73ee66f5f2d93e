"""Registered scoring and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadscope.functions import fixed, scores
from loadscope.operators import privacy, scoring, workload
from loadscope.plans.q_workload import _SPINE, _acwr
from loadscope.plans.registry import register
from loadscope.sources import views

HMAC_KEY = "demo-pseudonym-key"
AES_KEY = "demo-encryption-key"


def _sql_exact(col: str, pairs) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in pairs)
    return f"coalesce(CASE {arms} END, 1.0)"


def _sql_sub(col: str, pairs) -> str:
    arms = " ".join(f"WHEN contains(lower({col}), '{k.lower()}') OR contains('{k.lower()}', lower({col})) THEN {v}"
                    for k, v in pairs)
    return f"(CASE {arms} END)"


_SPORT_M = _sql_exact("trim(sport)", fixed.SPORT_MULTIPLIERS)
_POS_EXACT = _sql_exact("trim(position)", fixed.POSITION_MULTIPLIERS)
_POS_M = (f"(CASE WHEN {_POS_EXACT} = 1.0 AND trim(position) IS NOT NULL AND trim(position) <> '' "
          f"THEN coalesce({_sql_sub('trim(position)', fixed.POSITION_MULTIPLIERS)}, {_POS_EXACT}) ELSE {_POS_EXACT} END)")


@register("j1_j2_multipliers", f"""
SELECT record_id, {_SPORT_M} AS sport_mult, {_POS_M} AS position_mult FROM v_record""", views=("v_record",))
def j1_j2_multipliers(spark, sf):
    return scoring.attach_multipliers(views.records(spark, sf)).select("record_id", "sport_mult", "position_mult")


def _e5_sql(src: str = "v_record", vol="weekly_volume_hrs", inten="weekly_intensity_score", sleep="sleep_hours",
            hrv="hrv_ms", sore="soreness_score", rest="rest_days", priors="prior_injuries",
            days="days_since_last_injury") -> str:
    rest_d = f"CAST(CAST({rest} AS INTEGER) AS DOUBLE)"
    pri_d = f"CAST(CAST({priors} AS INTEGER) AS DOUBLE)"
    workload_ = (f"(least(2.0, {vol} / 14.0) * 0.35 + {inten} / 10.0 * 0.50 "
                 f"+ greatest(0.0, (2.0 - {rest_d}) / 2.0) * 0.15)")
    deficit = (f"least(1.0, greatest(0.0, greatest(0.0, (8.0 - {sleep}) / 8.0) * 0.35 "
               f"+ greatest(0.0, (70.0 - {hrv}) / 70.0) * 0.35 + {sore} / 10.0 * 0.30))")
    history = f"least(1.0, ({pri_d} * 0.15) * (0.4 + exp(-{days} / 90.0) * 0.6))"
    bio = f"({_SPORT_M} * {_POS_M} - 1.0)"
    z = f"({workload_} * 2.2 + {deficit} * 2.0 + {history} * 1.5 + {bio} * 2.0 - 2.2)"
    ok = " AND ".join(f"{c} IS NOT NULL" for c in (vol, inten, sleep, hrv, sore, rest, priors, days))
    return f"(CASE WHEN {ok} THEN round_even(1.0 / (exp(-{z}) + 1.0), 4) END)"


def _label_sql(p: str) -> str:
    return (f"(CASE WHEN {p} > -0.01 AND {p} <= 0.30 THEN 'LOW' WHEN {p} > 0.30 AND {p} <= 0.60 THEN 'MEDIUM' "
            f"WHEN {p} > 0.60 AND {p} <= 1.01 THEN 'HIGH' END)")


@register("e5_e6_score_formula", f"""
SELECT record_id, p AS injury_probability, {_label_sql('p')} AS injury_risk_label
FROM (SELECT record_id, {_e5_sql()} AS p FROM v_record)""", views=("v_record",))
def e5_e6_score_formula(spark, sf):
    return scoring.score_formula(views.records(spark, sf)).select("record_id", "injury_probability",
                                                                  "injury_risk_label")


@register("e5_e6_label_summary", f"""
SELECT {_label_sql('p')} AS injury_risk_label, count(*) AS n_records,
       CAST(sum(round(p * 10000)) AS BIGINT) AS sum_p_e4
FROM (SELECT {_e5_sql('v_dirty')} AS p FROM v_dirty) GROUP BY 1""", views=("v_dirty",))
def e5_e6_label_summary(spark, sf):
    s = scoring.score_formula(views.dirty(spark, sf))
    return s.groupBy("injury_risk_label").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.round(F.col("injury_probability") * 10000)).cast("bigint").alias("sum_p_e4"))


@register("e7_fallback_risk", """
SELECT record_id, round(s, 6) AS fallback_score, CAST(floor(s * 100.0 + 0.5) AS BIGINT) AS fallback_pct,
       CASE WHEN floor(s * 100.0 + 0.5) >= 60 THEN 'HIGH' WHEN floor(s * 100.0 + 0.5) >= 30 THEN 'MEDIUM' ELSE 'LOW' END
         AS fallback_label
FROM (SELECT record_id, least(1.0, weekly_intensity_score / 10.0 * 0.4 + soreness_score / 10.0 * 0.3
        + CASE WHEN prior_injuries > 0 THEN 0.2 ELSE 0.05 END) AS s FROM v_record)""", views=("v_record",))
def e7_fallback_risk(spark, sf):
    f = scoring.fallback_risk(views.records(spark, sf))
    return f.select("record_id", F.round("fallback_score", 6).alias("fallback_score"), "fallback_pct",
                    "fallback_label")


_HIT = " OR ".join(f"contains(lower(trim(position)), '{w.lower()}')" for w in fixed.HIGH_IMPACT_POSITION_WORDS)
_RULES = f"""[
  CASE WHEN {_HIT} THEN printf('High-Impact Sport Position (%s in %s)', trim(position), trim(sport)) END,
  CASE WHEN weekly_intensity_score >= 7.5 THEN printf('High Weekly Intensity (%.1f/10)', weekly_intensity_score)
       WHEN weekly_intensity_score >= 5.0 THEN printf('Moderate Training Exertion (%.1f/10)', weekly_intensity_score) END,
  CASE WHEN weekly_volume_hrs >= 14.0 THEN printf('Elevated Weekly Volume (%.1f hrs)', weekly_volume_hrs) END,
  CASE WHEN sleep_hours < 7.0 THEN printf('Sleep Deficit (%.1f hrs/night)', sleep_hours) END,
  CASE WHEN soreness_score >= 5.0 THEN printf('High Muscle Soreness (%.1f/10)', soreness_score) END,
  CASE WHEN rest_days <= 1 THEN 'Insufficient Rest (' || CAST(rest_days AS VARCHAR) || ' rest days)' END,
  CASE WHEN prior_injuries > 0 AND days_since_last_injury < 90 THEN 'Recent Injury History ('
       || CAST(prior_injuries AS VARCHAR) || ' prior, ' || CAST(CAST(trunc(days_since_last_injury) AS BIGINT) AS VARCHAR)
       || 'd ago)' END]"""


@register("e8_t3_top_factors", f"""
SELECT record_id, array_to_string(CASE WHEN len(h) = 0 THEN ['{fixed.DEFAULT_FACTORS[0]}', '{fixed.DEFAULT_FACTORS[1]}']
                                       ELSE list_slice(h, 1, 3) END, '|') AS top_contributing_factors
FROM (SELECT record_id, list_filter({_RULES}, lambda x: x IS NOT NULL) AS h FROM v_record)""", views=("v_record",))
def e8_t3_top_factors(spark, sf):
    t = scoring.top_factors(views.records(spark, sf))
    return t.select("record_id", F.array_join("top_contributing_factors", "|").alias("top_contributing_factors"))


_SP_LIST = " ".join(f"WHEN '{s}' THEN [{', '.join(repr(p) for p in ps)}]" for s, ps in fixed.SPORT_POSITIONS)
_SP_NAMES = ", ".join(f"'{s}'" for s, _ in fixed.SPORT_POSITIONS)


@register("e17_check_position", f"""
WITH d AS (SELECT DISTINCT sport, position FROM v_record),
r AS (SELECT sport, position, CASE WHEN sport IN ({_SP_NAMES}) THEN sport ELSE 'Football' END AS sport_resolved FROM d),
l AS (SELECT *, CASE sport_resolved {_SP_LIST} END AS lst FROM r)
SELECT sport, position, sport_resolved, coalesce(list_contains(lst, position), false) AS position_valid,
       CASE WHEN coalesce(list_contains(lst, position), false) THEN position ELSE lst[1] END AS position_resolved
FROM l""", views=("v_record",))
def e17_check_position(spark, sf):
    d = views.records(spark, sf).select("sport", "position").distinct()
    return scoring.check_position(d)


_WHATIF = " UNION ALL ".join(
    [f"SELECT record_id, 'baseline' AS scenario, {_e5_sql()} AS p FROM v_record"] +
    [f"SELECT record_id, '{name}' AS scenario, "
     + _e5_sql(vol=str(v), inten=str(i), sleep=str(s), hrv=str(h), sore=str(so), rest=str(r), priors=str(pr),
               days=str(dd)) + " AS p FROM v_record"
     for name, v, i, s, h, so, r, pr, dd in fixed.SCENARIOS])


@register("e18_what_if", f"""
SELECT record_id, scenario, p AS injury_probability, {_label_sql('p')} AS injury_risk_label FROM ({_WHATIF})""",
          views=("v_record",))
def e18_what_if(spark, sf):
    w = scoring.what_if(views.records(spark, sf))
    return w.select("record_id", "scenario", "injury_probability", "injury_risk_label")


@register("e11_e19_prior_prediction", "WITH" + _SPINE.rstrip() + """
SELECT athlete_id, d, CASE WHEN ratio_pct > 150 THEN 'High' WHEN ratio_pct > 130 THEN 'Medium' ELSE 'Low' END AS risk,
       CASE WHEN ratio_pct > 150 THEN 0.72 WHEN ratio_pct > 130 THEN 0.45 ELSE 0.18 END AS prior_probability,
       CASE WHEN ratio_pct > 150 THEN 'HIGH' WHEN ratio_pct > 130 THEN 'MEDIUM' ELSE 'LOW' END AS prior_label
FROM r""", views=("v_daily",))
def e11_e19_prior_prediction(spark, sf):
    a = _acwr(spark, sf).withColumn("risk", scores.rule_risk(F.lit(None).cast("bigint"), F.col("ratio")))
    return scoring.fill_prediction(a).select("athlete_id", "d", "risk", "prior_probability", "prior_label")


def _pads_hex():
    ipad, opad = privacy._pads(HMAC_KEY.encode())
    return ipad.hex(), opad.hex()


_IP, _OP = _pads_hex()


@register("p1_pseudonymize", f"""
SELECT athlete_id, 'PSN-' || upper(substr(sha256(unhex('{_OP}') || unhex(sha256(unhex('{_IP}') || encode(athlete_id)))),
                                    1, 12)) AS athlete_pseudonym
FROM (SELECT DISTINCT athlete_id FROM v_record)""", views=("v_record",))
def p1_pseudonymize(spark, sf):
    ids = views.records(spark, sf).select("athlete_id").distinct()
    return privacy.pseudonymize(ids, "athlete_id", HMAC_KEY)


def _p2_sql() -> str:
    pairs = ", ".join(f"'{c}', {c}" for c in privacy.AUDIT_FIELDS)
    return f"""
SELECT record_id, true AS roundtrip_ok, CAST(octet_length(encode(CAST(json_object({pairs}) AS VARCHAR))) AS BIGINT) AS plaintext_bytes
FROM v_dirty"""


@register("p2_p3_encrypt_roundtrip", _p2_sql(), views=("v_dirty",))
def p2_p3_encrypt_roundtrip(spark, sf):
    """All 13 audit fields of rows that also hold NULLs; every field comes back as it went in."""
    cols = privacy.AUDIT_FIELDS
    r = views.dirty(spark, sf).select("record_id", *cols)
    e = privacy.encrypt_struct(r, cols, AES_KEY)
    d = privacy.decrypt_struct(e, "encrypted_biometrics", T.StructType([r.schema[c] for c in cols]), AES_KEY)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(f"decrypted.{c}").eqNullSafe(F.col(c))
    return d.select("record_id", ok.alias("roundtrip_ok"),
                    (F.length(F.unbase64("encrypted_biometrics")) - 28).cast("bigint").alias("plaintext_bytes"))


_POLICY = [("Athlete", "ATH-7", None), ("Coach", None, "Football"), ("Medical Staff", None, None)]


@register("x3_row_policy", " UNION ALL ".join(
    f"SELECT '{role}' AS role, record_id, athlete_id, sport FROM v_record" + (
        f" WHERE athlete_id = '{a}'" if role == "Athlete" else f" WHERE sport = '{s}'" if role == "Coach" else "")
    for role, a, s in _POLICY), views=("v_record",))
def x3_row_policy(spark, sf):
    """The rows that one athlete, one coach and one member of the medical staff may see."""
    r = views.records(spark, sf).select("record_id", "athlete_id", "sport")
    out = None
    for role, athlete, sport in _POLICY:
        seen = privacy.row_policy(r, role, athlete, sport).withColumn("role", F.lit(role))
        out = seen if out is None else out.unionByName(seen)
    return out


@register("x3_visible_counts", """
WITH pa AS (SELECT athlete_id, count(*) AS n FROM v_record GROUP BY 1),
ps AS (SELECT sport, count(*) AS n FROM v_record GROUP BY 1)
SELECT username, role, CAST(CASE WHEN role = 'Athlete' THEN coalesce(pa.n, 0) WHEN role = 'Coach' THEN coalesce(ps.n, 0)
       ELSE (SELECT count(*) FROM v_record) END AS BIGINT) AS visible_records
FROM v_users u LEFT JOIN pa ON u.athlete_id = pa.athlete_id LEFT JOIN ps ON u.sport = ps.sport""",
          views=("v_record", "v_users"))
def x3_visible_counts(spark, sf):
    return privacy.visible_counts(views.records(spark, sf), views.users(spark, sf))

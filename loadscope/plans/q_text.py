"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.operators import scoring, text
from loadscope.plans.q_scoring import _RULES, _e5_sql, _label_sql
from loadscope.plans.registry import register
from loadscope.sources import views


def _scored_records(spark, sf):
    return scoring.top_factors(scoring.score_formula(views.records(spark, sf)))


_LAB = f"""lab AS (SELECT *, {_label_sql('p')} AS injury_risk_label FROM (SELECT *, {_e5_sql()} AS p FROM v_record))"""


def _by(label: str, pairs, default) -> str:
    arms = " ".join(f"WHEN {label} = '{k}' THEN {v!r}" for k, v in pairs)
    return f"(CASE {arms} ELSE {default!r} END)"


_TGT = f"""t AS (SELECT *, greatest(0.0, 8.5 - sleep_hours) AS sleep_deficit,
   least(9.5, sleep_hours + greatest(0.0, 8.5 - sleep_hours)) AS sleep_target,
   {_by('injury_risk_label', fixed.RPE_CAP, fixed.RPE_CAP_DEFAULT)} AS rpe_cap,
   {_by('injury_risk_label', fixed.THERAPY_MIN, fixed.THERAPY_MIN_DEFAULT)} AS therapy_min,
   {_by('injury_risk_label', fixed.WATER_ML, fixed.WATER_ML_DEFAULT)} AS water_ml,
   CAST(round_even(weight_kg * 0.35, 0) AS BIGINT) AS protein_g FROM lab)"""


@register("g1_prescription_targets", f"""WITH {_LAB}, {_TGT}
SELECT record_id, round(sleep_target, 6) AS sleep_target, CAST(rpe_cap AS DOUBLE) AS rpe_cap,
       CAST(therapy_min AS INTEGER) AS therapy_min, CAST(water_ml AS INTEGER) AS water_ml, protein_g FROM t""",
          views=("v_record",))
def g1_prescription_targets(spark, sf):
    t = text.prescription_targets(scoring.score_formula(views.records(spark, sf)))
    return t.select("record_id", F.round("sleep_target", 6).alias("sleep_target"), "rpe_cap", "therapy_min",
                    "water_ml", "protein_g")


def _v(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


_PRESC = (f"printf('{fixed.PRESCRIPTION_TEMPLATE}', printf('%.1f', sleep_deficit), printf('%.1f', sleep_target), "
          f"{_v('hrv_ms')}, printf('%.1f', sleep_target), {_v('CAST(rpe_cap AS DOUBLE)')}, {_v('CAST(rpe_cap AS DOUBLE)')}, "
          f"{_v('weekly_volume_hrs')}, CASE WHEN weekly_volume_hrs > 15 THEN '{fixed.VOLUME_WORDS[0]}' "
          f"ELSE '{fixed.VOLUME_WORDS[1]}' END, {_v('soreness_score')}, {_v('therapy_min')}, {_v('therapy_min')}, "
          f"{_v('protein_g')}, {_v('water_ml')}, {_v('protein_g')}, {_v('water_ml')}, {_v('weight_kg')}, "
          f"{_v('protein_g')}, {_v('water_ml')})")


@register("g2_prescription_text", f"""WITH {_LAB}, {_TGT}
SELECT record_id, {_PRESC} AS prescription FROM t""", views=("v_record",))
def g2_prescription_text(spark, sf):
    return text.prescription_text(scoring.score_formula(views.records(spark, sf))).select("record_id", "prescription")


def _sq(s: str) -> str:
    return s.replace("'", "''")


_TIPS = (f"printf('{_sq(fixed.TIPS_TEMPLATE)}', "
         f"CASE WHEN sleep_hours < 7.5 THEN printf('{_sq(fixed.TIPS_SLEEP_LOW)}', printf('%.1f', sleep_hours)) "
         f"ELSE printf('{_sq(fixed.TIPS_SLEEP_OK)}', printf('%.1f', sleep_hours)) END, "
         f"CASE WHEN soreness_score >= {fixed.TIPS_SORENESS[0][0]} THEN '{fixed.TIPS_SORENESS[0][1]}' "
         f"WHEN soreness_score >= {fixed.TIPS_SORENESS[1][0]} THEN '{fixed.TIPS_SORENESS[1][1]}' "
         f"ELSE '{fixed.TIPS_SORENESS_LOW}' END, {_v('soreness_score')}, {_v('hrv_ms')}, "
         + "CASE " + " ".join(f"WHEN injury_risk_label = '{k}' THEN '{_sq(v)}'" for k, v in fixed.TIPS_LOAD)
         + f" ELSE '{_sq(fixed.TIPS_LOAD_DEFAULT)}' END, "
         + "CASE " + " ".join(f"WHEN injury_risk_label = '{k}' THEN '{_sq(v)}'" for k, v in fixed.TIPS_LAST)
         + f" ELSE '{_sq(fixed.TIPS_LAST_DEFAULT)}' END)")


@register("g3_tips_text", f"WITH {_LAB} SELECT record_id, {_TIPS} AS tips FROM lab", views=("v_record",))
def g3_tips_text(spark, sf):
    return text.tips_text(scoring.score_formula(views.records(spark, sf))).select("record_id", "tips")


_PLAN = f"printf('{_sq(fixed.PLAN_TEMPLATE)}', {_v('sport')}, {_v('position')}, printf('%.0f', hrv_ms + 5.0))"


@register("g4_plan_text", f"SELECT record_id, {_PLAN} AS plan FROM v_record", views=("v_record",))
def g4_plan_text(spark, sf):
    return text.plan_text(views.records(spark, sf)).select("record_id", "plan")


_PROMPT = (f"printf('{_sq(fixed.PROMPT_TEMPLATE)}', {_v('sport')}, {_v('position')}, {_v('age')}, {_v('weight_kg')}, "
           f"{_v('height_cm')}, injury_risk_label, printf('%.0f', p * 100.0), array_to_string(list_slice(f, 1, 4), ', '), "
           f"{_v('sleep_hours')}, {_v('hrv_ms')}, {_v('soreness_score')}, {_v('weekly_volume_hrs')}, "
           f"{_v('weekly_intensity_score')}, {_v('rest_days')}, {_v('prior_injuries')}, "
           f"printf('%.0f', days_since_last_injury))")


@register("g5_prompt_table", f"""WITH {_LAB},
fac AS (SELECT *, CASE WHEN len(h) = 0 THEN ['{fixed.DEFAULT_FACTORS[0]}', '{fixed.DEFAULT_FACTORS[1]}']
                       ELSE list_slice(h, 1, 3) END AS f
        FROM (SELECT *, list_filter({_RULES}, lambda x: x IS NOT NULL) AS h FROM lab))
SELECT record_id, {_PROMPT} AS prompt FROM fac""", views=("v_record",))
def g5_prompt_table(spark, sf):
    return text.prompt_header(_scored_records(spark, sf)).select("record_id", "prompt")


def _prompt_sql(template: str) -> str:
    """Twin of ``text.prompt_table``: the same templates, filled by DuckDB from its own targets."""
    instruction, user = fixed.PROMPTS[template]
    fmt, names = text.named_fields(user)
    n = fixed.PROMPT_FACTORS[template]
    derived = {
        "label": "injury_risk_label", "factors": f"array_to_string({'f' if n is None else f'list_slice(f, 1, {n})'}, ', ')",
        "percent_0": "printf('%.0f', p * 100.0)", "percent_1": "printf('%.1f', p * 100.0)",
        "days_0": "printf('%.0f', days_since_last_injury)", "deficit_of_8": "printf('%.1f', greatest(0.0, 8.0 - sleep_hours))",
        "sleep_target": "printf('%.1f', sleep_target)", "rpe_cap": _v("CAST(rpe_cap AS DOUBLE)"),
        "water_ml": _v("CASE WHEN injury_risk_label = 'HIGH' THEN 750 ELSE 600 END"),
        "sleep_state": f"CASE WHEN sleep_deficit > 0 THEN printf('{fixed.PROMPT_SLEEP_SHORT}', printf('%.1f', sleep_deficit)) "
                       f"ELSE '{fixed.PROMPT_SLEEP_ENOUGH}' END",
    }
    args = ", ".join(derived.get(x, _v(x)) for x in names)
    return f"""WITH {_LAB}, {_TGT},
fac AS (SELECT *, CASE WHEN len(h) = 0 THEN ['{fixed.DEFAULT_FACTORS[0]}', '{fixed.DEFAULT_FACTORS[1]}']
                       ELSE list_slice(h, 1, 3) END AS f
        FROM (SELECT *, list_filter({_RULES}, lambda x: x IS NOT NULL) AS h FROM t))
SELECT record_id, '{_sq(instruction)}' AS system, printf('{_sq(fmt)}', {args}) AS prompt FROM fac"""


def _register_prompt(template: str) -> None:
    @register(f"g5_prompt_{template}", _prompt_sql(template), views=("v_record",))
    def prompts(spark, sf):
        return text.prompt_table(_scored_records(spark, sf), template).select("record_id", "system", "prompt")


for _template in fixed.PROMPTS:
    _register_prompt(_template)


_FULL = f"""fulltext AS (SELECT record_id, injury_risk_label, {_PRESC} || '\n{fixed.DETAIL_MARKER}\n' || {_PLAN} AS text FROM t)"""


def _ex(key: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_extract(split_part(text, '{fixed.DETAIL_MARKER}', 1), "
            f"'{key}:[ \\t\\n\\f\\r]*([^\\n]*)', 1), '^[ \\t\\n\\f\\r]+', ''), '[ \\t\\n\\f\\r]+$', '')")


def _full_text(spark, sf):
    r = text.plan_text(text.prescription_text(scoring.score_formula(views.records(spark, sf))))
    return r.select("record_id", "injury_risk_label",
                    F.concat(F.col("prescription"), F.lit(f"\n{fixed.DETAIL_MARKER}\n"), F.col("plan")).alias("text"))


_CARD_COLS = ", ".join(
    f"{_ex(k + '_' + x)} AS {k.lower()}_{x.lower()}" for k in fixed.CARD_KEYS for x in ("HEADLINE", "TARGET", "DETAIL"))
_NUM_COLS = ", ".join(f"nullif(regexp_extract({k.lower()}_target, '^[0-9.]+', 0), '') AS {k.lower()}_number"
                      for k in fixed.CARD_KEYS)


@register("g6_extract_cards", f"""WITH {_LAB}, {_TGT}, {_FULL},
c AS (SELECT record_id, {_CARD_COLS},
        regexp_replace(regexp_replace(substr(text, strpos(text, '{fixed.DETAIL_MARKER}') + {len(fixed.DETAIL_MARKER)}),
          '^[ \\t\\n\\f\\r]+', ''), '[ \\t\\n\\f\\r]+$', '') AS detail_text FROM fulltext)
SELECT *, {_NUM_COLS} FROM c""", views=("v_record",))
def g6_extract_cards(spark, sf):
    return text.extract_cards(_full_text(spark, sf)).drop("injury_risk_label", "text")


@register("g6_card_coverage", f"""WITH {_LAB}, {_TGT}, {_FULL},
c AS (SELECT injury_risk_label, {_ex('SLEEP_TARGET')} AS st, {_ex('NUTRITION_TARGET')} AS nt FROM fulltext)
SELECT injury_risk_label, count(*) AS n_texts,
       round(avg(CASE WHEN st <> '' THEN 1.0 ELSE 0.0 END), 6) AS sleep_fill_rate,
       round(avg(CAST(nullif(regexp_extract(st, '^[0-9.]+', 0), '') AS DOUBLE)), 6) AS mean_sleep_target,
       round(avg(CAST(nullif(regexp_extract(nt, '^[0-9.]+', 0), '') AS DOUBLE)), 6) AS mean_protein_target
FROM c GROUP BY injury_risk_label""", views=("v_record",))
def g6_card_coverage(spark, sf):
    c = text.extract_cards(_full_text(spark, sf))
    return c.groupBy("injury_risk_label").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.round(F.avg(F.when(F.col("sleep_target") != "", 1.0).otherwise(0.0)), 6).alias("sleep_fill_rate"),
        F.round(F.avg(F.col("sleep_number").cast("double")), 6).alias("mean_sleep_target"),
        F.round(F.avg(F.col("nutrition_number").cast("double")), 6).alias("mean_protein_target"))


def _blocks_sql(src: str, key: str, col: str) -> str:
    trim = "regexp_replace(regexp_replace(x, '^[ \\t\\n\\f\\r]+', ''), '[ \\t\\n\\f\\r]+$', '')"
    return f"""b AS (SELECT {key} AS k, list_filter(string_split(block, '\n'), lambda x: x <> '') AS lines
       FROM (SELECT {key}, unnest(string_split({col}, '\n\n')) AS block FROM {src})),
k AS (SELECT k, CASE WHEN regexp_matches(lines[1], '^#{{1,3}}[ \\t\\n\\f\\r]') THEN 'heading'
                     WHEN list_bool_and(list_transform(lines, lambda x: starts_with({trim}, '-') OR starts_with({trim}, '*')))
                     THEN 'bullets' ELSE 'paragraph' END AS kind FROM b WHERE len(lines) > 0)
SELECT k AS {key}, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) AS BIGINT) AS n_heading,
       CAST(sum(CASE WHEN kind = 'bullets' THEN 1 ELSE 0 END) AS BIGINT) AS n_bullets,
       CAST(sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END) AS BIGINT) AS n_paragraph FROM k GROUP BY k"""


@register("g7_section_blocks_documents", "WITH " + _blocks_sql("documents", "doc_id", "text"))
def g7_section_blocks_documents(spark, sf):
    from loadscope.sources.tables import table
    return text.section_blocks(table(spark, sf, "documents", "doc_id", "text"), "text", "doc_id")


@register("g7_section_blocks_plan", f"WITH p AS (SELECT record_id, {_PLAN} AS plan FROM v_record), "
          + _blocks_sql("p", "record_id", "plan"), views=("v_record",))
def g7_section_blocks_plan(spark, sf):
    return text.section_blocks(text.plan_text(views.records(spark, sf)), "plan", "record_id")


@register("q6_assemble_text", """
SELECT id, string_agg(content, '' ORDER BY seq) AS text, count(*) AS n_chunks FROM v_chunks GROUP BY id""",
          views=("v_chunks",))
def q6_assemble_text(spark, sf):
    return text.assemble_text(views.chunks(spark, sf), "id", "seq", "content")

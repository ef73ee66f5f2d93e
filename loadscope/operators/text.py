"""Rule-based text prescriptions, parsing and chunk assembly.

All text is produced with ``format_string`` over fixed templates (``functions.fixed``) and
parsed with ``regexp_extract`` — per-row JVM expressions. Python float formatting is
reproduced as: ``repr(x)`` -> ``cast(x as string)``; ``f'{x:.1f}'`` -> ``format_string('%.1f')``
(identical for the one-decimal inputs the records carry; Java rounds half-up where Python
rounds the exact binary value, which only differs on exact binary ties).
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions import fixed
from loadscope.functions.rounding import exact_tenths

_WS = "[ \\t\\n\\f\\r]"


def js_trim(c: Column) -> Column:
    """Whitespace trim including newlines (Spark ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(" \t\n\f\r"))


def _by_label(label: Column, pairs, default) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(label == k, F.lit(v)) if expr is None else expr.when(label == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def prescription_targets(df: DataFrame, label: str = "injury_risk_label", prompt_variant: bool = False) -> DataFrame:
    """G1: numeric targets per record."""
    lab = F.col(label)
    sleep = F.col("sleep_hours")
    deficit = F.greatest(F.lit(0.0), F.lit(8.5) - sleep)
    water = fixed.WATER_ML_PROMPT if prompt_variant else fixed.WATER_ML
    return df.select(
        "*",
        deficit.alias("sleep_deficit"),
        F.least(F.lit(9.5), sleep + deficit).alias("sleep_target"),
        _by_label(lab, fixed.RPE_CAP, fixed.RPE_CAP_DEFAULT).alias("rpe_cap"),
        _by_label(lab, fixed.THERAPY_MIN, fixed.THERAPY_MIN_DEFAULT).alias("therapy_min"),
        _by_label(lab, water, fixed.WATER_ML_DEFAULT).alias("water_ml"),
        F.bround(F.col("weight_kg") * 0.35, 0).cast("bigint").alias("protein_g"),
    )


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _f0(c: Column) -> Column:
    """Python ``f'{x:.0f}'``: half-to-even on the value (Java's %.0f rounds half-up)."""
    return F.bround(c, 0).cast("bigint").cast("string")


def _f1(c) -> Column:
    return F.format_string("%.1f", F.col(c) if isinstance(c, str) else c)


def prescription_text(df: DataFrame, label: str = "injury_risk_label", out: str = "prescription") -> DataFrame:
    """The 4-card rule-based prescription text."""
    t = prescription_targets(df, label)
    vol_word = F.when(F.col("weekly_volume_hrs") > 15, fixed.VOLUME_WORDS[0]).otherwise(fixed.VOLUME_WORDS[1])
    text = F.format_string(
        fixed.PRESCRIPTION_TEMPLATE,
        _f1("sleep_deficit"), _f1("sleep_target"), _s("hrv_ms"), _f1("sleep_target"),
        _s("rpe_cap"), _s("rpe_cap"), _s("weekly_volume_hrs"), vol_word, _s("soreness_score"),
        _s("therapy_min"), _s("therapy_min"),
        _s("protein_g"), _s("water_ml"), _s("protein_g"), _s("water_ml"),
        _s("weight_kg"), _s("protein_g"), _s("water_ml"))
    return t.withColumn(out, text).drop("sleep_deficit", "sleep_target", "rpe_cap", "therapy_min", "water_ml",
                                        "protein_g")


def tips_text(df: DataFrame, label: str = "injury_risk_label", out: str = "tips") -> DataFrame:
    """Five numbered tips."""
    lab = F.col(label)
    sleep, sore = F.col("sleep_hours"), F.col("soreness_score")
    sleep_msg = F.when(sleep < 7.5, F.format_string(fixed.TIPS_SLEEP_LOW, _f1(sleep))) \
        .otherwise(F.format_string(fixed.TIPS_SLEEP_OK, _f1(sleep)))
    (t_hi, w_hi), (t_mid, w_mid) = fixed.TIPS_SORENESS
    sore_word = F.when(sore >= t_hi, w_hi).when(sore >= t_mid, w_mid).otherwise(fixed.TIPS_SORENESS_LOW)
    load = _by_label(lab, fixed.TIPS_LOAD, fixed.TIPS_LOAD_DEFAULT)
    last = _by_label(lab, fixed.TIPS_LAST, fixed.TIPS_LAST_DEFAULT)
    return df.withColumn(out, F.format_string(fixed.TIPS_TEMPLATE, sleep_msg, sore_word, _s(sore), _s("hrv_ms"),
                                              load, last))


def plan_text(df: DataFrame, out: str = "plan") -> DataFrame:
    """Markdown plan; re-entry HRV = hrv + 5 formatted with no decimals."""
    return df.withColumn(out, F.format_string(fixed.PLAN_TEMPLATE, _s("sport"), _s("position"),
                                              _f0(F.col("hrv_ms") + 5.0)))


def named_fields(template: str) -> tuple[str, list[str]]:
    """A template with fields in braces as a ``printf`` format and the fields' names in order."""
    parts = list(Formatter().parse(template))
    return "".join(text.replace("%", "%%") + ("" if name is None else "%s") for text, name, _, _ in parts), \
        [name for _, name, _, _ in parts if name is not None]


def prompt_table(df: DataFrame, template: str = "full", label: str = "injury_risk_label", p: str = "injury_probability",
                 factors: str = "top_contributing_factors", system: str = "system", out: str = "prompt") -> DataFrame:
    """The system and user text of each record's prompt for offline batch inference (no model call), by one of
    the templates ``recovery``, ``tips``, ``cards`` and ``full``."""
    instruction, user = fixed.PROMPTS[template]
    fmt, names = named_fields(user)
    t = prescription_targets(df, label, prompt_variant=True)
    n = fixed.PROMPT_FACTORS[template]
    short = F.format_string(fixed.PROMPT_SLEEP_SHORT, _f1("sleep_deficit"))
    derived = {
        "label": _s(label), "factors": F.array_join(F.col(factors) if n is None else F.slice(F.col(factors), 1, n), ", "),
        "percent_0": _f0(F.col(p) * 100.0), "percent_1": exact_tenths(F.col(p) * 100.0), "days_0": _f0(F.col("days_since_last_injury")),
        "deficit_of_8": _f1(F.greatest(F.lit(0.0), F.lit(8.0) - F.col("sleep_hours"))), "sleep_target": _f1("sleep_target"),
        "sleep_state": F.when(F.col("sleep_deficit") > 0, short).otherwise(fixed.PROMPT_SLEEP_ENOUGH),
    }
    text = F.format_string(fmt, *[derived.get(x, _s(x)) for x in names])
    return t.select(*[c for c in df.columns if c not in (system, out)], F.lit(instruction).alias(system), text.alias(out))


def prompt_header(df: DataFrame, label: str = "injury_risk_label", p: str = "injury_probability",
                  factors: str = "top_contributing_factors", out: str = "prompt") -> DataFrame:
    """The record and prediction lines that open the full prompt."""
    fac = F.array_join(F.slice(F.col(factors), 1, 4), ", ")
    return df.withColumn(out, F.format_string(
        fixed.PROMPT_TEMPLATE, _s("sport"), _s("position"), _s("age"), _s("weight_kg"), _s("height_cm"),
        _s(label), _f0(F.col(p) * 100.0), fac,
        _s("sleep_hours"), _s("hrv_ms"), _s("soreness_score"),
        _s("weekly_volume_hrs"), _s("weekly_intensity_score"), _s("rest_days"),
        _s("prior_injuries"), _f0(F.col("days_since_last_injury"))))


def extract_field(text: Column, name: str) -> Column:
    """G6 field value: after ``NAME:`` up to the next line that starts with ``KEY:`` (or the
    end); trimmed; '' when absent. Written line-wise with possessive quantifiers — the same
    match as a lazy ``(?s).+?`` with a lookahead, without per-character backtracking."""
    pat = f"{name}:{_WS}*+([^\\n]*+(?:\\n(?![A-Z_]+:)[^\\n]*+)*+)"
    return js_trim(F.regexp_extract(text, pat, 1))


def extract_cards(df: DataFrame, text: str = "text") -> DataFrame:
    """Cards (headline, target, detail, leading number of target) for the 4 keys, plus
    the detail tail after the marker. The text is cut at the marker once per row."""
    t = F.col(text)
    idx = F.instr(t, fixed.DETAIL_MARKER)
    cut = df.select("*", F.when(idx > 0, F.substring(t, 1, idx - 1)).otherwise(t).alias("_before"),
                    F.when(idx > 0, F.substring(t, idx + len(fixed.DETAIL_MARKER), 1 << 30)).alias("_after"))
    before = F.col("_before")
    cols = []
    for k in fixed.CARD_KEYS:
        kl = k.lower()
        h, tg, d = (extract_field(before, f"{k}_{x}") for x in ("HEADLINE", "TARGET", "DETAIL"))
        cols += [h.alias(f"{kl}_headline"), tg.alias(f"{kl}_target"), d.alias(f"{kl}_detail")]
    out = cut.select("*", *cols, F.coalesce(js_trim(F.col("_after")), F.lit("")).alias("detail_text"))
    nums = [F.nullif(F.regexp_extract(f"{k.lower()}_target", "^[0-9.]+", 0), F.lit("")).alias(f"{k.lower()}_number")
            for k in fixed.CARD_KEYS]
    return out.select("*", *nums).drop("_before", "_after")


def section_blocks(df: DataFrame, text: str, key: str) -> DataFrame:
    """Split text into blocks on blank lines and classify each non-empty block as
    heading (first line ``#{1,3} ``), bullets (every line starts with - or *) or paragraph;
    returns block counts per kind per document."""
    blocks = df.select(key, F.posexplode(F.split(F.col(text), "\n\n")).alias("pos", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: x != "")
    b = blocks.select(key, "pos", lines.alias("lines")).filter(F.size("lines") > 0)
    is_head = F.element_at("lines", 1).rlike("^#{1,3}[ \\t\\n\\f\\r]")
    all_bullets = F.forall("lines", lambda x: js_trim(x).startswith("-") | js_trim(x).startswith("*"))
    kind = F.when(is_head, "heading").when(all_bullets, "bullets").otherwise("paragraph")
    g = b.groupBy(key).agg(
        F.sum(F.when(kind == "heading", 1).otherwise(0)).cast("bigint").alias("n_heading"),
        F.sum(F.when(kind == "bullets", 1).otherwise(0)).cast("bigint").alias("n_bullets"),
        F.sum(F.when(kind == "paragraph", 1).otherwise(0)).cast("bigint").alias("n_paragraph"))
    return g


def assemble_text(chunks: DataFrame, key: str = "id", seq: str = "seq", text: str = "content",
                  bucket: int = 1024, out: str = "text") -> DataFrame:
    """Q6: ordered chunks -> one text per key. Two levels: chunks are first joined within
    (key, seq div bucket) slices, then the slices per key — no task sorts a whole hot key's
    chunk list at once."""
    sl = chunks.withColumn("_slice", F.floor(F.col(seq) / bucket))
    part = sl.groupBy(key, "_slice").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))),
                                 lambda x: x["t"]), "").alias("_part"),
        F.count(F.lit(1)).alias("_n"))
    return part.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_slice").alias("s"), F.col("_part").alias("t")))),
                                 lambda x: x["t"]), "").alias(out),
        F.sum("_n").alias("n_chunks"))

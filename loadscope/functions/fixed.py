"""Fixed values that must equal the studied system's for identical results.

Everything in this module is data, stated plainly and in the studied system's own order
(order matters for first-match lookups). Nothing here is logic.
"""

from __future__ import annotations

# --- fixed values: sport risk multipliers (exact lookup, default 1.0) -------------------
SPORT_MULTIPLIERS = [
    ("Rugby", 1.25),
    ("Football", 1.15),
    ("Basketball", 1.15),
    ("Cricket", 1.18),
    ("Baseball", 1.12),
    ("Running", 1.10),
    ("Tennis", 1.05),
    ("Badminton", 1.02),
    ("Fitness Training", 1.00),
    ("Swimming", 0.82),
    ("Cycling", 0.85),
]

# --- fixed values: position risk multipliers, in lookup order ---------------------------
POSITION_MULTIPLIERS = [
    ("Forward (Prop/Hooker/Lock)", 1.20),
    ("Back (Scrum-half/Fly-half/Center/Wing)", 1.10),
    ("Goalkeeper", 0.80),
    ("Central Midfielder", 1.15),
    ("Winger", 1.12),
    ("Striker / Forward", 1.10),
    ("Center Back", 1.05),
    ("Fullback", 1.10),
    ("Point Guard", 1.12),
    ("Center", 1.15),
    ("Power Forward", 1.10),
    ("Small Forward", 1.08),
    ("Shooting Guard", 1.05),
    ("Fast Bowler", 1.30),
    ("All-Rounder", 1.15),
    ("Wicketkeeper", 1.08),
    ("Batsman", 0.90),
    ("Spin Bowler", 1.00),
    ("Pitcher", 1.25),
    ("Catcher", 1.15),
    ("Outfielder", 1.05),
    ("Infielder", 1.00),
    ("Marathoner", 1.15),
    ("Sprinter", 1.12),
    ("Trail Runner", 1.10),
    ("Middle Distance", 1.05),
    ("Climber", 1.05),
    ("Road Racer", 1.00),
    ("Time Trialist", 0.95),
    ("Sprint / Butterfly / Backstroke / Breaststroke", 1.05),
    ("Freestyle / Distance", 0.95),
]

# --- fixed values: record range rules (column, min, max) ---------------------------------
RECORD_RANGES = [
    ("age", 15.0, 50.0),
    ("weight_kg", 40.0, 150.0),
    ("height_cm", 140.0, 220.0),
    ("weekly_volume_hrs", 0.0, 40.0),
    ("weekly_intensity_score", 0.0, 10.0),
    ("sleep_hours", 0.0, 12.0),
    ("hrv_ms", 0.0, 200.0),
    ("soreness_score", 0.0, 10.0),
    ("rest_days", 0.0, 7.0),
    ("prior_injuries", 0.0, 20.0),
    ("days_since_last_injury", 0.0, 10000.0),
]
REQUIRED_TEXT = ["athlete_id", "date", "sport", "position"]

# --- fixed values: validation patterns ---------------------------------------------------
ATHLETE_ID_PATTERN = r"^ATH-[a-zA-Z0-9_-]+$"
TEXT_PATTERN = r"^[a-zA-Z0-9\s_\-\/\(\)\,]+$"
DATE_FORMAT = "yyyy-MM-dd"
ID_ILLEGAL_CHARS = r"[^a-zA-Z0-9_-]"
ID_EMPTY_FALLBACK = "101"

# --- fixed values: training-table required columns ---------------------------------------
TRAINING_COLUMNS = [
    "athlete_id", "date", "sport", "position", "age", "weight_kg", "height_cm",
    "weekly_volume_hrs", "weekly_intensity_score", "sleep_hours", "hrv_ms",
    "soreness_score", "rest_days", "prior_injuries", "days_since_last_injury", "injured",
]

# --- fixed values: formula defaults for absent columns (E5) ------------------------------
FORMULA_DEFAULTS = {
    "weekly_volume_hrs": 14.5,
    "weekly_intensity_score": 7.5,
    "sleep_hours": 7.5,
    "hrv_ms": 58.0,
    "soreness_score": 4.0,
    "rest_days": 1,
    "prior_injuries": 1,
    "days_since_last_injury": 90.0,
    "sport": "",
    "position": "",
}

# --- fixed values: high-impact position words (E8), in rule order -----------------------
HIGH_IMPACT_POSITION_WORDS = ["Fast Bowler", "Pitcher", "Prop", "Hooker", "Forward", "Midfielder",
                              "Marathoner"]
DEFAULT_FACTORS = ["Workload within safe threshold", "Normal recovery baseline"]

# --- fixed values: ACWR zones (E12) -------------------------------------------------------
ACWR_ZONES = [
    ("Undertraining", "Increase training load gradually"),
    ("Optimal Zone", "Maintain current training load"),
    ("Caution", "Reduce load or increase recovery"),
    ("Danger Zone", "High injury risk — rest immediately"),
]

# --- fixed values: readiness labels (E13) ------------------------------------------------
READINESS_LABELS = [(80, "Peak Ready"), (65, "Good"), (45, "Moderate")]
READINESS_LOW = "Low"
READINESS_NONE = "No Data"

# --- fixed values: recovery tips (E14): (title, description) -----------------------------
TIP_SLEEP = ("Prioritize Sleep", "Aim for 8–9 hours tonight. Avoid screens 1 hour before bed.")
TIP_REDUCE = ("Reduce Training Load",
              "Your acute load is elevated. Consider an easy session or rest day.")
TIP_INCREASE = ("Gradual Load Increase", "Safely increase training volume by 10% this week.")
TIP_ICE = ("Ice & Compression", "Apply cold therapy to areas of discomfort for 15–20 minutes.")
TIP_REST = ("Complete Rest Recommended", "Your body needs full recovery. Skip today's session.")
TIP_HYDRATION = ("Hydration", "Drink at least 2.5–3L of water today. Add electrolytes post-workout.")
TIP_MOBILITY = ("Mobility Work",
                "10–15 min of stretching or yoga improves recovery and reduces soreness.")
TIP_NUTRITION = ("Nutrition Timing",
                 "Consume protein within 45 minutes of your session for optimal recovery.")

# --- fixed values: body zones (19) and severities ----------------------------------------
BODY_ZONES = [
    "head", "neck", "left-shoulder", "right-shoulder", "chest", "left-arm", "right-arm",
    "abdomen", "lower-back", "left-hip", "right-hip", "left-thigh", "right-thigh",
    "left-knee", "right-knee", "left-calf", "right-calf", "left-ankle", "right-ankle",
]
SEVERITY_LABELS = ["None", "Mild", "Moderate", "Severe"]

# --- fixed values: sport -> positions domain (E17), default position first ---------------
SPORT_POSITIONS = [
    ("Football", ["Midfielder", "Goalkeeper", "Center Back", "Fullback", "Central Midfielder",
                  "Winger", "Striker / Forward"]),
    ("Basketball", ["Point Guard", "Shooting Guard", "Small Forward", "Power Forward", "Center"]),
    ("Running", ["Marathoner", "Sprinter", "Middle Distance", "Trail Runner"]),
    ("Tennis", ["Singles", "Doubles"]),
    ("Badminton", ["Singles", "Doubles"]),
    ("Rugby", ["Forward (Prop/Hooker/Lock)", "Back (Scrum-half/Fly-half/Center/Wing)"]),
    ("Cricket", ["Batsman", "Fast Bowler", "Spin Bowler", "Wicketkeeper", "All-Rounder"]),
    ("Baseball", ["Pitcher", "Catcher", "Infielder", "Outfielder"]),
    ("Swimming", ["Freestyle / Distance", "Sprint / Butterfly / Backstroke / Breaststroke"]),
    ("Cycling", ["Road Racer", "Time Trialist", "Sprinter", "Climber"]),
    ("Fitness Training", ["General Athlete", "Endurance", "Powerlifting / Crossfit"]),
]

# --- fixed values: what-if scenario presets (E18) ---------------------------------------
# (name, volume, intensity, sleep, hrv, soreness, rest, priors, days_since)
SCENARIOS = [
    ("optimal", 6.5, 3.5, 8.5, 85.0, 1.0, 2, 0, 365.0),
    ("spike", 28.5, 9.2, 5.0, 36.0, 8.5, 0, 2, 45.0),
    ("recovery", 8.0, 4.0, 9.0, 65.0, 3.0, 3, 3, 21.0),
]

# --- fixed values: evaluation thresholds ---------------------------------------------------
RECALL_TIERS = [0.05, 0.15, 0.25, 0.45]
PRECISION_TIERS = [0.55, 0.60, 0.65, 0.75]
OPERATING_MODES = [("Max Safety", 0.05), ("Early Warning", 0.15), ("High Alert", 0.25),
                   ("Balanced", 0.45)]
CASCADE_CONFIGS = [(0.10, 0.35), (0.15, 0.40), (0.20, 0.45)]
ENSEMBLE_WEIGHTS = [("rf", 2.0), ("gbm", 2.0), ("lr", 1.0)]

# --- fixed values: risk label bins (E6) and prior-prediction fallback (E19) -------------
RISK_BINS = [(0.30, "LOW"), (0.60, "MEDIUM"), (1.01, "HIGH")]
PRIOR_FROM_RULE = [("High", 0.72), ("Medium", 0.45), ("Low", 0.18)]

# --- fixed values: pseudonym prefix and length -------------------------------------------
PSEUDONYM_PREFIX = "PSN-"
PSEUDONYM_HEX_CHARS = 12

# --- stand-in mappings used by the derived views over the driver tables (ours) -----------
EVENT_TYPE_SPORT = [("view", "Running"), ("click", "Cycling"), ("signup", "Football"),
                    ("purchase", "Basketball"), ("error", "Swimming")]
SEGMENT_SPORT = [("MACHINERY", "Rugby"), ("BUILDING", "Football"), ("AUTOMOBILE", "Tennis"),
                 ("FURNITURE", "Cricket"), ("HOUSEHOLD", "Fencing")]
PRIORITY_POSITION = [("1-URGENT", "Forward (Prop/Hooker/Lock)"), ("2-HIGH", "Midfielder"),
                     ("3-MEDIUM", "Forward"), ("4-NOT SPECIFIED", "Spin Bowler"),
                     ("5-LOW", "Singles")]

# --- fixed values: safety status by recall (>= .90, >= .75, else) and delta arrows ------
SAFETY_STATUS = ["EXCELLENT", "GOOD", "HIGH RISK"]
DELTA_ARROWS = ["▲", "▼", "─"]

# --- fixed values: rule-based prescription text (G1/G2), %s placeholders in order --------
CARD_KEYS = ["SLEEP", "WORKLOAD", "THERAPY", "NUTRITION"]
RPE_CAP = [("HIGH", 4.0), ("MEDIUM", 5.5)]
RPE_CAP_DEFAULT = 7.0
THERAPY_MIN = [("HIGH", 25), ("MEDIUM", 20)]
THERAPY_MIN_DEFAULT = 15
WATER_ML = [("HIGH", 800)]
WATER_ML_PROMPT = [("HIGH", 750)]
WATER_ML_DEFAULT = 600
PRESCRIPTION_TEMPLATE = (
    "SLEEP_HEADLINE: Sleep deficit detected → extend by +%sh tonight\n"
    "SLEEP_TARGET: %s\n"
    "SLEEP_DETAIL: HRV at %sms suggests incomplete recovery. Aim for %sh uninterrupted. "
    "Avoid screens 45min before bed.\n\n"
    "WORKLOAD_HEADLINE: Cap training RPE at %s/10 for next 48 hours\n"
    "WORKLOAD_TARGET: %s\n"
    "WORKLOAD_DETAIL: Weekly volume at %sh is %s with soreness %s/10. "
    "No high-intensity sessions until HRV recovers above baseline.\n\n"
    "THERAPY_HEADLINE: %s-min cryotherapy + lower limb mobility protocol\n"
    "THERAPY_TARGET: %s\n"
    "THERAPY_DETAIL: Foam roll hamstrings, calves and hip flexors for 12 minutes. "
    "Follow with 10-min cold water immersion at 10–12°C to reduce inflammation markers.\n\n"
    "NUTRITION_HEADLINE: %sg protein + %sml water within 30min post-session\n"
    "NUTRITION_TARGET: %sg protein + %sml\n"
    "NUTRITION_DETAIL: At %skg bodyweight target %sg fast-digesting protein immediately post-session. "
    "Add sodium electrolytes to first %sml of post-session fluid.\n"
)
VOLUME_WORDS = ("elevated", "moderate")  # weekly volume > 15 h, else

# --- fixed values: fallback tips text (G3) ---------------------------------------------
TIPS_SLEEP_LOW = "You only got %s hours — try to hit at least 8 tonight."
TIPS_SLEEP_OK = "Sleep was decent at %s hours. Keep that going."
TIPS_SORENESS = [(7.0, "High soreness"), (4.0, "Moderate soreness")]
TIPS_SORENESS_LOW = "Low soreness"
TIPS_LOAD = [("HIGH", "Pull back on intensity for the next 2 days."),
             ("MEDIUM", "Keep sessions controlled this week.")]
TIPS_LOAD_DEFAULT = "You're managing load well."
TIPS_LAST = [("HIGH", "Skip today's session — your body needs a full rest day.")]
TIPS_LAST_DEFAULT = "Stick to zone 1-2 cardio today if you must train — nothing above RPE 5."
TIPS_TEMPLATE = (
    "1. %s\n"
    "2. %s at %s/10 — spend 15 minutes foam rolling before your next session.\n"
    "3. Your HRV is at %s ms. %s\n"
    "4. Drink at least 500ml of water in the next hour and include electrolytes post-training.\n"
    "5. %s"
)

# --- fixed values: markdown plan (G4); placeholders: sport, position, hrv + 5 ------------
PLAN_TEMPLATE = (
    "\n### 🏃‍♂️ Dynamic Warm-Up & Movement Activation\n"
    "- **World's Greatest Stretch**: 2 sets × 6 reps per side (activates hip flexors, hamstrings, and thoracic spine).\n"
    "- **Glute & Core Prep**: 2 sets × 12 reps of Banded Monster Walks and Single-Leg Glute Bridges for joint stabilization.\n"
    "- **Sport-Specific Movement**: 5 minutes of progressive linear acceleration & low-intensity directional footwork for %s %s.\n"
    "\n### 🧘‍♂️ Active Recovery & Mobility Exercises\n"
    "- **90/90 Hip Mobility**: 3 minutes per side to open hip capsule and relieve groin tightness.\n"
    "- **Hamstring & Calf PNF Stretch**: Hold 10s contract / 20s relax for 3 cycles targeting posterior chain.\n"
    "- **Thoracic Extension & Foam Rolling**: 8 minutes targeting upper back and IT band tissue release.\n"
    "\n### 🥗 Whole-Food Performance Diet & Meals\n"
    "- **Recovery Lunch**: Grilled salmon or chicken breast with quinoa, steamed broccoli, and avocado slices for healthy fats.\n"
    "- **Anti-Inflammatory Snack**: 250ml tart cherry juice mixed with blueberries and walnuts to accelerate muscle recovery.\n"
    "- **Evening Dinner**: Lean turkey or tofu stir-fry with sweet potato and leafy spinach.\n"
    "\n### 🛡️ Biometric Re-Entry & Safety Thresholds\n"
    "- **HRV Baseline Check**: Morning HRV must recover above %sms before resuming RPE > 7 sessions.\n"
    "- **Soreness Threshold**: Soreness score must drop below 4/10 before high-speed sprints.\n"
    "- **Pain Warning**: Discontinue drill immediately if localized sharp joint or tendon discomfort occurs.\n"
)
DETAIL_MARKER = "---DETAIL---"

# --- fixed values: full-prescription prompt, user part (G5) ------------------------------
PROMPT_TEMPLATE = (
    "Athlete: %s %s, age %s, %skg, %scm\n"
    "Injury Risk: %s (%s%%) | Key drivers: %s\n"
    "Sleep: %sh | HRV: %sms | Soreness: %s/10\n"
    "Weekly load: %sh @ RPE %s/10 | Rest days: %s\n"
    "Injury history: %s prior injuries (last: %s days ago)"
)

# --- fixed values: prompts for offline inference, system and user part (G5); names in braces are record fields,
# --- prediction fields and derived targets ------------------------------------------------
PROMPTS = {
    "recovery": (
        "You are an elite Sports Science & Athletic Recovery AI Specialist. "
        "Your job is to analyze an athlete's biometrics, training load, and ML injury risk prediction, "
        "and output a structured 4-part athletic recovery and workload prescription. "
        "Be clear, concise, evidence-based, and professional.",
        """Athlete Metadata:
- Athlete ID: {athlete_id}
- Sport: {sport} | Playing Position: {position}
- Demographics: Age {age}, Weight {weight_kg}kg, Height {height_cm}cm

Training & Recovery Metrics:
- Weekly Volume: {weekly_volume_hrs} hours
- Weekly Intensity (RPE): {weekly_intensity_score}/10
- Sleep Duration: {sleep_hours} hrs/night
- Heart Rate Variability (HRV): {hrv_ms} ms
- Soreness Rating: {soreness_score}/10
- Rest Days (Past Week): {rest_days} days
- Prior Injuries: {prior_injuries} (Last injury: {days_since_last_injury} days ago)

ML Injury Risk Output:
- Predicted Injury Probability: {percent_1}%
- Risk Category Label: {label}
- Top Contributing Risk Factors: {factors}

Please provide a structured Athletic Recovery Prescription in markdown with 4 sections:
1. 🚨 **Immediate Safety & Load Reduction Protocol**
2. 📉 **Next 3-Day RPE & Workload Target Caps**
3. 🧊 **Targeted Therapy & Mobility Routine**
4. 💤 **Sleep & Nutritional Recovery Optimization**"""),
    "tips": (
        "You are a knowledgeable sports coach who gives honest, practical recovery advice. "
        "Write in a direct, friendly tone — like a coach talking to their athlete. "
        "Do NOT use formal markdown headers or corporate-sounding language. "
        "Do NOT start sentences with 'It is recommended' or 'Ensure that'. "
        "Write short, specific sentences. Be conversational and human.",
        """Here is today's data for a {sport} {position}, age {age}:

- Sleep last night: {sleep_hours} hours
- HRV: {hrv_ms} ms
- Muscle soreness: {soreness_score}/10
- Training volume this week: {weekly_volume_hrs} hrs at RPE {weekly_intensity_score}/10
- Rest days this week: {rest_days}
- Injury history: {prior_injuries} past injuries, last one {days_0} days ago
- ML model injury risk: {label} ({percent_0}% probability)
- Key risk drivers: {factors}

Give 5 short, specific recovery tips for today based on this data. Each tip should be 1-2 sentences max. 
Write them as plain numbered points (1. 2. 3. etc.) with no sub-bullets or headings. 
Focus on what's most urgent given the data — don't give generic advice."""),
    "cards": (
        "You are a precision sports science AI. Output ONLY the 4 labeled sections below, nothing else. "
        "No preamble, no summary. Each section MUST start with its exact label on its own line. "
        "Be specific with numbers. Use real physiological reasoning based on the athlete's data.",
        """Athlete: {sport} {position}, age {age}, {weight_kg}kg
Injury Risk: {label} ({percent_0}%) | Risk factors: {factors}
Sleep: {sleep_hours}h | HRV: {hrv_ms}ms | Soreness: {soreness_score}/10
Weekly load: {weekly_volume_hrs}h @ RPE {weekly_intensity_score}/10 | Rest days: {rest_days}
Prior injuries: {prior_injuries} (last: {days_0} days ago)

Respond with EXACTLY this structure, no extra text:

SLEEP_HEADLINE: [one sentence target, e.g. "Sleep deficit detected → extend by +{deficit_of_8}h tonight"]
SLEEP_TARGET: [specific hours target as a number, e.g. "9.0"]
SLEEP_DETAIL: [2 sentences max explaining why and how — specific to HRV {hrv_ms}ms and sleep {sleep_hours}h]

WORKLOAD_HEADLINE: [one sentence cap, e.g. "Cap RPE at {rpe_cap}/10 for next 48 hours"]
WORKLOAD_TARGET: [RPE cap as a number e.g. "{rpe_cap}"]
WORKLOAD_DETAIL: [2 sentences max — reference actual training load {weekly_volume_hrs}h and soreness {soreness_score}/10]

THERAPY_HEADLINE: [one sentence protocol name and duration]
THERAPY_TARGET: [duration in minutes as a number]
THERAPY_DETAIL: [2 sentences — specific body areas for this {sport} {position}, reference soreness {soreness_score}/10]

NUTRITION_HEADLINE: [one sentence protein + hydration directive]
NUTRITION_TARGET: [{protein_g}g protein + hydration target in ml]
NUTRITION_DETAIL: [2 sentences — specific timing windows and electrolyte reasoning for this athlete]"""),
    "full": (
        "You are a Head Strength & Conditioning Coach and Sports Scientist at a Premier High-Performance Center. "
        "Your output has two parts separated by '---DETAIL---' on its own line.\n"
        "PART 1: Exactly 12 lines for the 4 labeled metric blocks. No extra text before them.\n"
        "PART 2: Practical athletic execution directives written in direct, tactical coaching language. "
        "IMPORTANT DIRECTIVE: DO NOT REPEAT the sleep targets, RPE cap numbers, therapy minutes, or protein/water quantities "
        "already stated in Part 1. Instead, provide NEW practical protocols: (1) Dynamic Warm-Up Exercises, "
        "(2) Active Recovery & Mobility Drills, (3) Whole-Food Performance Diet & Meals, and (4) Biometric Re-Entry Thresholds. "
        "Be specific with real exercise names, stretches, and whole food choices tailored for this athlete (~60-80 words per section).",
        """Athlete: {sport} {position}, age {age}, {weight_kg}kg, {height_cm}cm
Injury Risk: {label} ({percent_0}%) | Key drivers: {factors}
Sleep: {sleep_hours}h | HRV: {hrv_ms}ms | Soreness: {soreness_score}/10
Weekly load: {weekly_volume_hrs}h @ RPE {weekly_intensity_score}/10 | Rest days: {rest_days}
Injury history: {prior_injuries} prior injuries (last: {days_0} days ago)

PART 1 — output EXACTLY these 12 lines, nothing else before '---DETAIL---':

SLEEP_HEADLINE: Sleep {sleep_state}
SLEEP_TARGET: {sleep_target}
SLEEP_DETAIL: [2 sentences specific to HRV {hrv_ms}ms and {sleep_hours}h sleep]

WORKLOAD_HEADLINE: Cap RPE at {rpe_cap}/10 for next 48 hours
WORKLOAD_TARGET: {rpe_cap}
WORKLOAD_DETAIL: [2 sentences on {weekly_volume_hrs}h weekly load and soreness {soreness_score}/10]

THERAPY_HEADLINE: [specific therapy protocol and total duration for {sport} {position}]
THERAPY_TARGET: {therapy_min}
THERAPY_DETAIL: [2 sentences — specific body areas and modalities for this athlete]

NUTRITION_HEADLINE: {protein_g}g protein + {water_ml}ml hydration within 30min post-session
NUTRITION_TARGET: {protein_g}g + {water_ml}ml
NUTRITION_DETAIL: [2 sentences on protein timing and electrolyte strategy for {weight_kg}kg athlete]

---DETAIL---

PART 2 — Write 4 NEW practical sections with these exact headings (DO NOT repeat Part 1 numbers; give exercises, warm-ups, meals, re-entry rules):

### 🏃‍♂️ Dynamic Warm-Up & Movement Activation
### 🧘‍♂️ Active Recovery & Mobility Exercises
### 🥗 Whole-Food Performance Diet & Meals
### 🛡️ Biometric Re-Entry & Safety Thresholds"""),
}
PROMPT_FACTORS = {"recovery": None, "tips": 3, "cards": 4, "full": 4}  # factors named; None: all
PROMPT_SLEEP_SHORT = "deficit detected → extend by +%sh tonight"
PROMPT_SLEEP_ENOUGH = "adequate — maintain current schedule"

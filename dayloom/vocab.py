"""Feature names, themes and display names of the study's tables.

Fixed values: they are the column names and codes of the input files, so they
have to be spelled exactly like this.
"""

RING = [
    "breath_average", "efficiency", "hr_average", "hr_lowest", "onset_latency",
    "score", "temperature_delta", "temperature_trend_deviation", "total", "log_hrv",
]
WATCH = [
    "steps", "minHeartRateInBeatsPerMinute", "maxHeartRateInBeatsPerMinute",
    "averageHeartRateInBeatsPerMinute", "restingHeartRateInBeatsPerMinute",
    "averageStressLevel", "maxStressLevel", "stressDurationInSeconds",
    "restStressDurationInSeconds", "activityStressDurationInSeconds",
    "lowStressDurationInSeconds", "mediumStressDurationInSeconds", "highStressDurationInSeconds",
]
SURVEYS = [
    "daily_stressed", "daily_control", "daily_shifts", "sam8", "shift_stress", "promis_sd5",
    "EBTBP", "phq9_score", "gad7_score", "promis_sri_score", "pss4_score", "promis_es_score",
    "fss_score",
]
POPULATION = [
    "p_id", "dem_age", "dem_gender", "height", "weight", "ace_score", "hx_any", "mhx_any",
    "ptsd_score", "life_events_score",
]

# Theme of each node. One node may sit in two themes.
THEMES = {
    "phys": [
        "hr_lowest", "hr_average", "temperature_delta", "log_hrv", "daily_stressed",
        "daily_control", "daily_shifts", "shift_stress", "pss4_score", "breath_average",
    ],
    "sleep": [
        "efficiency", "onset_latency", "score", "promis_sri_score", "fss_score", "promis_sd5",
        "total",
    ],
    "mental": ["phq9_score", "gad7_score", "sam8", "EBTBP", "promis_es_score", "pss4_score"],
    "oura": RING,
    "survey": SURVEYS,
}

# The pairs of themes whose edges are counted, by result column.
THEME_PAIRS = {
    "between_oura": ("oura", "oura"),
    "between_survey": ("survey", "survey"),
    "between_modality": ("oura", "survey"),
    "between_phys": ("phys", "phys"),
    "between_sleep": ("sleep", "sleep"),
    "between_mental": ("mental", "mental"),
    "between_phys_sleep": ("phys", "sleep"),
    "between_phys_mental": ("phys", "mental"),
    "between_sleep_mental": ("sleep", "mental"),
}

SCALAR_MEASURES = ["difference", "int_union", *THEME_PAIRS]

# Stress definitions and the four cutoffs' defaults.
DEFINITIONS = ["daily_stressed", "daily_shifts", "shift_stress", "hrv_binary"]
STRESS_CUTOFF, NO_STRESS_CUTOFF = 0.75, 0.25

# Questionnaire scores as (item prefix, item numbers, number width).
ITEM_SCORES = {
    "phq9_score": ("phq9_", 9, 1),
    "gad7_score": ("gad_", 7, 1),
    "promis_sri_score": ("promis_sri", 8, 1),
    "pss4_score": ("pss4_", 4, 1),
    "promis_es_score": ("promis_es", 4, 1),
    "fss_score": ("fss_", 9, 1),
    "ace_score": ("ace_", 10, 1),
    "ptsd_score": ("pcl_", 17, 1),
    "life_events_score": ("lec_", 10, 2),
}
ONCE_SCORES = ["ace_score", "ptsd_score", "life_events_score"]

# Conditions in the order of their code, 1 first.
HISTORY = [
    "none", "diabetes", "obesity", "heart", "lung", "rheum", "kidney", "liver", "allergies",
    "pain", "gi", "ent", "neuro", "other",
]
MENTAL_HISTORY = [
    "none", "mood", "anxiety", "psych", "eating", "neurodev", "sleep", "suicide", "learning",
    "other", "undisclosed",
]
LIFESTYLE = ["alcohol", "binge", "smoke", "exercise"]
GENDERS = ["female", "male", "non-binary", "other", "prefer not to say"]

TRAITS_NUMERIC = ["dem_age", "weight", "ace_score", "ptsd_score", "life_events_score"]
TRAITS_CATEGORICAL = (
    ["dem_gender"]
    + [f"hx_{h}" for h in HISTORY] + ["hx_any"]
    + [f"mhx_{m}" for m in MENTAL_HISTORY if m != "undisclosed"] + ["mhx_any"]
    + LIFESTYLE
)


def coded_columns() -> dict[str, str]:
    """Survey export name -> readable name for the 29 coded columns."""
    names = {f"med_4___{i}": f"hx_{h}" for i, h in enumerate(HISTORY, 1)}
    names |= {f"med_5___{i}": f"mhx_{m}" for i, m in enumerate(MENTAL_HISTORY, 1)}
    return names | {f"lifestyle{i}": n for i, n in enumerate(LIFESTYLE, 1)}


def items(score: str) -> list[str]:
    """Item columns that add up to ``score``."""
    prefix, n, width = ITEM_SCORES[score]
    return [f"{prefix}{i:0{width}d}" for i in range(1, n + 1)]


# Node code -> (long name, short name).
DISPLAY = {
    "breath_average": ("Breath", "B"),
    "efficiency": ("Efficiency", "E"),
    "hr_average": ("HR Average", "HR"),
    "hr_lowest": ("HR Lowest", "HRL"),
    "onset_latency": ("Sleep Onset", "O"),
    "score": ("Sleep Score", "S"),
    "temperature_delta": ("Temp Change", "TD"),
    "temperature_trend_deviation": ("Temp Trend", "TT"),
    "total": ("Total Sleep", "T"),
    "log_hrv": ("HRV", "HRV"),
    "daily_stressed": ("Stress", "DS"),
    "daily_control": ("Control", "DC"),
    "daily_shifts": ("Shifts", "SH"),
    "sam8": ("SAM8", "S8"),
    "shift_stress": ("Shift Stress", "SS"),
    "promis_sd5": ("Sleep Quality", "SQ"),
    "EBTBP": ("EBT", "EBT"),
    "phq9_score": ("PHQ9", "PHQ9"),
    "gad7_score": ("GAD7", "GAD7"),
    "promis_sri_score": ("Impaired Sleep", "SRI"),
    "pss4_score": ("PSS4", "PSS4"),
    "promis_es_score": ("Emotional Support", "ES"),
    "fss_score": ("FSS", "FSS"),
    "phys": ("Physiological", "Physiological"),
    "sleep": ("Sleep", "Sleep"),
    "mental": ("Mental Health", "Mental Health"),
}

# Named feature sets of the search.
FEATURE_SETS = {
    "all": RING + WATCH + SURVEYS,
    "oura": RING,
    "garmin": WATCH,
    "surveys": SURVEYS,
    "oura+surveys": RING + SURVEYS,
    "garmin+surveys": WATCH + SURVEYS,
    "oura+garmin": RING + WATCH,
}

# Features that give a target away and leave with it.
LEAKING = {
    "total_stress": ["daily_stressed", "daily_control", "shift_stress"],
    "shift_stress": ["daily_shifts"],
    "daily_control": ["daily_stressed"],
    "control_cat": ["daily_stressed"],
}


def resolve_features(feature_set: str | list[str], target: str) -> list[str]:
    """Features of a named set (or a given list) without the target and what leaks it."""
    chosen = FEATURE_SETS[feature_set] if isinstance(feature_set, str) else feature_set
    drop = {target, *LEAKING.get(target, [])}
    return [f for f in chosen if f not in drop]


def needs_watch_panel(features: list[str]) -> bool:
    """Watch features live only in the watch-led merge."""
    return "steps" in features

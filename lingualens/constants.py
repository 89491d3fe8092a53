"""Fixed values that are part of the evaluation semantics.

These must equal the values of the system we reproduce for results to agree;
they are stated here once, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
# Metrics that enter the strict leaderboard average (no truthfulqa, no chrf).
AVERAGED_METRICS = [
    "translation_from_bleu",
    "translation_to_bleu",
    "classification_accuracy",
    "mmlu_accuracy",
    "arc_accuracy",
    "mgsm_accuracy",
]
# Tasks a language model is asked to do, in order.
TASKS = [
    "translation_from",
    "translation_to",
    "classification",
    "mmlu",
    "arc",
    "truthfulqa",
    "mgsm",
]
# Tasks of the dedicated translation service model.
TRANSLATION_TASKS = ["translation_from", "translation_to"]

# Bootstrap confidence intervals.
BOOTSTRAP_REPLICATES = 1000
BOOTSTRAP_LEVEL = 0.95
BOOTSTRAP_SEED = 42

# Speaker-rank tiers as (label, first rank, last rank), 1-based inclusive.
# The third label says 20-200 but its range really is 20..500.
TIERS = [
    ("Top 1", 1, 1),
    ("Top 2-20", 2, 20),
    ("Top 20-200", 20, 500),
]

# Model health and exclusion.
HEALTH_MIN_ATTEMPTS = 100
HEALTH_FAIL_PCT = 50.0
HEALTH_IMMEDIATE_FAIL_PCT = 80.0
HEALTH_MIN_RUNS = 2
SLOW_SEC_PER_SAMPLE = 0.3
HIGH_ERROR_ALERT = 0.8

# Cost cap per 1M output tokens.
COST_CAP_PER_1M = 30.0

# Run scale and the bar for publishing aggregates.
N_SENTENCES = 10
N_LANGUAGES = 1000
N_MODELS = 40
PUBLISH_MIN_LANGUAGES = 1000
PUBLISH_MIN_MODELS = 100

# Countries with fewer speakers than this get no score.
COUNTRY_MIN_POPULATION = 1000

# Freshness window for discovered models, in days.
DISCOVERY_WINDOW_DAYS = 365

# Logit clipping for classification scores.
LOGIT_CLIP = (0.001, 0.999)

# Macro-language mapping applied after tag standardisation.
MACROLANGUAGE_MAPPING = {"no": "nb"}

# The dedicated translation model appended to the cohort.
TRANSLATION_MODEL = {
    "id": "google/translate-v2",
    "name": "Google Translate",
    "provider_name": "Google",
    "cost": 20.0,
    "train_on_prompts": False,
    "type": "closed-source",
}
# ---------------------------------------------------------------------------

"""Fixed values.

These word lists, dictionaries, patterns and constants must equal the ones of
the tool this engine re-implements, or results differ. They are stated as
plain data in their natural order; the rest of the package only reads them.
"""

# ---- fixed values: flag values that mean "override = yes" -------------------
OVERRIDE_YES_VALUES = ("Y", "YES", "TRUE", "1")

# ---- fixed values: stopwords (common English, then domain filler) ----------
STOPWORDS = (
    "for", "the", "and", "with", "from", "into", "new", "to", "of", "on",
    "in", "a", "an", "by", "is", "was", "are", "be", "as", "at", "or",
    "its", "this", "that", "has", "have", "had", "not", "but", "also",
    "will", "would", "been", "more", "than", "per", "their", "there",
    "due", "related", "include", "added", "additional", "impact",
    "completed", "moves", "assessment", "override", "reason", "note",
    "sensitivity", "sensitized", "stressed", "stress", "sensitiv",
    "restated", "restatement", "layered", "sens",
)

# ---- fixed values: priority groups (ordered; first match wins) -------------
PRIORITY_GROUPS = {
    "Additional Debt / New Facility": [
        "additional_debt",
        "undrawn", "new debt", "new loan",
        "additional debt", "additional facility", "additional borrowing",
        "new credit", "new revolver", "outside debt",
    ],
    "Reallocation / Current Portion LTD": [
        "realloc", "reallocate", "reallocation",
        "current portion", "cpltd",
        "reclassif", "reclassification",
        "long term debt", "long-term debt",
    ],
}

# ---- fixed values: synonym groups (canonical key -> phrases) ---------------
SYNONYMS = {
    "additional_debt": [
        "undrawn debt", "undrawn facility", "undrawn line",
        "new term debt", "new loan", "new debt", "new credit facility",
        "additional loan", "additional debt", "additional borrowing",
        "additional credit", "incremental debt", "layered debt",
        "new borrowing", "new facility", "new revolver",
        "personal debt", "outside debt", "related debt",
    ],
    "equipment_purchase": [
        "equipment purchase", "purchase of equipment", "new equipment",
        "capital purchase", "capital expenditure", "capex",
        "farm equipment", "machinery purchase", "equipment financing",
        "purchase of machinery", "asset purchase",
    ],
    "cash_flow": [
        "cash flow", "cashflow", "operating cash flow", "free cash flow",
        "cash from operations", "operating earnings",
    ],
    "preferred_share": [
        "preferred share", "preference share", "preferred equity",
        "preferred stock",
    ],
    "real_estate": [
        "real estate", "real property", "property value",
        "land value", "farm land", "farmland",
    ],
    "working_capital": [
        "working capital", "operating line", "line of credit",
        "operating credit", "revolving credit",
    ],
    "restructuring": [
        "restructure", "restructuring", "refinanc", "refinancing",
        "debt restructure", "loan restructure", "credit restructure",
    ],
    "macro_environment": [
        "covid", "covid-19", "pandemic", "macro environment",
        "economic environment", "market conditions", "inflation pressure",
        "interest rate", "rate hike", "rate increase",
    ],
}

# ---- fixed values: abbreviations (case-insensitive keys) -------------------
ABBREVIATIONS = {
    "PS": "Preferred Share",
    "BRR": "Business Risk Rating",
    "MRA": "Model Risk Assessment",
    "LOC": "Line of Credit",
    "LOA": "Line of Account",
    "FPLOC": "Farm Plus Line of Credit",
    "TD": "Term Debt",
    "RE": "Real Estate",
    "OP": "Operating",
    "WC": "Working Capital",
}

# ---- fixed values: numeric settings ----------------------------------------
MIN_REASON_LENGTH = 3
N_CLUSTERS = 8
AUTO_SELECT_K = False
MIN_K = 3
NGRAM_RANGE = (1, 2)
MAX_TFIDF_FEATURES = 300
TOP_KEYWORDS_PER_CLUSTER = 6
MAX_SAMPLE_REASONS_PER_GROUP = 5
MAX_ENTITY_IDS_IN_SUMMARY_CELL = 30
SUMMARY_KEYWORDS = 8
ROLLUP_NAMES_PER_CELL = 3
KMEANS_N_INIT = 10
KMEANS_MAX_ITER = 150
KMEANS_SEED = 42
KMEANS_TOL = 1e-6

# ---- fixed values: explore settings ----------------------------------------
ABBREVIATION_EXAMPLES = 3
STEM_MIN_VARIANTS = 2
COLLOCATION_TOP_N = 40
COLLOCATION_MIN_COUNT = 2
PMI_EPSILON = 1e-12
PMI_SUGGEST_ABOVE = 3.0
CONTEXT_TOP_WORDS = 60
CONTEXT_TOP_PAIRS = 40
CONTEXT_MIN_DOC_FREQ = 2
CONTEXT_MIN_SIMILARITY = 0.3
CONTEXT_SUGGEST_ABOVE = 0.5
WORD_FREQUENCY_ROWS = 80
STOPWORD_SHARE_ABOVE = 0.4
VIEW_TOP_PHRASES = 20
VIEW_TOP_CONTEXT = 20
VIEW_TOP_STEMS = 15

# ---- fixed values: stemmer suffixes, tried in this order -------------------
STEM_SUFFIXES = ("ings", "ing", "tion", "tions", "ment", "ments",
                 "ers", "ies", "ed", "es", "er", "ly", "al", "s")
STEM_MIN_ROOT = 4

# ---- fixed values: patterns -------------------------------------------------
# token pattern applied to lower-cased text
TOKEN_PATTERN = r"[a-zA-Z][a-zA-Z\-']+"
# minimum token length kept by the tokenizer is 3 (length > 2)
TOKEN_MIN_LENGTH = 3
# abbreviation candidates: 2 to 6 capitals between word boundaries (case-sensitive)
ABBREVIATION_LETTERS = "[A-Z]{2,6}"

# ---- fixed values: report texts --------------------------------------------
MISC_LABEL = "miscellaneous"
AUTO_GROUP_FORMAT = "Auto Group {n}: {label}"
SUGGEST_STOPWORD = "Consider adding to STOPWORDS"
SUGGEST_PHRASE = 'Consider adding "{phrase}" to a SYNONYMS group'
SUGGEST_GROUPING = 'Consider grouping "{w1}" and "{w2}" in SYNONYMS'
SUGGEST_STEM = 'Add to SYNONYMS: "{stem}": [{variants}]'
YES = "YES"
ENTITY_SEPARATOR = ", "
SAMPLE_SEPARATOR = " | "
KEYWORD_SEPARATOR = ", "
NAME_SEPARATOR = " / "

# ---- fixed values: input columns --------------------------------------------
DEFAULT_COLUMN_MAP = {
    "borrower_name": "B",
    "entity_id": "E",
    "actual_rating": "M",
    "model_rating": "N",
    "notch_difference": "O",
    "override_flag": "P",
    "reason_text": "R",
}

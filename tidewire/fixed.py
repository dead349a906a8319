"""Word lists, limits and patterns that decide results.

Every operator takes these as defaults of a parameter, so that a caller can
pass another list.
"""

# --- Fixed values: keywords, categories and scores -------------------------
KEYWORD_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)
CATEGORY_WORDS = {
    "geopolitics": ("geopolitics", "diplomacy", "foreign policy", "international relations"),
    "conflict": ("conflict", "war", "tension", "dispute", "crisis"),
    "economy": ("economy", "economic", "trade", "finance", "market"),
    "security": ("security", "defense", "military", "terrorism"),
    "environment": ("climate", "environment", "sustainability"),
    "technology": ("technology", "cyber", "digital", "innovation"),
}
RELIABLE_SOURCES = ("reuters", "ap", "bbc", "cnn", "nytimes")
RELEVANT_CATEGORIES = ("geopolitics", "conflict", "diplomacy", "security")
RELEVANT_KEYWORDS = ("diplomacy", "foreign", "international", "policy", "relations")
GEOGRAPHIC_LABELS = ("GPE", "LOC")
POLITICAL_LABELS = ("ORG", "PERSON")

# --- Fixed values: risk and theme words ------------------------------------
CONFLICT_WORDS = ("conflict", "war", "tension", "crisis", "dispute")
URGENT_WORDS = ("crisis", "emergency", "urgent", "breaking", "alert")
THEME_WORDS = (
    "conflict", "crisis", "election", "protest", "economic",
    "military", "diplomatic", "health", "environment", "technology",
)

# --- Fixed values: content policy ------------------------------------------
FORBIDDEN_WORDS = (
    "classified", "secret", "confidential", "top secret", "restricted",
    "internal use only", "sensitive",
)
SENSITIVE_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}-\d{4}-\d{4}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}
MAX_CONTENT_LENGTH = 10000
SECRET_KEY_PARTS = ("password", "token", "key", "secret", "api_key")
REDACTED = "[REDACTED]"

# --- Fixed values: domain categories ---------------------------------------
DOMAIN_CATEGORIES = (
    "Geopolitical",
    "Military / Conflict / Strategic Alliances",
    "Economic / Trade / Sanctions",
    "Cultural / Identity Clashes",
    "Religious Tensions / Ideological Movements",
    "Technological Competition",
    "Cybersecurity Threats / Disinformation Ops",
    "Environmental Flashpoints / Resource Crises",
    "Civilizational / Ethnonationalist Narratives",
    "AI Governance / Tech Ethics Conflicts",
    "Migration / Demographic Pressures",
    "Sovereignty / Border / Legal Disputes",
)

# --- Fixed values: words looked for in news addresses ----------------------
NEWS_URL_WORDS = (
    "geopolitics", "foreign-policy", "territory", "border", "ceasefire", "sovereignty", "treaty",
    "airstrike", "missile", "military", "defense", "conflict", "clash", "invasion", "war",
    "proxy-war", "nuclear", "troops", "drill", "deterrence", "arms", "weapons", "sanctions",
    "economy", "economic", "finance", "inflation", "debt", "trade", "investment", "gdp", "markets",
    "currency", "interest-rates", "banking", "minority", "ethnic", "cultural", "nationhood",
    "demographic", "identity", "genocide", "refugee", "climate", "environment", "drought", "flood",
    "disaster", "energy", "oil", "gas", "water", "resources", "scarcity", "pollution", "tech", "ai",
    "cyber", "hack", "espionage", "surveillance", "malware", "ransomware", "intelligence", "spy",
    "detention", "terror", "resistance", "insurgency", "occupation", "hegemony",
    "sphere-of-influence",
)

# --- Fixed values: languages ------------------------------------------------
LANGUAGE_CODES = {
    "en": "en", "english": "en", "eng": "en",
    "es": "es", "spanish": "es",
    "fr": "fr", "french": "fr",
    "de": "de", "german": "de",
    "zh": "zh", "chinese": "zh",
    "ja": "ja", "japanese": "ja",
    "ko": "ko", "korean": "ko",
    "ar": "ar", "arabic": "ar",
    "ru": "ru", "russian": "ru",
}
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "zh": "Chinese",
    "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "ru": "Russian",
}
PASSTHROUGH_LANGS = ("en", "uk")

# --- Fixed values: prices per thousand tokens ------------------------------
TOKEN_PRICES = (
    ("mistral", "mistral-large", 0.007, 0.024),
    ("mistral", "mistral-medium", 0.4, 2.0),
    ("mistral", "mistral-small", 0.1, 0.3),
)
DEFAULT_PRICE = (0.01, 0.03)

# --- Fixed values: sentences of reports --------------------------------------
CORRELATION_SENTENCE = "%s %s correlation (%.3f) that is %s (p=%.3f)"
NEGATIVE_SENTENCE = "High negative sentiment ratio: %.2f"
COUNTRY_RISK_SENTENCE = "High risk in %s: %.2f"

# --- Fixed values: document filter time spans -------------------------------
TIMESPAN_UNITS = {
    "min": "minutes", "h": "hours", "hours": "hours", "d": "days", "days": "days",
    "w": "weeks", "weeks": "weeks", "m": "months", "months": "months",
}

# --- Own small lexicons (function words and opinion words) ------------------
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "it", "was", "for", "with", "this", "are"),
    "fr": ("le", "la", "les", "des", "est", "que", "qui", "une", "dans", "pour", "et", "du"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "ein", "sich", "zu"),
    "es": ("el", "los", "las", "que", "una", "por", "con", "para", "es", "del", "se", "en"),
}
OPINION_WORDS = {
    "good": 0.7, "great": 0.8, "excellent": 1.0, "peace": 0.6, "agreement": 0.5, "progress": 0.5,
    "win": 0.6, "hope": 0.5, "safe": 0.4, "success": 0.7, "best": 1.0, "love": 0.6,
    "bad": -0.7, "terrible": -1.0, "worthless": -0.8, "pathetic": -0.9, "attack": -0.6,
    "war": -0.6, "crisis": -0.6, "threat": -0.5, "hate": -0.8, "death": -0.7, "loss": -0.4,
    "stupid": -0.8, "worst": -1.0, "idiot": -0.8,
}

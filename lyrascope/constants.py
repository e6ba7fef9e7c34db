"""Defaults and vocabularies that results depend on."""

# Languages evaluated when the caller names none.
LANGUAGES = ["cs", "et", "ko", "nl", "uk"]

# Repeated song of each language: (kept text id, repeated text id).
REPEATED_SONGS = {
    "cs": (4, 14),
    "et": (3, 14),
    "ko": (3, 11),
    "nl": (3, 15),
    "uk": (3, 16),
}

# Shift of the rating axis per language in the song-points table; others are not shifted.
RATING_OFFSETS = {"cs": -0.03, "et": 0.0, "ko": 0.06, "nl": 0.06, "uk": 0.03}

# Word labels.
CORRECT = "correct"
WRONG = "wrong"
NOT_IMPORTANT = "not_important"
STATUSES = [CORRECT, WRONG, NOT_IMPORTANT]

# Texts a CSV reader of the pandas family takes for a missing value.
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Defaults of the topic and reduction jobs.
VARIANCE_TARGET = 0.95
SEED = 42
MIN_TOPICS = 2
MAX_TOPICS = 20
NUM_MODELS = 100
FOLDS = 5
OUTLIER_TOPIC = -1
UNKNOWN_TOPIC = "unknown"

# Text reports: title, the lines of a block in order, and one line per level.
QUALITY_TITLE = "Machine Translation Evaluation Results"
QUALITY_LINES = {
    "language": "Language: %s",
    "mean_rating": "  Mean overall rating: %.2f",
    "mean_correctness": "  Mean correctness: %.2f",
    "mean_importance": "  Mean importance: %.2f",
    "n_words": "  Total words evaluated: %d",
    "self_agreement": "  Self-agreement of annotator: %.2f",
    "hallucinations": "  Hallucinations: %s",
    "unusual_language": "  Unusual language distribution:",
}
LEVEL_LINE = "    %s: %d"
HALLUCINATIONS = "%d out of %d songs"
AGREEMENT_LINES = {
    "kappa_rating": "Cohen's kappa for overallRating: %.4f",
    "kappa_hallucination": "Cohen's kappa for hallucination: %.4f",
    "mean_kappa_words": "Mean Cohen's kappa for word-level labels: %.4f",
    "mean_accuracy_important": "Mean accuracy for important word-level labels: %.4f",
    "mean_kappa_important": "Mean Cohen's kappa for important word-level labels: %.4f",
}

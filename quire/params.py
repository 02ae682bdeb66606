"""Thresholds of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds and word lists that results depend on.
SURVEY_LIMIT, SURVEY_MOST, CITATIONS, MIN_BOOKS = 10, 25, 3, 2
MAX_NAME_WORDS, MIN_LETTER_RATIO = 6, 0.6
CARRYING_SHARE = 0.9
RRF_K = 60
BOOK_CANDIDATES, BOOK_MIN_SIMILARITY, BOOK_LIMIT = 60, 0.30, 8
HOUSE_CANDIDATES, HOUSE_MIN_SIMILARITY, HOUSE_LIMIT = 25, 0.25, 6
QUALITY_MIN_SCORE, QUALITY_MIN_CHARACTERS = 0.90, 60
CHUNK_TARGET, CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP, CHUNK_MAX_TOKENS, PREFIX_RESERVE = 1200, 1600, 250, 200, 440, 40
CHARS_PER_TOKEN = 3.6
HEADINGS_PER_PAGE, NOISE_BELOW, SERIES_MIN_RUN, EXTRAPOLATE_PAGES = 1.5, 0.70, 2, 10
EDGE_SHARE, MERGE_GAP = 0.15, 3
EMBED_BATCH = 32
IDLE_MINUTES, LAST_MESSAGES = 120, 12
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s"}
VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿæœ"
STOP_HEADINGS = (
    "punches", "punch", "cocktails", "cocktail", "fizzes", "sours", "cobblers", "juleps", "slings", "toddies", "smashes", "daisies", "flips", "sangarees", "shrubs", "eggnoggs", "noggs", "crustas", "fixes", "rickeys", "coolers", "cups", "wines", "liqueurs",
    "cordials", "syrups", "bitters", "index", "contents", "appendix", "preface", "introduction", "miscellaneous", "miscellaneousdrinks", "temperancedrinks", "hotdrinks", "summerdrinks", "winterdrinks",
)
HEAD_LETTERS, HEAD_CHARS, FUZZY_MIN_KEY = 3, 80, 6
ARTICLES = ("the", "a", "an", "le", "la", "el", "les", "los", "las")
RANKINGS = ("books", "mentions", "earliest", "latest")


@dataclass(frozen=True)
class Corpus:
    """What a retrieval corpus brings along."""

    name: str
    candidates: int
    min_similarity: float
    limit: int
    weights: dict[str, float] = field(default_factory=lambda: {"dense": 1.0, "lexical": 1.0})
    k: int = RRF_K


BOOKS = Corpus("books", BOOK_CANDIDATES, BOOK_MIN_SIMILARITY, BOOK_LIMIT)
HOUSE = Corpus("house", HOUSE_CANDIDATES, HOUSE_MIN_SIMILARITY, HOUSE_LIMIT)

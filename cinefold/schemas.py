"""Column contracts and the values that define results.

Everything in this module is a FIXED VALUE: names, bounds, word lists and phrases
that stored data and search results depend on.
"""

from __future__ import annotations

# Source column -> catalogue column, in source order.
SOURCE_COLUMNS = {
    "Title": "title",
    "US Gross": "us_gross",
    "Worldwide Gross": "worldwide_gross",
    "US DVD Sales": "us_dvd_sales",
    "Production Budget": "production_budget",
    "Release Date": "release_date",
    "MPAA Rating": "mpaa_rating",
    "Running Time min": "running_time_min",
    "Distributor": "distributor",
    "Source": "source",
    "Major Genre": "major_genre",
    "Creative Type": "creative_type",
    "Director": "director",
    "Rotten Tomatoes Rating": "rt_rating",
    "IMDB Rating": "imdb_rating",
    "IMDB Votes": "imdb_votes",
}

# Columns whose text is normalised, and those put to a majority vote.
TEXT_COLUMNS = [
    "title", "mpaa_rating", "distributor", "source", "major_genre", "creative_type", "director",
]
VOTED_COLUMNS = [
    "distributor", "director", "major_genre", "creative_type", "source", "mpaa_rating",
]

# Accepted closed range per numeric column.
NUMERIC_RANGES = {
    "imdb_rating": (0.0, 10.0),
    "rt_rating": (0.0, 100.0),
    "imdb_votes": (0.0, 1e9),
    "running_time_min": (1.0, 500.0),
    "production_budget": (1.0, 1e10),
    "us_gross": (1.0, 1e11),
    "worldwide_gross": (1.0, 1e11),
    "us_dvd_sales": (1.0, 1e11),
}

# Certificate spellings (upper case) -> official certificate.
CERTIFICATES = {
    "OPEN": "Not Rated",
    "NOT RATED": "Not Rated",
    "UNRATED": "Not Rated",
    "NR": "Not Rated",
    "G": "G",
    "PG": "PG",
    "PG-13": "PG-13",
    "R": "R",
    "NC-17": "NC-17",
}

# Date layouts in the order they are tried, and the last year the data covers.
DATE_LAYOUTS = [
    "MMM d yyyy", "yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy",
]
LAST_RELEASE_YEAR = 2011

# Sentinel per categorical column.
SENTINELS = {
    "major_genre": "Unknown",
    "creative_type": "Unknown",
    "source": "Unknown",
    "director": "Unknown",
    "distributor": "Unknown",
    "mpaa_rating": "Not Rated",
}
LEFT_MISSING = ["imdb_votes", "us_gross", "worldwide_gross", "us_dvd_sales"]
MIN_FIT_PAIRS = 30

# Exclusive upper bound, code and phrase of each budget tier.
BUDGET_TIERS = [
    (5_000_000, "micro", "Micro-budget (under $5M)"),
    (20_000_000, "low", "Low-budget ($5M to $20M)"),
    (50_000_000, "mid", "Mid-budget ($20M to $50M)"),
    (100_000_000, "high", "High-budget ($50M to $100M)"),
    (None, "blockbuster", "Blockbuster budget ($100M and above)"),
]
BLOCKBUSTER_GROSS = 100_000_000
BLOCKBUSTER_MULTIPLE = 2.0
RATIO_CAP = 9999.0

# Lowest critic score of each reception phrase.
RECEPTIONS = [
    (80, "Critically acclaimed by reviewers"),
    (60, "Well reviewed by critics"),
    (40, "Mixed reviews from critics"),
    (None, "Poorly reviewed by critics, panned"),
]
AUDIENCE_GAP = 15
AUDIENCE_AHEAD = "audiences liked it much more than critics did"
CRITICS_AHEAD = "critics liked it much more than audiences did"
BIG_EARNER = "a commercial blockbuster"
SMALL_EARNER = "a modest earner"

# Stored columns in insert order with their types.
STORED_TYPES = {
    "source_key": "string",
    "title": "string",
    "release_date": "date",
    "release_year": "int",
    "major_genre": "string",
    "creative_type": "string",
    "source": "string",
    "mpaa_rating": "string",
    "director": "string",
    "distributor": "string",
    "running_time_min": "int",
    "production_budget": "bigint",
    "us_gross": "bigint",
    "worldwide_gross": "bigint",
    "us_dvd_sales": "bigint",
    "imdb_rating": "decimal(3,1)",
    "imdb_votes": "int",
    "rt_rating": "int",
    "decade": "int",
    "budget_tier": "string",
    "rating_score_delta": "decimal(4,1)",
    "blockbuster_flag": "boolean",
    "profit_ratio": "decimal(10,3)",
    "imputed_fields": "array<string>",
    "augmented_text": "string",
    "content_hash": "string",
    "embedding": "array<float>",
    "embedding_model": "string",
    "pipeline_version": "string",
}

# The content fingerprint covers what is stored, but for itself and what the embedding and the run add.
HASHED_COLUMNS = [c for c in STORED_TYPES if c not in ("content_hash", "embedding", "embedding_model", "pipeline_version")]

# Columns of a search result, and of the two-dimensional export.
RESULT_COLUMNS = [
    "id", "title", "release_date", "release_year", "decade", "major_genre", "creative_type",
    "source", "mpaa_rating", "director", "distributor", "running_time_min",
    "production_budget", "us_gross", "worldwide_gross", "imdb_rating", "imdb_votes",
    "rt_rating", "budget_tier", "blockbuster_flag", "rating_score_delta", "imputed_fields",
]
EXPORT_COLUMNS = [
    "id", "title", "major_genre", "creative_type", "source", "mpaa_rating", "director",
    "distributor", "release_year", "decade", "running_time_min", "production_budget",
    "worldwide_gross", "imdb_rating", "imdb_votes", "rt_rating", "budget_tier",
    "blockbuster_flag", "rating_score_delta",
]

# Bounds of a search request.
QUERY_CHARS = 1000
TOP_K_DEFAULT, TOP_K_MIN, TOP_K_MAX = 10, 1, 50
RATING_MIN, RATING_MAX = 0, 10
DECADE_MIN, DECADE_MAX = 1900, 2100

# Candidate budget of approximate search, fuzzy-title thresholds.
CANDIDATES_PER_K, CANDIDATES_MIN, CANDIDATES_MAX = 20, 100, 1000
TITLE_THRESHOLD = 0.5

# Upper bounds of the latency histogram (seconds), alarm and budget settings.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RESULT_COUNT_BOUNDS = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]
RATIO_FLOOR = 0.0001
WINDOW_PERMITS, WINDOW_SECONDS = 60, 60

# Width of the stored vectors made by the offline embedder.
EMBEDDING_WIDTH = 64

REPORT_SCHEMA = "stage string, issue string, field string, count bigint, action string, detail string"

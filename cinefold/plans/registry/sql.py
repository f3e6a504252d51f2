"""The enrichment chain as DuckDB SQL, one named step after another.

Written apart from the Spark operators, from the definition of each rule, so that a check
compares two statements of the same rule.
"""

from __future__ import annotations

from cinefold import schemas as S
from cinefold.sources.testbed import raw_records_sql


def q(name: str) -> str:
    return f'"{name}"'


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def certificate(x: str) -> str:
    cases = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in S.CERTIFICATES.items())
    return f"CASE upper({x}) {cases} ELSE {x} END"


def in_range(x: str, low: float, high: float) -> str:
    n = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {n} BETWEEN {low} AND {high} THEN {n} END"


def parsed(x: str) -> str:
    return f"CAST(coalesce(try_strptime({x}, '%b %d %Y'), try_strptime({x}, '%Y-%m-%d')) AS DATE)"


def rolled(d: str) -> str:
    return (
        f"CAST(CASE WHEN year({d}) > {S.LAST_RELEASE_YEAR} THEN {d} - INTERVAL 100 YEAR ELSE {d} END AS DATE)"
    )


def slug(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', '-', 'g'), '-')"


def key_slug(x: str) -> str:
    return f"CASE WHEN {slug(x)} = '' THEN sha256({x}) ELSE {slug(x)} END"


def rounded(x: str, digits: int) -> str:
    return f"round_even({x}, 0)" if digits == 0 else f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


RENAMED = ", ".join(f"{q(a.replace(' ', '_'))} AS {b}" for a, b in S.SOURCE_COLUMNS.items())
CATALOGUE_COLUMNS = list(S.SOURCE_COLUMNS.values())


def _normal() -> str:
    columns = [
        f"{certificate(collapse(c)) if c == 'mpaa_rating' else collapse(c)} AS {c}"
        if c in S.TEXT_COLUMNS else c
        for c in CATALOGUE_COLUMNS
    ]
    return f"SELECT ord, {', '.join(columns)} FROM named WHERE {collapse('title')} IS NOT NULL"


def _votes() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS spelling, count(*) AS votes, min(ord) AS first_seen "
        f"FROM normal WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in S.VOTED_COLUMNS
    )


_VARIANTS = """
SELECT field, spelling, canonical FROM (
  SELECT *, first_value(spelling) OVER (
    PARTITION BY field, lower(upper(spelling)) ORDER BY votes DESC, first_seen) AS canonical
  FROM votes) WHERE spelling <> canonical"""


def _voted() -> str:
    columns = [
        f"coalesce(v_{c}.canonical, n.{c}) AS {c}" if c in S.VOTED_COLUMNS else f"n.{c}"
        for c in CATALOGUE_COLUMNS
    ]
    joins = " ".join(
        f"LEFT JOIN variants v_{c} ON v_{c}.field = '{c}' AND v_{c}.spelling = n.{c}"
        for c in S.VOTED_COLUMNS
    )
    return f"SELECT n.ord, {', '.join(columns)} FROM normal n {joins}"


def _typed() -> str:
    columns = []
    for c in CATALOGUE_COLUMNS:
        if c in S.NUMERIC_RANGES:
            columns.append(f"{in_range(c, *S.NUMERIC_RANGES[c])} AS {c}")
        elif c == "release_date":
            columns.append(f"{rolled(parsed(c))} AS release_date")
        else:
            columns.append(c)
    return f"SELECT ord, {', '.join(columns)} FROM voted"


_KEYED = f"""
SELECT *, CAST(year(release_date) AS INT) AS release_year, {key_slug('title')} AS title_slug,
  {key_slug('title')} || '::' || coalesce(strftime(release_date, '%Y-%m-%d'), 'undated') AS source_key
FROM typed"""

_CLEANED = """
SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY ord) AS place FROM keyed)
WHERE place = 1"""

_GROUPED = """
SELECT *, coalesce(major_genre, '__missing__') AS g,
  coalesce(CAST(CAST(floor(release_year / 10.0) * 10 AS INT) AS VARCHAR), '-1') AS d FROM cleaned"""

_LINE = """
SELECT regr_count(rt_rating, imdb_rating) AS pairs, regr_slope(rt_rating, imdb_rating) AS slope,
  regr_intercept(rt_rating, imdb_rating) AS intercept, corr(imdb_rating, rt_rating) AS correlation
FROM cleaned"""

_PREDICTED = f"""
SELECT grouped.*, coalesce(rt_rating, CASE WHEN pairs >= {S.MIN_FIT_PAIRS} AND imdb_rating IS NOT NULL
  THEN least(100.0, greatest(0.0, imdb_rating * slope + intercept)) END) AS rt_p
FROM grouped, line"""

_IMPUTED_LIST = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c}' END"
    for c in sorted(["imdb_rating", "rt_rating", "running_time_min", "production_budget", *S.SENTINELS])
)


def _imputed() -> str:
    def fill(c: str, source: str, by: str, digits: int) -> str:
        return rounded(f"coalesce({source}, m{by}.{c}, o.{c}, 0.0)", digits) + f" AS {c}"

    kept = [c for c in ("title", "us_gross", "worldwide_gross", "us_dvd_sales", "release_date",
                        "imdb_votes", "release_year", "source_key")]
    sentinels = [f"coalesce({c}, {sql_text(v)}) AS {c}" for c, v in S.SENTINELS.items()]
    return f"""
SELECT ord, {', '.join('p.' + c for c in kept)}, {', '.join(sentinels)},
  {fill('imdb_rating', 'p.imdb_rating', 'g', 1)}, {fill('rt_rating', 'p.rt_p', 'g', 0)},
  {fill('running_time_min', 'p.running_time_min', 'g', 0)},
  {fill('production_budget', 'p.production_budget', 'd', 0)},
  list_filter([{_IMPUTED_LIST.replace('WHEN ', 'WHEN p.')}], lambda x: x IS NOT NULL) AS imputed_fields
FROM predicted p
LEFT JOIN (SELECT g, median(imdb_rating) AS imdb_rating, median(rt_p) AS rt_rating,
             median(running_time_min) AS running_time_min FROM predicted GROUP BY g) mg ON mg.g = p.g
LEFT JOIN (SELECT d, median(production_budget) AS production_budget FROM predicted GROUP BY d) md
  ON md.d = p.d,
(SELECT median(imdb_rating) AS imdb_rating, median(rt_p) AS rt_rating,
   median(running_time_min) AS running_time_min, median(production_budget) AS production_budget
 FROM predicted) o"""


def tier_case(x: str, part: int) -> str:
    cases = " ".join(f"WHEN {x} < {t[0]} THEN {sql_text(t[part])}" for t in S.BUDGET_TIERS[:-1])
    return f"CASE WHEN {x} IS NULL THEN NULL {cases} ELSE {sql_text(S.BUDGET_TIERS[-1][part])} END"


RATIO = "CASE WHEN production_budget <> 0 THEN worldwide_gross / production_budget END"

_DERIVED = f"""
SELECT *, CAST(floor(release_year / 10.0) * 10 AS INT) AS decade,
  {tier_case('production_budget', 1)} AS budget_tier,
  {rounded('imdb_rating * 10 - rt_rating', 1)} AS rating_score_delta,
  CASE WHEN worldwide_gross IS NOT NULL AND production_budget IS NOT NULL
    THEN worldwide_gross >= {S.BLOCKBUSTER_GROSS} AND coalesce({RATIO}, 0) >= {S.BLOCKBUSTER_MULTIPLE}
    END AS blockbuster_flag,
  CASE WHEN ({RATIO}) IS NOT NULL THEN {rounded(f'least({RATIO}, {S.RATIO_CAP})', 3)} END AS profit_ratio
FROM imputed"""

_DUCK_TYPES = {"string": "VARCHAR", "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]"}


def duck_type(kind: str) -> str:
    return _DUCK_TYPES.get(kind, kind.upper())


_STORED = [c for c in S.STORED_TYPES
           if c not in ("embedding", "embedding_model", "pipeline_version", "augmented_text", "content_hash")]


def _cast() -> str:
    return "SELECT ord, " + ", ".join(
        f"CAST({c} AS {duck_type(S.STORED_TYPES[c])}) AS {c}" for c in _STORED
    ) + " FROM derived"


def _document() -> str:
    def observed(c: str) -> str:
        return f"NOT list_contains(imputed_fields, '{c}')"

    def unless_filled(label: str, c: str) -> str:
        return f"CASE WHEN {observed(c)} THEN '{label}: ' || {c} END"

    def known(c: str) -> str:
        return f"coalesce(CAST({c} AS VARCHAR), 'Unknown')"

    floors = " ".join(f"WHEN rt_rating >= {f} THEN {sql_text(p)}" for f, p in S.RECEPTIONS[:-1])
    reception = f"CASE {floors} ELSE {sql_text(S.RECEPTIONS[-1][1])} END"
    gap = f"{observed('rt_rating')} AND {observed('imdb_rating')}"
    lines = [
        "'Title: ' || title",
        unless_filled("Genre", "major_genre"),
        unless_filled("Director", "director"),
        unless_filled("MPAA Rating", "mpaa_rating"),
        f"'Release Year: ' || {known('release_year')}",
        f"'Runtime: ' || {known('running_time_min')} || ' minutes'",
        f"'IMDB Rating: ' || {known('imdb_rating')} || '/10 (' || "
        f"coalesce({thousands('imdb_votes')} || ' votes', 'vote count unknown') || ')'",
        f"'Rotten Tomatoes: ' || {known('rt_rating')} || '%'",
        f"'Budget: $' || coalesce({thousands('production_budget')}, 'unknown')",
        unless_filled("Distributor", "distributor"),
        unless_filled("Creative Type", "creative_type"),
        unless_filled("Source", "source"),
        "CASE WHEN release_year IS NOT NULL THEN 'Decade: ' || CAST(decade AS VARCHAR) || 's' END",
        f"CASE WHEN {observed('production_budget')} THEN 'Budget Tier: ' || "
        f"{tier_case('production_budget', 2)} END",
        f"CASE WHEN {observed('rt_rating')} THEN 'Critical Reception: ' || {reception} END",
        f"CASE WHEN {gap} AND rating_score_delta >= {S.AUDIENCE_GAP} THEN "
        f"'Audience Reception: {S.AUDIENCE_AHEAD}' WHEN {gap} AND rating_score_delta <= "
        f"-{S.AUDIENCE_GAP} THEN 'Audience Reception: {S.CRITICS_AHEAD}' END",
        f"'Box Office: $' || {thousands('worldwide_gross')} || ' worldwide, ' || "
        f"CASE WHEN blockbuster_flag THEN '{S.BIG_EARNER}' ELSE '{S.SMALL_EARNER}' END",
    ]
    return f"SELECT *, concat_ws(chr(10), {', '.join(lines)}) AS augmented_text FROM cast_rows"


def fingerprint(alias: str = "") -> str:
    def framed(c: str) -> str:
        kind = S.STORED_TYPES[c]
        text = f"array_to_string({alias}{c}, ',')" if kind.startswith("array") else f"CAST({alias}{c} AS VARCHAR)"
        return f"coalesce(CAST(length({text}) AS VARCHAR) || ':' || {text}, '-')"

    return f"sha256(concat_ws('|', {', '.join(framed(c) for c in S.HASHED_COLUMNS)}))"


def vectors(source: str, key: str, text: str) -> str:
    """Signed feature hashing of words into 64 places, scaled to unit length."""
    return f"""
WITH words AS (
  SELECT {key} AS k, md5(unnest(regexp_extract_all(lower({text}), '[a-z0-9]+'))) AS h FROM {source}),
places AS (
  SELECT k, (strpos('0123456789abcdef', h[1]) - 1) * 16 + strpos('0123456789abcdef', h[2]) - 1 AS byte,
    CASE WHEN h[3] < '8' THEN 1.0 ELSE -1.0 END AS sign FROM words),
sums AS (SELECT k, byte % {S.EMBEDDING_WIDTH} AS place, CAST(sum(sign) AS DOUBLE) AS v FROM places GROUP BY ALL),
lengths AS (SELECT k, sqrt(sum(v * v)) AS l FROM sums GROUP BY k)
SELECT k, list(CAST(CASE WHEN l = 0 THEN 0 ELSE coalesce(v, 0) / l END AS FLOAT) ORDER BY p.place) AS embedding
FROM lengths CROSS JOIN (SELECT unnest(range({S.EMBEDDING_WIDTH})) AS place) p
LEFT JOIN sums USING (k, place) GROUP BY k"""


STEPS: list[tuple[str, str]] = [
    ("raw", raw_records_sql()),
    ("named", f"SELECT ord, {RENAMED} FROM raw"),
    ("normal", _normal()),
    ("votes", _votes()),
    ("variants", _VARIANTS),
    ("voted", _voted()),
    ("typed", _typed()),
    ("keyed", _KEYED),
    ("cleaned", _CLEANED),
    ("grouped", _GROUPED),
    ("line", _LINE),
    ("predicted", _PREDICTED),
    ("imputed", _imputed()),
    ("derived", _DERIVED),
    ("cast_rows", _cast()),
    ("documented", _document()),
    ("enriched", f"SELECT *, {fingerprint()} AS content_hash FROM documented"),
    ("vectors", vectors("enriched", "source_key", "augmented_text")),
    ("snapshot", "SELECT sha256(source_key) AS id, e.*, v.embedding, 'hashed-words-64' AS embedding_model, "
                 "'1.0.0' AS pipeline_version, sha256(augmented_text) AS embedded_text_hash "
                 "FROM enriched e LEFT JOIN vectors v ON v.k = e.source_key"),
]


def upto(step: str, query: str, *more: tuple[str, str]) -> str:
    """``query`` over the chain up to ``step`` and further steps of its own."""
    names = [name for name, _ in STEPS]
    used = STEPS[: names.index(step) + 1] + list(more)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in used)
    return f"WITH {ctes}\n{query}"

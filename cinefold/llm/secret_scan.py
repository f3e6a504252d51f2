"""Secret scanning: candidates by shape, false positives removed by a random forest. DataFrame functions alone.

A candidate is every run of ``LEAST_RUN`` key characters or more in a word, every value of ``LEAST_NAMED`` characters or more behind a name that holds
secrets, and every such password of an address (``scheme://user:password@host``); a word may hold many. ``name=value`` is cut, and the name is the neighbour in
front. Its features: length; transitions between character
classes and how likely its letter pairs are among the corpus's words; dictionary coverage, the share of its letter
triples that the corpus's words have; the path (source and language) and the neighbouring words, hashed. Letter pairs and triples are
counted over all texts; there are at most 26 ** 3 of them, so their tables are of bounded size.

The forest is trained on labelled findings, at most ``LABELLED`` of them (those with the least hashes): a table of
``finding`` and ``secret``. ``labelled_by_format`` makes one from the findings whose published format or place decides. It is a teacher of rules, so a forest
trained by it is judged by formats it has not seen (``tests/llm``), not by rows held out; labelled findings of one's own are better.

Defined cases: null and empty texts have no candidate. Repeated rows repeat their findings. A null ``doc_id``, source or language is kept
and is a value of its own. An empty table, or labels of one class only, gives findings without a score; they are kept. Only
``doc_id``, ``text``, ``lang`` and ``source`` are looked at.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import words
from cinefold.session import step_table

LEAST_RUN, LEAST_NAMED = 16, 8
LABELLED = 20_000
TREES, DEPTH, SEED = 24, 8, 7
CUTOFF = 0.5
#: Published formats of keys, and names that hold secrets.
SECRET_FORMATS = [r"^AKIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}", r"^xox[baprs]-[A-Za-z0-9-]{10,}"]
NAME = "(?:password|passwd|secret|api_?key|token)"
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}"
PLAIN = rf"[A-Za-z_.-]{{1,64}}|[A-Za-z0-9_.-]{{1,{LEAST_RUN - 1}}}"  # a name; a long run with digits is a candidate itself
BEHIND_NAME = rf"""((?:{PLAIN})?(?i:{NAME}))["']?[=:]["']?([^\s"'&,;<>(){{}}\[\]]{{{LEAST_NAMED},}})"""
LOGIN = rf"://([^/@:\s]{{0,64}}):([^/@\s]{{{LEAST_NAMED},}})@"
BARE = rf"""(?:({PLAIN})["']?[=:]["']?)?({RUN})"""
FINDING = f"{BEHIND_NAME}|{LOGIN}|{BARE}"
HINT = rf"""[A-Za-z0-9+/_-]{{{LEAST_RUN}}}|(?i:{NAME})["']?[=:]|{LOGIN}"""  # what every word with a finding has
NUMERIC = ["length", "upper", "lower", "digits", "marks", "transitions", "pair_log", "coverage", "distinct_share"]
HASHED = ["before", "after", "source", "lang"]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: ``doc_id``, ``source``, ``lang``, ``position`` (word number), ``word``, ``part`` (number in the word), ``token``, whether
    it is ``behind`` a name of secrets or a ``login``, and its neighbours; that in front is the name in the word, if there is one."""
    split = docs.filter(F.col("text").rlike(HINT)).select("doc_id", "source", "lang", words(F.col("text")).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("position"), w.alias("word")))
    found = split.select("doc_id", "source", "lang", "words", F.explode(F.filter(placed, lambda p: p["word"].rlike(HINT))).alias("p"))
    at = F.col("p.position")
    group = lambda k: F.regexp_extract_all("p.word", F.lit(FINDING), F.lit(k))
    each = found.select(
        "doc_id", "source", "lang", at.cast("long").alias("position"), F.col("p.word").alias("word"),
        F.coalesce(F.get("words", at - 1), F.lit("")).alias("front"), F.coalesce(F.get("words", at - 2), F.lit("")).alias("second"),
        F.coalesce(F.get("words", at + 1), F.lit("")).alias("after"),
        F.posexplode(F.arrays_zip(*(group(k).alias(f"g{k}") for k in range(1, 7)))).alias("part", "g"))
    name = F.concat("g.g1", "g.g3", "g.g5")
    return each.select(
        "doc_id", "source", "lang", "position", "word", F.col("part").cast("long").alias("part"), F.concat("g.g2", "g.g4", "g.g6").alias("token"),
        (F.col("g.g2") != "").alias("behind"), (F.col("g.g4") != "").alias("login"),
        F.when(name != "", name).otherwise(F.col("front")).alias("before"), "second", "after")


def letter_grams(docs: DataFrame) -> DataFrame:
    """Counts of the letter pairs and triples of all words, by ``gram``: at most 26 ** 2 + 26 ** 3 rows.

    Words are counted first, so each different word is cut once.
    """
    letters = F.lower(F.regexp_replace(F.col("word"), "[^A-Za-z]", ""))
    each = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    plain = each.filter(~F.col("word").rlike(RUN)).select(letters.alias("w"), "n").filter(F.length("w") > 1).groupBy("w").agg(F.sum("n").alias("n"))
    grams = F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda size: F.when(
        F.length("w") >= size, F.transform(F.sequence(F.lit(1), F.length("w") - size + 1), lambda i: F.substring(F.col("w"), i, size)))
        .otherwise(F.array().cast("array<string>"))))
    return plain.select("n", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def _shapes(token: Column) -> list[Column]:
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)).cast("double")
    length = F.length(token).cast("double")
    change = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    return [length.alias("length"), (count("[A-Z]") / length).alias("upper"), (count("[a-z]") / length).alias("lower"),
            (count("[0-9]") / length).alias("digits"), (count("[+/_=-]") / length).alias("marks"),
            (count(change) / length).alias("transitions"),
            (F.size(F.array_distinct(F.split(token, ""))) / length).alias("distinct_share")]


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """``found`` with the numeric features beside; those of a token are made once for all its places."""
    tokens = found.select("token").distinct()
    letters = F.lower(F.regexp_replace("token", "[^A-Za-z]", ""))
    pieces = lambda size: F.when(F.length("w") >= size, F.transform(
        F.sequence(F.lit(1), F.length("w") - size + 1), lambda i: F.substring(F.col("w"), i, size))).otherwise(F.array().cast("array<string>"))
    cut = tokens.select("token", letters.alias("w")).select("token", F.explode_outer(F.concat(pieces(2), pieces(3))).alias("gram"))
    likely = F.when(F.length("gram") == 2, F.log1p(F.coalesce("n", F.lit(0))))
    told = F.when(F.length("gram") == 3, (F.coalesce("n", F.lit(0)) > 0).cast("double"))
    scored = cut.join(grams, "gram", "left").groupBy("token").agg(
        F.coalesce(F.avg(likely), F.lit(0.0)).alias("pair_log"), F.coalesce(F.avg(told), F.lit(0.0)).alias("coverage"))
    return found.join(scored.select("token", "pair_log", "coverage", *_shapes(F.col("token"))), "token")


def labelled_by_format(found: DataFrame) -> DataFrame:
    """Findings whose format or place decides: known key formats, values of secrets' names and passwords of addresses are secrets;
    numbers, other addresses and words without a digit are not."""
    secret = F.col("behind") | F.col("login") | (F.col("before").isin("=", ":") & F.col("second").rlike(f"(?i)^{NAME}$"))
    for pattern in SECRET_FORMATS:
        secret = secret | F.col("token").rlike(pattern)
    harmless = F.col("token").rlike(r"^[0-9+/_=-]+$|^[^0-9]+$") | F.col("word").rlike("@|://")
    return found.withColumn("secret", F.when(secret, 1.0).when(harmless, 0.0)).filter("secret IS NOT NULL")


def _visible(rows: DataFrame) -> DataFrame:
    """Null paths as a value of their own; the columns that the forest sees."""
    return rows.withColumns({f"_{c}": F.coalesce(c, F.lit("null")) for c in HASHED})


def train(labelled: DataFrame, limit: int = LABELLED, seed: int = SEED):
    """A fitted pipeline from rows with features and ``secret``; None if there is only one class. At most ``limit`` rows are used."""
    key = F.xxhash64("doc_id", "position", "part", "word", F.lit(seed))
    chosen = step_table(_visible(labelled).withColumn("_order", key).orderBy("_order", "position", "part").limit(limit), "labelled")
    if chosen.select("secret").distinct().count() < 2:
        return None
    hasher = FeatureHasher(inputCols=[f"_{c}" for c in HASHED], outputCol="_path", numFeatures=256)
    joined = VectorAssembler(inputCols=[*NUMERIC, "_path"], outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="secret", probabilityCol="_probability", rawPredictionCol="_raw",
                                    predictionCol="_predicted", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Pipeline(stages=[hasher, joined, forest]).fit(chosen)


def score(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the forest's ``score`` (null without a model)."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    kept = rows.columns
    return model.transform(_visible(rows)).select(*kept, vector_to_array("_probability")[1].alias("score"))


def scan(docs: DataFrame, labelled=labelled_by_format, cutoff: float = CUTOFF) -> DataFrame:
    """All findings with features, ``score`` and ``kept``: those that the forest does not take for false positives."""
    found = step_table(candidates(docs), "secret-candidates")
    rows = step_table(features(found, step_table(letter_grams(docs), "letter-grams")), "secret-features")
    scored = score(train(labelled(rows)), rows)
    return scored.withColumn("kept", F.coalesce(F.col("score") >= cutoff, F.lit(True)))

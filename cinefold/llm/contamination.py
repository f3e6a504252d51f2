"""Benchmark decontamination: every training passage asks a BM25 index of the test items.

Test items are indexed: a posting is a word's BM25 impact on an item, as a share of the score the item gives
itself, so one threshold suits all items. Documents are cut into passages of ``PASSAGE`` words that
overlap by half. Items of more than ``PART`` words, the overlap, are indexed in parts of exactly ``PART`` words that overlap by half (the last one
is moved back to full length), so any part lies whole in some passage. A passage's distinct
words are the query. As in WAND with block maxima, what can't reach the threshold is passed over by upper bounds: first by the words'
greatest impacts, where words that no item can reach the threshold with alone (``easy``) count once for all; then by the words'
greatest impacts per block of items. Items of blocks that are left are scored exactly, and all above the threshold are retrieved.

A retrieved item is verified as a whole: of the five-word shingles of its question (all lines but the last; the only line) and of its answer (the
last line), at least ``OVERLAP`` must be found in each, and of both together. An item of one part must be found in the passage, a longer one in the
document, wherever its parts stand. A question or answer shorter than five words is one shingle.

The index is cut into passes of about ``PASS_POSTINGS`` postings, an item whole in one of them, so what a task holds is bounded whatever the size of
the benchmark; there is one scan of the documents per pass. Within a pass parts are scored in shards of ``SHARD``.

Defined cases: null, empty and wordless texts and items match nothing. Words are runs of letters, digits and ``_``, lower-cased. Repeated rows get the
same answer. Empty tables give no rows. A null ``doc_id`` is kept. Items of equal text are all found. Only ``doc_id`` and ``text``, ``item_id`` and ``text`` are
looked at; ``drop_contaminated`` returns all columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices
from cinefold.session import step_table

K1, B = 1.2, 0.75
PASSAGE = 256
PART = PASSAGE // 2
THRESHOLD = 0.5  # share of an item's own score
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 16  # items whose impacts share a maximum
SHARD = 512
PASS_POSTINGS = 2_000_000

WORD = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double, passage int"


def _terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_id``, its words, and how many of them are the question's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                question, _, answer = (text or "").rstrip().rpartition("\n")
                if not _terms(question):
                    question, answer = answer, ""
                asked = _terms(question)
                terms = asked + _terms(answer)
                if terms:
                    for column, value in zip(out, (item, terms, len(asked))):
                        column.append(value)
            kinds = (pa.int64(), pa.list_(pa.string()), pa.int32())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds)], names=["item_id", "terms", "asked"])

    return benchmark.select("item_id", "text").mapInArrow(cut, "item_id long, terms array<string>, asked int")


def part_starts(n: int) -> list[int]:
    """Where the parts of an item of ``n`` words begin: one part if it is short, else full ones that overlap by half."""
    return [0] if n <= PART else [*range(0, n - PART, PART // 2), n - PART]


def index(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The indexed items: ``terms``, ``asked`` and aligned ``weights`` (inverse document frequencies), dealt to passes; the number of passes."""
    items = step_table(item_words(benchmark).distinct().withColumn("key", F.xxhash64("item_id", "terms", "asked")), "bm25-items")
    size = items.agg(F.count("*"), F.avg(F.least(F.size("terms"), F.lit(PART))), F.sum(F.size("terms"))).first()
    n, mean, postings = size[0], size[1] or 1.0, size[2] or 0
    words = items.select("key", F.explode(F.array_distinct("terms")).alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = words.join(counts, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", idf))).alias("idf"))
    passes = max(1, math.ceil(postings / PASS_POSTINGS))
    joined = items.join(weighed, "key").select(
        "item_id", "terms", "asked", F.transform("terms", lambda t: F.col("idf")[t]).alias("weights"),
        F.lit(float(mean)).alias("mean"), F.pmod("key", F.lit(passes)).alias("pass"))
    return step_table(joined, "bm25-index"), passes


class Shard:
    """Some parts' postings as dense tables over the words they use; word 0 is any other."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray, float]], words: int, threshold: float):
        self.items = [part[0] for part in parts]
        width = -len(parts) % BLOCK + len(parts)
        used = np.unique(np.concatenate([part[1] for part in parts]))
        self.column = np.zeros(words + 1, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        impact = np.zeros((len(used) + 1, width), np.float32)
        for j, (_, sequence, weights, mean) in enumerate(parts):
            term, first, tf = np.unique(sequence, return_index=True, return_counts=True)
            score = weights[first] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(sequence) / mean))
            impact[self.column[term], j] = score / score.sum()
        self.impact, self.threshold = impact, threshold
        self.block = impact.reshape(len(used) + 1, -1, BLOCK).max(axis=2)
        greatest = impact.max(axis=1)
        # Easy words: the least telling ones, as many as can't bring any item half way.
        order = np.argsort(greatest, kind="stable")
        reached = np.cumsum(impact[order], axis=0).max(axis=1)
        easy = order[reached < threshold / 2]
        self.easy = float(impact[easy].sum(axis=0).max()) if len(easy) else 0.0
        telling = greatest.copy()
        telling[easy] = 0
        self.telling = telling[self.column]  # by word of the vocabulary

    def search(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, part, score) above the threshold, for passages ``words[start:end]``."""
        bound = np.concatenate([[0.0], np.cumsum(self.telling[words], dtype=np.float64)])
        slack, within = 1e-4, np.arange(BLOCK)
        for p in np.flatnonzero(bound[ends] - bound[starts] + self.easy + slack >= self.threshold).tolist():
            query = np.unique(self.column[words[starts[p]:ends[p]]])
            query = query[query > 0]
            alive = np.flatnonzero(self.block[query].sum(axis=0) + slack >= self.threshold)
            if len(alive):
                items = (alive[:, None] * BLOCK + within).ravel()
                scores = self.impact[query][:, items].sum(axis=0, dtype=np.float64)
                for j in np.flatnonzero(scores >= self.threshold).tolist():
                    yield p, int(items[j]), float(scores[j])


def _overlaps(text: np.ndarray, sequence: np.ndarray, asked: int) -> tuple[float, float, float]:
    """Of question, answer and both: the share of shingles found in ``text``. An absent part counts as found.

    Only windows of ``text`` that consist of the item's words are compared, so a long document costs one look at each word.
    """
    known = np.isin(text, sequence)

    def share(part: np.ndarray) -> float:
        size = min(SHINGLE, len(part))
        if not size:
            return 1.0
        own = [part[i:i + size].tobytes() for i in range(len(part) - size + 1)]
        wanted, found = set(own), set()
        if len(text) >= size:
            run = np.concatenate([[0], np.cumsum(known)])
            for i in np.flatnonzero(run[size:] - run[:-size] == size).tolist():
                shingle = text[i:i + size].tobytes()
                if shingle in wanted:
                    found.add(shingle)
        return sum(shingle in found for shingle in own) / len(own)

    return share(sequence[:asked]), share(sequence[asked:]), share(sequence)


class Searcher:
    """One pass of the index, held by a task: about ``PASS_POSTINGS`` postings."""

    def __init__(self, items: list, threshold: float, overlap: float):
        items = sorted(items, key=lambda item: (item["item_id"] is None, item["item_id"] or 0, item["terms"]))
        self.vocabulary: dict[str, int] = {}
        for item in items:
            for term in item["terms"]:
                self.vocabulary.setdefault(term, len(self.vocabulary) + 1)
        self.ids = [item["item_id"] for item in items]
        self.asked = [item["asked"] for item in items]
        self.sequences = [np.array([self.vocabulary[t] for t in item["terms"]], np.int64) for item in items]
        parts = []
        for j, (item, sequence) in enumerate(zip(items, self.sequences)):
            weights = np.array(item["weights"])
            parts += [(j, sequence[k:k + PART], weights[k:k + PART], item["mean"]) for k in part_starts(len(sequence))]
        self.shards = [Shard(parts[i:i + SHARD], len(self.vocabulary), threshold) for i in range(0, len(parts), SHARD)]
        self.overlap = overlap

    def matches(self, texts: list[str | None]) -> Iterator[tuple]:
        """(row, item id, score, overlaps of question, answer and both, passage) of verified items, the best passage of each."""
        known, words, ends = self.vocabulary.get, [], []
        for text in texts:
            words.extend([known(t, 0) for t in _terms(text)])
            ends.append(len(words))
        if not self.shards or not words:
            return
        flat = np.array(words, np.int64)
        stop = np.array(ends)
        start = np.concatenate([[0], stop[:-1]])
        count = np.where(stop > start, np.maximum(1, -(-(stop - start - PART) // PART)), 0)
        row = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = start[row] + number * PART
        last = np.minimum(first + PASSAGE, stop[row])
        best: dict[tuple[int, int], tuple] = {}
        retrieved: dict[tuple[int, int], tuple] = {}  # items of several parts, with their best part's score
        for shard in self.shards:
            for p, part, score in shard.search(flat, first, last):
                j = shard.items[part]
                key, place = (int(row[p]), j), -int(number[p])
                if len(self.sequences[j]) > PART:
                    retrieved[key] = max(retrieved.get(key, (score, place)), (score, place))
                    continue
                asked, answered, both = _overlaps(flat[first[p]:last[p]], self.sequences[j], self.asked[j])
                if min(asked, answered, both) >= self.overlap:
                    found = (both, score, place, asked, answered)
                    best[key] = max(best.get(key, found), found)
        for (i, j), (score, place) in retrieved.items():
            asked, answered, both = _overlaps(flat[start[i]:stop[i]], self.sequences[j], self.asked[j])
            if min(asked, answered, both) >= self.overlap:
                best[i, j] = (both, score, place, asked, answered)
        for (i, j), (both, score, place, asked, answered) in best.items():
            yield i, self.ids[j], score, asked, answered, both, -place


def _searchers(benchmark: DataFrame, threshold: float, overlap: float) -> list:
    """One broadcast per pass; each is bounded by ``PASS_POSTINGS``."""
    parts, passes = index(benchmark)
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(passes):
        held = [row.asDict() for row in parts.filter(F.col("pass") == k).toLocalIterator()]
        out.append(context.broadcast((held, threshold, overlap)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item found in it, with the score and the overlaps of the best passage (items of several parts: of the document)."""

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*held.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[m[0]], *m[1:]) for m in searcher.matches(part.column("text").to_pylist())]
                    kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int32())
                    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap", "passage"]
                    columns = list(zip(*found)) or [()] * len(kinds)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        return run

    asked = docs.select("doc_id", "text")
    found = [asked.mapInArrow(search(held), MATCHES) for held in _searchers(benchmark, threshold, overlap)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no test item is found; one pass over the rows, nothing is shuffled."""

    def clean(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*held.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in searcher.matches(part.column("text").to_pylist())]] = False
                    yield part.filter(pa.array(keep))
        return run

    for held in _searchers(benchmark, threshold, overlap):
        docs = docs.mapInArrow(clean(held), docs.schema)
    return docs

"""Embedding as a column: prefixing, batching, failure isolation and the offline embedder."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.functions import text
from cinefold.schemas import EMBEDDING_WIDTH

Vectors = list[list[float]]
EMBEDDED = "vector array<float>, error string, batch_head boolean"
# Vectors that a worker holds as Python numbers at once; an Arrow batch may have many times more rows.
PIECE_TEXTS = 1 << 9


class Rejected(RuntimeError):
    """The service refuses this input; asking again cannot help."""


@dataclass(frozen=True)
class Embedder:
    """How to get vectors: ``connect`` runs once per task and gives a texts-to-vectors function.

    Errors other than ``Rejected`` count as passing and are tried again ``attempts`` times in all.
    """

    model: str
    connect: Callable[[], Callable[[list[str]], Vectors]]
    width: int = EMBEDDING_WIDTH
    prefix: str = ""
    batch_size: int = 32
    batch_limit: int | None = None
    attempts: int = 5
    first_wait: float = 1.0
    longest_wait: float = 20.0
    tasks: int | None = None

    @property
    def batch(self) -> int:
        return min(self.batch_size, self.batch_limit or self.batch_size)


def hashed_words() -> Callable[[list[str]], Vectors]:
    """Signed feature hashing of lower-case words, scaled to unit length. Needs no service."""
    width, words = EMBEDDING_WIDTH, re.compile(r"[a-z0-9]+")

    def place(word: str) -> int:
        """The places of negative words follow those of positive ones."""
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:2], 16) % width + (0 if digest[2] < "8" else width)

    def embed(texts: list[str]) -> Vectors:
        out = np.zeros((len(texts), width))
        # "İ" lower-cased is "i" and a combining dot, which would end the word; no other letter has two.
        found_in = [words.findall(content.replace("İ", "i").lower()) for content in texts]
        places = {word: place(word) for word in set().union(*found_in)}  # of this batch alone
        for row, words_of_text in enumerate(found_in):
            found = [places[word] for word in words_of_text]
            counts = np.bincount(found, minlength=2 * width) if found else np.zeros(2 * width)
            out[row] = counts[:width] - counts[width:]
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths == 0, 1.0, lengths)).tolist()

    return embed


def offline_embedder(**options) -> Embedder:
    return Embedder("hashed-words-64", hashed_words, **options)


def _call(service: Callable[[list[str]], Vectors], texts: list[str], plan: Embedder) -> Vectors:
    wait = plan.first_wait
    for attempt in range(1, plan.attempts + 1):
        try:
            vectors = service(texts)
            break
        except Rejected:
            raise
        except Exception:
            if attempt == plan.attempts:
                raise
            time.sleep(wait)
            wait = min(wait * 2, plan.longest_wait)
    if any(len(v) != plan.width for v in vectors):
        raise Rejected(f"expected vectors of width {plan.width}")
    return vectors


def embed_batch(
    service: Callable[[list[str]], Vectors], texts: list[str], plan: Embedder
) -> list[tuple[list[float] | None, str | None]]:
    """Vectors of one batch; when it fails, each text on its own, so one bad text loses only itself."""
    try:
        return [(v, None) for v in _call(service, texts, plan)]
    except Exception as problem:
        if len(texts) == 1:
            return [(None, f"{type(problem).__name__}: {problem}")]
    out: list[tuple[list[float] | None, str | None]] = []
    for one in texts:
        out.extend(embed_batch(service, [one], plan))
    return out


def embedded(content: Column, plan: Embedder) -> Column:
    """Struct of vector, error and whether the row opened a batch; NULL texts are passed over.

    The column stays in its row, so nothing is shuffled or joined back, and only the
    text travels to the Python worker. It hands over a few batches' vectors at a time, so what it holds does not grow with the
    rows of an Arrow batch.
    """

    @F.pandas_udf(EMBEDDED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        service = plan.connect()
        for texts in parts:
            present = np.flatnonzero(texts.notna().to_numpy())
            step = plan.batch * max(1, PIECE_TEXTS // plan.batch)
            first = 0
            for start in range(0, max(1, len(present)), step):
                # Up to the first text of the next piece.
                last = present[start + step] if start + step < len(present) else len(texts)
                yield piece(service, texts.iloc[first:last], present[start : start + step] - first)
                first = last

    def piece(service: Callable[[list[str]], Vectors], texts: pd.Series, present: np.ndarray) -> pd.DataFrame:
        vectors: list = [None] * len(texts)
        errors: list = [None] * len(texts)
        heads = [False] * len(texts)
        for start in range(0, len(present), plan.batch):
            rows = present[start : start + plan.batch]
            heads[rows[0]] = True
            answers = embed_batch(service, [texts.iloc[r] for r in rows], plan)
            for row, (vector, error) in zip(rows, answers):
                vectors[row], errors[row] = vector, error
        return pd.DataFrame({"vector": vectors, "error": errors, "batch_head": heads})

    return run(text.with_prefix(plan.prefix, content))


def require_service(plan: Embedder) -> None:
    """One probe before a run: a model of another width is an error, not a failed row."""
    width = len(plan.connect()(["dimension probe"])[0])
    if width != plan.width:
        raise ValueError(f"the service returns {width} dimensions, the table holds {plan.width}")


def require_stored_width(snapshot: DataFrame, width: int, vector: str = "embedding") -> None:
    """The stored vectors have one width, so one of them tells it."""
    row = snapshot.filter(F.col(vector).isNotNull()).select(F.size(vector)).head(1)
    if row and row[0][0] != width:
        raise ValueError(f"the stored vectors have {row[0][0]} dimensions, the service {width}")


def text_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def wrong_widths(frame: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """One row: vectors of another width than the contract's."""
    return frame.agg(F.count_if(F.size(vector) != width).alias("wrong_width"))


def require_width(frame: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    wrong = wrong_widths(frame, width, vector).first()[0]
    if wrong:
        raise ValueError(f"{wrong} vectors in '{vector}' are not {width} wide")
    return frame

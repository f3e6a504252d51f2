"""Client of an HTTP service that turns texts into vectors."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from cinefold.operators.embedding import Embedder, Rejected, Vectors


def http_embedder(url: str, model: str, width: int, timeout: float = 120.0, **options) -> Embedder:
    """An embedder over ``POST {url}/embed``.

    Answers of 429 and of 500 and above are tried again, other refusals are not.
    """

    def connect() -> Callable[[list[str]], Vectors]:
        def embed(texts: list[str]) -> Vectors:
            body = json.dumps({"inputs": texts, "normalize": True, "truncate": True}).encode()
            request = urllib.request.Request(
                url.rstrip("/") + "/embed", body, {"Content-Type": "application/json"}
            )
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as problem:
                if problem.code == 429 or problem.code >= 500:
                    raise
                raise Rejected(f"{problem.code} {problem.read()!r}") from problem

        return embed

    return Embedder(model, connect, width, **options)

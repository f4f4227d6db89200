"""Embedding providers: where vectors come from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class ProviderError(ValueError):
    """A provider is missing, incomplete, or gave a wrong answer."""


@dataclass(frozen=True)
class Reply:
    """What a provider says of a text: its vector, or the reason why there is none; the
    tokens that were used and those that were cut off."""

    vector: list[float] | None
    tokens: int = 0
    truncated: int = 0
    reason: str | None = None


class EmbeddingProvider:
    """``compute`` gives a vector or a ``Reply`` for each text.  One instance serves a Python worker.  Subclasses give ``compute``; a
    constructor that raises means the model can't be used.  Keys for remote
    services are constructor arguments and are never stored; ``needs_key`` tells
    that a model can't be chosen without ``api_key``."""

    needs_key = False

    def __init__(self, model: str, **settings: object):
        self.model = model

    def compute(self, texts: list[str]) -> list[list[float] | Reply]:
        raise NotImplementedError

    def warm_up(self) -> None:
        self.compute(["warm-up"])


class HashingProvider(EmbeddingProvider):
    """Deterministic vectors of hashed words, of length 1: no model file and no
    network.  ``model`` is the dimension, e.g. ``"64"``."""

    def __init__(self, model: str, **settings: object):
        super().__init__(model)
        self.dimension = int(model)

    def compute(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()) or [""]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1.0 if h >> 63 else -1.0
            row /= max(np.linalg.norm(row), 1e-12)
        return out.astype(np.float32).tolist()


_registry: dict[str, Callable[..., EmbeddingProvider]] = {"hashing": HashingProvider}


def register_provider(name: str, factory: Callable[..., EmbeddingProvider]) -> None:
    """Make ``factory(model, **settings)`` available under ``name``; a second call replaces the first."""
    if not callable(factory) or not callable(getattr(factory, "compute", None)):
        raise ProviderError("a provider needs a constructor and compute()")
    _registry[name.lower()] = factory


def provider_factory(name: str | None) -> Callable[..., EmbeddingProvider]:
    if not name or name.lower() not in _registry:
        raise ProviderError(f"unknown provider: {name!r}; set a model first" if not name else f"unknown provider: {name!r}")
    return _registry[name.lower()]


#: Times that a text is given to a provider that raises.
ATTEMPTS = 3
ANSWER = "embedding array<float>, reason string, attempts int, tokens long, truncated long"


def answers(provider: EmbeddingProvider, texts: list[str], attempts: int = ATTEMPTS) -> list[tuple[Reply, int]]:
    """A reply for each text, and how often the text was tried.

    Where ``compute`` raises, its texts are tried in halves, so that one that can't be
    embedded takes no other with it; alone, a text gets ``attempts`` tries.  A provider
    that gives another number of answers than texts is broken: that is an error."""
    if not texts:
        return []
    reason = ""
    for tried in range(1, attempts + 1 if len(texts) == 1 else 2):
        try:
            given = provider.compute(texts)
        except Exception as error:
            reason = f"{type(error).__name__}: {error}"
            continue
        if len(given) != len(texts):
            raise ProviderError("a provider must give one vector for each text")
        found = [g if isinstance(g, Reply) else Reply(g) for g in given]
        return [(r if r.vector is not None or r.reason else Reply(None, r.tokens, r.truncated, "no vector"), tried) for r in found]
    if len(texts) == 1:
        return [(Reply(None, reason=reason), attempts)]
    half = len(texts) // 2
    return answers(provider, texts[:half], attempts) + answers(provider, texts[half:], attempts)


def embed(rows: DataFrame, text: str, name: str, model: str, settings: dict | None = None) -> DataFrame:
    """``rows`` plus ``ANSWER``: the provider lives once in each worker and sees batches.  A text
    that gets no vector has a reason instead."""
    factory, settings, attempts = provider_factory(name), dict(settings or {}), ATTEMPTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory(model, **settings)
        for pdf in batches:
            found = answers(provider, pdf[text].tolist(), attempts)
            vectors = [None if r.vector is None else np.asarray(r.vector, dtype=np.float32) for r, _ in found]
            yield pdf.assign(embedding=vectors, reason=[r.reason for r, _ in found], attempts=[n for _, n in found], tokens=[r.tokens for r, _ in found], truncated=[r.truncated for r, _ in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, {ANSWER}")

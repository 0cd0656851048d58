"""Interfaces to what needs a network or a model, with the plain defaults of tests."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Texts to vectors of one size."""

    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Scores of texts for a question, in their order."""

    def rerank(self, question: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    """An answer to a prompt."""

    def generate(self, prompt: str, max_tokens: int) -> str: ...


class Fetcher(Protocol):
    """Bytes of an address, with their type; conditional where a mark of the last fetch is given."""

    def fetch(self, url: str, etag: str | None = None) -> tuple[int, bytes, str]: ...


class PageReader(Protocol):
    """Text and confidence of each page of a file."""

    def pages(self, content: bytes) -> list[tuple[str, float]]: ...


class ProviderError(RuntimeError):
    """A provider failed."""


class ProviderTimeout(ProviderError):
    """It took too long."""


class ProviderQuota(ProviderError):
    """Too much was asked of it."""


class ProviderNetwork(ProviderError):
    """It can't be reached."""


def provider_error(status: int | None, message: str) -> ProviderError:
    """The error for a status: 429 quota, 408 and 504 timeout, none network."""
    kind = ProviderQuota if status == 429 else ProviderTimeout if status in (408, 504) else ProviderNetwork if status is None else ProviderError
    return kind(message)


def retried(call: Callable[[], object], times: int = 3, wait: float = 0.5, jitter: float = 0.25, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call again on network errors and quota, waiting twice as long each time with some jitter."""
    for n in range(times):
        try:
            return call()
        except (ProviderNetwork, ProviderQuota):
            if n == times - 1:
                raise
            sleep(wait * 2**n * (1 + random.uniform(-jitter, jitter)))
    raise AssertionError


def split_long(text: str, length: Callable[[str], int], most: int) -> list[str]:
    """Halves of a text, at the space or line end nearest to the middle, until each is short enough."""
    if length(text) <= most or len(text) < 2:
        return [text]
    mid = len(text) // 2
    at = min((i for i, c in enumerate(text) if c in " \n" and 0 < i < len(text) - 1), key=lambda i: abs(i - mid), default=mid)
    return split_long(text[:at], length, most) + split_long(text[at:].lstrip(), length, most)


def embed_all(embedder: Embedder, texts: list[str], batch: int = 64) -> list[list[float]]:
    """Embed in batches; a batch that is refused is halved down to single texts."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        try:
            got = embedder.embed(part)
        except ProviderError:
            if len(part) == 1:
                raise
            got = embed_all(embedder, part, len(part) // 2)
        if len(got) != len(part) or any(len(v) != embedder.size for v in got):
            raise ProviderError("the embedder gave vectors of another number or size")
        out += got
    return out


def ask_with_repair(generate: Generator, prompt: str, check: Callable[[str], str | None], refusal: str, max_tokens: int = 1024, repair_tokens: int = 256) -> str:
    """Generate, check, repair the citations once, check, else refuse."""
    answer = generate.generate(prompt, max_tokens)
    reason = check(answer)
    if reason is None:
        return answer
    repaired = generate.generate(f"{prompt}\n\nCorrija somente as citações ({reason}):\n{answer}", repair_tokens)
    return repaired if check(repaired) is None else refusal


def embedded(embedder: Embedder, text: Column, batch: int = 64) -> Column:
    """Vectors of a text column through an embedder that can be sent to the workers; null for null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        given = [i for i, x in enumerate(v) if x is not None]
        out: list[list[float] | None] = [None] * len(v)
        for i, x in zip(given, embed_all(embedder, [v.iloc[i] for i in given], batch), strict=True):
            out[i] = x
        return pd.Series(out)

    return run(text)


def reranked(reranker: Reranker, question: Column, text: Column) -> Column:
    """Scores of texts for questions; rows of one question in a batch are scored together, null for a null text."""

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(t), dtype="Float64")
        known = pd.DataFrame({"q": q.to_numpy(), "t": t.to_numpy()}).dropna()
        for asked, part in known.groupby("q"):
            scores = reranker.rerank(asked, part["t"].tolist())
            if len(scores) != len(part):
                raise ProviderError("the reranker gave another number of scores")
            out.iloc[part.index] = scores
        return out.astype("float64")

    return run(question, text)

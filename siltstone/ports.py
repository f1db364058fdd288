"""Extension points: models and remote services behind small protocols, each with a deterministic default.

Nothing here reaches a network. A caller plugs in its own implementation; the defaults keep every pipeline runnable.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vectors import seeded_vector

QUERY_PREFIX = "Represent this sentence for searching: "


class Embedder(Protocol):
    name: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Generator(Protocol):
    name: str

    def generate(self, prompt: str) -> str: ...


class Fetcher(Protocol):
    """Bytes of an address (pages, feeds, documents)."""

    def fetch(self, address: str) -> bytes: ...


class PageParser(Protocol):
    """Pages of a binary document: (page_number, text)."""

    def pages(self, content: bytes) -> list[tuple[int, str]]: ...


class SeededEmbedder:
    """Vectors drawn by the digest of a text; they carry no likeness of meaning."""

    def __init__(self, dim: int = 384):
        self.dim, self.name = dim, f"seeded-{dim}"

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.vstack([seeded_vector(t, self.dim) for t in texts]) if len(texts) else np.zeros((0, self.dim), np.float32)


class EchoGenerator:
    """Says that no model is there."""

    name = "fallback"

    def generate(self, prompt: str) -> str:
        return ""


class PlainPages:
    """Text that is already extracted: form feeds part the pages, and bytes that are no text give one empty page."""

    def pages(self, content: bytes) -> list[tuple[int, str]]:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError:
            text = ""
        return list(enumerate(text.split("\f"), 1))


def embed_column(df: DataFrame, key: str, text: str, embedder: Embedder, query: bool = False) -> DataFrame:
    """key, embedding: batches of texts through an embedder; the model is loaded once for each worker's stream."""
    prefix = QUERY_PREFIX if query else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [v.tolist() for v in embedder.embed([prefix + (t or "") for t in b[text]])]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def hypothetical(questions: DataFrame, generator: Generator | None = None, least: int = 30) -> DataFrame:
    """``questions`` with ``passage``: a generated passage longer than ``least``, else the question itself."""
    if generator is None:
        return questions.withColumn("passage", F.col("question"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [generator.generate(q) for q in b["question"]]
            yield pd.DataFrame({"query_id": b["query_id"], "passage": [s if len(s) > least else q for s, q in zip(said, b["question"], strict=True)]})

    return questions.join(questions.select("query_id", "question").mapInPandas(run, "query_id long, passage string"), "query_id")


class KeyRing:
    """Keys taken in turn when one runs into its quota."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.at = list(keys), 0

    def call(self, use):
        for _ in self.keys:
            try:
                return use(self.keys[self.at])
            except PermissionError:
                self.at = (self.at + 1) % len(self.keys)
        raise PermissionError("every key is out of quota")


def generated(questions: DataFrame, generator: Generator | None, contexts: DataFrame | None = None) -> DataFrame:
    """query_id, answer, provider: a generator's answers (null where it gives none); without one the provider is extractive."""
    if generator is None:
        return questions.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit("extractive").alias("provider"))
    asked = questions.join(contexts, "query_id", "left") if contexts is not None else questions.withColumn("context", F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [generator.generate(f"{c or ''}\n\n{q}") or None for q, c in zip(b["question"], b["context"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "answer": said, "provider": [generator.name] * len(b)})

    return asked.select("query_id", "question", "context").mapInPandas(run, "query_id long, answer string, provider string")


def refine(chunks: DataFrame, hook) -> DataFrame:
    """What a caller's hook makes of rejected chunks; nothing where none is set."""
    return hook(chunks) if hook else chunks.limit(0)


def fetched(addresses: DataFrame, fetcher: Fetcher | None) -> DataFrame:
    """``addresses`` (url, held) with ``content``: what a fetcher gets, or what the table already holds."""
    if fetcher is None:
        return addresses.withColumn("content", F.col("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[fetcher.fetch(u) for u in b["url"]])

    kinds = ", ".join(f"{n} {k}" for n, k in addresses.dtypes)
    return addresses.mapInPandas(run, f"{kinds}, content binary")

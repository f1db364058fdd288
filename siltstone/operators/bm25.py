"""An inverted index as tables, and BM25 over it.

``postings`` (term, chunk_id, tf) is the large table and is meant to be written bucketed by term; ``lengths`` and ``terms``
follow from it. ``top`` finds the best chunks of a batch of questions block by block; ``search`` scores every pair that shares a
term, for those who want them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators import blocks

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame


def build(chunks: DataFrame, tokenizer=tokens, key: str = "chunk_id", text: str = "text") -> Index:
    """Postings, lengths of chunks and inverse document frequencies (negative ones become a share of the mean)."""
    words = chunks.select(key, tokenizer(F.col(text)).alias("t")).repartition(F.col(key))  # the only exchange of texts: what follows is keyed by it
    lengths = words.select(key, F.size("t").cast("long").alias("dl"))
    postings = words.select(key, F.explode("t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    return Index(postings, lengths, _idf(words.select(F.explode(F.array_distinct("t")).alias("term")), lengths))


def _terms(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    return _idf(postings.select("term"), lengths)


def _idf(occurrences: DataFrame, lengths: DataFrame) -> DataFrame:
    """term, df, mean_dl and idf from one row for each chunk that has a term."""
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean_dl"))
    raw = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "mean_dl", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def add(index: Index, chunks: DataFrame, tokenizer=tokens, key: str = "chunk_id") -> Index:
    """The index with chunks added; those known by id are replaced."""
    return _merge(remove(index, chunks.select(key), key), build(chunks, tokenizer, key), key)


def remove(index: Index, ids: DataFrame, key: str = "chunk_id") -> Index:
    postings, lengths = (t.join(ids.select(key).distinct(), key, "left_anti") for t in (index.postings, index.lengths))
    postings = postings.select("term", key, "tf")
    return Index(postings, lengths, _terms(postings, lengths))


def _merge(a: Index, b: Index, key: str) -> Index:
    postings, lengths = a.postings.select("term", key, "tf").unionByName(b.postings.select("term", key, "tf")), a.lengths.unionByName(b.lengths)
    return Index(postings, lengths, _terms(postings, lengths))


def top(index: Index, questions: DataFrame, k: int, keep_zero: bool = False, text: str = "question", tokenizer=tokens, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score, rank of the ``k`` best chunks of each question."""
    asked = questions.select("query_id", F.explode(tokenizer(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    weights = index.terms.join(F.broadcast(asked), "term").select("query_id", F.col("term").alias("place"), (F.col("qn") * F.col("idf") * (K1 + 1)).alias("w"))  # a batch of questions
    mean = index.lengths.agg(F.avg("dl")).first()[0] or 1.0
    held = index.postings.join(index.lengths, key).select(key, F.col("term").alias("place"), (F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))).alias("w"))
    return blocks.top(weights, held, key, k, keep_zero)


def search(index: Index, questions: DataFrame, text: str = "question", tokenizer=tokens, key: str = "chunk_id") -> DataFrame:
    """query_id, chunk_id, score of every chunk that shares a term; a repeated question term counts again."""
    asked = questions.select("query_id", F.explode(tokenizer(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    found = index.postings.join(asked.join(index.terms, "term"), "term").join(index.lengths, key)
    part: Column = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    return found.groupBy("query_id", key).agg(F.sum(part).alias("score"))

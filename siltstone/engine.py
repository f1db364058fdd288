"""The engine behind a few calls: ingest, update, ask and evaluate over one folder of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import metrics
from siltstone.operators.postings import Postings
from siltstone.operators.tables import Bucketed, exists
from siltstone.plans import answer, retrieve


class Engine:
    """Chunks (chunk_id, paper_id, section, ordinal, text, ...) in buckets of their paper, and an inverted index over them, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.chunks = Bucketed(spark, f"{folder}/chunks", "paper_id")
        self.index = Postings(spark, f"{folder}/postings")

    def ingest(self, chunks: DataFrame) -> Engine:
        """Chunks are added; those of papers that are known make way for the new ones."""
        if not exists(self.spark, f"{self.chunks.path}/schema"):
            self.chunks.create(chunks)
            self.index.create(chunks)
            return self
        fresh = chunks.select("paper_id").distinct()
        self.index.remove(self.chunks.rows_of(fresh).select("chunk_id"))
        self.index.add(chunks)
        self.chunks.replace(chunks)
        return self

    def delete(self, papers: DataFrame) -> Engine:
        self.index.remove(self.chunks.rows_of(papers).select("chunk_id"))
        self.chunks.remove(papers)
        return self

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """query_id, chunk_id, score, rank."""
        return retrieve.lexical(questions, self.index, k)

    def ask(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """query_id, answer, cited: extractive answers with their chunks."""
        hits = self.search(questions, k).join(self.chunks.read().select("chunk_id", "text"), "chunk_id")
        return answer.extractive(questions.select("query_id", "question"), hits)

    def evaluate(self, questions: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
        """query_id and retrieval metrics against ``relevant`` (query_id, item: chunk ids)."""
        return metrics.retrieval_metrics(self.search(questions, k).select("query_id", F.col("chunk_id").alias("item"), "rank"), relevant, k)

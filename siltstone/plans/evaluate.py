"""Evaluation of retrieval over real configurations of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import bm25, fusion, metrics
from siltstone.operators.postings import Postings
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans import retrieve
from siltstone.session import checkpointed

#: Configurations by name: lists that are searched, whether hits are re-ranked, hits of a section before others come first.
CONFIGURATIONS = {
    "full": (("dense", "bm25", "claim"), True, 3),
    "no_dense": (("bm25", "claim"), True, 3),
    "no_bm25": (("dense", "claim"), True, 3),
    "no_claims": (("dense", "bm25"), True, 3),
    "no_rerank": (("dense", "bm25", "claim"), False, 3),
    "no_cap": (("dense", "bm25", "claim"), True, 1_000),
}


def ablation(questions: DataFrame, relevant: DataFrame, chunks: DataFrame, claims: DataFrame, index: bm25.Index | Postings, k: int = 10, vectors: VectorIndex | None = None, claim_vectors: VectorIndex | None = None) -> DataFrame:
    """config, query_id and the metrics of each configuration's hits against ``relevant`` (query_id, item: chunk ids).

    The three searches run once for all, and texts are read once for what they find; a configuration fuses what it is allowed to see.
    Configurations that differ in nothing else are fused together: a question counts once for each of them.
    """
    every = checkpointed(retrieve.lists(questions, chunks, claims, index, k, vectors, claim_vectors))
    near = fusion.bodies(every.select("chunk_id").distinct(), chunks.select("chunk_id", "paper_id", "section", "text", "content_type"))
    names = every.sparkSession.createDataFrame([(name, list(seen)) for name, (seen, _, _) in CONFIGURATIONS.items()], "config string, seen array<string>")
    own = F.xxhash64("query_id", "config").alias("query_id")
    asked = checkpointed(questions.select("query_id", "question").crossJoin(F.broadcast(names.select("config"))).select(own, F.col("query_id").alias("of"), "config", "question"))
    seen = every.crossJoin(F.broadcast(names)).filter(F.array_contains("seen", F.col("list"))).select(own, "config", "chunk_id", "list", "rank", "claim")
    hits = None
    for rerank, cap in dict.fromkeys((rerank, cap) for _, rerank, cap in CONFIGURATIONS.values()):
        alike = [name for name, (_, *how) in CONFIGURATIONS.items() if how == [rerank, cap]]
        some = retrieve.merged(asked.filter(F.col("config").isin(alike)).select("query_id", "question"), near, seen.filter(F.col("config").isin(alike)).drop("config"), k, cap, rerank)
        some = checkpointed(some.select("query_id", F.col("chunk_id").alias("item"), F.col("position").alias("rank")))
        hits = some if hits is None else hits.unionByName(some)
    judged = checkpointed(relevant.select("query_id", "item").distinct()).crossJoin(F.broadcast(names.select("config"))).select(own, "item")
    return metrics.retrieval_metrics(hits, judged, k).join(asked.select("query_id", "of", "config"), "query_id").drop("query_id").withColumnRenamed("of", "query_id")

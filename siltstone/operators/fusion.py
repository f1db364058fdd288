"""Ranking, fusion and diversity over ranked lists keyed by query. All ranks break ties by chunk_id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import checkpointed

#: Hits that are sent to the tasks together.
SENT = 100_000


def rank(hits: DataFrame, by: list[str], score: str = "score", key: str = "chunk_id", out: str = "rank") -> DataFrame:
    return hits.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))


def top(hits: DataFrame, by: list[str], n: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The best ``n`` of each group; Spark prunes every partition to ``n`` before it shuffles."""
    return rank(hits, by, score, key).filter(F.col("rank") <= n)


def bodies(hits: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``hits`` joined to ``rows`` by key. Hits are few: they are sent to where rows are read, SENT at a time, so rows (with their texts) are not exchanged. What is found is kept, as are hits: neither is made again by those who read it more than once."""
    held = checkpointed(hits)
    parts = max(1, -(-held.count() // SENT))
    out = None
    for i in range(parts):
        own = held if parts == 1 else held.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
        found = F.broadcast(own).join(rows, key)
        out = found if out is None else out.unionByName(found)
    return checkpointed(out)


def reciprocal_rank(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, score, source: sum of weight / (k + rank) over the lists, source of the best hit."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, w).otherwise(weight)
    ranked = rank(hits, ["query_id", "list"])
    return ranked.groupBy("query_id", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.sum(weight / (F.lit(k) + F.col("rank"))).alias("fused"), F.max_by("list", F.struct("score", "list")).alias("source")).withColumnRenamed("fused", "score")


def min_max(hits: DataFrame, by: list[str]) -> DataFrame:
    """Scores scaled to 0..1 within each group; equal scores become 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def weighted(hits: DataFrame, first: str, second: str, alpha: float = 0.6) -> DataFrame:
    """Scaled scores of two lists, mixed; the source is the first list where it has the chunk."""
    scaled = min_max(hits.filter(F.col("list").isin(first, second)), ["query_id", "list"])
    return scaled.groupBy("query_id", "chunk_id").agg(
        F.sum(F.when(F.col("list") == first, F.col("score") * alpha).otherwise(F.col("score") * (1.0 - alpha))).alias("fused"), F.max(F.col("list") == first).alias("own")
    ).select("query_id", "chunk_id", F.col("fused").alias("score"), F.when(F.col("own"), first).otherwise(second).alias("source"))


def cap_and_fill(ranked: DataFrame, by: list[str], group: str, cap: int, n: int, order: str = "rank") -> DataFrame:
    """The first ``cap`` of each group in order, then the others in order, cut at ``n``: adds ``position``."""
    within = F.row_number().over(Window.partitionBy(*by, group).orderBy(order))
    held = ranked.withColumn("_late", (within > cap).cast("int"))
    return held.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_late", order))).filter(F.col("position") <= n).drop("_late")


def retrieval_quality(ranked: DataFrame, section: str = "section", score: str = "rrf_score") -> DataFrame:
    """query_id and quality: harmonic rank mean, mean of scaled scores and section diversity."""
    stats = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("top"), F.sum(score).alias("total"), F.count_distinct(section).alias("sections"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i) / F.col("n")
    scaled = F.when(F.col("top") > 0, F.col("total") / F.col("top") / F.col("n")).otherwise(0.0)
    diverse = F.col("sections") / F.least(F.col("n"), F.lit(5))
    return stats.select("query_id", F.round(F.least(F.lit(1.0), harmonic * 0.45 + scaled * 0.35 + diverse * 0.2), 4).alias("quality"))


def similarity(a: set, b: set) -> float:
    return len(a & b) / (len(a | b) or 1)


def diversify(hits: DataFrame, max_per_doc: int = 2, weight: float = 0.7, most: int = 200) -> DataFrame:
    """Greedy maximal marginal relevance for each query, with a cap for each document: adds ``position``.

    The choice is sequential, so each query's candidates (at most ``most``, the best) are walked in one group.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        rows = [(r, set(r.text.lower().split())) for r in frame.itertuples(index=False)]
        out, docs = [], {}
        while rows:
            open_rows = [(i, r, s) for i, (r, s) in enumerate(rows) if docs.get(r.doc_id, 0) < max_per_doc]
            if not open_rows:
                break
            best = max(open_rows, key=lambda x: (weight * x[1].score + (1 - weight) * (1 - max((similarity(x[2], s) for _, s in out), default=0.0)), -x[0]))
            out.append(rows.pop(best[0]))
            docs[best[1].doc_id] = docs.get(best[1].doc_id, 0) + 1
        return pd.DataFrame([(r.query_id, r.chunk_id, r.doc_id, r.score, i) for i, (r, _) in enumerate(out, 1)], columns=["query_id", "chunk_id", "doc_id", "score", "position"])

    return top(hits, ["query_id"], most).select("query_id", "chunk_id", "doc_id", "score", "text").groupBy("query_id").applyInPandas(walk, "query_id long, chunk_id string, doc_id string, score double, position long")


def neighbours(chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adds preceding and following: texts of the siblings beside a chunk in its paper and section."""
    w = Window.partitionBy("paper_id", "section").orderBy("ordinal")
    before = F.array_join(F.collect_list("text").over(w.rowsBetween(-window, -1)), " ")
    after = F.array_join(F.collect_list("text").over(w.rowsBetween(1, window)), " ")
    return chunks.withColumn("preceding", F.trim(before)).withColumn("following", F.trim(after))


def assemble(section: Column, before: Column, main: Column, after: Column) -> Column:
    """Tagged text of a chunk between its neighbours; empty parts are left out."""
    return F.concat_ws("\n", F.concat(F.lit("[SECTION: "), section, F.lit("]")), F.nullif(before, F.lit("")), F.concat(F.lit(">>> "), main), F.nullif(after, F.lit("")))

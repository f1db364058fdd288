"""Retrieval metrics over ranked lists (query_id, rank, item) and judged items (query_id, item)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``ranked`` with ``hit`` (0 or 1) and ``n_relevant``."""
    mark = relevant.select("query_id", "item").distinct().withColumn("hit", F.lit(1))
    sizes = mark.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return ranked.join(mark, ["query_id", "item"], "left").join(sizes, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0))).withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision (by k), recall, reciprocal_rank and average_precision."""
    seen = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = judged(ranked, relevant).withColumn("seen", seen)
    at_k = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    n = F.max("n_relevant")
    return rows.groupBy("query_id").agg(
        (at_k / F.lit(float(k))).alias("precision"), F.coalesce(F.try_divide(at_k.cast("double"), n), F.lit(0.0)).alias("recall"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)), n), F.lit(0.0)).alias("average_precision"),
    )


def ndcg(graded: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg from (query_id, rank, grade), with linear gain."""
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    rows = graded.withColumn("ideal", ideal)

    def gain(place: str) -> Column:
        return F.sum(F.when(F.col(place) <= k, F.col("grade") / F.log2(F.col(place) + 1)).otherwise(0.0))

    return rows.groupBy("query_id").agg(F.coalesce(F.try_divide(gain("rank"), gain("ideal")), F.lit(0.0)).alias("ndcg"))


def overlap_ratios(question: Column, answer: Column, context: Column, truth: Column) -> list[Column]:
    """faithfulness, answer_relevancy, context_precision, context_recall, answer_correctness of token sets."""

    def ratio(a: Column, b: Column, by: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(by)), F.lit(0.0))

    faithful, relevant = ratio(answer, context, answer), ratio(question, answer, question)
    correct = F.when(F.size(truth) > 0, ratio(answer, truth, truth)).otherwise(relevant * 0.5 + faithful * 0.5)
    return [faithful.alias("faithfulness"), relevant.alias("answer_relevancy"), ratio(context, question, context).alias("context_precision"), ratio(context, question, question).alias("context_recall"), correct.alias("answer_correctness")]


def router_health(calls: DataFrame, last: int = 5) -> DataFrame:
    """model, calls, failures, mean, latencies (the last ones, newest first) from a log of calls (model, seq, latency, ok)."""
    w = Window.partitionBy("model").orderBy(F.desc("seq"))
    rows = calls.withColumn("rn", F.row_number().over(w))
    recent = rows.filter(F.col("rn") <= last).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "latency"))), lambda r: r["latency"]).alias("latencies"))
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.avg("latency").alias("mean")).join(recent, "model")

"""A similarity join by threshold over sparse unit vectors: pairs are made only of rows that share a rare place.

Places are ordered by how many vectors have them, rare ones first. A vector's prefix are its places up to where the norm of the rest falls below the
threshold; two vectors whose prefixes have no place in common cannot reach it, as all they share lies in the rest of one of them. So candidates come
from an equi-join on the prefixes' places, and each is verified once with whole vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.vectors import gathered, hash_embedding
from siltstone.operators import stores

#: Room for rounding in the norm of what a prefix leaves.
SLACK = 1e-9


def _prefixes(vectors: DataFrame, key: str, order: DataFrame, threshold: float) -> DataFrame:
    """key, idx of the places of each vector's prefix."""
    places = vectors.select(key, F.explode(F.arrays_zip("idx", "w")).alias("p")).select(key, F.col("p.idx").alias("idx"), F.col("p.w").alias("w")).join(order, "idx")
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy("place").rowsBetween(0, Window.unboundedFollowing))
    return places.withColumn("rest", rest).filter(F.sqrt("rest") + SLACK >= threshold).select(key, "idx")


def _dot(a_idx: Column, a_w: Column, b_idx: Column, b_w: Column) -> Column:
    """Product of two sparse rows whose places ascend."""
    held = F.map_from_arrays(b_idx, b_w)
    return F.transform(F.array(held), lambda m: F.aggregate(F.zip_with(a_idx, a_w, lambda i, w: w * F.coalesce(m[i], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))[0]


def above(asked: DataFrame, held: DataFrame, key: str, threshold: float, digits: int = 9) -> DataFrame:
    """query_id, key, score of the pairs of asked (query_id, idx, w) and held (key, idx, w) rows whose product reaches ``threshold`` (over 0)."""
    counted = held.select(F.explode("idx").alias("idx")).unionByName(asked.select(F.explode("idx").alias("idx"))).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    order = counted.select("idx", F.struct("n", "idx").alias("place"))
    near = _prefixes(asked, "query_id", order, threshold).join(_prefixes(held, key, order, threshold), "idx").select("query_id", key).distinct()
    pairs = near.join(asked.select("query_id", F.col("idx").alias("ai"), F.col("w").alias("aw")), "query_id").join(held.select(key, F.col("idx").alias("bi"), F.col("w").alias("bw")), key)
    return pairs.select("query_id", key, F.round(_dot(F.col("ai"), F.col("aw"), F.col("bi"), F.col("bw")), digits).alias("score")).filter(F.col("score") >= threshold)


def cached(cache: DataFrame, asked: DataFrame, now: Column, threshold: float = 0.92, dim: int = 1024) -> DataFrame:
    """query_id, entry, score: the nearest live entry of the cache (entry, query, created_at, ttl_seconds) for each question that reaches ``threshold``; ties take the least entry.

    Expired entries are left out before anything is compared.
    """
    live = stores.cache_live(cache, now)
    found = above(gathered(hash_embedding(asked, "query_id", "question", dim), "query_id"), gathered(hash_embedding(live, "entry", "query", dim), "entry"), "entry", threshold)
    best = F.max_by(F.struct("entry", "score"), F.struct("score", -F.col("entry")))
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.entry", "b.score")

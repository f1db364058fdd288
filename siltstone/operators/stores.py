"""State kept in tables: upserts, replacements and deletions as joins and unions of immutable DataFrames.

Nothing here mutates: each function returns the new state, for the caller to write (by key bucket, or as a new version).
Keys are joined, never collected; the small side of a join is left to the optimizer's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: str = "created_at") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; ``keep`` stays as it was first inserted."""
    first = old.select(key, F.col(keep).alias("_kept"))
    merged = new.join(first, key, "left").withColumn(keep, F.coalesce("_kept", keep)).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(merged)


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last writer wins by key (vectors, index entries)."""
    return replace_by(old, new, key)


def delete_by(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def existed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """For each of the ``keys``, whether the table had it."""
    there = table.select(key).distinct().withColumn("existed", F.lit(True))
    return keys.select(key).distinct().join(there, key, "left").select(key, F.coalesce("existed", F.lit(False)).alias("existed"))


def newest(table: DataFrame, order: list[Column], n: int, by: list[str]) -> DataFrame:
    """The newest ``n`` rows of each group (a ring buffer). Windows prune before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return table.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries by the hash of their query; the last one wins."""
    return merge_last(cache, entries.withColumn("query_hash", F.xxhash64("query")), "query_hash")


def cache_live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that have not passed their time to live."""
    return cache.filter(F.col("created_at") + F.col("ttl_seconds") >= now)


def invalidate(cache: DataFrame, doc_id: Column) -> DataFrame:
    """Entries that do not rest on the document."""
    return cache.filter(~F.array_contains("doc_ids", doc_id))


def author_edges(documents: DataFrame, document: str, authors: str) -> DataFrame:
    """src, dst, rel of WRITTEN_BY."""
    return documents.select(F.col(document).alias("src"), F.explode(authors).alias("dst"), F.lit("WRITTEN_BY").alias("rel")).distinct()


def entity_edges(documents: DataFrame, document: str, entities: str) -> DataFrame:
    """src, dst, rel of USES (each once)."""
    return documents.select(F.col(document).alias("src"), F.explode(entities).alias("dst"), F.lit("USES").alias("rel")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def drop_node(edges: DataFrame, node: Column) -> DataFrame:
    """Edges without those that touch the node."""
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def adapt_legacy(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old document and chunk rows as paper and chunk rows."""
    papers = documents.select(F.col("document_id").alias("paper_id"), F.col("source_name").alias("title"), "source_path", "checksum", "page_count", "chunk_count", "created_at", "updated_at")
    sections = chunks.select("chunk_id", F.col("document_id").alias("paper_id"), "page_number", F.coalesce("section", F.lit("unknown")).alias("section"), "ordinal", "text", F.length("text").cast("long").alias("char_count"))
    return papers, sections

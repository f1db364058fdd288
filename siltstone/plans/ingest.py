"""Ingest pipelines: pages to chunks, claims, tables, entities, vectors and index, as one lazy set of tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import extract as e
from siltstone.functions import vectors as v
from siltstone.operators import bm25, chunking, stores


@dataclass(frozen=True)
class Corpus:
    papers: DataFrame
    chunks: DataFrame
    claims: DataFrame
    vectors: DataFrame
    index: bm25.Index
    entities: DataFrame

    def write(self, folder: str, mode: str = "overwrite") -> None:
        """Every table as Parquet below ``folder``; chunks are read once for all (persisted while they are written)."""
        self.chunks.persist()
        try:
            for name, table in (("papers", self.papers), ("chunks", self.chunks), ("claims", self.claims), ("vectors", self.vectors), ("postings", self.index.postings), ("lengths", self.index.lengths), ("terms", self.index.terms), ("entities", self.entities)):
                table.write.mode(mode).parquet(str(PurePosixPath(folder) / name) if "://" not in folder else f"{folder}/{name}")
        finally:
            self.chunks.unpersist()


def sections(pages: DataFrame, now: str, chars: int = 600, overlap: int = 80, dim: int = 1024, private: bool = False) -> Corpus:
    """The adaptive core's ingest of (paper_id, title, page_number, text); with ``private``, personal data is redacted first."""
    text = e.redact(F.col("text")) if private else F.col("text")
    clean = pages.withColumn("text", text)
    chunks = chunking.chunk_by_sections(clean.select("paper_id", "page_number", "text"), chars, overlap)
    claims = chunking.extract_claims(chunks)
    at = F.lit(now).cast("timestamp")
    papers = clean.groupBy("paper_id").agg(F.max("title").alias("title"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda r: r["text"]), "\n"), 256).alias("checksum"), F.count(F.lit(1)).alias("page_count"))
    counted = papers.join(chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunk_count")), "paper_id", "left").select("paper_id", "title", "checksum", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), at.alias("created_at"), at.alias("updated_at"))
    entities = stores.entity_edges(chunks.select("paper_id", e.named_entities(F.col("text")).alias("e")), "paper_id", "e")
    return Corpus(counted, chunks, claims, v.hash_embedding(chunks, "chunk_id", "text", dim), bm25.build(chunks), entities)


def report(corpus: Corpus) -> DataFrame:
    """paper_id, chunks, claims, sections."""
    claims = corpus.claims.groupBy("paper_id").agg(F.count(F.lit(1)).alias("claims"))
    return corpus.chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections")).join(claims, "paper_id", "left").select("paper_id", "chunks", F.coalesce("claims", F.lit(0)).alias("claims"), "sections")


def merge(old: Corpus, new: Corpus) -> Corpus:
    """``new`` ingested over ``old``: papers upserted, all else replaced by paper."""
    chunks = stores.replace_by(old.chunks, new.chunks, "paper_id")
    gone = old.chunks.join(new.papers.select("paper_id"), "paper_id", "left_semi").select("chunk_id")
    vectors = stores.delete_by(old.vectors, gone, "chunk_id").unionByName(new.vectors)
    index = bm25._merge(bm25.remove(old.index, gone), new.index, "chunk_id")
    return Corpus(stores.upsert(old.papers, new.papers, "paper_id"), chunks, stores.replace_by(old.claims, new.claims, "paper_id"), vectors, index, stores.replace_by(old.entities, new.entities, "src"))

"""The stored tables that queries share: made once for a version of the given tables, then read by whoever asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors as v
from siltstone.operators import chunking, tables, vector_index
from siltstone.operators.postings import Postings
from siltstone.operators.vector_index import VectorIndex
from siltstone.queries import corpus

DIM = 1024
#: Changes with what is written, so that tables of an earlier layout are not taken for these.
LAYOUT = 6


def _once(t, name: str, table: str, build) -> str:
    return tables.once(t.spark, f"{name}-{LAYOUT}", tables.version(t.spark, f"{t.folder}/{table}.parquet"), build)


def chunks(t) -> DataFrame:
    return t.spark.read.parquet(_once(t, "chunks", "documents", lambda path: corpus.chunks(t).write.option("compression", "zstd").parquet(f"{path}/rows")) + "/rows")


def claims(t) -> DataFrame:
    """claim_id, chunk_id, claim."""
    return t.spark.read.parquet(_once(t, "claims", "documents", lambda path: chunking.extract_claims(chunks(t)).select("claim_id", "chunk_id", "claim").write.option("compression", "zstd").parquet(f"{path}/rows")) + "/rows")


def chunk_vectors(t) -> VectorIndex:
    """Vectors of the chunks, with doc_id for filters."""

    def build(path: str) -> None:
        held = corpus.chunks(t).withColumn("own", F.struct("doc_id", "chunk_id"))  # no join for what a filter asks
        vector_index.create(v.hash_vectors(held, "own", "text", DIM, unit=False).select("own.*", "idx", "w"), path, "chunk_id", DIM, "doc_id", flat=True)

    return VectorIndex(t.spark, _once(t, "chunk-vectors", "documents", build))


def claim_vectors(t) -> VectorIndex:
    def build(path: str) -> None:
        vector_index.create(v.hash_vectors(claims(t), "claim_id", "claim", DIM, unit=False), path, "claim_id", DIM, flat=True)

    return VectorIndex(t.spark, _once(t, "claim-vectors", "documents", build))


def embeddings(t) -> VectorIndex:
    """The given embeddings, dense."""

    def build(path: str) -> None:
        rows = t("embeddings").select("vec_id", F.lit(None).cast("array<int>").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("w"))
        dim = rows.agg(F.coalesce(F.max(F.size("w")), F.lit(1))).first()[0]
        vector_index.create(rows, path, "vec_id", dim)

    return VectorIndex(t.spark, _once(t, "embedding-vectors", "embeddings", build))


def postings(t) -> Postings:
    return Postings(t.spark, _once(t, "postings", "documents", lambda path: Postings(t.spark, path).create(corpus.chunks(t), made=False)))

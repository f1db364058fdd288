"""Vectors: hash embeddings as sparse rows, norms, similarities and drift; all in built-in expressions."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens, unique_words


def token_weights(token: Column, dim: int, weighted: bool) -> Column:
    """Struct (idx, w) of a token: bytes 0-1 of its SHA-256 give the place; the sign is byte 2 (weighted) or byte 3."""
    digest = F.sha2(token, 256)

    def byte(i: int, n: int = 1) -> Column:
        return F.conv(F.substring(digest, 2 * i + 1, 2 * n), 16, 10).cast("int")

    sign = F.when(F.pmod(byte(2 if weighted else 3), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return F.struct(F.pmod(byte(0, 2), F.lit(dim)).alias("idx"), (sign * (F.lit(1.0) + byte(3) / F.lit(255.0)) if weighted else sign).alias("w"))


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 1024, weighted: bool = False) -> DataFrame:
    """key, idx, w: the non-zero places of the L2-normalised hash embedding."""
    return hash_vectors(df, key, text, dim, weighted).select(key, F.explode(F.arrays_zip("idx", "w")).alias("p")).select(key, "p.idx", "p.w")


def hash_vectors(df: DataFrame, key: str, text: str, dim: int = 1024, weighted: bool = False, unit: bool = True) -> DataFrame:
    """key, idx, w as arrays in the order of places; a row without places has none. Sums are made where texts are read: no exchange."""
    rows = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    if not rows.groupBy(F.xxhash64("key")).count().filter("count > 1").isEmpty():  # rows of a key count together
        rows = rows.groupBy("key").agg(F.flatten(F.collect_list("t")).alias("t"))
    return rows.mapInArrow(_hashed(dim, weighted, unit), f"key {dict(rows.dtypes)['key']}, idx array<int>, w array<double>").withColumnRenamed("key", key)


def _hashed(dim: int, weighted: bool, unit: bool):
    def place(token: str) -> tuple[int, float]:
        """As ``token_weights``."""
        h = hashlib.sha256(token.encode()).digest()
        sign = 1.0 if h[2 if weighted else 3] % 2 == 0 else -1.0
        return (h[0] << 8 | h[1]) % dim, sign * (1.0 + h[3] / 255.0) if weighted else sign

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(words.flatten().cast(pa.string()))
            if not len(coded):
                continue
            idx, w = (np.array(x) for x in zip(*map(place, coded.dictionary.to_pylist()), strict=True))
            each, n = np.unique(np.repeat(np.arange(batch.num_rows), sizes) * len(idx) + coded.indices.to_numpy(), return_counts=True)  # equal tokens are counted
            row, code = np.divmod(each, len(idx))
            at, of = np.unique(row * dim + idx[code], return_inverse=True)
            sums = np.bincount(of, weights=w[code] * n)
            at, sums = at[sums != 0], sums[sums != 0]
            row, at = np.divmod(at, dim)
            if unit:
                sums = sums / np.sqrt(np.bincount(row, weights=sums * sums, minlength=batch.num_rows))[row]
            own = np.bincount(row, minlength=batch.num_rows)
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists(at.astype(np.int32), own[some]), lists(sums, own[some])], ["key", "idx", "w"])

    return run


def gathered(places: DataFrame, key: str) -> DataFrame:
    """key, idx and w as arrays in the order of places, from a row for each place."""
    return places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("p")).select(key, F.col("p.idx").alias("idx"), F.col("p.w").alias("w"))


def sparse_cosine(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """query_key, doc_key, score for all pairs that share a place: an equi-join on the place and a sum."""
    pairs = queries.select(query_key, "idx", F.col("w").alias("qw")).join(docs.select(doc_key, "idx", "w"), "idx")
    return pairs.groupBy(query_key, doc_key).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda v: F.when(n == 0, v.cast("double")).otherwise(v.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def distance_score(distance: Column) -> Column:
    """1 - half the distance cut to 0..2."""
    return F.lit(1.0) - F.least(F.greatest(distance, F.lit(0.0)), F.lit(2.0)) / 2.0


def add_noise(a: Column, key: Column, sigma: float = 0.01, seed: int = 7) -> Column:
    """Gaussian noise that a key and a seed determine (Box-Muller over hashes), so a rerun gives the same rows."""

    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))

    return F.transform(a, lambda v, i: v.cast("double") + F.sqrt(F.log(uniform(i, 1)) * -2.0) * F.cos(uniform(i, 2) * 2.0 * np.pi) * sigma)


#: Rows of one side of a kernel product, and numbers of one product.
KERNEL_ROWS, KERNEL_PRODUCT = 16_384, 2 << 20


def kernel_sums(rows: DataFrame, side: str, vector: str, gamma: float = 1.0) -> DataFrame:
    """a, b, total, n: sums of the RBF kernel over all pairs of rows, by the sides of the two.

    One block of rows at a time (``KERNEL_ROWS``, bounded in numbers, too) goes to the tasks as a dense matrix; they multiply their rows with it
    and give back sums. Pairs are never rows.
    """
    kind = dict(rows.dtypes)[side]
    held = rows.select(side, F.transform(vector, lambda v: v.cast("double")).alias("v")).filter(F.col(vector).isNotNull())
    n, dim = held.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(KERNEL_ROWS, (8 << 20) // max(dim, 1)))))
    numbered = held.withColumn("_block", F.pmod(F.xxhash64(side, "v"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = numbered.filter(F.col("_block") == b).select(side, "v").toPandas()  # a block of a bounded size
        if not len(part):
            continue
        sides = sorted(part[side].unique().tolist())
        mine = [np.array(part["v"][part[side] == s].tolist()) for s in sides]
        sent = rows.sparkSession.sparkContext.broadcast((sides, mine))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            sides, mine = sent.value
            for batch in batches:
                for a, own in batch.groupby(side):
                    x = np.array(own["v"].tolist())
                    for s, y in zip(sides, mine, strict=True):
                        step, total = max(1, KERNEL_PRODUCT // len(y)), 0.0
                        for i in range(0, len(x), step):
                            near = x[i : i + step]
                            squared = (near**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * near @ y.T
                            total += float(np.exp(np.maximum(squared, 0.0) * -gamma).sum())
                        yield pd.DataFrame({"a": [a], "b": [s], "total": [total], "n": [len(x) * len(y)]})

        found = held.mapInPandas(run, f"a {kind}, b {kind}, total double, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"a {kind}, b {kind}, total double, n long")
    return out.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def mmd(base: DataFrame, new: DataFrame, vector: str, gamma: float = 1.0) -> DataFrame:
    """One row, mmd: the biased estimate with an RBF kernel over all pairs of both samples; 0 where one is empty."""
    rows = base.select(F.lit(0).alias("side"), vector).unionByName(new.select(F.lit(1).alias("side"), vector))
    mean = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("total"))) / F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("n")))
    return kernel_sums(rows, "side", vector, gamma).agg(F.greatest(F.lit(0.0), F.coalesce(mean(0, 0) + mean(1, 1) - mean(0, 1) * 2, F.lit(0.0))).alias("mmd"))


def seeded_vector(text: str, dim: int, algorithm: str = "sha256") -> np.ndarray:
    """A unit vector drawn from the normal distribution by the digest of a text."""
    seed = int.from_bytes(hashlib.new(algorithm, text.encode()).digest()[:8], "big")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / (np.linalg.norm(v) or 1.0)


def text_vectors(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """key, embedding: the seeded vector of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": [seeded_vector(t or "", dim).tolist() for t in b[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def token_vectors(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, token, vector: each distinct token is drawn once, then joined."""
    own = df.select(key, F.explode(unique_words(F.col(text))).alias("token"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "vector": [seeded_vector(t, dim, "md5").tolist() for t in b["token"]]})

    return own.join(own.select("token").distinct().mapInPandas(run, "token string, vector array<float>"), "token")


def max_sim(pairs: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """query_id, key, score of the given pairs (query_id, key, asked, held: distinct tokens): the mean over the tokens asked of the best likeness to one held.

    Token vectors follow from the tokens, so they are drawn where they are needed and a bounded number is remembered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = functools.lru_cache(maxsize=100_000)(lambda token: seeded_vector(token, dim, "md5"))
        for b in batches:
            scores = [float((np.array([drawn(t) for t in asked]) @ np.array([drawn(t) for t in held]).T).max(axis=1).mean()) if len(asked) and len(held) else 0.0 for asked, held in zip(b["asked"], b["held"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], key: b[key], "score": scores})

    return pairs.select("query_id", key, "asked", "held").mapInPandas(run, f"query_id long, {key} {dict(pairs.dtypes)[key]}, score double")

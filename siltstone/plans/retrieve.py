"""Hybrid retrieval over a batch of questions: dense, BM25 and claim hits, fused, re-ranked, diversified and enriched.

All questions of a batch are answered together, keyed by query_id: the three searches are blockwise products, everything after them
works on their few hits. Ties are broken by chunk_id. Scores that order rows are rounded, so that summation order cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.functions import verify as check
from siltstone.functions.extract import citations, expand_question, expanded_terms, intent_weights, is_table_question, named_entities
from siltstone.functions.vectors import hash_embedding, hash_vectors, max_sim, normalize
from siltstone.operators import blocks, bm25, fusion
from siltstone.operators.postings import Postings
from siltstone.operators.vector_index import VectorIndex
from siltstone.ports import Generator, hypothetical
from siltstone.session import checkpointed

DIGITS = 9
RRF_K, CLAIM_WEIGHT, TABLE_BOOST, CLAIM_BONUS = 60, 1.3, 1.2, 0.025


def dense(questions: DataFrame, chunks: DataFrame | VectorIndex, k: int, dim: int = 1024, key: str = "chunk_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """query_id, key, score, rank: the ``k`` best chunks of each question by cosine of hash embeddings; of a stored index no text is read."""
    if isinstance(chunks, VectorIndex):
        return chunks.search(hash_vectors(questions, "query_id", "question", dim), k, where, DIGITS, shared=True).hits
    asked = hash_embedding(questions, "query_id", "question", dim)
    held = hash_vectors(chunks if where is None else chunks.filter(where), key, text, dim)
    return blocks.top_rows(asked.withColumnRenamed("idx", "place"), held, key, k, digits=DIGITS)


def lexical(questions: DataFrame, index: bm25.Index | Postings, k: int, keep_zero: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25; zero scores are dropped unless kept. A stored index skips the blocks that cannot matter."""
    return index.search(questions, k, keep_zero=keep_zero).hits if isinstance(index, Postings) else bm25.top(index, questions, k, keep_zero)


def by_claims(questions: DataFrame, claims: DataFrame, k: int, dim: int = 1024, vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, chunk_id, rank, score, claim: the best claim of each chunk among the ``k`` best claims."""
    best = fusion.bodies(dense(questions, vectors or claims, k, dim, "claim_id", "claim"), claims.select("claim_id", "chunk_id", "claim"), "claim_id")
    return best.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"), F.min_by("claim", "rank").alias("claim"))


def hybrid(questions: DataFrame, chunks: DataFrame, claims: DataFrame, index: bm25.Index | Postings, k: int = 12, cap: int = 3, vectors: VectorIndex | None = None, claim_vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, position, chunk_id, rrf_score, rerank_score, claim: the adaptive core's retrieval.

    With stored indexes (postings, and vectors of chunks and claims) each is read once and the corpus itself only for the hits.

    Ranks are taken over all vectors before any filter of the corpus. Dense, BM25 and claim hits (3k each) are fused; the
    2k best are re-ranked by shared words, blended, and cut to k with a cap for each section.
    """
    return merged(questions, chunks, lists(questions, chunks, claims, index, k, vectors, claim_vectors), k, cap)


def lists(questions: DataFrame, chunks: DataFrame, claims: DataFrame, index: bm25.Index | Postings, k: int = 12, vectors: VectorIndex | None = None, claim_vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, chunk_id, list (dense, bm25, claim), rank, claim: the three searches, each 3k deep."""
    none = F.lit(None).cast("string").alias("claim")
    parts = [
        dense(questions, vectors or chunks.select("chunk_id", "text"), 3 * k).select("query_id", "chunk_id", F.lit("dense").alias("list"), "rank", none),
        lexical(questions, index, 3 * k).select("query_id", "chunk_id", F.lit("bm25").alias("list"), "rank", none),
        by_claims(questions, claims, 3 * k, vectors=claim_vectors).select("query_id", "chunk_id", F.lit("claim").alias("list"), "rank", "claim"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def merged(questions: DataFrame, chunks: DataFrame, every: DataFrame, k: int = 12, cap: int = 3, rerank: bool = True) -> DataFrame:
    """The hits of ``lists`` fused, re-ranked (or left in the fused order) and cut to k with a cap for each section."""
    body = chunks.select("chunk_id", "paper_id", "section", "text", "content_type")
    weight = F.when(F.col("list") == "claim", CLAIM_WEIGHT).otherwise(1.0)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(weight / (F.col("rank") + RRF_K)).alias("fused"), F.max("claim").alias("claim"))
    asked = questions.select("query_id", "question", expanded_terms(F.col("question")).alias("terms"), intent_weights(F.col("question")).alias("intents"), is_table_question(F.col("question")).alias("tabular"))
    rows = fusion.bodies(fused, body).join(asked, "query_id")
    bonus = F.coalesce(F.get(F.filter("intents", lambda r: r["section"] == F.lower("section")), F.lit(0))["weight"], F.lit(0.0))
    boosted = F.when(F.col("tabular") & (F.col("content_type") == "table"), F.col("fused") * TABLE_BOOST).otherwise(F.col("fused"))
    rows = rows.withColumn("bonus", bonus).withColumn("rrf_score", F.round(boosted + F.col("bonus"), DIGITS))
    rows = fusion.top(rows, ["query_id"], 2 * k, "rrf_score").withColumnRenamed("rank", "rrf_rank")
    shown = F.when(F.col("claim").isNotNull(), F.concat("claim", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    if not rerank:
        rows = rows.withColumn("rerank_score", F.col("rrf_score")).withColumn("rank", F.col("rrf_rank"))
        return fusion.cap_and_fill(rows, ["query_id"], "section", cap, k).select("query_id", "position", "chunk_id", "paper_id", "section", "text", "rrf_score", "rerank_score", "claim")
    rows = rows.withColumn("shared", x.overlap(F.array_distinct(x.tokens(F.col("question"))), F.array_distinct(x.tokens(shown))))
    rerank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "rrf_rank"))
    rows = rows.withColumn("rerank_rank", rerank)
    score = F.lit(1.2) / (F.col("rerank_rank") + RRF_K) + F.lit(1.0) / (F.col("rrf_rank") + RRF_K) + check.lexical_overlap(F.col("terms"), F.col("text")) * 0.10 + F.col("bonus") + F.when(F.col("claim").isNotNull(), CLAIM_BONUS).otherwise(0.0)
    rows = fusion.rank(rows.withColumn("rerank_score", F.round(score, DIGITS)), ["query_id"], "rerank_score")
    return fusion.cap_and_fill(rows, ["query_id"], "section", cap, k).select("query_id", "position", "chunk_id", "paper_id", "section", "text", "rrf_score", "rerank_score", "claim")


def match_scores(questions: DataFrame, hits: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, paper_id, score over 0: how well a paper's title fits what the hits cite, and the question."""
    terms = F.filter(F.array_distinct(x.tokens(F.col("c"))), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    found = checkpointed(hits.select("query_id", F.explode(citations(F.col("text"))).alias("c")).distinct())
    asked = found.select("query_id").distinct().join(questions, "query_id")
    title = papers.select("paper_id", F.array_distinct(x.tokens(F.col("title"))).alias("title"))
    words = title.select("paper_id", F.explode("title").alias("w"))
    of_citation = found.select("query_id", "c", terms.alias("t")).filter(F.size("t") > 0)
    best = of_citation.select("query_id", "c", F.size("t").alias("n"), F.explode("t").alias("w")).join(words, "w").groupBy("query_id", "paper_id", "c", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("query_id", "paper_id").agg(F.max(F.col("k") / F.col("n")).alias("best"))
    own = F.filter(F.array_distinct(x.tokens(F.col("question"))), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    shared = asked.select("query_id", own.alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("w")).join(words, "w").groupBy("query_id", "paper_id", "n").agg(F.count(F.lit(1)).alias("k")).select("query_id", "paper_id", (F.col("k") / F.col("n")).alias("share"))
    scores = best.join(shared, ["query_id", "paper_id"], "full").select("query_id", "paper_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("share", F.lit(0.0)).alias("share"))
    scores = scores.withColumn("score", F.round(F.when(F.col("best") > 0, F.col("best") * 0.7 + F.col("share") * 0.3).when(F.col("share") >= 0.2, F.col("share")).otherwise(0.0), DIGITS)).filter("score > 0")
    return scores


def cited(questions: DataFrame, hits: DataFrame, papers: DataFrame, chunks: DataFrame, most_papers: int = 3, per_paper: int = 2) -> DataFrame:
    """query_id, paper_id, chunk_id, score: chunks of papers whose titles the hits' citations name (or the question shares)."""
    scores = match_scores(questions, hits, papers)
    fresh = scores.join(hits.select("query_id", "paper_id").distinct(), ["query_id", "paper_id"], "left_anti")
    chosen = fusion.top(fresh, ["query_id"], most_papers, key="paper_id").select("query_id", "paper_id").join(questions, "query_id")
    near = chosen.join(chunks.select("paper_id", "chunk_id", "text"), "paper_id").withColumn("score", F.round(check.alignment(F.col("question"), F.col("text")), DIGITS)).filter("score > 0")
    return fusion.top(near, ["query_id", "paper_id"], per_paper).select("query_id", "paper_id", "chunk_id", "score")


def hyde(questions: DataFrame, chunks: DataFrame, k: int, generator: Generator | None = None, direct: float = 0.4, passage: float = 0.6, dim: int = 1024) -> DataFrame:
    """query_id, chunk_id, score, rank: hits of the question and of a passage that a generator writes for it, their scores weighted and added."""
    written = hypothetical(questions.select("query_id", "question"), generator)
    own = dense(questions, chunks, k, dim).select("query_id", "chunk_id", (F.col("score") * direct).alias("score"))
    said = dense(written.select("query_id", F.col("passage").alias("question")), chunks, k, dim).select("query_id", "chunk_id", (F.col("score") * passage).alias("score"))
    merged = own.unionByName(said).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return fusion.top(merged, ["query_id"], k)


def related(questions: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 10, per_paper: int = 3) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks of papers that the entities of a question lead to in two steps (src paper, dst entity)."""
    return related_to(questions.select("query_id", F.explode(named_entities(F.col("question"))).alias("dst")), edges, chunks, k, per_paper)


def related_to(entities: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 10, per_paper: int = 3) -> DataFrame:
    """The same from given entities (query_id, dst).

    Papers that use an entity of the question come before those that share another entity with them; the score is 1 / rank.
    """
    asked = entities.select("query_id", "dst").distinct()
    near = asked.join(edges, "dst").select("query_id", "src").distinct()
    first = fusion.top(near.withColumn("score", F.lit(0)), ["query_id"], k, key="src").select("query_id", "src", F.lit(1).alias("step"))  # what is beyond the first k papers cannot reach the first k chunks
    beside = first.join(edges, "src").select("query_id", "dst").distinct().join(edges, "dst").select("query_id", "src", F.lit(2).alias("step"))
    papers = first.unionByName(beside).groupBy("query_id", "src").agg(F.min("step").alias("step"))
    papers = papers.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "src"))).filter(F.col("_n") <= k)
    own = papers.join(chunks.select(F.col("paper_id").alias("src"), "chunk_id", "ordinal"), "src")
    own = own.withColumn("_c", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("ordinal", "chunk_id"))).filter(F.col("_c") <= per_paper)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("step", "src", "ordinal", "chunk_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", (F.lit(1.0) / F.col("rank")).alias("score"), "rank")


def nearest(asked: DataFrame, held: DataFrame | VectorIndex, key: str, k: int) -> DataFrame:
    """query_id, key, score, rank: cosine of dense vectors (query_id, embedding) and those of a table (key, embedding) or a stored index."""
    if isinstance(held, VectorIndex):
        return held.search(asked.select("query_id", F.lit(None).cast("array<int>").alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("w")), k, digits=DIGITS).hits

    def sparse(df: DataFrame, own: str) -> DataFrame:
        return df.select(own, F.posexplode(normalize(F.col("embedding"))).alias("place", "w")).filter("w <> 0")

    return blocks.top(sparse(asked, "query_id"), sparse(held, key), key, k, digits=DIGITS)


def advanced(questions: DataFrame, chunks: DataFrame, index: bm25.Index, graph_hits: DataFrame | None = None, k: int = 5, per_doc: int = 2, graph_edges: DataFrame | None = None, parameters: DataFrame | None = None, generator: Generator | None = None) -> DataFrame:
    """query_id, position, chunk_id, score: the advanced backend's retrieval.

    Vector 30, BM25 20 and graph 10 hits are fused (60), references dropped, diversified with a cap for each document,
    re-ranked by word sets (at least 0.3, or the fused order where none reaches it) and cut. Graph hits are given, or follow from
    edges of papers and entities. ``parameters`` (of ``answer.tuned``, by query_id) replace these numbers and add passages of a
    generator; terms are expanded and token vectors re-rank where they say so.
    """
    body = chunks.select("chunk_id", F.col("paper_id").alias("doc_id"), "section", "text")
    if parameters is None:
        vector, words = dense(questions, body, 30), lexical(questions, index, 20, True)
    else:
        p = parameters.select("query_id", "k_vector", "k_bm25", "use_hyde", "use_colbert", "max_per_doc", "rerank_threshold", "expand")
        wide = p.agg(F.coalesce(F.max("k_vector"), F.lit(30)), F.coalesce(F.max("k_bm25"), F.lit(20))).first()
        told = questions.join(p, "query_id")
        said = told.withColumn("question", F.when(F.col("expand"), expand_question(F.col("question"))).otherwise(F.col("question"))).select("query_id", "question")
        vector = dense(said, body, wide[0]).join(hyde(said, body, wide[0], generator).select("query_id", "chunk_id", F.col("score").alias("merged")), ["query_id", "chunk_id"], "full")
        vector = vector.join(p.select("query_id", "k_vector", "use_hyde"), "query_id").select("query_id", "chunk_id", F.when(F.col("use_hyde"), F.col("merged")).otherwise(F.col("score")).alias("score"), "k_vector").filter("score IS NOT NULL")
        vector = fusion.rank(vector, ["query_id"]).filter("rank <= k_vector")
        words = lexical(said, index, wide[1], True).join(p.select("query_id", "k_bm25"), "query_id").filter("rank <= k_bm25")
    lists = vector.select("query_id", F.lit("vector").alias("list"), "chunk_id", "score").unionByName(words.select("query_id", F.lit("bm25").alias("list"), "chunk_id", "score"))
    if graph_edges is not None:
        graph_hits = related(questions, graph_edges, chunks)
    if graph_hits is not None:
        lists = lists.unionByName(fusion.top(graph_hits.select("query_id", "chunk_id", "score"), ["query_id"], 10).select("query_id", F.lit("graph").alias("list"), "chunk_id", "score"))
    kept = lists.join(body.filter(~F.lower("section").isin("references", "bibliography", "acknowledgments")), "chunk_id")
    fused = fusion.reciprocal_rank(kept).withColumn("score", F.round("score", DIGITS)).join(body.select("chunk_id", "text"), "chunk_id")
    if parameters is None:
        spread = fusion.diversify(fused, per_doc)
        least = F.lit(0.3)
    else:
        capped = fused.join(p.select("query_id", "max_per_doc"), "query_id")
        spread = fusion.diversify(capped.filter("max_per_doc = 1").drop("max_per_doc"), 1).unionByName(fusion.diversify(capped.filter("max_per_doc > 1").drop("max_per_doc"), per_doc)).join(p.select("query_id", "use_colbert", "rerank_threshold"), "query_id")
        least = F.col("rerank_threshold")
    spread = spread.join(body.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", "question"), "query_id").filter("position <= 50")
    scored = spread.withColumn("score", F.round(x.jaccard(x.word_set(F.col("question")), x.word_set(F.col("text"))), DIGITS))
    if parameters is not None:
        late = max_sim(scored.filter("use_colbert").select("query_id", "chunk_id", x.unique_words(F.col("question")).alias("asked"), x.unique_words(F.col("text")).alias("held")), "chunk_id")
        scored = scored.join(late.select("query_id", "chunk_id", F.col("score").alias("late")), ["query_id", "chunk_id"], "left").withColumn("score", F.when(F.col("use_colbert"), F.round(F.coalesce("late", F.lit(0.0)), DIGITS)).otherwise(F.col("score")))
    ranked = fusion.rank(scored, ["query_id"]).filter((F.col("score") >= least) | (F.col("rank") <= k))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").alias("position"), "chunk_id", "doc_id", "text", "score")

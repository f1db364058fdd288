"""Answers without a model: extractive ones with citations, and the driver's bounded retry loops."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import extract as e
from siltstone.functions import text as x
from siltstone.functions import verify as check
from siltstone.functions.substring import Substrings
from siltstone.operators import bm25, fusion
from siltstone.operators.postings import Postings
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans import retrieve
from siltstone.ports import Generator
from siltstone.session import checkpointed

#: What is said where nothing is found (a fixed value); so are the sentences of refusals and overviews below.
NOTHING = "I could not find any indexed context that answers this question yet."
MODELS = {"simple_fact": "fast", "procedural": "fast", "quantitative": "fast", "comparative": "strong", "multi_hop": "strong", "causal": "strong", "temporal": "strong", "survey": "strong"}


def extractive(questions: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """query_id, answer, cited (chunk ids): the three best distinct sentences of the hits (query_id, chunk_id, text, score)."""
    s = hits.join(questions, "query_id").select("query_id", "question", "chunk_id", "score", F.posexplode(F.when(F.size(x.sentences(F.col("text"))) > 0, x.sentences(F.col("text"))).otherwise(F.array("text"))).alias("i", "s"))
    value = F.round(F.col("score") * 0.75 + x.overlap(x.answer_terms(F.col("question")), x.answer_terms(F.col("s"))) * 0.25, 9)
    order = [F.desc("value"), F.desc("score"), F.col("chunk_id"), F.col("i")]
    first = F.row_number().over(Window.partitionBy("query_id", F.lower("s")).orderBy(*order))
    rows = s.withColumn("value", value).withColumn("_first", first).filter("_first = 1")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rn") <= n)
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "s", "chunk_id"))).alias("r"))
    made = made.select("query_id", F.array_join(F.transform("r", lambda r: r["s"]), " ").alias("answer"), F.array_distinct(F.transform("r", lambda r: r["chunk_id"])).alias("cited"))
    return questions.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NOTHING)).alias("answer"), F.coalesce("cited", F.array().cast("array<string>")).alias("cited"))


def fallback(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, answer from (query_id, position, text, section): best sentences of the first three, or an overview.

    Contexts that share too few of the question's terms are refused, and so are answers that look like templates.
    """
    near = hits.join(questions, "query_id").withColumn("near", check.alignment(F.col("question"), F.col("text")))
    gate = near.groupBy("query_id").agg(F.max(F.when(F.col("position") <= 8, F.col("near"))).alias("near"))
    best = F.array_sort(F.collect_list(F.when(F.col("position") <= 3, F.struct("position", x.best_sentence(F.col("text")).alias("s")))))
    made = near.groupBy("query_id", "question").agg(F.array_join(F.transform(best, lambda r: r["s"]), " ").alias("body"))
    focus = F.array_join(e.focus_terms(F.col("question")), ", ")
    answer = F.when(focus != "", F.concat(F.lit("Focus: "), focus, F.lit(". "), x.clean_claim(F.col("body")))).otherwise(x.clean_claim(F.col("body")))
    said = made.join(gate, "query_id").withColumn("answer", answer)
    refused = F.when(F.col("near") < 0.12, "The retrieved context does not directly answer this question. Try rephrasing the query or restricting to a more relevant paper.")
    noisy = F.when(e.is_noise_answer(F.col("answer")), "The retrieved context is too noisy to produce a reliable answer. Try re-ingesting the document or narrowing the question.")
    out = said.select("query_id", F.coalesce(refused, noisy, F.col("answer")).alias("answer"))
    none = F.lit("I do not have enough evidence in the indexed papers to answer this question.")
    return questions.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("answer", none).alias("answer"))


def overview(hits: DataFrame) -> DataFrame:
    """query_id, answer: sentences of the eight contexts that come first by section; noise is passed over where anything else is left."""
    priority = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("abstract", "introduction", "conclusion", "results", "method", "experiments", "related_work", "body"))), F.col("section")), F.lit(0)), F.lit(100))
    rows = hits.withColumn("noise", e.is_noise_chunk(F.col("text"))).withColumn("clean", F.min(F.col("noise").cast("int")).over(Window.partitionBy("query_id")))
    rows = rows.filter((F.col("clean") == 1) | ~F.col("noise")).withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(priority, F.desc("rerank_score"), F.desc("rrf_score"), "chunk_id"))).filter("rn <= 8")
    blob = rows.groupBy("query_id").agg(x.clean_claim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda r: r["text"]), " ")).alias("blob"))
    found = blob.select("query_id", "blob", x.overview_sentences(F.col("blob")).alias("s"), e.tech_terms(F.col("blob")).alias("tech"), e.project_phrases(F.col("blob")).alias("projects"), e.looks_like_resume(F.col("blob")).alias("resume"))

    def listed(head: str, items, n: int):
        return F.when(F.size(items) > 0, F.concat(F.lit(f" {head} "), F.array_join(F.slice(items, 1, n), ", "), F.lit("."))).otherwise("")

    cv = F.concat(F.lit("This document appears to be a professional CV/resume focused on AI and machine learning work."), listed("It highlights projects such as", F.col("projects"), 3), listed("The profile emphasizes hands-on experience with", F.col("tech"), 6))
    paper = F.concat(F.lit("This document discusses its core topic through methods, results, and practical implementation details. Key points include: "), F.array_join(F.slice("s", 1, 2), " "), listed("Important technical terms include", F.col("tech"), 5))
    poor = F.lit("I found relevant sections, but the extracted PDF text is too noisy for a reliable high-level summary in fallback mode.")
    return found.select("query_id", x.clean_claim(F.when(F.col("resume"), cv).when(F.size("s") > 0, paper).otherwise(poor)).alias("answer"))


def marker(style: Column, title: Column, chunk_id: Column, page: Column | None = None) -> Column:
    """The mark of a citation: title and page for apa and mla, else the chunk's id."""
    at = F.coalesce(page.cast("string") if page is not None else F.lit(None).cast("string"), F.lit("1"))
    return F.when(style == "apa", F.concat(F.lit("("), title, F.lit(", p."), at, F.lit(")"))).when(style == "mla", F.concat(F.lit("("), title, F.lit(" "), at, F.lit(")"))).otherwise(F.concat(F.lit("["), chunk_id, F.lit("]")))


def cite(answers: DataFrame, hits: DataFrame, threshold: float = 0.65, style: str = "inline") -> DataFrame:
    """query_id, annotated, cited, uncited: each sentence with the marker of the chunk most like it."""
    s = answers.select("query_id", F.posexplode(x.sentences(F.col("answer"))).alias("i", "s"))
    pairs = s.join(hits.select("query_id", "chunk_id", "doc_id", "text"), "query_id").withColumn("score", F.round(x.jaccard(x.word_set(F.col("s")), x.word_set(F.col("text"))), 9))
    best = pairs.groupBy("query_id", "i").agg(F.max_by(F.struct("chunk_id", "doc_id", "score"), F.struct("score", "chunk_id")).alias("b"))
    rows = s.join(best, ["query_id", "i"], "left").withColumn("ok", F.coalesce(F.col("b.score") >= threshold, F.lit(False)))
    shown = F.when(F.col("ok"), F.concat("s", F.lit(" "), marker(F.lit(style), F.col("b.doc_id"), F.col("b.chunk_id")))).otherwise(F.col("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("t")))), lambda r: r["t"]), " ").alias("annotated"), F.count_if("ok").alias("cited"), F.count_if(~F.col("ok")).alias("uncited"))


def quality(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id with relevance, diversity, coverage, completeness, overall and issues of the hits (query_id, doc_id, text)."""
    rows = hits.join(questions, "query_id")
    q, c = F.array_distinct(x.keywords(F.col("question"))), F.array_distinct(x.keywords(F.col("text")))
    grouped = rows.groupBy("query_id", "question").agg(
        F.avg(F.when(F.size(q) == 0, 0.5).otherwise(x.jaccard(q, c))).alias("relevance"), (F.count_distinct("doc_id") / F.count(F.lit(1))).alias("diversity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda r: r["text"]), " ").alias("context")
    )
    scored = grouped.select("query_id", "relevance", "diversity", check.coverage(F.col("question"), F.col("context")).alias("coverage"), check.subtopic_completeness(F.col("question"), F.col("context")).alias("completeness"))
    issues = F.filter(F.array(*(F.when(F.col(n) < least, f"low_{n}") for n, least in (("relevance", 0.4), ("diversity", 0.35), ("coverage", 0.45), ("completeness", 0.4)))), lambda i: i.isNotNull())
    out = scored.withColumn("overall", F.col("relevance") * 0.4 + F.col("diversity") * 0.25 + F.col("coverage") * 0.2 + F.col("completeness") * 0.15).withColumn("issues", issues)
    rest = questions.select("query_id").join(out, "query_id", "left")
    return rest.select("query_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("relevance", "diversity", "coverage", "completeness", "overall")), F.coalesce("issues", F.array(F.lit("no_results"))).alias("issues"))


@dataclass(frozen=True)
class Parameters:
    k_vector: int = 30
    k_bm25: int = 20
    k_graph: int = 10
    use_hyde: bool = False
    use_graph: bool = True
    use_colbert: bool = False
    max_per_doc: int = 2
    rerank_threshold: float = 0.3
    expand: bool = False


def tuned(relevance: Column, diversity: Column, coverage: Column, overall: Column, attempt: Column, any_hits: Column, p: Parameters | None = None) -> Column:
    """Struct of the next attempt's parameters from the quality of this one."""
    p = p or Parameters()
    weak, narrow, thin, good = relevance < 0.4, diversity < 0.35, coverage < 0.45, any_hits & (overall >= 0.75)
    k_vector = F.when(weak, int(p.k_vector * 1.5)).otherwise(p.k_vector)
    k_bm25 = F.when(thin, int(p.k_bm25 * 1.5)).otherwise(p.k_bm25)

    def fewer(k: Column) -> Column:
        return F.when(good, F.greatest(F.lit(10), F.floor(k * 0.8).cast("int"))).otherwise(k)

    return F.struct(
        fewer(k_vector).alias("k_vector"), fewer(k_bm25).alias("k_bm25"), F.lit(p.k_graph).alias("k_graph"), (weak | F.lit(p.use_hyde)).alias("use_hyde"), (narrow | F.lit(p.use_graph)).alias("use_graph"),
        ((attempt >= 2) | F.lit(p.use_colbert)).alias("use_colbert"), F.when(narrow, 1).otherwise(p.max_per_doc).alias("max_per_doc"),
        F.when(weak, max(0.05, p.rerank_threshold * 0.8)).otherwise(p.rerank_threshold).alias("rerank_threshold"), (thin | F.lit(p.expand)).alias("expand"),
    )


def label_score(label: Column) -> Column:
    return F.when(label == "High", 0.85).when(label == "Medium", 0.60).otherwise(0.30)


def retry(score: Column, attempt: Column, threshold: float = 0.65, most: int = 3) -> Column:
    return (score < threshold) & (attempt < most)


def adaptive(questions: DataFrame, chunks: DataFrame, index: bm25.Index, graph_edges: DataFrame | None = None, generator=None, attempts: int = 2, threshold: float = 0.65, written=None) -> DataFrame:
    """query_id, answer, overall, attempts: the advanced core's loop. A question whose context scores too low is retrieved again with tuned parameters.

    Each attempt is one batched plan over the questions left. What it found is kept (by default in the checkpoint folder), so that
    the next one does not compute it again.
    """
    kept = written or checkpointed
    left, parameters, done = questions.select("query_id", "question"), None, None
    for attempt in range(1, attempts + 1):
        hits = kept(retrieve.advanced(left, chunks, index, graph_edges=graph_edges, parameters=parameters, generator=generator))
        judged = quality(left, hits).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").join(extractive(left, hits).select("query_id", "answer"), "query_id")
        again = retry(F.col("overall"), F.lit(attempt), threshold, attempts)
        rows = kept(judged.select("query_id", "answer", "overall", F.lit(attempt).alias("attempts"), again.alias("again"), tuned(F.col("relevance"), F.col("diversity"), F.col("coverage"), F.col("overall"), F.lit(attempt), F.coalesce("n", F.lit(0)) > 0).alias("p")))
        good = rows.filter("NOT again").select("query_id", "answer", "overall", "attempts")
        done = good if done is None else done.unionByName(good)
        if attempt < attempts:
            parameters = rows.filter("again").select("query_id", "p.*")
            left = questions.select("query_id", "question").join(parameters.select("query_id"), "query_id", "left_semi")
    return done


def answer_batch(questions: DataFrame, chunks: DataFrame, claims: DataFrame, index: bm25.Index | Postings, retries: int = 1, base_k: int = 12, most_k: int = 30, vectors: VectorIndex | None = None, claim_vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, answer, supported, confidence, quality, attempts: the adaptive loop.

    Each attempt is one batched job over the questions that the one before left unsatisfied; the number of attempts is bounded.
    """
    left, done, k = questions, None, min(most_k, base_k + 6)
    for attempt in range(retries + 1):
        hits = retrieve.hybrid(left, chunks, claims, index, k, vectors=vectors, claim_vectors=claim_vectors)
        context = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"]), " ").alias("context"))
        judged = fallback(left, hits).join(context, "query_id", "left").join(fusion.retrieval_quality(hits), "query_id", "left")
        judged = judged.select("query_id", "answer", check.verification(F.col("answer"), F.coalesce("context", F.lit(""))).alias("v"), F.coalesce("quality", F.lit(0.0)).alias("quality"), F.lit(attempt + 1).alias("attempts"))
        again = check.should_retry(F.col("v.supported"), F.col("v.issues"), F.col("v.confidence"), F.col("quality"), F.lit(attempt), retries, model=False)
        rows = checkpointed(judged.select("query_id", "answer", "v.supported", "v.confidence", "quality", "attempts", again.alias("again")))
        good = rows.filter("NOT again").drop("again")
        done = good if done is None else done.unionByName(good)
        rest = rows.filter("again").select("query_id")
        if attempt == retries or rest.isEmpty():
            break
        left, k = left.join(rest, "query_id", "left_semi"), min(most_k, k + 3)
    return done


def correct(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, labels (map of counts), bad, act: the corrective check of retrieved chunks and whether to retrieve again."""
    labels = hits.join(questions, "query_id").select("query_id", check.corrective_label(F.col("question"), F.col("text")).alias("label")).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    bad = F.sum(F.when(F.col("label").isin("INCORRECT", "IRRELEVANT", "CONTRADICTORY"), F.col("n")).otherwise(0))
    return labels.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"), bad.alias("bad"), F.sum("n").alias("total")).withColumn("act", F.col("bad") > F.greatest(F.lit(1), F.floor(F.col("total") / 2))).drop("total")


def reason(questions: DataFrame, chunks: DataFrame, index: bm25.Index, mode: str = "multihop", k: int = 3) -> DataFrame:
    """query_id, answer: sub-questions answered in one batch and joined in order."""
    split = e.sub_questions if mode == "multihop" else e.query_variants if mode == "survey" else e.hops
    parts = questions.select(F.col("query_id").alias("parent"), F.posexplode(split(F.col("question"))).alias("i", "question")).withColumn("query_id", F.xxhash64("parent", "i"))
    hits = fusion.bodies(retrieve.lexical(parts.select("query_id", "question"), index, k), chunks.select("chunk_id", "text"))
    answers = extractive(parts.select("query_id", "question"), hits, 1).join(parts.select("query_id", "parent", "i", "question"), "query_id")
    return answers.groupBy(F.col("parent").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "question", "answer"))), lambda r: F.concat(r["question"], F.lit(" "), r["answer"])), "\n").alias("answer"))


#: Chunks of a context; characters that an answer may share with a chunk before it is an echo; what a generator without a model says first (fixed values).
CONTEXT_CHUNKS, ECHO_CHARS, NO_MODEL = 8, 80, "LLM fallback response:"
ASK, PARAPHRASE = "Answer from the context alone.", "Say it in words of your own: no sentence of the context may come back verbatim."


def contexts(hits: DataFrame, most: int = CONTEXT_CHUNKS) -> DataFrame:
    """query_id, context, texts: the first ``most`` usable chunks under their ids, and the texts of all of them.

    Chunks that look like references are left out, unless nothing else is there (hits: query_id, position, chunk_id, text).
    """
    whole = Window.partitionBy("query_id")
    marked = hits.withColumn("_reference", e.is_reference_chunk(F.col("text"))).withColumn("_all", F.min(F.col("_reference").cast("int")).over(whole) == 1)
    usable = marked.filter("NOT _reference OR _all").withColumn("_n", F.row_number().over(whole.orderBy("position", "chunk_id")))
    shown = F.concat(F.lit("["), "chunk_id", F.lit("] "), x.strip(F.col("text")))
    rows = usable.select("query_id", "_n", "text", F.when((F.col("_n") <= most) & (x.strip(F.col("text")) != ""), shown).alias("shown"))
    got = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", "shown", "text"))).alias("r"))
    return got.select("query_id", F.array_join(F.transform("r", lambda r: r["shown"]), "\n\n").alias("context"), F.transform("r", lambda r: r["text"]).alias("texts"))


def advanced(questions: DataFrame, hits: DataFrame, generator: Generator) -> DataFrame:
    """query_id, answer, summary, echo, attempts: a generator's answer from at most eight chunks.

    An answer that shares more than ``ECHO_CHARS`` characters in a row with a usable chunk is asked for again, once, with the order to
    paraphrase; the second one stands if there is one. Where no model is there, the answer is null.
    """
    asked = questions.select("query_id", "question").join(contexts(hits), "query_id", "left").select("query_id", "question", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for question, context, texts in zip(b["question"], b["context"], b["texts"], strict=True):

                def say(order: str, question=question, context=context) -> str:
                    said = generator.generate(f"{order}\n\nQuestion: {question}\n\nContext:\n{context}")
                    return "" if not said or said.startswith(NO_MODEL) else said

                first = say(ASK)
                own = Substrings(first[:4000])
                echo = bool(first) and any(own.longest_in((t or "")[:4000]) > ECHO_CHARS for t in texts)
                answer = (say(PARAPHRASE) or first) if echo else first
                out.append((answer or None, answer[:180] + "..." if len(answer) > 180 else answer or None, echo, 1 + echo))
            yield pd.DataFrame({"query_id": b["query_id"], **dict(zip(("answer", "summary", "echo", "attempts"), map(list, zip(*out, strict=True)), strict=True))})

    return asked.mapInPandas(run, "query_id long, answer string, summary string, echo boolean, attempts int")

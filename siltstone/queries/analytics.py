"""Queries of aggregates, windows, vectors, metrics, graphs and time (AGG, WIN, MTH, DT, JN13-18, STR, HLP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.functions import vectors as v
from siltstone.operators import fusion, graph, metrics, similar
from siltstone.plans import retrieve
from siltstone.queries.corpus import QUESTIONS, SQL_CHUNKS, SQL_HITS, SQL_PAPERS, SQL_QUESTIONS, chunks, hits, papers, questions, s_sentences, s_tokens
from siltstone.queries.registry import query

C, H, P, Q = SQL_CHUNKS, SQL_HITS, SQL_PAPERS, SQL_QUESTIONS
# counts and reports
query("agg01_counts", f"WITH {C} SELECT paper_id, count(*) AS chunks, CAST(sum(ordinal % 3) AS BIGINT) AS claims FROM chunks GROUP BY 1")(lambda t: chunks(t).groupBy("paper_id").agg(F.count("*").alias("chunks"), F.sum(F.pmod("ordinal", F.lit(3))).alias("claims")))
query("agg02_system_stats", f"WITH {P}, {C} SELECT (SELECT count(*) FROM papers) AS papers, count(*) AS chunks, count(DISTINCT section) AS sections FROM chunks")(lambda t: chunks(t).agg(F.count("*").alias("chunks"), F.count_distinct("section").alias("sections")).crossJoin(papers(t).agg(F.count("*").alias("papers"))).select("papers", "chunks", "sections"))
query("agg03_structure_rollup", f"WITH {C} SELECT coalesce(section, '*') AS section, coalesce(content_type, '*') AS content_type, count(*) AS n FROM chunks GROUP BY ROLLUP (section, content_type)")(lambda t: chunks(t).rollup("section", "content_type").agg(F.count("*").alias("n")).select(F.coalesce("section", F.lit("*")).alias("section"), F.coalesce("content_type", F.lit("*")).alias("content_type"), "n"))
query("agg04_ingest_report", f"WITH {C} SELECT paper_id, count(*) FILTER (content_type = 'table') AS tables, count(*) FILTER (content_type = 'text') AS texts, max(page_number) AS pages, round(avg(length(text)), 6) AS mean_chars, array_to_string(list_sort(list(DISTINCT section)), '|') AS sections FROM chunks GROUP BY 1")(
    lambda t: chunks(t).groupBy("paper_id").agg(F.count_if(F.col("content_type") == "table").alias("tables"), F.count_if(F.col("content_type") == "text").alias("texts"), F.max("page_number").alias("pages"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))
)
query("agg05_source_counter", f"WITH {H} SELECT query_id, list AS source, count(*) AS n FROM hits GROUP BY 1, 2")(lambda t: hits(t).groupBy("query_id", F.col("list").alias("source")).agg(F.count("*").alias("n")))
query("agg06_majority_bad", f"WITH {H}, l AS (SELECT query_id, CASE WHEN score < 20 THEN 'IRRELEVANT' WHEN score < 35 THEN 'INCORRECT' WHEN score < 60 THEN 'AMBIGUOUS' ELSE 'CORRECT' END AS label FROM hits) SELECT query_id, count(*) FILTER (label IN ('IRRELEVANT', 'INCORRECT')) AS bad, count(*) AS total, bad > greatest(1, total // 2) AS act FROM l GROUP BY 1")(
    lambda t: hits(t).withColumn("label", F.when(F.col("score") < 20, "IRRELEVANT").when(F.col("score") < 35, "INCORRECT").when(F.col("score") < 60, "AMBIGUOUS").otherwise("CORRECT")).groupBy("query_id").agg(F.count_if(F.col("label").isin("IRRELEVANT", "INCORRECT")).alias("bad"), F.count("*").alias("total")).withColumn("act", F.col("bad") > F.greatest(F.lit(1), F.floor(F.col("total") / 2)))
)
query("agg07_eval_summary", "SELECT lang, round(avg(list_sum(list_transform(['the', 'tion', 'der'], lambda k: CAST(contains(lower(text), k) AS INT))) / 3.0), 6) AS keyword_recall, round(count(*) FILTER (n_chars > 500) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS supported_rate FROM documents GROUP BY 1")(
    lambda t: t("documents").groupBy("lang").agg(F.round(F.avg(x.count_any(F.lower("text"), "the", "tion", "der") / 3.0), 6).alias("keyword_recall"), F.round(F.count_if(F.col("n_chars") > 500) / F.greatest(F.count("*"), F.lit(1)), 6).alias("supported_rate"))
)


def _ragas(t):
    q, c = x.eval_tokens(F.col("question")), x.eval_tokens(F.col("text"))
    rows = t("benchmark").select("item_id", F.col("text").alias("answer")).join(questions(t), F.col("item_id") == F.col("query_id")).join(t("documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    d = F.array_distinct
    return rows.select("item_id", *metrics.overlap_ratios(d(q), d(x.eval_tokens(F.col("answer"))), d(c), d(x.eval_tokens(F.substring("answer", 1, 60)))))


_ts = r"list_distinct(list_transform(list_filter(regexp_extract_all({}, '[A-Za-z0-9_\-]+'), lambda w: length(w) > 2), lambda w: lower(w)))"
_ratio = "coalesce(len(list_intersect({0}, {1})) / CAST(nullif(len({2}), 0) AS DOUBLE), 0.0)"
RAGAS = f"""{Q}, s AS (SELECT b.item_id, {_ts.format("q.question")} AS q, {_ts.format("b.text")} AS a, {_ts.format("d.text")} AS c, {_ts.format("left(b.text, 60)")} AS g FROM benchmark b JOIN questions q ON q.query_id = b.item_id JOIN documents d ON d.doc_id = b.item_id),
m AS (SELECT item_id, {_ratio.format("a", "c", "a")} AS faithfulness, {_ratio.format("q", "a", "q")} AS answer_relevancy, {_ratio.format("c", "q", "c")} AS context_precision, {_ratio.format("c", "q", "q")} AS context_recall, CASE WHEN len(g) > 0 THEN {_ratio.format("a", "g", "g")} ELSE 0.5 * {_ratio.format("q", "a", "q")} + 0.5 * {_ratio.format("a", "c", "a")} END AS answer_correctness FROM s)"""
_five = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
query("mth18_overlap_ratios", f"WITH {RAGAS} SELECT item_id, {', '.join(f'round({c}, 6) AS {c}' for c in _five)} FROM m")(lambda t: _ragas(t).select("item_id", *(F.round(c, 6).alias(c) for c in _five)))
query("agg08_dataset_average", f"WITH {RAGAS} SELECT count(*) AS size, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _five)} FROM m")(lambda t: _ragas(t).agg(F.count("*").alias("size"), *(F.round(F.avg(c), 6).alias(c) for c in _five)))
for name in ("agg09_latency_profile", "hlp11_latency_records"):
    query(name, "SELECT event_type AS name, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n, count(*) FILTER (value > 90) AS failures FROM events GROUP BY 1")(lambda t: t("events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"), F.count_if(F.col("value") > 90).alias("failures")))
query("agg18_router_health", "WITH c AS (SELECT event_type AS model, event_id AS seq, round(value, 3) AS latency, value < 90 AS ok FROM events) SELECT model, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, round(avg(latency), 6) AS mean, array_to_string(list_transform(list_slice(list(latency ORDER BY seq DESC), 1, 5), lambda x_: CAST(CAST(round(x_ * 1000) AS BIGINT) AS VARCHAR)), '|') AS latencies FROM c GROUP BY 1")(
    lambda t: metrics.router_health(t("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.round("value", 3).alias("latency"), (F.col("value") < 90).alias("ok"))).select("model", "calls", "failures", F.round("mean", 6).alias("mean"), F.array_join(F.transform("latencies", lambda v: F.round(v * 1000).cast("long").cast("string")), "|").alias("latencies"))
)
_abl = ("full", "no_view", "no_click")
query("agg10_list_ablation", f"WITH {H}, a AS (SELECT c.config, h.* FROM hits h, (SELECT unnest({list(_abl)}) AS config) c WHERE NOT (c.config = 'no_view' AND h.list = 'view') AND NOT (c.config = 'no_click' AND h.list = 'click')), r AS (SELECT *, row_number() OVER (PARTITION BY config, query_id, list ORDER BY score DESC, chunk_id) AS rank FROM a) SELECT config, round(avg(1 / CAST(60 + rank AS DOUBLE)), 9) AS mean_fused, count(*) AS n FROM r GROUP BY 1")(
    lambda t: fusion.rank(hits(t).select("*", F.explode(F.array(*map(F.lit, _abl))).alias("config")).filter(~((F.col("config") == "no_view") & (F.col("list") == "view")) & ~((F.col("config") == "no_click") & (F.col("list") == "click"))), ["config", "query_id", "list"]).groupBy("config").agg(F.round(F.avg(F.lit(1.0) / (F.col("rank") + 60)), 9).alias("mean_fused"), F.count("*").alias("n"))
)
query("agg11_feedback_stats", "SELECT count(*) AS total, count(*) FILTER (quality = 0 OR toxic = 1) AS hard_negatives, count(*) FILTER (quality = 1 AND toxic = 0) AS high_quality FROM labels")(lambda t: t("labels").agg(F.count("*").alias("total"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("hard_negatives"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("high_quality")))
query("agg12_index_audit", f"WITH {C} SELECT count(DISTINCT paper_id) AS papers, count(*) AS chunks, round(count(*) / CAST(count(DISTINCT paper_id) AS DOUBLE), 6) AS per_paper, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(trim(text)) < 30) AS under_30, count(*) FILTER (length(trim(text)) < 80) AS under_80 FROM chunks")(
    lambda t: chunks(t).agg(F.count_distinct("paper_id").alias("papers"), F.count("*").alias("chunks"), F.round(F.count("*") / F.count_distinct("paper_id"), 6).alias("per_paper"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.length(F.trim("text")) < 30).alias("under_30"), F.count_if(F.length(F.trim("text")) < 80).alias("under_80"))
)
query("agg13_quality_audit", "SELECT event_type, round(avg(value / 100), 6) AS mean, min(value / 100) AS least, max(value / 100) AS most, count(*) FILTER (value / 100 < 0.4) AS under_40, count(*) FILTER (value / 100 < 0.5) AS under_50, count(*) FILTER (value / 100 >= 0.7) AS from_70 FROM events GROUP BY 1")(
    lambda t: t("events").withColumn("q", F.col("value") / 100).groupBy("event_type").agg(F.round(F.avg("q"), 6).alias("mean"), F.min("q").alias("least"), F.max("q").alias("most"), F.count_if(F.col("q") < 0.4).alias("under_40"), F.count_if(F.col("q") < 0.5).alias("under_50"), F.count_if(F.col("q") >= 0.7).alias("from_70"))
)
query("agg13_worst_eight", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 8")(lambda t: t("events").orderBy("value", "event_id").limit(8).select("event_id", "value"))
query("agg14_dashboard_kpis", "SELECT CAST(floor(avg(value) + 0.5) AS BIGINT) AS avg_latency, CAST(floor(100 * avg(value / 100) + 0.5) AS BIGINT) AS avg_confidence, CAST(floor(100 * count(*) FILTER (value / 100 > 0.6) / CAST(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS success_rate FROM events")(
    lambda t: t("events").agg(F.floor(F.avg("value") + 0.5).alias("avg_latency"), F.floor(F.avg(F.col("value") / 100) * 100 + 0.5).alias("avg_confidence"), F.floor(F.count_if(F.col("value") / 100 > 0.6) * 100 / F.count("*") + 0.5).alias("success_rate"))
)
_spine = "s AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day)"


def _daily(t):
    days = t.spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2023-12-25")), F.to_date(F.lit("2024-01-31")))).alias("day"))
    counts = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"))


for name in ("agg15_daily_series", "str08_daily_series", "dt05_day_buckets", "agg17_sparkline"):
    query(name, f"WITH {_spine} SELECT s.day, count(e.event_id) AS n, round(coalesce(avg(e.value), 0.0), 6) AS mean FROM s LEFT JOIN events e ON CAST(e.ts AS DATE) = s.day GROUP BY 1")(_daily)
query("agg16_histogram", "WITH b AS (SELECT unnest(range(10)) AS bucket) SELECT b.bucket, count(e.event_id) AS n FROM b LEFT JOIN events e ON CAST(floor(e.value / 10) AS BIGINT) = b.bucket GROUP BY 1")(lambda t: t.spark.range(10).select(F.col("id").alias("bucket")).join(t("events").groupBy(F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("k")), "bucket", "left").select("bucket", F.coalesce("k", F.lit(0)).alias("n")))
query("agg17_last_twenty", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY 1")(lambda t: t("events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 20").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")))
query("agg19_literature_review", "WITH r AS (SELECT lang AS cluster, doc_id, left(string_split(text, chr(10))[1], 40) AS title, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT s.section, cluster, '## ' || s.section || chr(10) || '### ' || cluster || chr(10) || string_agg('- ' || title, chr(10) ORDER BY rn) AS body FROM r, (SELECT unnest(['Background', 'Findings']) AS section) s WHERE rn <= 5 GROUP BY 1, 2")(
    lambda t: t("documents").select(F.col("lang").alias("cluster"), F.substring(F.split("text", "\n")[0], 1, 40).alias("title"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rn")).filter("rn <= 5").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda r: F.concat(F.lit("- "), r["title"])), "\n").alias("items")).select(F.explode(F.array(F.lit("Background"), F.lit("Findings"))).alias("section"), "cluster", "items").select("section", "cluster", F.concat(F.lit("## "), "section", F.lit("\n### "), "cluster", F.lit("\n"), "items").alias("body"))
)

# ranks and windows
_r = "row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id)"
query("win01_vector_ranks", f"WITH {H} SELECT query_id, list, chunk_id, {_r} AS rank FROM hits")(lambda t: fusion.rank(hits(t), ["query_id", "list"]).select("query_id", "list", "chunk_id", F.col("rank").cast("long").alias("rank")))
query("win02_best_claim_rank", f"WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, list) AS rank FROM hits) SELECT query_id, chunk_id, min(rank) AS rank, arg_min(list, rank) AS headline FROM r GROUP BY 1, 2")(
    lambda t: hits(t).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "list"))).groupBy("query_id", "chunk_id").agg(F.min("rank").cast("long").alias("rank"), F.min_by("list", "rank").alias("headline"))
)
query("win03_nonzero_ranks", f"WITH {H}, z AS (SELECT query_id, list, chunk_id, CASE WHEN score < 10 THEN 0 ELSE score END AS score FROM hits) SELECT query_id, list, chunk_id, {_r} AS rank FROM z WHERE score <> 0 QUALIFY rank <= 15")(lambda t: fusion.top(hits(t).withColumn("score", F.when(F.col("score") < 10, 0.0).otherwise(F.col("score"))).filter("score <> 0"), ["query_id", "list"], 15).select("query_id", "list", "chunk_id", F.col("rank").cast("long").alias("rank")))


def _blend(t):
    f = fusion.reciprocal_rank(hits(t))
    w = Window.partitionBy("query_id")
    r1 = F.row_number().over(w.orderBy(F.xxhash64("chunk_id").isNull(), F.desc("source"), "chunk_id"))
    r2 = F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return f.select("query_id", "chunk_id", F.round(F.lit(1.2) / (r1 + 60) + F.lit(1.0) / (r2 + 60) + F.when(F.col("source") == "view", 0.025).otherwise(0.0), 9).alias("blended"))


query("win04_blended_rank", f"WITH {H}, r AS (SELECT *, {_r} AS rank FROM hits), f AS (SELECT query_id, chunk_id, round(sum(1 / CAST(60 + rank AS DOUBLE)), 9) AS score, arg_max(list, (score, list)) AS source FROM r GROUP BY 1, 2) SELECT query_id, chunk_id, round(1.2 / CAST(60 + row_number() OVER (PARTITION BY query_id ORDER BY source DESC, chunk_id) AS DOUBLE) + 1.0 / CAST(60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS DOUBLE) + CASE WHEN source = 'view' THEN 0.025 ELSE 0.0 END, 9) AS blended FROM f")(_blend)
query("win05_section_cap", f"WITH {H}, b AS (SELECT query_id, chunk_id, doc_id, max(score) AS score FROM hits GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) > 2 AS late FROM r) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS position FROM s QUALIFY position <= 10")(
    lambda t: fusion.cap_and_fill(fusion.rank(hits(t).groupBy("query_id", "chunk_id", "doc_id").agg(F.max("score").alias("score")), ["query_id"]), ["query_id"], "doc_id", 2, 10).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))
)
query("win06_retrieval_quality", f"WITH {H}, b AS (SELECT query_id, count(*) AS n, max(score) AS top, sum(score) AS total, count(DISTINCT doc_id) AS docs FROM hits GROUP BY 1) SELECT query_id, round(least(1.0, 0.45 * (list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / i)) / n) + 0.35 * CASE WHEN top > 0 THEN total / top / n ELSE 0 END + 0.2 * docs / CAST(least(n, 5) AS DOUBLE)), 4) AS quality FROM b")(lambda t: fusion.retrieval_quality(hits(t), "doc_id", "score"))
query("win08_greedy_diversity")(lambda t: fusion.diversify(fusion.reciprocal_rank(hits(t)).withColumn("text", F.concat("chunk_id", F.lit(" "), "doc_id", F.lit(" "), "source"))))
query("win09_section_carry", f"WITH {C} SELECT chunk_id, coalesce(last_value(CASE WHEN content_type = 'table' THEN section WHEN ordinal % 4 = 0 THEN section END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), 'body') AS current FROM chunks")(
    lambda t: chunks(t).select("chunk_id", F.coalesce(F.last(F.when((F.col("content_type") == "table") | (F.pmod("ordinal", F.lit(4)) == 0), F.col("section")), True).over(Window.partitionBy("paper_id").orderBy("ordinal")), F.lit("body")).alias("current"))
)
query("win10_chunk_stamps", f"WITH {C} SELECT chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY ordinal) - 1 AS chunk_index, count(*) OVER (PARTITION BY paper_id) AS total_chunks FROM chunks")(lambda t: chunks(t).select("chunk_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy("ordinal")) - 1).cast("long").alias("chunk_index"), F.count("*").over(Window.partitionBy("paper_id")).alias("total_chunks")))
query("win11_char_cursor", f"WITH {C} SELECT chunk_id, CAST(sum(length(text) + 1) OVER (PARTITION BY paper_id ORDER BY ordinal) - length(text) - 1 AS BIGINT) AS char_start FROM chunks")(lambda t: chunks(t).select("chunk_id", (F.sum(F.length("text") + 1).over(Window.partitionBy("paper_id").orderBy("ordinal")) - F.length("text") - 1).alias("char_start")))
query("win13_sliding_windows", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda v: v <> '') AS ws FROM documents) SELECT doc_id, array_to_string(list_transform(range(0, len(ws), 40), lambda i: sha1(array_to_string(list_slice(ws, i + 1, i + 50), ' '))), '|') AS digests FROM w")(lambda t: t("documents").select("doc_id", x.windows(x.split_words(F.col("text")), 50, 40).alias("w")).select("doc_id", F.array_join(F.transform("w", lambda s: F.sha1(s)), "|").alias("digests")))

# hashes and vectors
query("mth01_row_ids", f"WITH {C} SELECT sha1(paper_id || ':' || page_number || ':' || section || ':' || ordinal || ':' || text) AS id FROM chunks")(lambda t: chunks(t).select(F.sha1(F.concat_ws(":", "paper_id", F.col("page_number").cast("string"), "section", F.col("ordinal").cast("string"), "text")).alias("id")))
query("mth02_stable_id", r"SELECT page_id, 'page-' || coalesce(nullif(left(trim(regexp_replace(lower(url), '[^a-zA-Z0-9-]+', '-', 'g'), '-'), 48), ''), 'item') || '-' || left(sha1(url), 12) AS id FROM pages")(lambda t: t("pages").select("page_id", F.concat(F.lit("page-"), F.coalesce(F.nullif(F.substring(F.btrim(F.regexp_replace(F.lower("url"), "[^a-zA-Z0-9-]+", "-"), F.lit("-")), 1, 48), F.lit("")), F.lit("item")), F.lit("-"), F.substring(F.sha1("url"), 1, 12)).alias("id")))
query("mth03_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")(lambda t: t("pages").select("page_id", F.sha2("html", 256).alias("digest")))


def _embedding_sql(weighted: bool, dim: int, table: str = "documents", key: str = "doc_id", cte: str = "") -> str:
    sign = "CASE WHEN CAST('0x' || substr(h, {}, 2) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END"
    w = f"{sign.format(5)} * (1.0 + CAST('0x' || substr(h, 7, 2) AS INT) / 255.0)" if weighted else sign.format(7)
    return f"""{cte}tk AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({s_tokens("text")}) AS token FROM {table}) GROUP BY 1, 2), hh AS (SELECT {key}, n, sha256(token) AS h FROM tk),
 pl AS (SELECT {key}, CAST('0x' || substr(h, 1, 4) AS INT) % {dim} AS idx, CAST(sum(n * ({w})) AS DOUBLE) AS w FROM hh GROUP BY 1, 2), nm AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM pl GROUP BY 1),
 emb AS (SELECT {key}, idx, w / norm AS w FROM pl JOIN nm USING ({key}) WHERE norm > 0 AND w <> 0)"""


for name, weighted, dim in (("mth04_hash_embedding_weighted", True, 384), ("mth05_hash_embedding", False, 1024), ("hlp17_embed_texts", True, 384)):
    query(name, f"WITH {_embedding_sql(weighted, dim)} SELECT doc_id, count(*) AS places, round(sum(w * (idx + 1)), 6) AS weighted, round(sum(w * w), 6) AS length FROM emb WHERE abs(w) > 1e-9 GROUP BY 1")(
        lambda t, weighted=weighted, dim=dim: v.hash_embedding(t("documents"), "doc_id", "text", dim, weighted).filter("abs(w) > 1e-9").groupBy("doc_id").agg(F.count("*").alias("places"), F.round(F.sum(F.col("w") * (F.col("idx") + 1)), 6).alias("weighted"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("length"))
    )


def _told(vector):
    """A vector as text, six digits a number."""
    return F.array_join(F.transform(vector, lambda v: F.format_number(v.cast("double"), 6)), " ")


query("mth06_seeded_vectors")(lambda t: v.text_vectors(t("documents"), "doc_id", "text").select("doc_id", _told(F.col("embedding")).alias("vector")))
query("mth07_token_vectors")(lambda t: v.token_vectors(t("benchmark"), "item_id", "text").select("item_id", "token", _told(F.col("vector")).alias("vector")))


def _token_index(t):
    """The index of token vectors: an item that comes twice keeps its last text; looked up by the questions' first words."""
    twice = t("benchmark").select("item_id", "text", F.lit(0).alias("version")).unionByName(t("benchmark").filter(F.pmod("item_id", F.lit(5)) == 0).select("item_id", F.concat("text", F.lit(" refreshed")).alias("text"), F.lit(1).alias("version")))
    last = twice.groupBy("item_id").agg(F.max_by("text", "version").alias("text"))
    index = v.token_vectors(last, "item_id", "text")
    asked = questions(t).select(F.lower(F.get(x.tokens(F.col("question")), F.lit(0))).alias("token")).unionByName(t.spark.createDataFrame([("refreshed",)], "token string")).distinct()
    return index.join(asked, "token").select("item_id", "token", _told(F.col("vector")).alias("vector"))


query("hlp19_token_index")(_token_index)
_pair = "p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vector_pairs(t):
    e = t("embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b")), "a_id")


_dot = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_cos = f"{_dot.format('a', 'b')} / nullif(sqrt({_dot.format('a', 'a')}) * sqrt({_dot.format('b', 'b')}), 0)"
query("mth08_normalize", f"SELECT vec_id, round({_dot.format('embedding', 'embedding')} / ({_dot.format('embedding', 'embedding')}), 6) AS squared FROM embeddings")(lambda t: t("embeddings").select("vec_id", v.normalize(F.col("embedding")).alias("u")).select("vec_id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("squared")))
query("mth09_cosine", f"WITH {_pair} SELECT a_id, round(coalesce({_cos}, 0), 6) AS score FROM p")(lambda t: _vector_pairs(t).select("a_id", F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("score")))
query("mth10_distance_score", f"WITH {_pair} SELECT a_id, round(1.0 - least(greatest(1.0 - coalesce({_cos}, 0), 0.0), 2.0) / 2.0, 6) AS score FROM p")(lambda t: _vector_pairs(t).select("a_id", F.round(v.distance_score(F.lit(1.0) - v.cosine(F.col("a"), F.col("b"))), 6).alias("score")))
query("mth11_embedding_noise")(lambda t: t("embeddings").select("vec_id", v.add_noise(F.col("embedding"), F.col("vec_id")).alias("n")).select("vec_id", F.transform("n", lambda e: F.round(e, 9)).alias("noised")))

_k = "avg(exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))"
_k = "avg(exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))"
query("mth12_drift", f"WITH m AS (SELECT label < 5 AS old, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), k AS (SELECT (SELECT {_k} FROM m a, m b WHERE a.old AND b.old) + (SELECT {_k} FROM m a, m b WHERE NOT a.old AND NOT b.old) - 2 * (SELECT {_k} FROM m a, m b WHERE a.old AND NOT b.old) AS mmd) SELECT round(greatest(0.0, mmd), 6) AS mmd, mmd > 0.2 AS drift FROM k")(
    lambda t: v.mmd(t("embeddings").filter("label < 5"), t("embeddings").filter("label >= 5"), "embedding").select(F.round("mmd", 6).alias("mmd"), (F.col("mmd") > 0.2).alias("drift"))
)

# metrics: a user's ranked event types by value against those of long sessions
_RK = f"{H}, rk AS (SELECT query_id, chunk_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, chunk_id) AS rank FROM hits GROUP BY 1, 2), rel AS (SELECT DISTINCT query_id, chunk_id AS item FROM hits WHERE list = 'purchase'), j AS (SELECT rk.*, CAST(rel.item IS NOT NULL AS INT) AS hit, (SELECT count(*) FROM rel r WHERE r.query_id = rk.query_id) AS n, sum(CAST(rel.item IS NOT NULL AS INT)) OVER (PARTITION BY rk.query_id ORDER BY rank) AS seen FROM rk LEFT JOIN rel ON rel.query_id = rk.query_id AND rel.item = rk.item)"


def _ranked(t):
    best = hits(t).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return fusion.rank(best, ["query_id"]).select("query_id", F.col("chunk_id").alias("item"), "rank")


def _metric(name, column, sql):
    query(name, f"WITH {_RK} SELECT query_id, round(CAST({sql} AS DOUBLE), 6) AS value FROM j GROUP BY query_id")(lambda t: metrics.retrieval_metrics(_ranked(t), hits(t).filter("list = 'purchase'").select("query_id", F.col("chunk_id").alias("item")), 5).select("query_id", F.round(column, 6).alias("value")))


_metric("mth13_precision_at_k", "precision", "sum(hit) FILTER (rank <= 5) / 5.0")
_metric("mth14_recall_at_k", "recall", "coalesce(sum(hit) FILTER (rank <= 5) / CAST(nullif(max(n), 0) AS DOUBLE), 0)")
_metric("mth15_reciprocal_rank", "reciprocal_rank", "coalesce(1.0 / CAST(min(rank) FILTER (hit = 1) AS DOUBLE), 0)")
_metric("mth17_average_precision", "average_precision", "coalesce(sum(CASE WHEN hit = 1 THEN seen / CAST(rank AS DOUBLE) ELSE 0 END) / CAST(nullif(max(n), 0) AS DOUBLE), 0)")
query("mth16_ndcg", f"WITH {_RK}, g AS (SELECT query_id, rank, CAST(substr(item, 2) AS INT) % 4 AS grade FROM rk), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM g) SELECT query_id, round(CAST(coalesce(sum(CASE WHEN rank <= 5 THEN grade / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 5 THEN grade / log2(ideal + 1) ELSE 0 END), 0), 0) AS DOUBLE), 6) AS value FROM i GROUP BY 1")(
    lambda t: metrics.ndcg(_ranked(t).select("query_id", "rank", F.pmod(F.substring("item", 2, 9).cast("int"), F.lit(4)).alias("grade")), 5).select("query_id", F.round("ndcg", 6).alias("value"))
)
query("hlp12_safe_ratio", "SELECT event_id, round(least(greatest(coalesce(value / nullif(CAST(user_id % 3 AS DOUBLE), 0), 0), 0), 1), 6) AS out FROM events")(lambda t: t("events").select("event_id", F.round(F.least(F.greatest(F.coalesce(F.try_divide("value", F.pmod("user_id", F.lit(3)).cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 6).alias("out")))

# graphs over suppliers and parts
_E = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def _edges(t):
    return t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


query("mth22_degrees", f"WITH {_E}, b AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM b GROUP BY 1")(lambda t: graph.degrees(_edges(t)))
PAGERANK = f"""WITH RECURSIVE {_E}, n AS (SELECT id, sum(o) AS o FROM (SELECT src AS id, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY 1), r AS (
  SELECT 0 AS i, id, o, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank, 1.0::DOUBLE AS change FROM n
  UNION ALL
  SELECT i + 1, id, o, next, sum(abs(next - rank)) OVER () FROM (
    SELECT r.i, r.id, r.o, r.rank, r.change, 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank) FILTER (o = 0), 0) FROM r) / (SELECT count(*) FROM n)) + 0.15 / (SELECT count(*) FROM n) AS next
    FROM r LEFT JOIN (SELECT e.dst AS id, sum(q.rank / q.o) AS flow FROM e JOIN r q ON q.id = e.src GROUP BY 1) f USING (id)
  ) WHERE change >= 1e-6
) SELECT id, round(rank, 9) AS rank, CAST(i AS INTEGER) AS rounds FROM r WHERE i = (SELECT max(i) FROM r)"""


def _ranked_nodes(t):
    ranks, rounds = graph.pagerank(_edges(t))
    return ranks.select("id", F.round("rank", 9).alias("rank"), F.lit(rounds).alias("rounds"))


query("mth20_pagerank", PAGERANK)(_ranked_nodes)


def _both_ways(t):
    """Suppliers and parts, joined both ways, so that paths are longer than one step."""
    return _edges(t).unionByName(_edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _between(t):
    """Every node whose number is divisible by 100 is a source; all nodes and edges are searched."""
    e = _both_ways(t)
    sources = e.select(F.col("src").alias("id")).distinct().filter(F.pmod(F.substring("id", 2, 19).cast("long"), F.lit(100)) == 0)
    return graph.betweenness(e, sources).select("id", F.round("betweenness", 9).alias("betweenness"))


query("mth21_betweenness")(_between)
query("jn13_neighbours", f"WITH {_E} SELECT src AS id, count(*) AS n FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) GROUP BY 1")(lambda t: graph.neighbours(_edges(t), True).groupBy("id").agg(F.count("*").alias("n")))
query("jn14_citation_network", f"WITH {_E} SELECT src, dst FROM e WHERE src = 's1' OR dst = 's1'")(lambda t: _edges(t).distinct().filter("src = 's1' OR dst = 's1'"))
query("jn16_neighbour_ranks", f"WITH {_E} SELECT src AS entity, dst AS related, round(1.0 / CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS DOUBLE), 6) AS score FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 10")(lambda t: _edges(t).distinct().withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter("rn <= 10").select(F.col("src").alias("entity"), F.col("dst").alias("related"), F.round(F.lit(1.0) / F.col("rn"), 6).alias("score")))




# what papers of an entity lead to: papers use their source and their language
RELATED = f"""WITH {P}, {C}, ed AS (SELECT DISTINCT 'p' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS src, unnest([source, lang]) AS dst FROM documents), aq AS (SELECT item_id AS query_id, 'src' || item_id % 7 AS dst FROM benchmark),
 f1 AS (SELECT query_id, src, 1 AS step FROM (SELECT DISTINCT query_id, src FROM aq JOIN ed USING (dst)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY src) <= 10),
 b1 AS (SELECT b.query_id, e.src, 2 AS step FROM (SELECT DISTINCT query_id, ed.dst FROM f1 JOIN ed USING (src)) b JOIN ed e USING (dst)), p0 AS (SELECT query_id, src, min(step) AS step FROM (FROM f1 UNION ALL FROM b1) GROUP BY 1, 2), pp AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step, src) <= 10),
 oc AS (SELECT query_id, src, step, chunk_id, ordinal FROM pp JOIN chunks ON paper_id = src QUALIFY row_number() OVER (PARTITION BY query_id, src ORDER BY ordinal, chunk_id) <= 3),
 rk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY step, src, ordinal, chunk_id) AS rank FROM oc)
SELECT query_id, chunk_id, round(1.0 / CAST(rank AS DOUBLE), 6) AS score FROM rk WHERE rank <= 10"""


def _related(t):
    edges = t("documents").select(F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("src"), F.explode(F.array("source", "lang")).alias("dst")).filter("dst IS NOT NULL").distinct()
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("item_id", F.lit(7)).cast("string")).alias("dst"))
    return retrieve.related_to(asked, edges, chunks(t)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


query("jn16_graph_search", RELATED)(_related)
query("jn17_graph_sql", f"WITH {_E} SELECT a.src AS a, b.src AS b, count(*) AS shared FROM e a JOIN e b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2")(lambda t: graph.shared_neighbours(_edges(t)))
CACHED = f"""WITH turns AS (SELECT conv_id * 1000 + turn AS entry, text, conv_id * 60 AS created_at, 1800 * (1 + conv_id % 4) AS ttl_seconds FROM conversations WHERE role = 'user'),
 live AS (SELECT entry, text FROM turns WHERE created_at + ttl_seconds >= (SELECT max(created_at) FROM turns)), asked AS (SELECT entry AS query_id, CASE WHEN entry % 2 = 0 THEN text || ' please' ELSE text END AS text FROM turns),
 {_embedding_sql(False, 1024, "live", "entry")}, {_embedding_sql(False, 1024, "asked", "query_id").replace("tk AS", "tk2 AS").replace("FROM tk)", "FROM tk2)").replace("hh AS", "hh2 AS").replace("FROM hh ", "FROM hh2 ").replace("pl AS", "pl2 AS").replace("FROM pl ", "FROM pl2 ").replace("nm AS", "nm2 AS").replace("JOIN nm ", "JOIN nm2 ").replace("emb AS", "emb2 AS")},
 s AS (SELECT query_id, entry, round(sum(a.w * b.w), 9) AS score FROM emb2 a JOIN emb b USING (idx) GROUP BY 1, 2)
SELECT query_id, entry, round(score, 6) AS score FROM s WHERE score >= 0.92 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) = 1"""


def _cached(t):
    """Every user turn asks a cache of all user turns (every second one in other words), some of them expired."""
    turns = t("conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("entry"), F.col("text").alias("query"), (F.col("conv_id") * 60).alias("created_at"), ((F.pmod("conv_id", F.lit(4)) + 1) * 1800).alias("ttl_seconds"))
    asked = turns.select(F.col("entry").alias("query_id"), F.when(F.pmod("entry", F.lit(2)) == 0, F.concat("query", F.lit(" please"))).otherwise(F.col("query")).alias("question"))
    now = turns.agg(F.coalesce(F.max("created_at"), F.lit(0))).first()[0]
    return similar.cached(turns, asked, F.lit(now)).select("query_id", "entry", F.round("score", 6).alias("score"))


query("jn18_cache_match", CACHED)(_cached)

# time and event streams in batch form
query("dt01_now")(lambda t: t.spark.range(1).select(F.current_timestamp().alias("now")))
query("dt03_iso_parse", "SELECT event_id, ts AS parsed FROM events")(lambda t: t("events").select("event_id", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("parsed")))
for name in ("str06_request_gaps", "src29_rate_gaps"):
    query(name, "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), -1) AS gap_us FROM events")(lambda t: t("events").select("event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(-1)).alias("gap_us")))
query("str01_answer_events", f"WITH {Q}, w AS (SELECT query_id, string_split(short, ' ') AS ws FROM questions), s AS (SELECT query_id, 0 AS seq, 'status' AS type, 'started' AS payload FROM w UNION ALL SELECT query_id, unnest(range(1, len(ws) + 1)), 'token', unnest(ws) FROM w UNION ALL SELECT query_id, len(ws) + 1, 'complete', '' FROM w) SELECT query_id, CAST(seq AS BIGINT) AS seq, type, payload FROM s")(
    lambda t: questions(t).select("query_id", F.posexplode(F.concat(F.array(F.lit("started")), F.split("short", " "), F.array(F.lit("")))).alias("seq", "payload"), F.size(F.split("short", " ")).alias("n")).select("query_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("seq") == 0, "status").when(F.col("seq") > F.col("n"), "complete").otherwise("token").alias("type"), "payload")
)
query("str04_sync_counts", f"WITH {P}, b AS (SELECT paper_id, source_path IN ('src1', 'src2') AS known, length(title) > 20 AS relevant FROM papers) SELECT count(*) AS fetched, count(*) FILTER (relevant) AS matched, count(*) FILTER (relevant AND known) AS skipped, count(*) FILTER (relevant AND NOT known) AS ingested FROM b")(
    lambda t: papers(t).select(F.col("source_path").isin("src1", "src2").alias("known"), (F.length("title") > 20).alias("relevant")).agg(F.count("*").alias("fetched"), F.count_if("relevant").alias("matched"), F.count_if(F.col("relevant") & F.col("known")).alias("skipped"), F.count_if(F.col("relevant") & ~F.col("known")).alias("ingested"))
)
query("set04_set_difference", f"WITH {C}, t AS (SELECT chunk_id, {s_sentences('text')} AS ss FROM chunks), n AS (SELECT chunk_id, list_distinct(flatten(list_transform(list_filter(ss, lambda s: contains(lower(s), 'not')), lambda s: {s_tokens('s')}))) AS neg, list_distinct(flatten(list_transform(list_filter(ss, lambda s: NOT contains(lower(s), 'not')), lambda s: {s_tokens('s')}))) AS pos FROM t) SELECT chunk_id, array_to_string(list_sort(list_filter(list_intersect(neg, pos), lambda w: w NOT IN ('that', 'with', 'from', 'this'))), '|') AS out FROM n")(
    lambda t: chunks(t).select("chunk_id", x.sentences(F.col("text")).alias("ss")).select("chunk_id", F.flatten(F.transform(F.filter("ss", lambda s: F.lower(s).contains("not")), x.tokens)).alias("neg"), F.flatten(F.transform(F.filter("ss", lambda s: ~F.lower(s).contains("not")), x.tokens)).alias("pos")).select("chunk_id", F.array_join(F.array_sort(F.array_except(F.array_intersect("neg", "pos"), F.array(*map(F.lit, ("that", "with", "from", "this"))))), "|").alias("out"))
)
query("set05_unknown_terms", f"WITH {C} SELECT chunk_id, array_to_string(list_slice(list_sort(list_filter(list_distinct({s_tokens('text')}), lambda w: NOT list_contains({s_tokens(repr(QUESTIONS[0]))}, w))), 1, 3), '|') AS out FROM chunks")(lambda t: chunks(t).select("chunk_id", F.array_join(F.slice(F.array_sort(F.array_except(F.array_distinct(x.tokens(F.col("text"))), x.tokens(F.lit(QUESTIONS[0])))), 1, 3), "|").alias("out")))

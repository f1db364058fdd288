"""Queries of stores, filters, sorts, joins and set operations (SNK, FLT01-16, SRT, SET, JN)."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import fusion, stores, tables
from siltstone.operators.chunking import extract_claims
from siltstone.operators.tables import Bucketed
from siltstone.queries.corpus import SQL_CHUNKS, SQL_HITS, SQL_PAPERS, chunks, hits, papers, s_sentences
from siltstone.queries.extract import _plain_claim
from siltstone.queries.registry import query
from siltstone.session import fresh_path
from siltstone.streaming import caches, fanout, streams

P, C, H = SQL_PAPERS, SQL_CHUNKS, SQL_HITS
LATER = "TIMESTAMP '2024-03-01 00:00:00'"


# Incoming batch: papers of two sources come again with new titles, papers of a third come under new ids.
def incoming(t):
    p = papers(t).filter(F.col("source_path").isin("src1", "src2", "src3"))
    return p.select(
        F.when(F.col("source_path") == "src3", F.concat("paper_id", F.lit("n"))).otherwise(F.col("paper_id")).alias("paper_id"), "doc_id", F.concat(F.lit("new "), "title").alias("title"), "source_path", "checksum", "page_count",
        F.expr(f"cast({LATER} as timestamp_ntz)").alias("created_at"), F.expr(f"cast({LATER} as timestamp_ntz)").alias("updated_at"),
    )


IN = f"incoming AS (SELECT CASE WHEN source_path = 'src3' THEN paper_id || 'n' ELSE paper_id END AS paper_id, doc_id, 'new ' || title AS title, source_path, checksum, page_count, {LATER} AS created_at, {LATER} AS updated_at FROM papers WHERE source_path IN ('src1', 'src2', 'src3'))"
UP = f"WITH {P}, {IN} SELECT p.* FROM papers p WHERE paper_id NOT IN (SELECT paper_id FROM incoming) UNION ALL SELECT i.paper_id, i.doc_id, i.title, i.source_path, i.checksum, i.page_count, coalesce(p.created_at, i.created_at) AS created_at, i.updated_at FROM incoming i LEFT JOIN papers p USING (paper_id)"
for name in ("snk01_upsert_document", "snk02_upsert_paper", "snk13_relational_upsert"):
    query(name, UP)(lambda t: stores.upsert(papers(t), incoming(t), "paper_id"))


def _new_chunks(t):
    fresh = chunks(t).join(incoming(t).select("paper_id"), "paper_id", "left_semi").filter("ordinal < page_number + 3")
    return fresh.withColumn("chunk_id", F.sha1(F.concat("chunk_id", F.lit("v2"))))


NEWC = f"{C}, {P}, {IN}, fresh AS (SELECT sha1(chunk_id || 'v2') AS chunk_id, paper_id, doc_id, page_number, section, ordinal, text, content_type FROM chunks WHERE paper_id IN (SELECT paper_id FROM incoming) AND ordinal < page_number + 3)"
_cols = "chunk_id, paper_id, section, ordinal"
_replaced = f"WITH {NEWC} SELECT {_cols} FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM fresh) UNION ALL SELECT {_cols} FROM fresh"


def _replaced_chunks(t):
    """Chunks in buckets of their paper; only the buckets of the papers that change are written again."""
    held = Bucketed(t.spark, fresh_path(t.spark, "chunks"), "paper_id").create(chunks(t))
    held.replace(_new_chunks(t))
    return held.read().select("chunk_id", "paper_id", "section", "ordinal")


for name in ("snk03_replace_chunks", "snk20_update_document"):
    query(name, _replaced)(_replaced_chunks)


def _sql_claims(name: str) -> str:
    return f"SELECT sha1(chunk_id || ':' || i || ':' || text) AS claim_id, paper_id FROM (SELECT chunk_id, paper_id, generate_subscripts({s_sentences('text')}, 1) - 1 AS i, unnest({s_sentences('text')}) AS text FROM {name}) WHERE {_plain_claim}"


query("snk04_replace_claims", f"WITH {NEWC}, oc AS ({_sql_claims('chunks')}), nc AS ({_sql_claims('fresh')}) SELECT claim_id, paper_id FROM oc WHERE paper_id NOT IN (SELECT paper_id FROM nc) UNION ALL SELECT claim_id, paper_id FROM nc")(
    lambda t: stores.replace_by(extract_claims(chunks(t)), extract_claims(_new_chunks(t)), "paper_id").select("claim_id", "paper_id")
)


def _gone(t):
    return papers(t).filter("source_path = 'src4'").select("paper_id")


GONE = f"{P}, {C}, gone AS (SELECT paper_id FROM papers WHERE source_path = 'src4')"
for name in ("snk05_delete_paper", "snk08_system_delete", "snk14_relational_delete", "snk19_pipeline_delete"):
    query(name, f"WITH {GONE} SELECT 'papers' AS store, count(*) AS rows FROM papers WHERE paper_id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE paper_id NOT IN (FROM gone)")(
        lambda t: stores.delete_by(papers(t), _gone(t), "paper_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("papers").alias("store"), "rows").unionByName(stores.delete_by(chunks(t), _gone(t), "paper_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("chunks").alias("store"), "rows"))
    )
query("snk05_delete_flags", f"WITH {GONE}, k AS (SELECT paper_id FROM gone UNION SELECT paper_id || '?' FROM gone) SELECT k.paper_id, p.paper_id IS NOT NULL AS existed FROM k LEFT JOIN papers p USING (paper_id)")(
    lambda t: stores.existed(papers(t), _gone(t).unionByName(_gone(t).select(F.concat("paper_id", F.lit("?")).alias("paper_id"))), "paper_id")
)


def _vectors(t):
    return t("embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


def _moved(t):
    return _vectors(t).filter("label = 3").select(F.when(F.col("x") > 0, F.col("vec_id")).otherwise(-F.col("vec_id") - 1).alias("vec_id"), "label", (-F.col("x")).alias("x"))


V = "v AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings), moved AS (SELECT CASE WHEN x > 0 THEN vec_id ELSE -vec_id - 1 END AS vec_id, label, -x AS x FROM v WHERE label = 3)"
for name in ("snk06_vector_upsert", "snk10_vector_table_upsert"):
    query(name, f"WITH {V} SELECT * FROM v WHERE vec_id NOT IN (SELECT vec_id FROM moved) UNION ALL SELECT * FROM moved")(lambda t: stores.merge_last(_vectors(t), _moved(t), "vec_id"))
query("snk09_vector_append", f"WITH {V} SELECT label, count(*) AS rows FROM (SELECT * FROM v UNION ALL SELECT * FROM moved) GROUP BY label")(lambda t: _vectors(t).unionByName(_moved(t)).groupBy("label").agg(F.count(F.lit(1)).alias("rows")))
for name in ("snk07_vector_delete", "hlp20_vector_delete_and_stats"):
    query(name, f"WITH {V} SELECT label, count(*) AS rows FROM v WHERE label <> 3 GROUP BY label")(lambda t: stores.delete_by(_vectors(t), _vectors(t).filter("label = 3"), "label").groupBy("label").agg(F.count(F.lit(1)).alias("rows")))

AUTH = "edges AS (SELECT DISTINCT 'd' || doc_id AS src, unnest(string_split(source || ',' || lang, ',')) AS dst, 'WRITTEN_BY' AS rel FROM documents)"


def _author_graph(t):
    return stores.author_edges(t("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("d"), F.array("source", "lang").alias("a")), "d", "a")


query("snk15_author_edges", f"WITH {AUTH} SELECT * FROM edges")(_author_graph)
query("snk15_graph_nodes", f"WITH {AUTH} SELECT src AS id FROM edges UNION SELECT dst FROM edges")(lambda t: stores.nodes_of(_author_graph(t)))
query("snk16_entity_edges", "SELECT DISTINCT user_id AS src, event_type AS dst, 'USES' AS rel FROM events")(lambda t: stores.entity_edges(t("events").select("user_id", F.array("event_type", "event_type").alias("e")), "user_id", "e"))
query("snk17_drop_node", f"WITH {AUTH} SELECT * FROM edges WHERE src <> 'en' AND dst <> 'en'")(lambda t: stores.drop_node(_author_graph(t), F.lit("en")))


def _cache(t):
    return t("events").select(F.concat("event_type", F.lit(":"), F.pmod("user_id", F.lit(50)).cast("string")).alias("query"), F.col("event_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.lit(3600).cast("long").alias("ttl_seconds"), F.array(F.pmod("event_id", F.lit(7)), F.pmod("event_id", F.lit(5))).alias("doc_ids"))


def _last(c):
    w = Window.partitionBy("query").orderBy(F.desc("created_at"), F.desc("event_id"))
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


CACHE = "c AS (SELECT event_type || ':' || (user_id % 50) AS query, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS created_at, CAST(3600 AS BIGINT) AS ttl_seconds, [event_id % 7, event_id % 5] AS doc_ids FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY created_at DESC, event_id DESC) = 1)"
query("snk21_cache_put", f"WITH {CACHE} SELECT query, event_id, created_at FROM l")(lambda t: stores.cache_put(_last(_cache(t)).withColumn("query_hash", F.xxhash64("query")).limit(0), _last(_cache(t))).select("query", "event_id", "created_at"))
query("snk22_cache_invalidate", f"WITH {CACHE} SELECT d.doc AS doc_id, count(*) FILTER (list_contains(doc_ids, d.doc)) AS removed, count(*) FILTER (NOT list_contains(doc_ids, d.doc)) AS kept FROM l, (SELECT unnest(range(7)) AS doc) d GROUP BY 1")(
    lambda t: _last(_cache(t)).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("doc_id"), F.array_contains("doc_ids", F.lit(i).cast("long")).alias("hit")) for i in range(7)))).alias("r")).groupBy("r.doc_id").agg(F.count_if("r.hit").alias("removed"), F.count_if(~F.col("r.hit")).alias("kept"))
)
_live = f"WITH {CACHE} SELECT query, event_id FROM l WHERE created_at + ttl_seconds >= (SELECT max(created_at) FROM c)"
query("dt04_ttl_expiry", _live)(lambda t: stores.cache_live(_last(_cache(t)).crossJoin(F.broadcast(_cache(t).agg(F.max("created_at").alias("now")))), F.col("now")).select("query", "event_id"))


def _cache_stream(t):
    """The puts replayed as a stream; entries end by their timers."""
    schema = ", ".join(f"{n} {k}" for n, k in t("events").dtypes)
    events = t.spark.readStream.schema(schema).parquet(t.folder + "/events.parquet*")
    out = fresh_path(t.spark, "cache")
    with caches.with_state(t.spark):
        run = caches.changes(_cache(lambda _: events)).writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return caches.live(t.spark.read.schema(caches.CHANGES).parquet(f"{out}/changes"))


query("str05_ttl_cache", _live)(_cache_stream)


# every store of a batch, or none
def _stores(docs):
    of = lambda _: docs
    return {"papers": papers(of), "chunks": chunks(of), "claims": extract_claims(chunks(of))}


def _store_counts(t, folder):
    out = None
    for name, key in (("papers", "paper_id"), ("chunks", "chunk_id"), ("claims", "claim_id")):
        one = fanout.current(t.spark, folder, name, "paper_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("store"), "rows", "keys")
        out = one if out is None else out.unionByName(one)
    return out


STORED = f"WITH {P}, {C}, cl AS ({_sql_claims('chunks')}) SELECT 'papers' AS store, count(*) AS rows, count(DISTINCT paper_id) AS keys FROM papers UNION ALL SELECT 'chunks', count(*), count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'claims', count(*), count(DISTINCT claim_id) FROM cl"


def _stored_everywhere(t):
    folder = fresh_path(t.spark, "stores")
    fanout.store_everywhere(_stores(t("documents")), 0, folder)
    return _store_counts(t, folder)


#: Bytes of a file that arrives, about.
ARRIVAL = 32 << 20


def _ingested(t):
    """Documents arrive in four batches of files of a bounded size; a second copy of a fifth of them arrives later, as a batch of the same papers."""
    folder = fresh_path(t.spark, "stores")
    docs = t("documents")
    size = sum(n for n, _ in tables.files(t.spark, f"{t.folder}/documents.parquet").values())

    def arrive(rows):
        """New files, taken by the stream that goes on where it ended before."""
        before = len(tables.files(t.spark, f"{folder}/in")) if tables.exists(t.spark, f"{folder}/in") else 0
        rows.write.mode("append").parquet(f"{folder}/in")
        new = len(tables.files(t.spark, f"{folder}/in")) - before
        stream = streams.arrivals(t.spark, f"{folder}/in", ", ".join(f"{n} {k}" for n, k in docs.dtypes), max(1, new if before else -(-new // 4)))
        fanout.ingest_batches(stream, _stores, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    arrive(docs.repartition(4 * max(1, -(-size // (4 * ARRIVAL))), "doc_id"))
    arrive(docs.filter(F.pmod("doc_id", F.lit(5)) == 0))
    return _store_counts(t, f"{folder}/out")


query("snk18_store_everywhere", STORED)(_stored_everywhere)
query("str07_batch_ingest", STORED)(_ingested)
query("snk23_append_annotations", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, 'note' FROM labels)")(lambda t: t("documents").select("doc_id", "text").unionByName(t("labels").select("doc_id", F.lit("note").alias("text"))).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("docs")))
query("snk24_report_rows", "SELECT lang, '<tr><td>' || lang || '</td><td>' || count(*) || '</td></tr>' AS html FROM documents GROUP BY lang")(lambda t: t("documents").groupBy("lang").count().select("lang", F.concat(F.lit("<tr><td>"), "lang", F.lit("</td><td>"), F.col("count").cast("string"), F.lit("</td></tr>")).alias("html")))
query("snk25_keep_newest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")(lambda t: stores.newest(t("events"), [F.desc("ts"), F.desc("event_id")], 5, ["user_id"]).select("user_id", "event_id"))


def _legacy(t):
    docs = papers(t).select(F.col("paper_id").alias("document_id"), F.col("title").alias("source_name"), "source_path", "checksum", "page_count", F.lit(0).alias("chunk_count"), "created_at", "updated_at")
    old = chunks(t).withColumn("document_id", F.col("paper_id")).withColumn("section", F.when(F.col("section") != "table", F.col("section")))
    return stores.adapt_legacy(docs, old)


query("snk26_legacy_papers", f"WITH {P} SELECT paper_id, title, source_path, page_count, created_at FROM papers")(lambda t: _legacy(t)[0].select("paper_id", "title", "source_path", "page_count", "created_at"))
query("snk26_legacy_chunks", f"WITH {C} SELECT chunk_id, CASE WHEN section = 'table' THEN 'unknown' ELSE section END AS section, length(text) AS char_count FROM chunks")(lambda t: _legacy(t)[1].select("chunk_id", "section", "char_count"))

# filters and scans
query("flt01_list_documents", f"WITH {P} SELECT paper_id, updated_at FROM papers ORDER BY updated_at DESC, paper_id")(lambda t: papers(t).select("paper_id", "updated_at").orderBy(F.desc("updated_at"), "paper_id"))
query("flt02_list_papers", f"WITH {P} SELECT paper_id, title, page_count, updated_at FROM papers ORDER BY updated_at DESC, paper_id")(lambda t: papers(t).select("paper_id", "title", "page_count", "updated_at").orderBy(F.desc("updated_at"), "paper_id"))
query("flt03_point_lookup", f"WITH {P} SELECT paper_id, title FROM papers WHERE paper_id = 'p000000007'")(lambda t: papers(t).filter("paper_id = 'p000000007'").select("paper_id", "title"))


def fetch(c, ids: list[str] | None, empty_means_all: bool):
    """Chunks of the papers; an empty list is no filter, or no rows."""
    if not ids and empty_means_all or ids is None:
        return c
    return c.filter(F.col("paper_id").isin(*ids)) if ids else c.limit(0)


_some = "('p000000003', 'p000000011', 'p000000042')"
query("flt04_fetch_chunks", f"WITH {C} SELECT chunk_id, ordinal FROM chunks WHERE paper_id IN {_some} ORDER BY paper_id, ordinal")(lambda t: fetch(chunks(t), ["p000000003", "p000000011", "p000000042"], True).orderBy("paper_id", "ordinal").select("chunk_id", "ordinal"))
query("flt04_empty_is_all", f"WITH {C} SELECT count(*) AS n FROM chunks")(lambda t: fetch(chunks(t), [], True).agg(F.count(F.lit(1)).alias("n")))
query("flt05_empty_is_none", f"WITH {C} SELECT m AS mode, count(*) FILTER (CASE m WHEN 'some' THEN paper_id IN {_some} WHEN 'all' THEN true ELSE false END) AS n FROM chunks, (SELECT unnest(['none', 'some', 'all']) AS m) GROUP BY 1")(
    lambda t: functools.reduce(lambda a, b: a.unionByName(b), (fetch(chunks(t), ids, every).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n") for mode, ids, every in (("none", [], False), ("some", ["p000000003", "p000000011", "p000000042"], False), ("all", [], True))))
)
query("flt06_section_filter", f"WITH {C} SELECT chunk_id, section FROM chunks WHERE contains(lower(section), 'results and method') OR contains('results and method', lower(section))")(lambda t: chunks(t).filter(F.lower("section").contains("results and method") | F.lit("results and method").contains(F.lower("section"))).select("chunk_id", "section"))
query("flt07_exclude_references", f"WITH {C} SELECT chunk_id, section FROM chunks WHERE section NOT IN ('references', 'bibliography', 'acknowledgments') AND paper_id <> 'p000000001'")(lambda t: chunks(t).filter(~F.lower("section").isin("references", "bibliography", "acknowledgments") & (F.col("paper_id") != "p000000001")).select("chunk_id", "section"))
query("flt08_pushdown_one_document", "SELECT doc_id, lang FROM documents WHERE doc_id = 17")(lambda t: t("documents").filter("doc_id = 17").select("doc_id", "lang"))
query("flt09_min_relevance", f"WITH {H} SELECT query_id, list, chunk_id, score FROM hits WHERE score >= 20 QUALIFY row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) <= 5")(lambda t: fusion.top(hits(t).filter("score >= 20"), ["query_id", "list"], 5).select("query_id", "list", "chunk_id", "score"))
_bag = "lower(title || ' ' || source_path)"
query("flt11_feed_filter", f"WITH {P} SELECT paper_id FROM papers WHERE updated_at >= TIMESTAMP '2024-01-02 00:00:00' AND (source_path IN ('src1', 'src2') OR starts_with(source_path, 'src1')) AND (contains({_bag}, 'thor') OR (CAST(contains({_bag}, 'tion') AS INT) + CAST(contains({_bag}, 'with') AS INT) + CAST(contains({_bag}, 'that') AS INT)) >= greatest(1, least(3, 3 // 3)))")(
    lambda t: papers(t).filter(F.col("updated_at") >= F.expr("timestamp_ntz'2024-01-02 00:00:00'")).filter(F.col("source_path").isin("src1", "src2") | F.col("source_path").startswith("src1")).withColumn("bag", F.lower(F.concat("title", F.lit(" "), "source_path"))).filter(F.col("bag").contains("thor") | (sum((F.col("bag").contains(w).cast("int") for w in ("tion", "with", "that")), F.lit(0)) >= 1)).select("paper_id")
)
query("flt12_tenant_scope", "SELECT doc_id, lang || '::' || doc_id AS scoped FROM documents WHERE starts_with(lang || '::' || doc_id, 'de::')")(lambda t: t("documents").select("doc_id", F.concat("lang", F.lit("::"), F.col("doc_id").cast("string")).alias("scoped")).filter(F.col("scoped").startswith("de::")))
query("flt13_tenant_resolve", "SELECT doc_id, CASE WHEN contains(source, '1') THEN lang || '::' || doc_id WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) ELSE '-' END AS resolved FROM documents")(lambda t: t("documents").select("doc_id", F.when(F.col("source").contains("1"), F.concat("lang", F.lit("::"), F.col("doc_id").cast("string"))).when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise("-").alias("resolved")))
query("flt14_key_tenants", "WITH k AS (SELECT unnest(string_split('key-a:en, key-b:de,,key-c:fr', ',')) AS p), m AS (SELECT trim(split_part(p, ':', 1)) AS api_key, trim(split_part(p, ':', 2)) AS lang FROM k WHERE contains(p, ':')) SELECT api_key, count(*) AS documents FROM documents JOIN m USING (lang) GROUP BY 1")(
    lambda t: t("documents").join(F.broadcast(t.spark.createDataFrame([(x.split(":")[0].strip(), x.split(":")[1].strip()) for x in "key-a:en, key-b:de,,key-c:fr".split(",") if ":" in x], "api_key string, lang string")), "lang").groupBy("api_key").agg(F.count(F.lit(1)).alias("documents"))
)
query("flt15_annotation_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'clown') OR contains(lower(source), 'src7')")(lambda t: t("documents").filter(F.lower("text").contains("clown") | F.lower("source").contains("src7")).select("doc_id"))
query("flt16_feedback_split", "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'hard_negative' WHEN quality = 1 AND toxic = 0 THEN 'high_quality' ELSE 'other' END AS kind FROM labels")(lambda t: t("labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "hard_negative").when((F.col("quality") == 1) & (F.col("toxic") == 0), "high_quality").otherwise("other").alias("kind")))
query("flt25_title_search", f"WITH {P} SELECT paper_id, title FROM papers WHERE contains(lower(title), 'the')")(lambda t: papers(t).filter(F.lower("title").contains("the")).select("paper_id", "title"))
query("flt27_low_quality_results", f"WITH {H} SELECT query_id, count(*) AS low, array_to_string(list_slice(list(chunk_id ORDER BY score, chunk_id), 1, 5), '|') AS worst FROM hits WHERE score < 30 GROUP BY 1")(lambda t: hits(t).filter("score < 30").groupBy("query_id").agg(F.count(F.lit(1)).alias("low"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("score", "chunk_id"))), 1, 5), lambda r: r["chunk_id"]), "|").alias("worst")))
for name in ("flt28_time_range", "dt02_days_back"):
    query(name, "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY 1")(lambda t: t("events").filter(F.col("ts") > F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(7)")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
query("src35_history_scan", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC")(lambda t: t("events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")))
query("hlp22_chunk_rows", f"WITH {C} SELECT chunk_id, ordinal, left(text, 80) AS preview FROM chunks WHERE paper_id = 'p000000003' ORDER BY ordinal LIMIT 5")(lambda t: chunks(t).filter("paper_id = 'p000000003'").orderBy("ordinal").limit(5).select("chunk_id", "ordinal", F.substring("text", 1, 80).alias("preview")))

# sorts and cuts
query("srt01_top_k", f"WITH {H} SELECT chunk_id, list, query_id, score FROM hits ORDER BY score DESC, query_id, list, chunk_id LIMIT 50")(lambda t: hits(t).orderBy(F.desc("score"), "query_id", "list", "chunk_id").limit(50).select("chunk_id", "list", "query_id", "score"))
query("srt02_overfetch", f"WITH {H}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) AS r FROM hits), b AS (SELECT query_id, chunk_id, max(score) AS score FROM a WHERE r <= 15 GROUP BY 1, 2) SELECT query_id, chunk_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10")(
    lambda t: fusion.top(fusion.top(hits(t), ["query_id", "list"], 15).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), ["query_id"], 10).select("query_id", "chunk_id", "score")
)
_prio = ("abstract", "introduction", "conclusion", "results", "method", "experiments", "related_work", "body")
query("srt04_overview_priority", f"WITH {C}, o AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(list_position({list(_prio)}, section), 100), -length(text), ordinal) AS position FROM chunks) SELECT * FROM o")(
    lambda t: chunks(t).select("paper_id", "chunk_id", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _prio)), F.col("section")), F.lit(0)), F.lit(100)), -F.length("text"), "ordinal")).cast("long").alias("position"))
)
# sorts of a library view: within each source, so that no sort needs one task
query("srt05_sort_modes", f"WITH {P} SELECT paper_id, row_number() OVER (PARTITION BY source_path ORDER BY updated_at DESC, paper_id) AS newest, row_number() OVER (PARTITION BY source_path ORDER BY updated_at, paper_id) AS oldest, row_number() OVER (PARTITION BY source_path ORDER BY page_count DESC, paper_id) AS longest, row_number() OVER (PARTITION BY source_path ORDER BY title, paper_id) AS alphabetical FROM papers")(
    lambda t: papers(t).select("paper_id", *(F.row_number().over(Window.partitionBy("source_path").orderBy(*o, "paper_id")).cast("long").alias(n) for n, o in (("newest", [F.desc("updated_at")]), ("oldest", ["updated_at"]), ("longest", [F.desc("page_count")]), ("alphabetical", ["title"]))))
)
query("srt06_previews", f"WITH {C} SELECT chunk_id, left(text, 320) AS a, left(text, 200) AS b, left(text, 180) || '...' AS c FROM chunks")(lambda t: chunks(t).select("chunk_id", F.substring("text", 1, 320).alias("a"), F.substring("text", 1, 200).alias("b"), F.concat(F.substring("text", 1, 180), F.lit("...")).alias("c")))

# sets
query("set01_union_of_ids", f"WITH {H} SELECT query_id, chunk_id FROM hits WHERE score > 50 UNION SELECT query_id, chunk_id FROM hits WHERE score < 10")(lambda t: hits(t).filter("score > 50").select("query_id", "chunk_id").union(hits(t).filter("score < 10").select("query_id", "chunk_id")).distinct())

# joins
JN1 = f"WITH {C}, claims AS (SELECT chunk_id, sha1(chunk_id || ':' || i) AS claim_id FROM (SELECT chunk_id, unnest(range(ordinal % 3)) AS i FROM chunks)) SELECT c.chunk_id, c.paper_id, c.ordinal, left(c.text, 320) AS preview, count(claim_id) AS claim_count FROM chunks c LEFT JOIN claims USING (chunk_id) GROUP BY ALL"


def _claim_rows(t):
    return chunks(t).filter("ordinal % 3 > 0").select("chunk_id", F.explode(F.sequence(F.lit(0), (F.pmod("ordinal", F.lit(3)) - 1).cast("int"))).alias("i")).select("chunk_id", F.sha1(F.concat_ws(":", "chunk_id", F.col("i").cast("string"))).alias("claim_id"))


query("jn01_chunk_samples", JN1)(lambda t: chunks(t).join(_claim_rows(t), "chunk_id", "left").groupBy("chunk_id", "paper_id", "ordinal", F.substring("text", 1, 320).alias("preview")).agg(F.count("claim_id").alias("claim_count")))
_rr = f"{H}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, chunk_id) AS rank FROM hits)"
query("jn02_rank_union", f"WITH {_rr} SELECT query_id, chunk_id, CAST(min(rank) FILTER (list = 'view') AS BIGINT) AS first_rank, CAST(min(rank) AS BIGINT) AS best_rank, count(*) AS lists FROM r GROUP BY 1, 2")(lambda t: fusion.rank(hits(t), ["query_id", "list"]).groupBy("query_id", "chunk_id").agg(F.min(F.when(F.col("list") == "view", F.col("rank"))).cast("long").alias("first_rank"), F.min("rank").cast("long").alias("best_rank"), F.count(F.lit(1)).alias("lists")))
query("jn03_reciprocal_rank_fusion", f"WITH {_rr} SELECT query_id, chunk_id, round(sum(CASE WHEN list = 'view' THEN 1.3 ELSE 1.0 END / CAST(60 + rank AS DOUBLE)), 9) AS score, arg_max(list, (score, list)) AS source FROM r GROUP BY 1, 2")(lambda t: fusion.reciprocal_rank(hits(t), 60, {"view": 1.3}).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "source"))
query("jn04_weighted_outer", f"WITH {H}, a AS (SELECT * FROM hits WHERE list = 'view'), b AS (SELECT * FROM hits WHERE list = 'click') SELECT query_id, chunk_id, round(0.4 * coalesce(a.score, 0) + 0.6 * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (query_id, chunk_id)")(
    lambda t: hits(t).filter("list = 'view'").select("query_id", "chunk_id", F.col("score").alias("a")).join(hits(t).filter("list = 'click'").select("query_id", "chunk_id", F.col("score").alias("b")), ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", F.round(F.coalesce("a", F.lit(0.0)) * 0.4 + F.coalesce("b", F.lit(0.0)) * 0.6, 6).alias("score"))
)
_mm = "n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM hits WINDOW w AS (PARTITION BY query_id, list))"
query("jn05_weighted_combination", f"WITH {H}, {_mm} SELECT query_id, chunk_id, round(CAST(sum(CASE WHEN list = 'view' THEN 0.6 * s ELSE 0.4 * s END) AS DOUBLE), 6) AS score, CASE WHEN bool_or(list = 'view') THEN 'view' ELSE 'click' END AS source FROM n WHERE list IN ('view', 'click') GROUP BY 1, 2")(lambda t: fusion.weighted(hits(t), "view", "click").withColumn("score", F.round("score", 6)))
query("win07_min_max", f"WITH {H}, {_mm} SELECT query_id, list, chunk_id, round(CAST(s AS DOUBLE), 6) AS score FROM n")(lambda t: fusion.min_max(hits(t), ["query_id", "list"]).select("query_id", "list", "chunk_id", F.round("score", 6).alias("score")))
query("jn09_neighbours", f"WITH {C}, n AS (SELECT chunk_id, lag(text) OVER w AS b, text, lead(text) OVER w AS a, section FROM chunks WINDOW w AS (PARTITION BY paper_id, section ORDER BY ordinal)) SELECT chunk_id, sha1(concat_ws(chr(10), '[SECTION: ' || section || ']', nullif(coalesce(b, ''), ''), '>>> ' || text, nullif(coalesce(a, ''), ''))) AS digest FROM n")(
    lambda t: fusion.neighbours(chunks(t)).select("chunk_id", F.sha1(fusion.assemble(F.col("section"), F.col("preceding"), F.col("text"), F.col("following"))).alias("digest"))
)
query("hlp03_assemble", f"WITH {C} SELECT chunk_id, '[SECTION: ' || section || ']' || chr(10) || '>>> ' || text AS out FROM chunks")(lambda t: chunks(t).select("chunk_id", fusion.assemble(F.col("section"), F.lit(""), F.col("text"), F.lit("")).alias("out")))
query("jn10_already_indexed", f"WITH {P}, {IN} SELECT i.paper_id, p.paper_id IS NOT NULL AS known FROM incoming i LEFT JOIN papers p USING (paper_id)")(lambda t: incoming(t).join(papers(t).select("paper_id", F.lit(True).alias("there")), "paper_id", "left").select("paper_id", F.coalesce("there", F.lit(False)).alias("known")))
query("jn11_text_lookup", "SELECT i.item_id, coalesce(d.text, '') AS text FROM (SELECT item_id, item_id * 37 AS doc_id FROM benchmark) i LEFT JOIN documents d USING (doc_id)")(lambda t: t("benchmark").select("item_id", (F.col("item_id") * 37).alias("doc_id")).join(t("documents").select("doc_id", "text"), "doc_id", "left").select("item_id", F.coalesce("text", F.lit("")).alias("text")))


def _structure(t):
    c = chunks(t)
    a = c.groupBy("paper_id", "section").agg(F.count(F.lit(1)).alias("a"))
    b = c.filter("ordinal % 3 > 0").groupBy("paper_id", "section").agg(F.sum(F.pmod("ordinal", F.lit(3))).alias("b"))
    d = c.filter("content_type = 'table'").groupBy("paper_id", "section").agg(F.count(F.lit(1)).alias("d"))
    j = a.join(b, ["paper_id", "section"], "full").join(d, ["paper_id", "section"], "full")
    return j.select("paper_id", "section", *(F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in (("a", "chunk_count"), ("b", "claim_count"), ("d", "table_count"))))


for name in ("jn12_structure_counts", "agg03_section_structure"):
    query(name, f"WITH {C} SELECT paper_id, section, count(*) AS chunk_count, CAST(sum(ordinal % 3) AS BIGINT) AS claim_count, count(*) FILTER (content_type = 'table') AS table_count FROM chunks GROUP BY 1, 2")(_structure)
query("jn15_citations_for_ids", f"WITH {C} SELECT paper_id, chunk_id, section FROM chunks WHERE list_contains([1, 3, 4], ordinal)")(lambda t: chunks(t).filter(F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(4)).cast("array<bigint>"), F.col("ordinal"))).select("paper_id", "chunk_id", "section"))
query("win14_first_n_per_key", f"WITH {C} SELECT paper_id, section, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY paper_id, section ORDER BY ordinal) <= 2")(lambda t: chunks(t).withColumn("rn", F.row_number().over(Window.partitionBy("paper_id", "section").orderBy("ordinal"))).filter("rn <= 2").select("paper_id", "section", "chunk_id"))
query("agg20_distinct_citations", f"WITH {C} SELECT paper_id, section, page_number, min(ordinal) AS first FROM chunks GROUP BY 1, 2, 3")(lambda t: chunks(t).withColumn("rn", F.row_number().over(Window.partitionBy("paper_id", "section", "page_number").orderBy("ordinal"))).filter("rn = 1").select("paper_id", "section", "page_number", F.col("ordinal").alias("first")))

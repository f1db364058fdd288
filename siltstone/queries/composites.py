"""Queries of indexes, chunkers, layouts, retrieval, answers and checks (MTH19-26, CMP, HLP, JN06-08, SRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.functions import extract as e
from siltstone.functions import substring
from siltstone.functions import text as x
from siltstone.functions import vectors as v
from siltstone.functions import verify as check
from siltstone.operators import bm25, chunking, fusion, layout, stores
from siltstone.operators.postings import Postings
from siltstone.plans import answer, evaluate, retrieve
from siltstone.queries import stored
from siltstone.queries.analytics import _embedding_sql
from siltstone.queries.corpus import QUESTIONS, SQL_CHUNKS, SQL_HITS, SQL_PAPERS, SQL_QUESTIONS, STATEMENTS, chunks, hits, papers, pick, questions, s_any, s_in, s_parts, s_sentences, s_strip, s_tokens, s_words, sql_list, sql_pick
from siltstone.queries.extract import _kind, _plain_claim
from siltstone.queries.registry import ORACLES, query
from siltstone.queries.sources import Passage
from siltstone.queries.text import _q1
from siltstone.session import fresh_path

C, Q, P, H = SQL_CHUNKS, SQL_QUESTIONS, SQL_PAPERS, SQL_HITS

# inverted index and BM25
_BM = f"""{C}, {Q}, w AS (SELECT chunk_id, unnest({s_tokens("text")}) AS term FROM chunks), po AS (SELECT term, chunk_id, count(*) AS tf FROM w GROUP BY 1, 2),
 le AS (SELECT chunk_id, len({s_tokens("text")}) AS dl FROM chunks), st AS (SELECT count(*) AS n, avg(dl) AS mean_dl FROM le), rw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, st GROUP BY 1),
 te AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw), qs AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({s_tokens("question")}) AS term FROM questions) GROUP BY 1, 2),
 sc AS (SELECT query_id, chunk_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_dl))) AS raw, round(raw, 9) AS score FROM po JOIN qs USING (term) JOIN te USING (term) JOIN le USING (chunk_id), st GROUP BY 1, 2)"""
query("mth23_bm25_scores", f"WITH {_BM} SELECT query_id, chunk_id, round(raw, 4) AS score FROM sc")(lambda t: stored.postings(t).scores(questions(t)).select("query_id", "chunk_id", F.round("score", 4).alias("score")))
_top = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"
for name in ("srt03_bm25_top_k", "win03_bm25_ranks"):
    query(name, f"WITH {_BM} SELECT query_id, chunk_id, {_top} AS rank FROM sc WHERE score <> 0 QUALIFY {_top} <= 10")(lambda t: retrieve.lexical(questions(t), stored.postings(t), 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank")))
query("src34_index_terms", f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM te")(lambda t: bm25.build(chunks(t)).terms.select("term", "df", F.round("idf", 6).alias("idf")))
query("snk12_index_remove", f"WITH {C.replace('FROM chunks0)', 'FROM chunks0 WHERE section <> ' + chr(39) + 'references' + chr(39) + ')')}, w AS (SELECT DISTINCT chunk_id, unnest({s_tokens('text')}) AS term FROM chunks) SELECT term, count(*) AS df FROM w GROUP BY 1")(lambda t: _own_postings(t, chunks(t)).remove(chunks(t).filter("section = 'references'")).frequencies())


def _own_postings(t, rows):
    """An index of its own for a query that changes it."""
    return Postings(t.spark, fresh_path(t.spark, "postings")).create(rows)


def _added(t):
    c = chunks(t)
    fresh = c.filter("section IN ('references', 'table')").withColumn("text", F.concat("text", F.lit(" refreshed")))
    return _own_postings(t, c.filter("section <> 'table'")).add(fresh).frequencies()


query("snk11_index_add", f"WITH {C}, n AS (SELECT chunk_id, CASE WHEN section IN ('references', 'table') THEN text || ' refreshed' ELSE text END AS text FROM chunks), w AS (SELECT DISTINCT chunk_id, unnest({s_tokens('text')}) AS term FROM n) SELECT term, count(*) AS df FROM w GROUP BY 1")(_added)
_short = f"({sql_list(QUESTIONS)})[1 + ordinal % {len(QUESTIONS)}]"


def _asked():
    return pick(QUESTIONS, F.col("ordinal"))


_qt = s_tokens(_short)
query("mth24_overlap_fallback", f"WITH {C} SELECT chunk_id, round(len(list_filter({_qt}, lambda w: list_contains({s_tokens('text')}, w))) / CAST(greatest(len({_qt}), 1) AS DOUBLE), 6) AS score FROM chunks")(
    lambda t: chunks(t).select("chunk_id", x.tokens(_asked()).alias("q"), x.tokens(F.col("text")).alias("d")).select("chunk_id", F.round(F.size(F.filter("q", lambda w: F.array_contains("d", w))) / F.greatest(F.size("q"), F.lit(1)).cast("double"), 6).alias("score"))
)
query("mth25_lexical_rerank", f"WITH {C}, s AS (SELECT chunk_id, list_distinct({s_words(f'lower({_short})')}) AS a, list_distinct({s_words('lower(text)')}) AS b FROM chunks) SELECT chunk_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared, round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 6) AS score FROM s")(
    lambda t: chunks(t).select("chunk_id", x.word_set(_asked()).alias("a"), x.word_set(F.col("text")).alias("b")).select("chunk_id", x.overlap(F.col("a"), F.col("b")).cast("long").alias("shared"), F.round(x.jaccard(F.col("a"), F.col("b")), 6).alias("score"))
)


_best_of = "list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(0, length(a) - i + 2), lambda n: CASE WHEN contains(b, a[i : i + n - 1]) THEN n ELSE 0 END))))"
query("mth19_longest_common_substring", f"WITH {C}, ab AS (SELECT chunk_id, left({sql_pick(STATEMENTS, 'ordinal + doc_id')}, 4000) AS a, left(text, 4000) AS b FROM chunks) SELECT chunk_id, CAST(coalesce({_best_of}, 0) AS BIGINT) AS longest FROM ab")(
    lambda t: substring.longest_common(chunks(t).select("chunk_id", pick(STATEMENTS, F.col("ordinal") + F.col("doc_id")).alias("a"), F.col("text").alias("b")), "chunk_id", "a", "b")
)

# checks of answers: statements against the chunk texts
_ans = sql_pick(STATEMENTS, "doc_id + ordinal + 1")


def _stated():
    return pick(STATEMENTS, F.col("doc_id") + F.col("ordinal") + 1)


A = f"{C}, a AS (SELECT chunk_id, {_ans} AS answer, text, lower(text) AS low FROM chunks)"
_nums = r"regexp_extract_all(answer, '\b\d+(?:\.\d+)?\b')"
_refs = r"regexp_extract_all(answer, '\[([^\]]+)\]', 1)"
_ents = rf"list_filter(list_distinct(regexp_extract_all(answer, '\b[A-Z][a-zA-Z0-9_\-]{{3,}}\b')), lambda w: NOT {s_in('w', check.ENTITY_STOP)})"
_share = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE len(list_filter({0}, lambda v: {1})) / CAST(len({0}) AS DOUBLE) END"
_numeric, _cited, _entity = _share.format(_nums, "contains(low, v)"), _share.format(_refs, "trim(v) <> '' AND contains(low, lower(trim(v)))"), _share.format(_ents, "contains(low, lower(v))")
_whole = f"CASE WHEN length({s_strip('answer')}) < 24 THEN 0.2 WHEN len({s_sentences('answer')}) = 1 AND length({s_strip('answer')}) < 70 THEN 0.55 ELSE 1.0 END"
_terms = f"list_distinct({s_tokens('c')})"
_bad = f"list_filter({s_parts('answer')}, lambda c: len({_terms}) >= 4 AND len(list_filter({_terms}, lambda w: contains(low, w))) / CAST(len({_terms}) AS DOUBLE) < 0.42)"
_missing = "len(list_filter({0}, lambda v: NOT ({1})))"
_noise = "(" + " OR ".join(f"regexp_matches(lower(answer), '{p}')" for p in e.NOISE_ANSWER) + ")"
V = f"""{A}, s AS (SELECT chunk_id, answer, len({_bad}) AS bad, CASE WHEN len({s_parts("answer")}) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - len({_bad}) / CAST(len({s_parts("answer")}) AS DOUBLE)) END AS grounding, {_numeric} AS numeric, {_cited} AS citation, {_entity} AS entity, {_whole} AS completeness,
 {_missing.format(_nums, "contains(low, v)")} + {_missing.format(_refs, "trim(v) <> '' AND contains(low, lower(trim(v)))")} + {_missing.format(_ents, "contains(low, lower(v))")} AS missing, {_noise} AS noise FROM a),
v AS (SELECT *, bad + missing + CASE WHEN completeness < 1 THEN 1 ELSE 0 END AS n, 0.38 * round(grounding, 4) + 0.18 * round(numeric, 4) + 0.15 * round(citation, 4) + 0.14 * round(entity, 4) + 0.15 * completeness AS weighted FROM s),
f AS (SELECT *, greatest(0.0, least(1.0, weighted - least(0.45, 0.07 * n))) AS c FROM v)"""


def _verified(t):
    return chunks(t).select("chunk_id", _stated().alias("answer"), "text").select("chunk_id", check.verification(F.col("answer"), F.col("text")).alias("v"))


query("mth26_stage_scores", f"WITH {V} SELECT chunk_id, round(CAST(grounding AS DOUBLE), 3) AS grounding, round(CAST(numeric AS DOUBLE), 3) AS numeric, round(CAST(citation AS DOUBLE), 3) AS citation, round(CAST(entity AS DOUBLE), 3) AS entity, CAST(completeness AS DOUBLE) AS completeness FROM f")(lambda t: _verified(t).select("chunk_id", *(F.round(f"v.{c}", 3).alias(c) for c in ("grounding", "numeric", "citation", "entity")), "v.completeness"))
query("cmp20_verify_answer", f"WITH {V} SELECT chunk_id, answer <> '' AND NOT noise AND c >= 0.62 AND bad = 0 AS supported, round(CAST(CASE WHEN answer = '' THEN 0.0 WHEN noise THEN 0.15 ELSE c END AS DOUBLE), 3) AS confidence, CAST(CASE WHEN answer = '' OR noise THEN 1 ELSE n END AS BIGINT) AS issues FROM f")(lambda t: _verified(t).select("chunk_id", "v.supported", F.round("v.confidence", 3).alias("confidence"), F.col("v.issues").cast("long").alias("issues")))
query("cmp21_should_retry", "SELECT event_id, (event_id % 4 < 3) AND (value < 50 OR event_id % 5 >= 3 OR value / 100 < 0.75 OR value / 100 < 0.45) AS again FROM events")(lambda t: t("events").select("event_id", check.should_retry(F.col("value") >= 50, F.pmod("event_id", F.lit(5)), F.col("value") / 100, F.col("value") / 100, F.pmod("event_id", F.lit(4))).alias("again")))
query("cmp19_choose_k", "SELECT event_id, CAST(least(30, greatest(12, 12 + CASE WHEN event_type = 'view' THEN 4 ELSE 0 END + CASE WHEN value / 100 < 0.35 THEN 6 ELSE 0 END + (event_id % 4) * 3)) AS BIGINT) AS k FROM events")(lambda t: t("events").select("event_id", check.choose_k(F.col("value") / 100, F.pmod("event_id", F.lit(4)), F.when(F.col("event_type") == "view", "multi_hop").otherwise("simple")).cast("long").alias("k")))
query("cmp30_retry_rule", "SELECT event_id, (CASE WHEN value > 80 THEN 0.85 WHEN value > 40 THEN 0.6 ELSE 0.3 END) < 0.65 AND event_id % 5 < 3 AS again FROM events")(
    lambda t: t("events").select("event_id", answer.retry(answer.label_score(F.when(F.col("value") > 80, "High").when(F.col("value") > 40, "Medium").otherwise("Low")), F.pmod("event_id", F.lit(5))).alias("again"))
)
query("cmp37_model_routing", f"WITH {Q} SELECT query_id, CASE WHEN {s_any('lower(question)', 'compare', 'vs', 'difference between', 'why', 'cause', 'because')} THEN 'strong' ELSE 'other' END AS model FROM questions")(lambda t: questions(t).select("query_id", F.when(e.query_type(F.col("question")).isin("comparative", "causal"), answer.MODELS["comparative"]).otherwise("other").alias("model")))
_big = "list_distinct(list_filter({0}, lambda w: length(w) > 2))"
query("cmp22_alignment", f"WITH {C}, s AS (SELECT chunk_id, {_big.format(s_tokens(_short))} AS q, list_distinct({s_tokens('text')}) AS c FROM chunks) SELECT chunk_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, c)) / CAST(len(q) AS DOUBLE) END, 6) AS score FROM s")(lambda t: chunks(t).select("chunk_id", F.round(check.alignment(_asked(), F.col("text")), 6).alias("score")))
_cw = "list_filter(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)"
query("hlp05_claim_supported", f"WITH {A} SELECT chunk_id, len({_cw}) = 0 OR len(list_filter({_cw}, lambda w: contains(low, w))) >= 0.45 * len({_cw}) AS supported FROM a")(lambda t: chunks(t).select("chunk_id", check.claim_supported(_stated(), F.col("text")).alias("supported")))
query("hlp06_unknown_citations", f"WITH {A} SELECT chunk_id, array_to_string(list_filter(list_transform({_refs}, lambda r: trim(split_part(r, ',', 1))), lambda c: c <> '' AND c <> '12'), '|') AS unknown FROM a")(lambda t: chunks(t).select("chunk_id", F.array_join(check.unknown_citations(_stated(), F.array(F.lit("12"))), "|").alias("unknown")))
query("cmp33_self_verification")(lambda t: chunks(t).select("chunk_id", check.self_verification(_asked(), _stated(), F.col("text"), F.array(F.lit("12"))).alias("v")).select("chunk_id", "v.*"))
_jw = f"list_distinct(list_filter(list_transform({s_words('{0}')}, lambda w: lower(trim(w, '.,;:!?()[]{{{{}}}}\"'''))), lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_CRAG)}))"
_negw = "list_has_any(" + s_words("lower({})") + ", ['no', 'not', 'never', 'without'])"
query("cmp31_corrective_label", f"WITH {C}, s AS (SELECT chunk_id, {_jw.format(_short)} AS q, {_jw.format('text')} AS c, {_negw.format(_short)} <> {_negw.format('text')} AS clash FROM chunks), o AS (SELECT chunk_id, clash, len(list_intersect(q, c)) / CAST(greatest(len(q), 1) AS DOUBLE) AS o FROM s) SELECT chunk_id, CASE WHEN o = 0 THEN 'IRRELEVANT' WHEN clash THEN 'CONTRADICTORY' WHEN o >= 0.35 THEN 'CORRECT' WHEN o >= 0.15 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS label FROM o")(lambda t: chunks(t).select("chunk_id", check.corrective_label(_asked(), F.col("text")).alias("label")))
_kws = rf"list_filter(regexp_extract_all(lower({_short}), '[A-Za-z0-9_\-]+'), lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_QUALITY)})"
query("cmp28_coverage", f"WITH {C} SELECT chunk_id, round(CASE WHEN len({_kws}) = 0 THEN 0.5 ELSE 0.7 * len(list_filter({_kws}, lambda w: contains(lower(text), w))) / CAST(len({_kws}) AS DOUBLE) END, 6) AS coverage FROM chunks")(lambda t: chunks(t).select("chunk_id", F.round(check.coverage(_asked(), F.col("text")), 6).alias("coverage")))


# parameter rules, one row for each quality of an event
def _tuned(t):
    v, n = F.col("value") / 100, F.col("event_id")
    p = answer.tuned(v, F.pmod(n, F.lit(10)) / 10.0, F.pmod(n, F.lit(7)) / 7.0, F.pmod(n, F.lit(9)) / 9.0, F.pmod(n, F.lit(4)), F.pmod(n, F.lit(11)) > 0)
    return t("events").select("event_id", p.alias("p")).select("event_id", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("k_vector", "k_bm25", "max_per_doc")), *(f"p.{c}" for c in ("use_hyde", "use_colbert", "expand")), F.round("p.rerank_threshold", 6).alias("rerank_threshold"))


_good = "(event_id % 11 > 0 AND event_id % 9 / 9.0 >= 0.75)"
query("cmp29_parameter_rules", f"""WITH e AS (SELECT event_id, value / 100 AS r, event_id % 10 / 10.0 < 0.35 AS narrow, event_id % 7 / 7.0 < 0.45 AS thin, {_good} AS good FROM events)
SELECT event_id, CAST(CASE WHEN r < 0.4 THEN CASE WHEN good THEN 36 ELSE 45 END WHEN good THEN 24 ELSE 30 END AS BIGINT) AS k_vector, CAST(CASE WHEN thin THEN CASE WHEN good THEN 24 ELSE 30 END WHEN good THEN 16 ELSE 20 END AS BIGINT) AS k_bm25,
 CAST(CASE WHEN narrow THEN 1 ELSE 2 END AS BIGINT) AS max_per_doc, r < 0.4 AS use_hyde, event_id % 4 >= 2 AS use_colbert, thin AS expand, CASE WHEN r < 0.4 THEN 0.24 :: DOUBLE ELSE 0.3 :: DOUBLE END AS rerank_threshold FROM e""")(_tuned)


# chunkers
def _pages(t):
    return t("documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


_units = "flatten(list_transform({0}, lambda s: list_transform(range(0, len({1}), 220), lambda i: array_to_string(list_slice({1}, i + 1, i + 220), ' '))))"
_normal = rf"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> ''), chr(10)), '[ \t]+', ' ', 'g'))"
_n_words = "len(" + s_words("{}") + ")"
query("cmp01_word_chunks", f"""WITH RECURSIVE d AS (SELECT doc_id AS document_id, {_units.format(s_sentences(_normal), s_words('s'))} AS u FROM documents),
r AS (SELECT document_id, u, 0 AS i, '' AS cur, CAST(NULL AS VARCHAR) AS done FROM d UNION ALL
 SELECT document_id, u, i + 1, CASE WHEN i = len(u) THEN '' WHEN cur <> '' AND {_n_words.format('cur')} + {_n_words.format('u[i + 1]')} > 220 THEN CASE WHEN least(40, {_n_words.format('cur')}) + {_n_words.format('u[i + 1]')} > 220 THEN u[i + 1] ELSE array_to_string(list_slice({s_words('cur')}, greatest({_n_words.format('cur')} - 39, 1), {_n_words.format('cur')}), ' ') || ' ' || u[i + 1] END ELSE trim(cur || ' ' || u[i + 1]) END,
 CASE WHEN i = len(u) THEN nullif(cur, '') WHEN cur <> '' AND {_n_words.format('cur')} + {_n_words.format('u[i + 1]')} > 220 THEN cur END FROM r WHERE i <= len(u))
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS ordinal, done AS text, CAST({_n_words.format('done')} AS BIGINT) AS token_count FROM r WHERE done IS NOT NULL""")(lambda t: chunking.chunk_by_words(_pages(t)).select("document_id", "ordinal", "text", "token_count"))
query("cmp11_word_ingest", f"SELECT 'team::' || document_id AS document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS words FROM ({ORACLES['cmp01_word_chunks']}) GROUP BY 1")(
    lambda t: chunking.chunk_by_words(_pages(t).withColumn("document_id", F.concat(F.lit("team::"), F.col("document_id").cast("string")))).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("words"))
)
query("cmp02_section_chunks")(lambda t: chunking.chunk_by_sections(_pages(t).select(F.concat(F.lit("p"), F.col("document_id").cast("string")).alias("paper_id"), "page_number", "text")))


def _sections(t):
    return t("documents").select("doc_id", F.col("text").alias("raw_text"), F.array(F.struct(F.lit("Abstract").alias("name"), F.substring("text", 1, 300).alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end")), F.struct(F.lit("Results").alias("name"), F.substr("text", F.lit(301), F.length("text")).alias("text"), F.lit(2).alias("page_start"), F.lit(2).alias("page_end"))).alias("sections"), F.array(F.concat(F.lit("Figure 1: "), F.substring("text", 1, 20))).alias("captions"))


def _adv(t, strategy):
    return chunking.chunk_sections(_sections(t), strategy)


for name, strategy in (("cmp04_section_aware", "section"), ("cmp05_recursive", "recursive"), ("cmp06_semantic", "semantic")):
    query(name)(lambda t, strategy=strategy: _adv(t, strategy))
_sw = s_words("text")
query("cmp07_sliding", f"WITH w AS (SELECT doc_id, {_sw} AS ws FROM documents), s AS (SELECT doc_id, unnest(range(0, len(ws), 448)) AS pos, ws FROM w) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, array_to_string(list_slice(ws, pos + 1, pos + 512), ' ') AS text FROM s")(lambda t: _adv(t, "sliding").select("doc_id", "chunk_index", "text"))
_claims = f"{C}, k AS (SELECT chunk_id, section, generate_subscripts({s_sentences('text')}, 1) - 1 AS i, unnest({s_sentences('text')}) AS text FROM chunks), cl AS (SELECT sha1(chunk_id || ':' || i || ':' || text) AS claim_id, chunk_id, text AS claim, {_kind} AS claim_type, section FROM k WHERE {_plain_claim})"
query("cmp08_claims", f"WITH {_claims} SELECT claim_id, chunk_id, claim, claim_type, section FROM cl")(lambda t: chunking.extract_claims(chunks(t)).select("claim_id", "chunk_id", "claim", "claim_type", "section"))

# layouts: words of chunks placed on a page of two columns by their position
_PW = 1000.0


def _boxes(t):
    w = t("documents").select(F.col("doc_id").alias("page"), F.posexplode(x.split_words(F.col("text"))).alias("n", "token"))
    col, row, k = F.pmod("n", F.lit(2)), F.floor(F.col("n") / 8), F.floor(F.pmod("n", F.lit(8)) / 2)
    x0 = col * 560.0 + k * 60.0 + 40.0
    return w.select("page", x0.alias("x0"), (row * 12.0 + F.pmod("n", F.lit(3)) * 0.5).alias("y0"), (x0 + 50.0).alias("x1"), (row * 12.0 + 10.0).alias("y1"), "token", (col + 1).cast("int").alias("block"), row.cast("int").alias("line"), F.col("n").alias("word"))


BX = f"b AS (SELECT doc_id AS page, generate_subscripts({_sw}, 1) - 1 AS n, unnest({_sw}) AS token FROM documents), bx AS (SELECT page, n, token, (n % 2) * 560.0 + ((n % 8) // 2) * 60.0 + 40.0 AS x0, (n // 8) * 12.0 + (n % 3) * 0.5 AS y0, (n % 2) * 560.0 + ((n % 8) // 2) * 60.0 + 90.0 AS x1, (n // 8) * 12.0 + 10.0 AS y1, (n % 2) + 1 AS block, n // 8 AS line FROM b)"
query("src09_column_count", f"WITH {BX}, h AS (SELECT page, least(greatest(floor(x0 / 1000 * 20), 0), 19) AS bin, count(*) AS n FROM bx GROUP BY 1, 2), f AS (SELECT p.page, g.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT page FROM bx) p CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN h ON h.page = p.page AND h.bin = g.bin) SELECT page, CAST(CASE WHEN sum(n) >= 20 AND min(n) FILTER (bin BETWEEN 8 AND 11) < 0.45 * least(max(n) FILTER (bin < 8), max(n) FILTER (bin >= 12)) THEN 2 ELSE 1 END AS BIGINT) AS columns FROM f GROUP BY 1")(lambda t: layout.columns(_boxes(t), _PW).select("page", F.col("columns").cast("long").alias("columns")))
query("src10_row_groups", f"WITH {BX}, j AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, x0, n) > 3 THEN 1 ELSE 0 END AS jump FROM bx) SELECT page, n AS word, CAST(sum(jump) OVER (PARTITION BY page ORDER BY y0, x0, n) AS BIGINT) AS row FROM j")(lambda t: layout.rows(_boxes(t).withColumn("column", F.lit(0))).select("page", F.col("word").cast("long").alias("word"), "row"))
_two = "(SELECT page, sum(n) >= 20 AND min(n) FILTER (bin BETWEEN 8 AND 11) < 0.45 * least(max(n) FILTER (bin < 8), max(n) FILTER (bin >= 12)) AS two FROM (SELECT p.page, g.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT page FROM bx) p CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN (SELECT page, least(greatest(floor(x0 / 1000 * 20), 0), 19) AS bin, count(*) AS n FROM bx GROUP BY 1, 2) h ON h.page = p.page AND h.bin = g.bin) GROUP BY 1)"
LN = f"{BX}, t2 AS {_two}, j2 AS (SELECT bx.*, CASE WHEN two AND x0 > 500 THEN 1 ELSE 0 END AS col FROM bx JOIN t2 USING (page)), j3 AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page, col ORDER BY y0, x0, n) > 3 THEN 1 ELSE 0 END AS jump FROM j2), j4 AS (SELECT *, sum(jump) OVER (PARTITION BY page, col ORDER BY y0, x0, n) AS row FROM j3)"
query("src11_lines", f"WITH {LN} SELECT page, CAST(col AS INT) AS column, CAST(row AS BIGINT) AS row, string_agg(token, ' ' ORDER BY x0, n) AS text, CAST(min(x0) AS DOUBLE) AS x0, CAST(max(y1) AS DOUBLE) AS y1 FROM j4 GROUP BY 1, 2, 3")(lambda t: layout.lines(_boxes(t), _PW).select("page", "column", "row", "text", "x0", "y1"))
query("src12_median", f"WITH {BX} SELECT page, round(median(CAST(y1 - y0 AS DOUBLE)), 6) AS height FROM bx GROUP BY 1")(lambda t: _boxes(t).groupBy("page").agg(F.round(F.median(F.col("y1") - F.col("y0")), 6).alias("height")))
_BBOX = f"""{LN}, ln AS (SELECT page, col, row, string_agg(token, ' ' ORDER BY x0, n) AS text, CAST(min(y0) AS DOUBLE) AS y0 FROM j4 GROUP BY 1, 2, 3), md AS (SELECT page, median(CAST(y1 - y0 AS DOUBLE)) AS h FROM bx GROUP BY 1),
 gp AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY page ORDER BY col, row) AS gap FROM ln), tx AS (SELECT page, string_agg(CASE WHEN abs(gap) > greatest(8.0, h * 1.5) THEN chr(10) || text ELSE text END, chr(10) ORDER BY col, row) AS text FROM gp JOIN md USING (page) GROUP BY 1)"""
query("src08_bbox_text", f"WITH {_BBOX} SELECT page, text FROM tx")(lambda t: layout.page_text(_boxes(t), _PW))
query("src13_bbox_pages", f"WITH {_BBOX} SELECT page, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS columns, round(CAST({_q1} AS DOUBLE), 6) AS quality FROM tx JOIN t2 USING (page)")(
    lambda t: layout.page_text(_boxes(t), _PW).join(layout.columns(_boxes(t), _PW), "page").select("page", F.col("columns").cast("long").alias("columns"), F.round(x.quality_by_word_length(F.col("text")), 6).alias("quality"))
)
query("src16_text_by_gaps", f"WITH {BX}, g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, block, line ORDER BY n) AS gap FROM bx), l AS (SELECT page, block, line, string_agg(CASE WHEN gap > 1.5 THEN ' ' ELSE '' END || token, '' ORDER BY n) AS text FROM g GROUP BY 1, 2, 3) SELECT page, string_agg(text, chr(10) ORDER BY block, line) AS text FROM l GROUP BY 1")(lambda t: layout.text_by_gaps(_boxes(t)))
query("src06_text_by_tops", f"WITH {BX}, l AS (SELECT page, round_even(y0, 0) AS top, string_agg(token, ' ' ORDER BY n) AS text FROM bx GROUP BY 1, 2) SELECT page, string_agg(text, chr(10) ORDER BY top) AS text FROM l GROUP BY 1")(lambda t: layout.text_by_tops(_boxes(t)))
query("src07_average_quality", "SELECT source, round(avg(coalesce(CASE WHEN n_chars > 100 THEN least(1.0, n_chars / 2000.0) END, 0)), 6) AS quality FROM documents GROUP BY 1")(lambda t: t("documents").groupBy("source").agg(F.round(F.avg(F.coalesce(F.when(F.col("n_chars") > 100, F.least(F.lit(1.0), F.col("n_chars") / 2000.0)), F.lit(0.0))), 6).alias("quality")))

# dense retrieval, fusion and answers
_embs = _embedding_sql(False, 1024, "chunks", "chunk_id") + ", " + _embedding_sql(False, 1024, "qq", "query_id").replace("tk AS", "tk2 AS").replace("FROM tk)", "FROM tk2)").replace("hh AS", "hh2 AS").replace("FROM hh ", "FROM hh2 ").replace("pl AS", "pl2 AS").replace("FROM pl ", "FROM pl2 ").replace("nm AS", "nm2 AS").replace("JOIN nm ", "JOIN nm2 ").replace("emb AS", "emb2 AS")
D = f"{C}, {Q}, qq AS (SELECT query_id, question AS text FROM questions), {_embs}, ds AS (SELECT query_id, chunk_id, round(sum(a.w * b.w), 9) AS score FROM emb2 a JOIN emb b USING (idx) GROUP BY 1, 2)"
query("jn06_dense_top_k", f"WITH {D} SELECT query_id, chunk_id, round(score, 6) AS score FROM ds QUALIFY {_top} <= 10")(lambda t: retrieve.dense(questions(t), stored.chunk_vectors(t), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score")))
query("cmp13_dense_search", f"WITH {D}, own AS (SELECT ds.* FROM ds JOIN chunks USING (chunk_id) WHERE doc_id % 3 = 0) SELECT query_id, chunk_id, round(score, 6) AS score FROM own QUALIFY {_top} <= 10")(lambda t: retrieve.dense(questions(t), stored.chunk_vectors(t), 10, where=F.pmod("doc_id", F.lit(3)) == 0).select("query_id", "chunk_id", F.round("score", 6).alias("score")))
_near = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
query("cmp14_memory_search", f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x_: CAST(x_ AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY {_near} <= 10")(
    lambda t: retrieve.nearest(t("embeddings").filter(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("query_id"), "embedding"), stored.embeddings(t), "vec_id", 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))
)


def _numbered(sql, n):
    """The embedding statements under names of their own."""
    for name in ("tk", "hh", "pl", "nm", "emb"):
        sql = sql.replace(f"{name} AS", f"{name}{n} AS").replace(f"FROM {name} ", f"FROM {name}{n} ").replace(f"FROM {name})", f"FROM {name}{n})").replace(f"JOIN {name} ", f"JOIN {name}{n} ")
    return sql


HYDE = f"""WITH {D}, qp AS (SELECT query_id, 'An excerpt on what was asked: ' || question AS text FROM questions), {_numbered(_embedding_sql(False, 1024, "qp", "query_id"), 9)},
 dp AS (SELECT query_id, chunk_id, round(sum(a.w * b.w), 9) AS score FROM emb9 a JOIN emb b USING (idx) GROUP BY 1, 2),
 bo AS (SELECT query_id, chunk_id, 0.4 * score AS score FROM (SELECT * FROM ds QUALIFY {_top} <= 10) UNION ALL SELECT query_id, chunk_id, 0.6 * score FROM (SELECT * FROM dp QUALIFY {_top} <= 10)),
 me AS (SELECT query_id, chunk_id, round(sum(CAST(score AS DOUBLE)), 9) AS score FROM bo GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score FROM me QUALIFY {_top} <= 10"""
query("cmp16_hypothetical", HYDE)(lambda t: retrieve.hyde(questions(t), chunks(t), 10, Passage()).select("query_id", "chunk_id", F.round("score", 6).alias("score")))


def _setup(t):
    return questions(t), stored.chunks(t), stored.claims(t), stored.postings(t)


def _hybrid(t, k):
    return retrieve.hybrid(*_setup(t), k=k, vectors=stored.chunk_vectors(t), claim_vectors=stored.claim_vectors(t))


_CL = f"""ck AS (SELECT chunk_id, section, generate_subscripts({s_sentences("text")}, 1) - 1 AS i, unnest({s_sentences("text")}) AS text FROM chunks), cl AS (SELECT sha1(chunk_id || ':' || i || ':' || text) AS claim_id, chunk_id, text FROM ck WHERE {_plain_claim})"""
_EMC = _embedding_sql(False, 1024, "cl", "claim_id").replace("tk AS", "tk3 AS").replace("FROM tk)", "FROM tk3)").replace("hh AS", "hh3 AS").replace("FROM hh ", "FROM hh3 ").replace("pl AS", "pl3 AS").replace("FROM pl ", "FROM pl3 ").replace("nm AS", "nm3 AS").replace("JOIN nm ", "JOIN nm3 ").replace("emb AS", "emb3 AS")
_BMQ = _BM[_BM.index("w AS (SELECT chunk_id") :]
_map = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in e.EXPANSIONS.items()) + "}"
_exp = f"list_distinct(list_concat({s_tokens('question')}, flatten(list_transform({s_tokens('question')}, lambda w: coalesce(({_map})[w], [])))))"
_intent = " UNION ALL ".join(f"SELECT query_id, unnest({sql_list(names)}) AS section, {w} AS weight FROM questions WHERE {s_any('lower(question)', *words)}" for words, names, w in e.INTENTS)
_tabular = f"(regexp_matches(question, '\\d') OR {s_any('lower(question)', *e.TABLE_MARKERS)})"
_rk = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, {})"
HYBRID = f"""WITH {D}, {_BMQ}, {_CL}, {_EMC}, dc AS (SELECT query_id, claim_id, round(sum(a.w * b.w), 9) AS score FROM emb2 a JOIN emb3 b USING (idx) GROUP BY 1, 2),
 l1 AS (SELECT query_id, chunk_id, {_rk.format("score", "chunk_id")} AS rank, CAST(NULL AS VARCHAR) AS claim, 1.0 AS weight FROM ds QUALIFY rank <= 30),
 l2 AS (SELECT query_id, chunk_id, {_rk.format("score", "chunk_id")} AS rank, CAST(NULL AS VARCHAR) AS claim, 1.0 AS weight FROM sc WHERE score <> 0 QUALIFY rank <= 30),
 l3a AS (SELECT query_id, claim_id, {_rk.format("score", "claim_id")} AS rank FROM dc QUALIFY rank <= 30), l3 AS (SELECT query_id, chunk_id, min(rank) AS rank, arg_min(text, rank) AS claim, 1.3 AS weight FROM l3a JOIN cl USING (claim_id) GROUP BY 1, 2),
 ev AS (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3), fu AS (SELECT query_id, chunk_id, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS fused, max(claim) AS claim FROM ev GROUP BY 1, 2),
 iw AS (SELECT query_id, section, CAST(max(weight) AS DOUBLE) AS weight FROM ({_intent}) GROUP BY 1, 2),
 rr AS (SELECT f.*, c.section, c.text, q.question, coalesce(w.weight, 0.0) AS bonus, round(CASE WHEN {_tabular} AND c.content_type = 'table' THEN f.fused * 1.2 ELSE f.fused END + coalesce(w.weight, 0.0), 9) AS rrf_score FROM fu f JOIN chunks c USING (chunk_id) JOIN questions q USING (query_id) LEFT JOIN iw w ON w.query_id = f.query_id AND w.section = c.section),
 r1 AS (SELECT *, {_rk.format("rrf_score", "chunk_id")} AS rrf_rank FROM rr QUALIFY rrf_rank <= 20),
 r2 AS (SELECT *, {_rk.format(f"len(list_intersect(list_distinct({s_tokens('question')}), list_distinct({s_tokens('CASE WHEN claim IS NULL THEN text ELSE claim || chr(10) || chr(10) || text END')})))", "rrf_rank")} AS rerank_rank FROM r1),
 r3 AS (SELECT *, round(1.2 / (60.0 + rerank_rank) + 1.0 / (60.0 + rrf_rank) + 0.10 * least(1.0, len(list_intersect({_exp}, list_distinct({s_tokens("text")}))) / CAST(greatest(4, len({_exp})) AS DOUBLE)) + bonus + CASE WHEN claim IS NULL THEN 0.0 ELSE 0.025 END, 9) AS rerank_score FROM r2),
 r4 AS (SELECT *, {_rk.format("rerank_score", "chunk_id")} AS rank FROM r3), r5 AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY rank) > 3 AS late FROM r4)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS position, chunk_id FROM r5 QUALIFY position <= 10"""
query("cmp17_hybrid_retrieve", HYBRID)(lambda t: _hybrid(t, 10).select("query_id", F.col("position").cast("long").alias("position"), "chunk_id"))
query("cmp18_advanced_retrieve")(lambda t: retrieve.advanced(questions(t), chunks(t), stored.postings(t)).select("query_id", "position", "chunk_id", "score"))


def _named_papers(t):
    """Every seventh paper's title names the authors that statements cite."""
    return papers(t).withColumn("title", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat("title", F.lit(" Vaswani et al"))).otherwise(F.col("title")))


_plain_terms = "list_distinct(list_filter({0}, lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+')))"
CHAIN = rf"""WITH {_BM}, {P}, hi AS (SELECT query_id, chunk_id FROM sc WHERE score <> 0 QUALIFY {_top} <= 10), hp AS (SELECT DISTINCT query_id, paper_id FROM hi JOIN chunks USING (chunk_id)),
 ci AS (SELECT DISTINCT query_id, unnest(list_concat(regexp_extract_all(text, '\(([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s+\d{{4}})\)', 1), regexp_extract_all(text, '\[(\d+)\]', 1))) AS c FROM hi JOIN chunks USING (chunk_id)),
 pt AS (SELECT paper_id, list_distinct({s_tokens("CASE WHEN doc_id % 7 = 0 THEN title || ' Vaswani et al' ELSE title END")}) AS w FROM papers), ct AS (SELECT query_id, c, {_plain_terms.format(s_tokens("c"))} AS w FROM ci),
 bb AS (SELECT query_id, paper_id, max(len(list_intersect(ct.w, pt.w)) / CAST(len(ct.w) AS DOUBLE)) AS best FROM ct JOIN pt ON list_has_any(ct.w, pt.w) GROUP BY 1, 2),
 qt AS (SELECT query_id, {_plain_terms.format(s_tokens("question"))} AS w FROM questions WHERE query_id IN (SELECT query_id FROM ci)), sh AS (SELECT query_id, paper_id, len(list_intersect(qt.w, pt.w)) / CAST(len(qt.w) AS DOUBLE) AS share FROM qt JOIN pt ON list_has_any(qt.w, pt.w)),
 ss AS (SELECT query_id, paper_id, round(CASE WHEN coalesce(best, 0) > 0 THEN best * 0.7 + coalesce(share, 0) * 0.3 WHEN coalesce(share, 0) >= 0.2 THEN share ELSE 0 END, 9) AS score FROM bb FULL JOIN sh USING (query_id, paper_id)),
 c3 AS (SELECT query_id, paper_id FROM ss ANTI JOIN hp USING (query_id, paper_id) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) <= 3),
 ne AS (SELECT c3.query_id, c3.paper_id, c.chunk_id, {_big.format(s_tokens("q.question"))} AS q, list_distinct({s_tokens("c.text")}) AS d FROM c3 JOIN questions q USING (query_id) JOIN chunks c USING (paper_id)),
 ns AS (SELECT query_id, paper_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) / CAST(len(q) AS DOUBLE) END, 9) AS score FROM ne)
SELECT query_id, paper_id, chunk_id, round(score, 6) AS score FROM ns WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, chunk_id) <= 2"""
query("hlp01_paper_match", CHAIN[: CHAIN.index(" c3 AS (")].rstrip().rstrip(",") + " SELECT query_id, paper_id, round(score, 6) AS score FROM ss WHERE score > 0")(
    lambda t: retrieve.match_scores(questions(t), fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 10), chunks(t).select("chunk_id", "paper_id", "text")), _named_papers(t)).select("query_id", "paper_id", F.round("score", 6).alias("score"))
)
query("jn07_citation_chain", CHAIN)(lambda t: retrieve.cited(questions(t), fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 10), chunks(t).select("chunk_id", "paper_id", "text")), _named_papers(t), chunks(t)).withColumn("score", F.round("score", 6)))


def _extractive_sql(scored: str) -> str:
    """Answers from ``scored`` (query_id, chunk_id, score), five hits a question."""
    terms = f"list_distinct(list_filter({{0}}, lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_ANSWER)}))"
    q, own = terms.format(s_tokens("q.question")), terms.format(s_tokens("s.s"))
    return f"""hit AS (SELECT query_id, chunk_id, score FROM {scored} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
 sn AS (SELECT h.query_id, h.chunk_id, h.score, generate_subscripts({s_sentences("c.text")}, 1) - 1 AS i, unnest({s_sentences("c.text")}) AS s FROM hit h JOIN chunks c USING (chunk_id)),
 va AS (SELECT s.*, round(0.75 * s.score + 0.25 * len(list_intersect({q}, {own})), 9) AS value FROM sn s JOIN questions q USING (query_id)),
 fi AS (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY query_id, lower(s) ORDER BY value DESC, score DESC, chunk_id, i) = 1),
 to3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, score DESC, chunk_id, i) AS rn FROM fi QUALIFY rn <= 3),
 an AS (SELECT q.query_id, coalesce(string_agg(t.s, ' ' ORDER BY t.rn), '{answer.NOTHING}') AS answer FROM questions q LEFT JOIN to3 t USING (query_id) GROUP BY 1)"""


D384 = D.replace("% 1024", "% 384")
query("cmp27_extractive_query", f"WITH {D384}, {_extractive_sql('ds')} SELECT query_id, answer FROM an")(lambda t: answer.extractive(questions(t), fusion.bodies(retrieve.dense(questions(t), chunks(t), 5, 384), chunks(t).select("chunk_id", "text"))).select("query_id", "answer"))
query("cmp26_extractive_answer", f"WITH {_BM}, {_extractive_sql('(SELECT query_id, chunk_id, score FROM sc WHERE score <> 0)')} SELECT query_id, answer FROM an")(lambda t: answer.extractive(questions(t), fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 5), chunks(t).select("chunk_id", "text"))).select("query_id", "answer"))
_ss, _sets = s_sentences("a.answer"), "len(list_intersect({0}, {1})) / CAST(greatest(len(list_distinct(list_concat({0}, {1}))), 1) AS DOUBLE)"
_wa, _wb = f"list_distinct({s_words('lower(a.s)')})", f"list_distinct({s_words('lower(c.text)')})"
CITED = f"""WITH {_BM}, {_extractive_sql('(SELECT query_id, chunk_id, score FROM sc WHERE score <> 0)')}, st2 AS (SELECT query_id, generate_subscripts({_ss}, 1) - 1 AS i, unnest({_ss}) AS s FROM an a),
 pr AS (SELECT a.query_id, a.i, a.s, h.chunk_id, round({_sets.format(_wa, _wb)}, 9) AS score FROM st2 a JOIN hit h USING (query_id) JOIN chunks c USING (chunk_id)),
 bs AS (SELECT query_id, i, any_value(s) AS s, arg_max(chunk_id, (score, chunk_id)) AS chunk_id, max(score) AS score FROM pr GROUP BY 1, 2)
SELECT query_id, string_agg(CASE WHEN score >= 0.3 THEN s || ' [' || chunk_id || ']' ELSE s END, ' ' ORDER BY i) AS annotated, count(*) FILTER (score >= 0.3) AS cited, count(*) FILTER (score < 0.3) AS uncited FROM bs GROUP BY 1"""
query("cmp24_fallback_answer")(lambda t: answer.fallback(questions(t), _hybrid(t, 8)))
query("cmp25_overview_answer")(lambda t: answer.overview(_hybrid(t, 8)))
query("cmp38_answer_loop")(lambda t: answer.answer_batch(*_setup(t), vectors=stored.chunk_vectors(t), claim_vectors=stored.claim_vectors(t)))
query("cmp39_adaptive_loop")(lambda t: answer.adaptive(questions(t), chunks(t), stored.postings(t), stores.entity_edges(chunks(t).select("paper_id", e.named_entities(F.col("text")).alias("e")), "paper_id", "e"), Passage()).withColumn("overall", F.round("overall", 6)))
query("cmp39_adaptive_quality")(lambda t: answer.quality(questions(t), retrieve.advanced(questions(t), chunks(t), stored.postings(t))).select("query_id", *(F.round(c, 6).alias(c) for c in ("relevance", "diversity", "coverage", "completeness", "overall")), F.array_join("issues", "|").alias("issues")))
query("cmp32_corrective_loop")(lambda t: answer.correct(questions(t), fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 10), chunks(t).select("chunk_id", "text"))).select("query_id", "bad", "act"))
query("cmp34_reasoning_modes")(lambda t: answer.reason(questions(t), chunks(t), stored.postings(t)))


def _answers(t):
    hits_ = fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 5), chunks(t).select("chunk_id", F.col("paper_id").alias("doc_id"), "text"))
    return answer.extractive(questions(t), hits_), hits_


for name in ("cmp35_cited_answer", "jn08_sentence_argmax"):
    query(name, CITED)(lambda t: answer.cite(*_answers(t), threshold=0.3))
query("hlp13_citation_markers", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '(' || source || ', p.' || doc_id % 5 || ')' WHEN 1 THEN '(' || source || ' ' || doc_id % 5 || ')' ELSE '[' || doc_id || ']' END AS marker FROM documents")(
    lambda t: t("documents").select("doc_id", answer.marker(pick(("apa", "mla", "ieee"), F.col("doc_id")), F.col("source"), F.col("doc_id").cast("string"), F.pmod("doc_id", F.lit(5))).alias("marker"))
)
query("hlp02_rank_by_overlap", f"WITH {C}, s AS (SELECT paper_id, chunk_id, {_big.format(s_tokens(_short))} AS q, list_distinct({s_tokens('text')}) AS c FROM chunks), o AS (SELECT paper_id, chunk_id, round(len(list_intersect(q, c)) / CAST(greatest(len(q), 1) AS DOUBLE), 9) AS score FROM s) SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_id) AS rank FROM o WHERE score > 0")(lambda t: fusion.rank(chunks(t).withColumn("score", F.round(check.alignment(_asked(), F.col("text")), 9)).filter("score > 0"), ["paper_id"]).select("paper_id", "chunk_id", F.col("rank").cast("long").alias("rank")))
query("hlp01_match_formula", f"WITH {P}, s AS (SELECT paper_id, list_distinct({s_tokens('title')}) AS t, ['the', 'tion', 'vaswani'] AS c, ['der', 'and', 'edth'] AS q FROM papers), o AS (SELECT paper_id, len(list_intersect(c, t)) / 3.0 AS best, len(list_intersect(q, t)) / 3.0 AS share FROM s) SELECT paper_id, round(CAST(CASE WHEN best > 0 THEN 0.7 * best + 0.3 * share WHEN share >= 0.2 THEN share ELSE 0 END AS DOUBLE), 6) AS score FROM o")(
    lambda t: papers(t).select("paper_id", F.array_distinct(x.tokens(F.col("title"))).alias("t")).select("paper_id", (x.overlap(F.array(*map(F.lit, ("the", "tion", "vaswani"))), F.col("t")) / F.lit(3.0)).alias("best"), (x.overlap(F.array(*map(F.lit, ("der", "and", "edth"))), F.col("t")) / F.lit(3.0)).alias("share")).select("paper_id", F.round(F.when(F.col("best") > 0, F.col("best") * 0.7 + F.col("share") * 0.3).when(F.col("share") >= 0.2, F.col("share")).otherwise(0.0), 6).alias("score"))
)
query("hlp10_response_doc_ids", f"WITH {H} SELECT query_id, array_to_string(list_sort(list(DISTINCT doc_id)), '|') AS doc_ids FROM hits GROUP BY 1")(lambda t: hits(t).groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "doc_id")).alias("citations")).select("query_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("citations", lambda c: c["doc_id"]), lambda d: d.isNotNull()))), "|").alias("doc_ids")))


def _maxsim(t):
    """Token-level scores of each question's ten best chunks."""
    hits_ = fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 10).select("query_id", "chunk_id"), chunks(t).select("chunk_id", "text")).join(questions(t).select("query_id", "question"), "query_id")
    return v.max_sim(hits_.select("query_id", "chunk_id", x.unique_words(F.col("question")).alias("asked"), x.unique_words(F.col("text")).alias("held")), "chunk_id").withColumn("score", F.round("score", 5))


query("cmp15_max_sim")(_maxsim)


# a generator's answer over real hits, asked again where it copies
class Copier:
    """Says the beginning of the first chunk of its context; told to paraphrase, only how many chunks there are."""

    name = "copier"

    def generate(self, prompt):
        order, context = prompt.split("\n\nContext:\n", 1)
        parts = [p for p in context.split("\n\n") if p]
        if not parts:
            return answer.NO_MODEL
        return f"{len(parts)} chunks say so." if order.startswith(answer.PARAPHRASE) else parts[0].split("] ", 1)[1][:120]


ADVANCED = rf"""WITH {_BM}, hi AS (SELECT query_id, chunk_id, text, {_top} AS position FROM sc JOIN chunks USING (chunk_id) WHERE score <> 0 QUALIFY {_top} <= 10),
 fl AS (SELECT *, regexp_matches(left(text, 200), '(?i)^\s*\[\d+\]|(^|[^\p{{L}}\p{{N}}_])et\s+al($|[^\p{{L}}\p{{N}}_])|doi:|arxiv:') AS ref FROM hi), us AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM (SELECT *, bool_and(ref) OVER (PARTITION BY query_id) AS every FROM fl) WHERE every OR NOT ref),
 an AS (SELECT query_id, left(arg_min(trim(text), n), 120) AS said, least(count(*), 8) AS shown FROM us GROUP BY 1)
SELECT query_id, CASE WHEN length(said) > 80 THEN shown || ' chunks say so.' ELSE said END AS answer, coalesce(length(said) > 80, false) AS echo, CASE WHEN length(said) > 80 THEN 2 ELSE 1 END AS attempts FROM questions LEFT JOIN an USING (query_id)"""
query("cmp36_advanced_answer", ADVANCED)(lambda t: answer.advanced(questions(t), fusion.bodies(retrieve.lexical(questions(t), stored.postings(t), 10).withColumnRenamed("rank", "position"), chunks(t).select("chunk_id", "text")), Copier()).select("query_id", "answer", "echo", "attempts"))


# real configurations of retrieval, judged by the chunks that hold an item's first words
def _relevant(t):
    first = t("benchmark").select(F.col("item_id").alias("query_id"), F.slice(x.split_words(F.col("text")), 1, 3).alias("w")).select("query_id", "w", F.array_join("w", " ").alias("words"))
    return _holding(stored.chunks(t).select("chunk_id", "text"), first.filter(F.size("w") > 0)).select("query_id", F.col("chunk_id").alias("item"))


def _holding(texts, first):
    """query_id, chunk_id: the texts that hold the words (w) one space apart, and share a term with them.

    The second of three words stands between spaces, so texts are joined by it and not compared with every question. Questions are sent to where texts are read.
    """
    three = first.filter(F.size("w") == 3).select("query_id", "words", F.get("w", F.lit(1)).alias("part"))
    near = texts.select("chunk_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("part")).join(F.broadcast(three), "part")
    few = texts.join(F.broadcast(first.filter(F.size("w") < 3)), F.contains("text", F.col("words")))
    pairs = near.select("query_id", "chunk_id", "text", "words").unionByName(few.select("query_id", "chunk_id", "text", "words"))
    return pairs.filter(F.contains("text", F.col("words"))).filter(F.arrays_overlap(x.tokens(F.col("text")), x.tokens(F.col("words")))).select("query_id", "chunk_id").distinct()


query("agg10_ablation")(lambda t: evaluate.ablation(questions(t), _relevant(t), stored.chunks(t), stored.claims(t), stored.postings(t), 10, stored.chunk_vectors(t), stored.claim_vectors(t)).groupBy("config").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "average_precision")), F.count(F.lit(1)).alias("questions")))


# the engine behind its calls: papers ingested, some of them again, some deleted, then asked
def _engine(t):
    c = chunks(t)
    made = Engine(t.spark, fresh_path(t.spark, "engine")).ingest(c.withColumn("text", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat("text", F.lit(" draft"))).otherwise(F.col("text"))))
    made.ingest(c.filter("doc_id % 4 = 0")).delete(c.filter("doc_id % 10 = 3"))
    return made.search(questions(t), 3).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


_BM_KEPT = _BM.replace("FROM chunks0)", "FROM chunks0 WHERE doc_id % 10 <> 3)")
query("hlp21_facade_query", f"WITH {_BM_KEPT} SELECT query_id, chunk_id, {_top} AS rank FROM sc WHERE score <> 0 QUALIFY {_top} <= 3")(_engine)
# every strategy for a quarter of the documents
query("cmp03_chunk_dispatch")(lambda t: chunking.chunk_dispatch(_sections(t).withColumn("strategy", pick(("section", "recursive", "semantic", "sliding"), F.col("doc_id"))), "strategy"))

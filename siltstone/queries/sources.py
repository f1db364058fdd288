"""Queries of sources, ingest, streams and ports (SRC, SNK18, STR, CMP10-16, EXT10, HLP)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone import ports
from siltstone.functions import text as x
from siltstone.functions.extract import claims_of_answer, figure_captions, lenient_json
from siltstone.functions.vectors import norm
from siltstone.operators import bm25
from siltstone.plans import ingest, retrieve
from siltstone.queries.corpus import SQL_CHUNKS, SQL_QUESTIONS, chunks, questions, s_clean_claim, s_collapse, s_sentences, s_strip
from siltstone.queries.registry import query
from siltstone.queries.text import _q1, _q2
from siltstone.sources import readers
from siltstone.streaming import streams

query("src01_page_scan", "SELECT doc_id AS path, 1 AS page_number, length(text) AS chars FROM documents")(lambda t: readers.documents(t("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))).select(F.col("path").cast("long").alias("path"), "page_number", F.length("text").cast("long").alias("chars")))
query("src02_bucketed_pages", "SELECT source AS path, CAST(doc_id % 3 AS INT) AS page_number, sha1(string_agg(text, chr(10) ORDER BY doc_id, text)) AS digest FROM documents GROUP BY 1, 2")(lambda t: readers.bucketed_pages(t("documents").select(F.col("source").alias("path"), F.pmod("doc_id", F.lit(3)).cast("int").alias("page_number"), F.col("doc_id").alias("seq"), "text")).select("path", "page_number", F.sha1("text").alias("digest")))
query("src03_markdown_pages", "SELECT doc_id, CAST(p AS INT) AS page_number, CASE WHEN p = 1 THEN n_chars ELSE 0 END AS chars FROM (SELECT doc_id, n_chars, unnest(range(1, greatest(doc_id % 4, 1) + 1)) AS p FROM documents)")(lambda t: readers.markdown_pages(t("documents"), F.pmod("doc_id", F.lit(4)).cast("int")).select("doc_id", "page_number", F.length("text").cast("long").alias("chars")))


def _page_texts(t):
    """Pages as three parsers would give them: the lines; none for every third document; the whole text on one page."""
    lines = F.split("text", "\n")
    return t("documents").select("doc_id", "text", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.transform(lines, lambda _: F.lit(" "))).otherwise(lines).alias("a"), F.when(F.pmod("doc_id", F.lit(6)) == 0, F.array(F.lit(""))).otherwise(F.array(F.reverse("text"))).alias("b"), F.array("text").alias("c"))


SQL_PAGES = "pp AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN list_transform(string_split(text, chr(10)), lambda p_: ' ') ELSE string_split(text, chr(10)) END AS a, CASE WHEN doc_id % 6 = 0 THEN [''] ELSE [reverse(text)] END AS b, [text] AS c FROM documents)"
query("src05_legacy_cascade", f"WITH {SQL_PAGES} SELECT doc_id, CASE WHEN len(list_filter(a, lambda p_: trim(p_) <> '')) > 0 THEN 'words' WHEN len(list_filter(b, lambda p_: trim(p_) <> '')) > 0 THEN 'reversed' ELSE 'plain' END AS parser, length(CASE parser WHEN 'words' THEN array_to_string(a, chr(10)) WHEN 'reversed' THEN b[1] ELSE text END) AS chars FROM pp")(
    lambda t: _page_texts(t).select("doc_id", readers.first_with_text([("words", F.col("a")), ("reversed", F.col("b")), ("plain", F.col("c"))]).alias("p")).select("doc_id", "p.parser", F.length("p.text").cast("long").alias("chars"))
)
_mean_quality = "coalesce(list_avg(list_transform({0}, lambda t_: {1})), 0.0)"
_page_quality = _q1.replace("text", "t_")
query("src04_quality_cascade", f"WITH {SQL_PAGES}, q AS (SELECT doc_id, {_mean_quality.format('a', _page_quality)} AS qa, {_mean_quality.format('b', _page_quality)} AS qb, {_mean_quality.format('c', _page_quality)} AS qc FROM pp) SELECT doc_id, CASE WHEN qa > 0.75 THEN 'docling' WHEN qb > 0.65 THEN 'marker' WHEN qc > 0.55 THEN 'bbox' ELSE 'legacy' END AS parser FROM q")(
    lambda t: _page_texts(t).select("doc_id", readers.quality_cascade([("docling", F.col("a"), 0.75), ("marker", F.col("b"), 0.65), ("bbox", F.col("c"), 0.55)], ("legacy", F.col("c"))).alias("p")).select("doc_id", "p.parser")
)


def _processed(t):
    first, second = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.regexp_replace("text", " ", "")).when(F.pmod("doc_id", F.lit(4)) == 1, F.lit("  ")).otherwise(F.col("text")), F.when(F.pmod("doc_id", F.lit(8)) == 0, F.lit("")).otherwise(F.col("text"))
    return t("documents").select("doc_id", first.alias("a"), second.alias("b"), F.lower("text").alias("c")).select("doc_id", F.sha1(readers.process_cascade(F.col("a"), F.col("b"), F.col("c"))).alias("digest"))


query("src14_process_cascade", f"WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN '  ' ELSE text END AS a, CASE WHEN doc_id % 8 = 0 THEN '' ELSE text END AS b, lower(text) AS c FROM documents), q AS (SELECT *, {_q2.replace('text', 'a')} AS qa, {_q2.replace('text', 'b')} AS qb FROM p), r AS (SELECT *, CASE WHEN qa < 0.5 AND qb >= qa THEN b ELSE a END AS chosen FROM q) SELECT doc_id, sha1(CASE WHEN trim(chosen) = '' THEN c ELSE chosen END) AS digest FROM r")(_processed)
query("src19_csv_text", "SELECT n_regionkey, string_agg('Row ' || rn || ': n_nationkey=' || n_nationkey || ', n_name=' || n_name, chr(10) ORDER BY rn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY 1")(lambda t: readers.csv_text(t("nation"), ["n_nationkey", "n_name"], "n_nationkey", "n_regionkey"))
query("src20_json_text")(lambda t: readers.json_documents(t("events").select(F.col("event_id").cast("string").alias("path"), F.encode("props", "UTF-8").alias("content"))))
_ILLEGAL = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"


def docx_bytes(text):
    """A DOCX file with a paragraph for each line."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def _docx_files(t):
    def run(batches):
        for b in batches:
            for rows in readers._pieces((p.as_py(), docx_bytes(x.as_py())) for p, x in zip(b.column(0), b.column(1), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    return t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.regexp_replace("text", _ILLEGAL, "").alias("text")).mapInArrow(run, "path string, content binary")


_docx_sql = f"array_to_string(list_filter(string_split(regexp_replace(text, '{_ILLEGAL}', '', 'g'), chr(10)), lambda l_: {s_strip('l_')} <> ''), chr(10))"
query("src21_docx_text", f"SELECT doc_id || '.docx' AS path, sha1({_docx_sql}) AS digest FROM documents")(lambda t: readers.docx(_docx_files(t)).select("path", F.sha1("text").alias("digest")))


def _sources(t):
    """Sources of all five kinds, as addresses and bytes."""
    pdf = t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    url = t("pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    row = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name")
    csv = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("l")).select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("key,name\n"), F.array_join(F.transform("l", lambda x: x["r"]), "\n")), "UTF-8").alias("content"))
    json = t("events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.encode("props", "UTF-8").alias("content"))
    return pdf.unionByName(url).unionByName(csv).unionByName(json).unionByName(_docx_files(t))


query("src22_dispatch", f"""SELECT 'pdf' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'url', count(*), CAST(0 AS BIGINT) FROM pages
 UNION ALL SELECT 'docx', count(*), CAST(sum(length({_docx_sql})) AS BIGINT) FROM documents UNION ALL SELECT 'json', count(*), CAST(sum(11 + length(CAST(props AS JSON) ->> 'k')) AS BIGINT) FROM events
 UNION ALL SELECT 'csv', count(DISTINCT n_regionkey), CAST(sum(length('Row ' || rn || ': key=' || n_nationkey || ', name=' || n_name)) + count(*) - count(DISTINCT n_regionkey) AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation)""")(
    lambda t: readers.dispatch(_sources(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("kind") == "url", 0).otherwise(F.length("text"))).cast("long").alias("chars"))
)
query("src24_single_section", "SELECT doc_id, 'Document' AS name, length(text) AS chars FROM documents")(lambda t: readers.single_section(t("documents")).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.name", F.length("s.text").cast("long").alias("chars")))
_plain = s_collapse(r"regexp_replace(html, '<[^>]*>', ' ', 'g')")


def _cascade(t):
    plain = x.collapse(F.regexp_replace("html", "<[^>]*>", " "))
    return t("pages").select("page_id", readers.scrape_cascade(F.when(F.pmod("page_id", F.lit(2)) == 0, F.substring(plain, 1, 600)), plain, F.lit(None).cast("string")).alias("text")).select("page_id", F.length("text").cast("long").alias("chars"))


query("src25_scrape_cascade", f"WITH p AS (SELECT page_id, {_plain} AS plain FROM pages), c AS (SELECT page_id, plain, CASE WHEN page_id % 2 = 0 THEN left(plain, 600) END AS article FROM p) SELECT page_id, length(coalesce(CASE WHEN length(article) >= 500 THEN article END, CASE WHEN length(plain) >= 500 THEN plain END, plain, article, '')) AS chars FROM c")(_cascade)
_decoded = "replace(replace(replace(replace({0}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_text_of = lambda part: s_collapse(_decoded.format(rf"regexp_replace(regexp_replace({part}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"))
_body = _text_of("regexp_extract(html, '(?is)<body[^>]*>(.*)', 1)")
SELECTED = f"""WITH p AS (SELECT page_id, {_text_of("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} AS article, {_body} AS body, {_text_of("html")} AS every FROM pages)
SELECT page_id, CASE WHEN length(article) > 200 THEN article WHEN length(body) > 200 THEN body ELSE every END AS text FROM p"""
query("src26_selected_text", SELECTED)(lambda t: readers.main_texts(t("pages"), "page_id", "html"))
# back-ends of a web page: the article of its markup, else all of its text
query("hlp24_page_backends", f"WITH p AS (SELECT page_id, {_text_of("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} AS article, {_text_of("html")} AS every FROM pages) SELECT page_id, CASE WHEN length(article) > 200 THEN article ELSE every END AS text, CASE WHEN length(article) > 200 THEN 'article' ELSE 'page' END AS backend FROM p")(
    lambda t: readers.page_backends(t("pages"), "page_id", "html")
)
query("src27_title", f"SELECT page_id, {s_collapse(r"regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM pages")(lambda t: t("pages").select("page_id", readers.title(F.col("html")).alias("title")))
query("src29_hosts", r"SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")(lambda t: t("pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n")))
_abs = "'<title>' || url || '</title><p>Subjects: cs.' || page_id % 7 || '; math.' || page_id % 3 || '<br>subject: stat' || chr(10) || '</p>'"
query("src28_paper_page", f"SELECT page_id, regexp_extract({_abs}, '<title>(.*?)</title>', 1) AS title, array_to_string(list_transform(regexp_extract_all({_abs}, '(?i)subjects?:\\s*([^<\\n]+)', 1), lambda c_: trim(c_)), '|') AS categories FROM pages")(
    lambda t: t("pages").select("page_id", readers.paper_page(F.concat(F.lit("<title>"), "url", F.lit("</title><p>Subjects: cs."), F.pmod("page_id", F.lit(7)).cast("string"), F.lit("; math."), F.pmod("page_id", F.lit(3)).cast("string"), F.lit("<br>subject: stat\n</p>"))).alias("p")).select("page_id", "p.title", F.array_join("p.categories", "|").alias("categories"))
)
query("src33_default_cases")(lambda t: readers.benchmark_cases(t.spark))


def _corpus(t):
    pages = t("documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), "source", F.lit(1).alias("page_number"), "text").withColumnRenamed("source", "title")
    return ingest.sections(pages, "2024-01-31 00:00:00")


query("cmp10_ingest_report")(lambda t: ingest.report(_corpus(t)))
query("cmp12_private_entities")(lambda t: _corpus(t).entities)
query("hlp16_query_vectors", f"WITH {SQL_QUESTIONS} SELECT query_id, CAST(384 AS BIGINT) AS dim, 1.0 :: DOUBLE AS norm FROM questions")(
    lambda t: ports.embed_column(questions(t), "query_id", "question", ports.SeededEmbedder(), query=True).select("query_id", F.size("embedding").cast("long").alias("dim"), F.round(norm(F.col("embedding")), 4).alias("norm"))
)


class Passage:
    """Writes a passage that says what it was asked."""

    name = "passage"

    def generate(self, prompt):
        return "An excerpt on what was asked: " + prompt


query("hlp15_hypothetical", f"WITH {SQL_QUESTIONS} SELECT query_id, 'An excerpt on what was asked: ' || question AS passage FROM questions")(lambda t: ports.hypothetical(questions(t), Passage()).select("query_id", "passage"))
query("hlp18_provider_names", "SELECT 'seeded-384' AS embedder, 'fallback' AS generator")(lambda t: t.spark.range(1).select(F.lit(ports.SeededEmbedder().name).alias("embedder"), F.lit(ports.EchoGenerator().name).alias("generator")))
_VOTES = {"en": ("the", "and", "of", "is", "that"), "de": ("der", "die", "und", "das", "den"), "fr": ("le", "la", "et", "de", "les"), "es": ("el", "la", "que", "los", "del")}


def _vote(t):
    words = F.split(F.lower(F.substring("text", 1, 5000)), r"\s+")
    counts = F.array(*(F.struct((-sum((F.size(F.filter(words, _is(w))) for w in v), F.lit(0))).alias("n"), F.lit(k).alias("lang")) for k, v in sorted(_VOTES.items())))
    best = F.get(F.array_sort(counts), F.lit(0))
    return t("documents").select("doc_id", F.when(best["n"] < 0, best["lang"]).otherwise("unknown").alias("language"))


def _is(word):
    return lambda w: w == word


_votes = ", ".join(f"{{'n': -len(list_filter(ws, lambda w: w IN {v!r})), 'lang': '{k}'}}" for k, v in sorted(_VOTES.items()))
query("ext10_language_vote", f"WITH w AS (SELECT doc_id, regexp_split_to_array(lower(left(text, 5000)), '\\s+') AS ws FROM documents), b AS (SELECT doc_id, list_sort([{_votes}])[1] AS b FROM w) SELECT doc_id, CASE WHEN b.n < 0 THEN b.lang ELSE 'unknown' END AS language FROM b")(_vote)


def _calls(t):
    return t("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), (F.col("value") < 60).alias("ok"))


query("str09_circuit_breaker", "WITH c AS (SELECT event_type AS model, event_id AS seq, value < 60 AS ok FROM events), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY model ORDER BY seq) AS good FROM c) SELECT model, seq, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY model, good ORDER BY seq) >= 3 AS open FROM r")(lambda t: streams.breaker_table(_calls(t)))


def _streamed(t):
    schema = ", ".join(f"{n} {k}" for n, k in t("events").dtypes)
    stream = t.spark.readStream.schema(schema).parquet(t.folder + "/events.parquet*")
    return streams.run_to_memory(streams.windows(stream, "ts", ["event_type"]), "siltstone_windows", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


query("str08_windowed_stream", "SELECT date_trunc('day', ts) :: TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")(_streamed)

# feeds and datasets made of the tables' own texts
def _feed(t):
    entry = F.concat(F.lit("<entry><id>http://arxiv.org/abs/24"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("v3</id><title>Title "), F.col("lang"), F.lit("</title><updated>2024-01-02T03:04:05Z</updated><category term=\"cs."), F.col("lang"), F.lit("\"/></entry>"))
    return readers.entries(t("documents").select("doc_id", entry.alias("xml")), "xml", "doc_id")


query("src31_feed_entries", "SELECT doc_id, '24' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS entry_id, 'Title ' || lang AS title, 'cs.' || lang AS category FROM documents")(lambda t: _feed(t).select("doc_id", "entry_id", "title", F.get("categories", F.lit(0)).alias("category")))
query("src30_feed_order", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10")(lambda t: _feed(t).orderBy(F.desc("updated"), F.desc("doc_id")).limit(10).select("doc_id"))
query("src32_eval_cases", "SELECT item_id, trim(text) AS question, CAST(1 AS BIGINT) AS keywords FROM benchmark WHERE trim(text) <> ''")(
    lambda t: readers.case_rows(t("benchmark").select("item_id", F.to_json(F.struct(F.concat(F.lit(" "), "text").alias("question"), F.array("item_id").cast("array<string>").alias("expected_keywords"))).alias("line")), "line", "item_id").select("item_id", "question", F.size("expected_keywords").cast("long").alias("keywords"))
)
query("str03_monitor_digest", "SELECT DATE '2024-01-02' AS day, 'cs.' || lang AS category, count(*) AS items FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")(
    lambda t: streams.digest(streams.monitored(_feed(t), ["cs.en", "cs.de"], F.lit("2024-01-01 00:00:00").cast("timestamp")))
)
for name in ("src15_backend_texts", "hlp24_paged_texts"):  # form feeds part the pages of plain back-ends
    query(name, "SELECT doc_id AS path, CAST(i AS INT) AS page_number, length(p) AS chars FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents)")(
        lambda t: readers.documents(t("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.translate("text", "\n", "\f"), "UTF-8").alias("content"))).select(F.col("path").cast("long").alias("path"), "page_number", F.length("text").cast("long").alias("chars"))
    )


def _tabled(t):
    line = F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n")
    text = F.concat(F.lit("Nations\n"), lines, F.lit("\nFigure "), F.col("n_regionkey").cast("string"), F.lit(": a map\nfigure of none"))
    return t("nation").groupBy("n_regionkey").agg(text.alias("text"))


query("src17_table_scan", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_nationkey || '/' || n_name AS cells FROM nation")(
    lambda t: _tabled(t).select("n_regionkey", F.posexplode(readers.piped_rows(F.col("text"))).alias("row", "c")).select("n_regionkey", F.col("row").cast("long").alias("row"), F.array_join("c", "/").alias("cells"))
)
query("src18_tables_and_figures", "SELECT n_regionkey, count(*) AS rows, 'Figure ' || n_regionkey || ': a map' AS figures FROM nation GROUP BY 1")(
    lambda t: _tabled(t).select("n_regionkey", F.size(readers.piped_rows(F.col("text"))).cast("long").alias("rows"), F.array_join(figure_captions(F.col("text")), "|").alias("figures"))
)


class Said:
    """Answers in fenced JSON with the last paragraph of its prompt."""

    name = "said"

    def generate(self, prompt):
        import json

        return "```json\n" + json.dumps({"answer": prompt.split("\n\n", 1)[1]}) + "\n```"


_said = f"list_slice(list_filter(list_transform({s_sentences('question')}, lambda s_: {s_clean_claim('s_')}), lambda c_: length(c_) >= 20), 1, 3)"
query("cmp23_model_answer", f"WITH {SQL_QUESTIONS} SELECT query_id, 'said' AS provider, array_to_string({_said}, '|') AS claims FROM questions")(
    lambda t: ports.generated(questions(t), Said()).select("query_id", "provider", F.get_json_object(lenient_json(F.col("answer")), "$.answer").alias("said")).select("query_id", "provider", F.array_join(claims_of_answer(F.col("said")), "|").alias("claims"))
)
def _keys(t):
    def run(frame):
        import collections

        import pandas as pd

        frame = frame.sort_values("event_id")
        spent, quota, ring = collections.Counter(), -(-len(frame) // 3), ports.KeyRing(["k0", "k1", "k2"])

        def use(key):
            if spent[key] >= quota:
                raise PermissionError(key)
            spent[key] += 1
            return key

        return pd.DataFrame({"event_id": frame["event_id"], "key": [ring.call(use) for _ in range(len(frame))]})

    return t("events").select("event_id", "user_id").groupBy("user_id").applyInPandas(run, "event_id long, key string")


query("str10_key_rotation", "SELECT event_id, 'k' || CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // CAST(ceil(count(*) OVER (PARTITION BY user_id) / 3.0) AS BIGINT) AS VARCHAR) AS key FROM events")(_keys)


def _refined(t):
    parts = [ports.refine(chunks(t), None).select(F.lit("unset").alias("hook")), ports.refine(chunks(t), lambda c: c.filter("section = 'results'")).select(F.lit("results").alias("hook"))]
    hooks = t.spark.createDataFrame([("unset",), ("results",)], "hook string")
    return hooks.join(parts[0].unionByName(parts[1]).groupBy("hook").agg(F.count(F.lit(1)).alias("n")), "hook", "left").select("hook", F.coalesce("n", F.lit(0)).alias("refined"))


query("hlp09_refine_hook", f"WITH {SQL_CHUNKS} SELECT 'unset' AS hook, CAST(0 AS BIGINT) AS refined UNION ALL SELECT 'results', count(*) FROM chunks WHERE section = 'results'")(_refined)
query("hlp23_fetched_pages", "SELECT page_id, octet_length(encode(html)) AS chars FROM pages")(lambda t: ports.fetched(t("pages").select("page_id", "url", F.encode("html", "UTF-8").alias("held")), None).select("page_id", F.length("content").cast("long").alias("chars")).withColumn("chars", F.col("chars")))

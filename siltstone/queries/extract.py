"""Queries of classification and extraction (EXT, FLT10-FLT28, HLP04-HLP07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import extract as e
from siltstone.queries.corpus import QUESTIONS, SQL_CHUNKS, SQL_QUESTIONS, chunks, questions, s_any, s_clean_claim, s_count, s_in, s_sentences, s_strip, s_tokens, s_words, sql_list
from siltstone.queries.registry import query


def _shown(out, kind):
    if kind == "list":
        return F.array_join(out, "|")
    return F.round(out.cast("double"), 6) if kind == "double" else out.cast(kind) if kind else out


def _sql_shown(sql, kind):
    return {"list": f"array_to_string({sql}, '|')", "double": f"round(CAST({sql} AS DOUBLE), 6)", "long": f"CAST({sql} AS BIGINT)"}.get(kind, sql)


def on_chunks(name, column, sql, kind=None):
    query(name, f"WITH {SQL_CHUNKS} SELECT chunk_id, {_sql_shown(sql, kind)} AS out FROM chunks" if sql else None)(lambda t: chunks(t).select("chunk_id", _shown(column(F.col("text")), kind).alias("out")))


def on_questions(name, column, sql, kind=None):
    query(name, f"WITH {SQL_QUESTIONS} SELECT query_id, {_sql_shown(sql, kind)} AS out FROM questions" if sql else None)(lambda t: questions(t).select("query_id", _shown(column(F.col("question")), kind).alias("out")))


def s_case(pairs, test):
    return "CASE " + " ".join(f"WHEN {test(rule)} THEN '{name}'" for name, rule in pairs) + " END"


# headings over lines, half of them synthetic
HEADS = ("Abstract", "1. Introduction", "2 Related Work", "3.1 Model Architecture Design", "Results", "conclusions", "REFERENCES", "Appendix", "4 Training Setup", "Discussion", "Method", "nothing of the kind", "5.2 Ethical remarks and broader impact", "Bibliography")
_lines = f"WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS n, unnest(string_split(text, chr(10))) AS raw FROM documents), h AS (SELECT doc_id, n, CASE WHEN n % 2 = 0 THEN ({sql_list(HEADS)})[1 + (doc_id + n // 2) % {len(HEADS)}] ELSE raw END AS line FROM l)"


def _heads(t):
    n = F.col("n").cast("long")
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    synthetic = F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.pmod(F.col("doc_id") + F.floor(n / 2), F.lit(len(HEADS))) + 1).cast("int"))
    return lines.select("doc_id", n.alias("n"), F.when(n % 2 == 0, synthetic).otherwise(F.col("raw")).alias("line"))


_title = rf"lower(trim(regexp_extract(line, '{e.NUMBERED}', 2)))"
_numbered = f"CASE WHEN regexp_matches(line, '{e.NUMBERED}') THEN {s_case(e.NUMBERED_WORDS, lambda w: s_any(_title, *w))} END"
_heading = f"CASE WHEN len({s_words('line')}) <= 8 THEN coalesce({s_case(e.HEADINGS, lambda p: f"regexp_matches(line, '{p}')")}, {_numbered}) END"
query("ext01_section_heading", f"{_lines} SELECT doc_id, n, coalesce({_heading}, '-') AS section FROM h")(lambda t: _heads(t).select("doc_id", "n", F.coalesce(e.section_heading(F.col("line")), F.lit("-")).alias("section")))
_plain = s_case(e.PLAIN_HEADINGS, lambda p: f"regexp_matches({s_strip('line')}, '{p}')")
query("ext02_plain_heading", f"{_lines} SELECT doc_id, n, coalesce({_plain}, '-') AS section FROM h")(lambda t: _heads(t).select("doc_id", "n", F.coalesce(e.plain_heading(F.col("line")), F.lit("-")).alias("section")))


def _segments(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("n")
    rows = _heads(t).withColumn("head", e.plain_heading(F.col("line"))).withColumn("part", F.count("head").over(w)).withColumn("name", F.last("head", True).over(w))
    body = rows.filter("head IS NULL").groupBy("doc_id", "part", F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("raw"), F.min("n").alias("first"))
    return body.select("doc_id", "part", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"), "name", "first").filter("text <> ''").select("doc_id", "part", F.when(e.references_count(F.col("text")) >= 3, "references").otherwise(F.col("name")).alias("name"), F.length("text").cast("long").alias("chars"), F.sha1("text").alias("digest"))


_refs = r"(len(regexp_extract_all(text, '\[\d+\]\s+[A-Z][a-z]+')) + len(regexp_extract_all(text, '(?m)^\s*\d+\.\s+[A-Z][a-z]+.+\(\d{4}\)')))"
query("ext03_section_segments", f"""{_lines}, m AS (SELECT *, {_plain} AS head FROM h), p AS (
 SELECT *, count(head) OVER w AS part, last_value(head IGNORE NULLS) OVER w AS name FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)
), b AS (SELECT doc_id, part, coalesce(name, 'Unknown') AS name, {s_strip("string_agg(line, chr(10) ORDER BY n)")} AS text FROM p WHERE head IS NULL GROUP BY 1, 2, 3)
SELECT doc_id, part, CASE WHEN {_refs} >= 3 THEN 'references' ELSE name END AS name, length(text) AS chars, sha1(text) AS digest FROM b WHERE text <> ''""")(_segments)
on_chunks("ext04_references_heuristic", lambda c: e.references_count(c) >= 3, f"{_refs} >= 3")
on_chunks("ext06_equations", e.equations, r"list_concat(list_concat(regexp_extract_all(text, '\$[^$]{2,200}\$'), regexp_extract_all(text, '\\\[[\s\S]{2,200}?\\\]')), regexp_extract_all(text, '\\begin\{equation\}[\s\S]{2,500}?\\end\{equation\}'))", "list")
_captioned = r"regexp_replace(text, '\n', chr(10) || 'Figure 1: ', 'g')"
query("ext07_figure_captions", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({_captioned}, '(?im)^(figure\s*\d+[:.\-].+)$', 1), lambda s: {s_strip('s')}), '|') AS out FROM documents")(lambda t: t("documents").select("doc_id", F.array_join(e.figure_captions(F.regexp_replace("text", "\n", "\nFigure 1: ")), "|").alias("out")))
query("ext05_reference_list", r"""WITH d AS (SELECT doc_id, text || chr(10) || 'References' || chr(10) || '[1] Someone (2017)' || chr(10) || ' [2] Another, 1984a ' || chr(10) || chr(10) || 'no year' AS text FROM documents), l AS (
 SELECT doc_id, list_filter(list_transform(string_split('[1] Someone (2017)' || chr(10) || ' [2] Another, 1984a ' || chr(10) || chr(10) || 'no year', chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM d)
SELECT doc_id, array_to_string(lines, '|') AS raw, array_to_string(list_transform(lines, lambda x: coalesce(nullif(regexp_extract(x, '((?:19|20)\d{2})', 1), ''), '-')), '|') AS years FROM l""")(
    lambda t: t("documents").select("doc_id", e.reference_lines(F.concat("text", F.lit("\nReferences\n[1] Someone (2017)\n [2] Another, 1984a \n\nno year"))).alias("r")).select("doc_id", F.array_join(F.transform("r", lambda x: x["raw"]), "|").alias("raw"), F.array_join(F.transform("r", lambda x: F.coalesce(x["year"].cast("string"), F.lit("-"))), "|").alias("years"))
)


def _basics(t):
    doi, year, venue = e.basics(F.col("text"))
    return chunks(t).select("chunk_id", F.coalesce(doi, F.lit("-")).alias("doi"), F.coalesce(year.cast("long"), F.lit(0)).alias("year"), F.coalesce(venue, F.lit("-")).alias("venue"))


# word boundaries are spelled out, as RE2 knows only ASCII ones
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
query("ext08_basic_metadata", rf"WITH {SQL_CHUNKS} SELECT chunk_id, coalesce(nullif(regexp_extract(text, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'), ''), '-') AS doi, CAST(coalesce(nullif(regexp_extract(text, '{_B}((?:19|20)\d{{2}}){_E}', 1), ''), '0') AS BIGINT) AS year, coalesce(upper(nullif(regexp_extract(text, '(?i){_B}(neurips|icml|iclr|acl|emnlp|cvpr|eccv|aaai|ijcai|kdd|www|sigir){_E}', 1), '')), '-') AS venue FROM chunks")(_basics)


def _title_page(t):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = t("documents").select("doc_id", lines.alias("l"))
    authors = F.filter(F.transform(F.split(F.coalesce(F.get("l", F.lit(1)), F.lit("")), ",| and "), lambda a: F.trim(a)), lambda a: a != "")
    return d.select("doc_id", F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("title"), F.array_join(authors, "|").alias("authors"))


query("ext09_title_page", "WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, coalesce(l[1], '') AS title, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(l[2], ''), ',| and '), lambda a: trim(a)), lambda a: a <> ''), '|') AS authors FROM d")(_title_page)
_word = r"regexp_extract_all(text, '[\p{L}\p{N}_-]+')"
ASCII = f"{SQL_CHUNKS}, ascii AS (SELECT chunk_id, paper_id, regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g') AS text FROM chunks)"
_named = "list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '\\b[Bb][Ee][Rr][Tt][A-Za-z0-9\\-]*\\b'), regexp_extract_all(text, '\\b[Gg][Pp][Tt][- ]?\\d+(?:\\.\\d+)?\\b')), list_concat(regexp_extract_all(text, '\\b[A-Z][A-Za-z]+(?:Net|Former|LM)\\b'), regexp_extract_all(text, '\\b[A-Z]{2,}\\b')))))"


def _ascii(t):
    """Chunks with other than ASCII characters made spaces: there both engines agree on word boundaries."""
    return chunks(t).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]+", " "))


query("ext11_named_entities", f"WITH {ASCII} SELECT chunk_id, array_to_string({_named}, '|') AS out FROM ascii")(lambda t: _ascii(t).select("chunk_id", F.array_join(e.named_entities(F.col("text")), "|").alias("out")))
query("agg21_distinct_entities", f"WITH {ASCII} SELECT DISTINCT paper_id, unnest({_named}) AS entity FROM ascii")(lambda t: _ascii(t).select("paper_id", F.explode(e.named_entities(F.col("text"))).alias("entity")).distinct())
query("ext12_claim_entities", f"WITH {ASCII} SELECT chunk_id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(text, '\\b([A-Z][A-Za-z0-9_\\-]{{2,}}|\\d+(?:\\.\\d+)?%?)\\b', 1))), 1, 10), '|') AS out FROM ascii")(lambda t: _ascii(t).select("chunk_id", F.array_join(e.claim_entities(F.col("text")), "|").alias("out")))
_low = "lower(text)"
_kind = f"coalesce({s_case(e.CLAIM_TYPES, lambda w: s_any(_low, *w))}, CASE WHEN contains(lower(section), 'method') OR {s_any(_low, 'we propose', 'we introduce', 'our approach')} THEN 'method' ELSE 'result' END)"
query("ext13_claim_type", f"WITH {SQL_CHUNKS} SELECT chunk_id, {_kind} AS out FROM chunks")(lambda t: chunks(t).select("chunk_id", e.claim_type(F.col("text"), F.col("section")).alias("out")))
query("ext14_claim_confidence", f"WITH {SQL_CHUNKS}, k AS (SELECT chunk_id, text, {_kind} AS kind FROM chunks) SELECT chunk_id, CAST(round(least(0.95, 0.55 + CASE WHEN regexp_matches(text, '{_B}\\d+{_E}') THEN 0.1 ELSE 0 END + CASE WHEN kind IN ('result', 'comparison') THEN 0.1 ELSE 0 END + CASE WHEN len({s_words('text')}) >= 14 THEN 0.1 ELSE 0 END), 3) AS DOUBLE) AS out FROM k")(
    lambda t: chunks(t).select("chunk_id", e.claim_confidence(F.col("text"), e.claim_type(F.col("text"), F.col("section"))).alias("out"))
)
on_chunks("ext15_citation_strings", e.citations, r"list_concat(regexp_extract_all(text, '\(([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s+\d{4})\)', 1), regexp_extract_all(text, '\[(\d+)\]', 1))", "list")
_red = "regexp_replace(regexp_replace({0}, '\\b\\d{{3}}[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}\\b', '[REDACTED_PHONE]', 'g'), '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[REDACTED_SSN]', 'g')"
query("ext16_redact", f"WITH {ASCII} SELECT chunk_id, {_red.format(f"regexp_replace(text, '{e.EMAIL}', '[REDACTED_EMAIL]', 'g')")} AS out, {_red.format('text')} AS compat FROM ascii")(lambda t: _ascii(t).select("chunk_id", e.redact(F.col("text")).alias("out"), e.redact(F.col("text"), compat=True).alias("compat")))


def _privacy(t):
    c = chunks(t).withColumn("redacted", e.redact(F.col("text")))
    return c.groupBy("paper_id").agg(F.count_if(F.col("redacted") != F.col("text")).alias("redacted_blocks"), F.count(F.lit(1)).alias("blocks")).withColumn("privacy_applied", F.col("redacted_blocks") > 0)


query("ext17_privacy_counts", f"WITH {SQL_CHUNKS} SELECT paper_id, count(*) FILTER (regexp_matches(text, '{e.EMAIL}') OR regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])\\d{{3}}[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}(?:$|[^\\p{{L}}\\p{{N}}_])') OR regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])\\d{{3}}-\\d{{2}}-\\d{{4}}(?:$|[^\\p{{L}}\\p{{N}}_])')) AS redacted_blocks, count(*) AS blocks, redacted_blocks > 0 AS privacy_applied FROM chunks GROUP BY 1")(_privacy)
_ql = "lower(question)"
on_questions("ext18_hop_type", e.hop_type, rf"CASE WHEN {s_any(_ql, *e.MULTI_HOP)} OR len(list_filter(regexp_extract_all({_ql}, '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ('and', 'then'))) >= 2 THEN 'multi_hop' ELSE 'simple' END")
_tok_split = r"regexp_split_to_array(regexp_replace(regexp_replace(' ' || question || ' ', '(?i)([^\p{L}\p{N}_])(and|then|vs|versus|compare)([^\p{L}\p{N}_])', '\1' || chr(1) || '\3', 'g'), '(?i)([^\p{L}\p{N}_])(and|then|vs|versus|compare)([^\p{L}\p{N}_])', '\1' || chr(1) || '\3', 'g'), chr(1))"
on_questions("ext19_hops", e.hops, f"list_filter(list_transform({_tok_split}, lambda p: trim(p, ' ,.?')), lambda p: p <> '')", "list")
_types = f"coalesce({s_case(e.QUERY_TYPES, lambda w: s_any(_ql, *w))}, CASE WHEN len(regexp_extract_all(question, '[A-Z][A-Za-z0-9\\-]+')) >= 2 OR {s_any(_ql, 'and', 'relation', 'impact of')} THEN 'multi_hop' ELSE 'simple_fact' END)"


def _analysis(t):
    a = questions(t).select("query_id", e.query_analysis(F.col("question")).alias("a"))
    return a.select("query_id", "a.query_type", "a.complexity", "a.requires_synthesis", "a.suggested_mode", F.col("a.estimated_sources_needed").cast("long").alias("sources"))


query("ext20_query_analysis", f"""WITH {SQL_QUESTIONS}, k AS (SELECT query_id, {_types} AS query_type, len({s_words('question')}) AS n FROM questions),
c AS (SELECT *, CASE WHEN n > 22 OR query_type IN ('survey', 'multi_hop') THEN 'high' WHEN n > 12 OR query_type = 'comparative' THEN 'medium' ELSE 'low' END AS complexity FROM k)
SELECT query_id, query_type, complexity, query_type IN ('multi_hop', 'survey', 'comparative', 'temporal') AS requires_synthesis,
 CASE query_type WHEN 'multi_hop' THEN 'multihop' WHEN 'comparative' THEN 'comparison' ELSE 'basic' END AS suggested_mode,
 CAST(CASE complexity WHEN 'high' THEN 6 WHEN 'medium' THEN 4 ELSE 2 END AS BIGINT) AS sources FROM c""")(_analysis)
_and_split = r"regexp_split_to_array(regexp_replace(question, '(?i)([^\p{L}\p{N}_])and([^\p{L}\p{N}_])', '\1' || ';' || '\2', 'g'), ';|,')"
_sub = f"list_filter(list_transform({_and_split}, lambda p: {s_strip('p')}), lambda p: p <> '')"
on_questions("ext21_sub_questions", e.sub_questions, f"CASE WHEN len({_sub}) <= 1 THEN [{s_strip('question')}] ELSE list_transform(list_slice({_sub}, 1, 5), lambda p: CASE WHEN suffix(p, '?') THEN p ELSE p || '?' END) END", "list")
on_questions("ext22_query_variants", e.query_variants, "[question, question || ' state of the art limitations comparison evaluation methodology', 'What broader research problem does this address: ' || question || '?']", "list")
query("hlp14_expand_and_step_back", f"WITH {SQL_QUESTIONS} SELECT query_id, question || ' state of the art limitations comparison evaluation methodology' AS expanded, 'What broader research problem does this address: ' || question || '?' AS step_back FROM questions")(lambda t: questions(t).select("query_id", e.expand_question(F.col("question")).alias("expanded"), e.step_back(F.col("question")).alias("step_back")))
_map = "MAP {" + ", ".join(f"'{k}': {sql_list(v)}" for k, v in e.EXPANSIONS.items()) + "}"
on_questions("ext23_expanded_terms", e.expanded_terms, f"list_sort(list_distinct(list_concat({s_tokens('question')}, flatten(list_transform({s_tokens('question')}, lambda w: coalesce(({_map})[w], []))))))", "list")
_rules = " UNION ALL ".join(f"SELECT query_id, unnest({sql_list(names)}) AS section, {w} AS weight FROM questions WHERE {s_any(_ql, *words)}" for words, names, w in e.INTENTS)
query("ext24_section_intents", f"WITH {SQL_QUESTIONS}, r AS ({_rules}) SELECT query_id, section, CAST(max(weight) AS DOUBLE) AS weight FROM r GROUP BY 1, 2")(lambda t: questions(t).select("query_id", F.explode(e.intent_weights(F.col("question"))).alias("r")).select("query_id", "r.section", "r.weight"))
_focus = "flatten([" + ", ".join(f"CASE WHEN {s_any(_ql, *w)} THEN {sql_list(v)} ELSE [] END" for w, v in e.FOCUS) + "])"
on_questions("ext25_focus_terms", e.focus_terms, f"list_slice(list_filter({_focus}, lambda v, i: list_position({_focus}, v) = i), 1, 4)", "list")
_tech = "list_filter([" + ", ".join(f"CASE WHEN contains({_low}, '{w}') THEN '{w.title()}' END" for w in e.TECH) + "], lambda w: w IS NOT NULL)"
on_chunks("ext26_tech_terms", e.tech_terms, _tech, "list")
query("ext26_project_phrases")(lambda t: chunks(t).select("chunk_id", F.array_join(e.project_phrases(F.col("text")), "|").alias("out")))

# tables: the first rows of a document's lines, cut at commas
_rows = "list_transform(list_slice(string_split(text, chr(10)), 1, 5), lambda l: list_slice(string_split(l, ','), 1, 4))"
_width = "list_max(list_transform(r, lambda x: len(x)))"
_norm = rf"list_filter(list_transform(r, lambda x: list_resize(list_transform(x, lambda c: regexp_replace({s_strip('c')}, '\s+', ' ', 'g')), {_width}, '')), lambda x: len(list_filter(x, lambda c: c <> '')) > 0)"
_tables = f"WITH t AS (SELECT doc_id, {_rows} AS r FROM documents), n AS (SELECT doc_id, {_norm} AS r FROM t), v AS (SELECT doc_id, r FROM n WHERE len(r) >= 2)"


def _tables_of(t):
    rows = F.transform(F.slice(F.split("text", "\n"), 1, 5), lambda line: F.slice(F.split(line, ","), 1, 4))
    return t("documents").select("doc_id", e.table_rows(rows).alias("r")).filter(F.size("r") >= 2)


_md = "array_to_string(list_concat(['| ' || array_to_string(r[1], ' | ') || ' |', '| ' || array_to_string(list_transform(r[1], lambda x: '---'), ' | ') || ' |'], list_transform(list_slice(r, 2, len(r)), lambda x: '| ' || array_to_string(x, ' | ') || ' |')), chr(10))"
query("ext27_table_rows", f"{_tables} SELECT doc_id, array_to_string(list_transform(r, lambda x: array_to_string(x, ';')), '|') AS out FROM v")(lambda t: _tables_of(t).select("doc_id", F.array_join(F.transform("r", lambda x: F.array_join(x, ";")), "|").alias("out")))
query("ext28_table_markdown", f"{_tables} SELECT doc_id, {_md} AS out FROM v")(lambda t: _tables_of(t).select("doc_id", e.table_markdown(F.col("r")).alias("out")))
_cells = "array_to_string(list_transform(range(1, len(r[1]) + 1), lambda j: CASE WHEN r[1][j] <> '' THEN r[1][j] ELSE 'col' || j END || '=' || r[i + 1][j]), ', ')"
_nl = f"array_to_string(list_concat(['Table on page 1.', 'The table has ' || (len(r) - 1) || ' rows and ' || len(r[1]) || ' columns.', 'Column headers: ' || coalesce(nullif(array_to_string(list_filter(r[1], lambda h: h <> ''), ', '), ''), 'unlabeled') || '.'], list_transform(range(1, least(len(r), 4)), lambda i: 'Row ' || i || ': ' || {_cells} || '.')), ' ')"
query("ext29_table_sentences", f"{_tables} SELECT doc_id, {_nl} AS out FROM v")(lambda t: _tables_of(t).select("doc_id", e.table_sentences(F.col("r"), F.lit(1)).alias("out")))
_numeric = r"len(list_filter(flatten(list_slice(r, 2, len(r))), lambda c: regexp_matches(c, '\d'))) >= 0.4 * len(flatten(list_slice(r, 2, len(r))))"
query("ext30_table_numeric", f"{_tables} SELECT doc_id, {_numeric} AS out FROM v")(lambda t: _tables_of(t).select("doc_id", e.table_is_numeric(F.col("r")).alias("out")))
query("cmp09_table_chunks", f"{_tables} SELECT doc_id, '[TABLE]' || chr(10) || {_md} || chr(10) || chr(10) || {_nl} AS text, CAST(len(r) - 1 AS BIGINT) AS n_rows, CAST(len(r[1]) AS BIGINT) AS n_cols, {_numeric} AS has_numeric_data, sha1(doc_id || ':table:1:0:' || '[TABLE]' || chr(10) || {_md} || chr(10) || chr(10) || {_nl}) AS chunk_id FROM v")(
    lambda t: _tables_of(t).withColumn("text", F.concat(F.lit("[TABLE]\n"), e.table_markdown(F.col("r")), F.lit("\n\n"), e.table_sentences(F.col("r"), F.lit(1)))).select("doc_id", "text", (F.size("r") - 1).cast("long").alias("n_rows"), F.size(F.col("r")[0]).cast("long").alias("n_cols"), e.table_is_numeric(F.col("r")).alias("has_numeric_data"), F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit(":table:1:0:"), F.col("text"))).alias("chunk_id"))
)
query("ext31_lenient_json", r"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-' ELSE regexp_extract(props, '(?s)\{.*\}') END AS out FROM events")(
    lambda t: t("events").select("event_id", F.coalesce(e.lenient_json(F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.concat(F.lit("```json\nHere: "), F.col("props"), F.lit("\n```")))), F.lit("-")).alias("out"))
)
query("ext32_payload_text", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-') AS out FROM events")(
    lambda t: t("events").select("event_id", F.coalesce(F.get_json_object(F.concat(F.lit('{"choices":[{"message":{"content":'), F.col("props"), F.lit("}}]}")), "$.choices[0].message.content.k"), F.lit("-")).alias("out"))
)

# predicates
_plain_claim = rf"length(text) >= 35 AND len({s_words('text')}) >= 7 AND NOT {s_any(_low, 'future work', 'we plan', 'might', 'could', 'todo')} AND NOT regexp_matches({_low}, '(^|[^\p{{L}}\p{{N}}_])(table|figure|appendix)\s*\d+')"
on_chunks("flt10_claim_candidate", e.is_claim, f"({_plain_claim})")
query("flt17_drop_reference_chunks", rf"WITH {SQL_CHUNKS} SELECT chunk_id, section FROM chunks WHERE NOT regexp_matches(left(text, 200), '(?i)^\s*\[\d+\]|(^|[^\p{{L}}\p{{N}}_])et\s+al($|[^\p{{L}}\p{{N}}_])|doi:|arxiv:')")(lambda t: chunks(t).filter(~e.is_reference_chunk(F.col("text"))).select("chunk_id", "section"))
on_chunks("flt18_looks_like_reference", e.looks_like_reference, r"(regexp_matches(text, '\[\d+\]\s+[A-Z][a-z]+') OR regexp_matches(text, '(?m)^\s*\d+\.\s+[A-Z][a-z]+.+\(\d{4}\)'))")
on_chunks("flt19_looks_like_noise", e.looks_like_noise, s_any(_low, "example query", "grounding:", "mode:", "sub-questions generated"))
on_chunks("flt20_noise_answer", e.is_noise_answer, "(" + " OR ".join(f"regexp_matches({_low}, '{p}')" for p in e.NOISE_ANSWER) + ")")
_aw = "regexp_extract_all(text, '[a-zA-Z]+')"
_lw = f"list_filter({_aw}, lambda w: length(w) >= 4)"
on_chunks("flt21_noise_chunk", e.is_noise_chunk, f"(trim(text) = '' OR {s_count(_low, *e.NOISE_CHUNK)} >= 2 OR len({_aw}) < 8 OR coalesce(len(list_filter({_lw}, lambda w: regexp_matches(w, '^[A-Z]'))) / CAST(nullif(len({_lw}), 0) AS DOUBLE) > 0.6, false))")
on_questions("flt22_overview_question", e.is_overview_question, s_any(_ql, *e.OVERVIEW))
on_questions("flt23_table_question", e.is_table_question, rf"(regexp_matches(question, '\d') OR {s_any(_ql, *e.TABLE_MARKERS)})")
on_chunks("flt24_resume_like", e.looks_like_resume, f"{s_count(_low, *e.RESUME)} >= 3")
on_chunks("flt26_spaces_ratio", lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / F.greatest(F.length(c), F.lit(1)) > 0.1, "(length(text) - length(replace(text, ' ', ''))) / CAST(greatest(length(text), 1) AS DOUBLE) > 0.1")
on_chunks("hlp04_claims_of_answer", e.claims_of_answer, f"list_slice(list_filter(list_transform({s_sentences('text')}, lambda s: {s_clean_claim('s')}), lambda c: length(c) >= 20), 1, 3)", "list")
query("hlp07_answer_entities", f"WITH {ASCII} SELECT chunk_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9_-]{{2,}}\\b')), lambda w: NOT {s_in('lower(w)', e.ENTITY_STOP)})), '|') AS out FROM ascii")(lambda t: _ascii(t).select("chunk_id", F.array_join(e.answer_entities(F.col("text")), "|").alias("out")))
_neg = "list_has_any(" + s_words("{}") + ", ['no', 'not', 'never', 'without'])"
query("hlp08_negation_conflict", f"WITH {SQL_CHUNKS}, {SQL_QUESTIONS} SELECT chunk_id, {_neg.format('lower(text)')} <> {_neg.format(f'lower(({sql_list(QUESTIONS)})[1 + ordinal % {len(QUESTIONS)}])')} AS conflict FROM chunks")(
    lambda t: chunks(t).select("chunk_id", (F.arrays_overlap(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, ("no", "not", "never", "without")))) != F.arrays_overlap(F.split(F.lower(F.element_at(F.array(*(F.lit(q) for q in QUESTIONS)), (F.pmod("ordinal", F.lit(len(QUESTIONS))) + 1).cast("int"))), r"\s+"), F.array(*map(F.lit, ("no", "not", "never", "without"))))).alias("conflict"))
)
query("src23_source_type", r"SELECT page_id, CASE WHEN regexp_matches(s, '(?i)^https?://') THEN 'url' WHEN regexp_matches(s, '(?i)\.pdf$') THEN 'pdf' WHEN regexp_matches(s, '(?i)\.csv$') THEN 'csv' WHEN regexp_matches(s, '(?i)\.docx$') THEN 'docx' ELSE 'json' END AS kind FROM (SELECT page_id, ([url, 'a.PDF', 'b.csv', 'c.docx', 'd.txt'])[1 + page_id % 5] AS s FROM pages)")(
    lambda t: t("pages").select("page_id", e.source_type(F.element_at(F.array("url", F.lit("a.PDF"), F.lit("b.csv"), F.lit("c.docx"), F.lit("d.txt")), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))).alias("kind"))
)

"""Queries of the text functions (TXT, SET03, SET06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.operators.chunking import split_long
from siltstone.queries.corpus import SQL_CHUNKS, chunks, s_any, s_collapse, s_count, s_clean_claim, s_in, s_parts, s_sentences, s_sentences_tight, s_strip, s_tokens, s_words
from siltstone.queries.registry import query


def on_chunks(name: str, column, sql: str, kind: str | None = None):
    """One output column over every chunk; arrays are joined by a bar, so that values compare as text."""

    def run(t):
        out = column(F.col("text"))
        if kind == "list":
            out = F.array_join(out, "|")
        elif kind == "double":
            out = F.round(out.cast("double"), 6)
        elif kind:
            out = out.cast(kind)
        return chunks(t).select("chunk_id", out.alias("out"))

    shown = {"list": f"array_to_string({sql}, '|')", "double": f"round(CAST({sql} AS DOUBLE), 6)", "long": f"CAST({sql} AS BIGINT)"}.get(kind, sql)
    query(name, f"WITH {SQL_CHUNKS} SELECT chunk_id, {shown} AS out FROM chunks")(run)


_lines = rf"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {s_strip('l')}), lambda l: l <> ''), chr(10)), '[ \t]+', ' ', 'g'))"
query("txt01_normalize_text", f"SELECT doc_id, {_lines} AS out FROM documents")(lambda t: t("documents").select("doc_id", x.normalize_lines(F.col("text")).alias("out")))
query("txt02_normalize_ws", f"SELECT doc_id, {s_collapse('text')} AS out FROM documents")(lambda t: t("documents").select("doc_id", x.collapse(F.col("text")).alias("out")))
_clean = rf"regexp_replace({s_collapse('text')}, '([.!?;:,])([A-Z])', '\1 \2', 'g')"
_clean = s_collapse(rf"regexp_replace({_clean}, '([a-z])([A-Z])', '\1 \2', 'g')")
on_chunks("txt03_clean_line", x.clean_line, _clean)
on_chunks("txt04_clean_claim", x.clean_claim, s_clean_claim("text"))
_extracted = r"translate(text, chr(173) || chr(8203) || chr(65279), '')"
_extracted = rf"regexp_replace({_extracted}, '([a-zA-Z])-\s*\n\s*([a-z])', '\1\2', 'g')"
_extracted = rf"regexp_replace({_extracted}, '\s+', ' ', 'g')"
_extracted = rf"regexp_replace({_extracted}, '([a-z])([A-Z])', '\1 \2', 'g')"
_extracted = rf"trim(regexp_replace({_extracted}, '([.,;:!?])([A-Za-z])', '\1 \2', 'g'))"
query("txt05_clean_extracted", f"SELECT doc_id, {_extracted} AS out FROM documents")(lambda t: t("documents").select("doc_id", x.clean_extracted(F.col("text")).alias("out")))
_pdf = r"replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi')"
_pdf = rf"regexp_replace({_pdf}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
_pdf = rf"translate({_pdf}, chr(8203) || chr(8204) || chr(8205) || chr(65279), '')"
_pdf = s_strip(rf"regexp_replace(regexp_replace({_pdf}, '  +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
query("txt06_clean_pdf", f"SELECT doc_id, {_pdf} AS out FROM documents")(lambda t: t("documents").select("doc_id", x.clean_pdf(F.col("text")).alias("out")))
_n = "CAST(greatest(length(text), 1) AS DOUBLE)"
_spaces = f"((length(text) - length(replace(text, ' ', ''))) / {_n})"
_alpha = rf"(len(regexp_extract_all(text, '\p{{L}}')) / {_n})"
_mean = f"list_sum(list_transform({s_words('text')}, lambda w: length(w))) / CAST(len({s_words('text')}) AS DOUBLE)"
_q1 = f"CASE WHEN len({s_words('text')}) = 0 THEN 0.0 ELSE least(1.0, 0.4 * greatest(0.0, 1.0 - abs({_mean} - 6.0) / 6.0) + 0.3 * least({_spaces} / 0.15, 1.0) + 0.3 * least({_alpha} / 0.65, 1.0)) END"
on_chunks("txt07_quality_by_word_length", x.quality_by_word_length, _q1, "double")
_alphawords = "regexp_extract_all(text, '[A-Za-z]+')"
_mean2 = f"coalesce(list_sum(list_transform({_alphawords}, lambda w: length(w))) / CAST(nullif(len({_alphawords}), 0) AS DOUBLE), 0.0)"
_q2 = f"CASE WHEN length(text) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 0.4 * (1.0 - least(1.0, abs({_spaces} - 0.17) / 0.17)) + 0.35 * least({_alpha} / 0.6, 1.0) + 0.25 * CASE WHEN {_mean2} BETWEEN 3 AND 8 THEN 1.0 WHEN {_mean2} BETWEEN 2 AND 12 THEN 0.6 ELSE 0.2 END)) END"
on_chunks("txt08_quality_by_spacing", x.quality_by_spacing, _q2, "double")
on_chunks("txt09_tokens", x.tokens, s_tokens("text"), "list")
_unicode = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
on_chunks("txt10_index_tokens", x.index_tokens, f"list_filter({_unicode}, lambda w: regexp_full_match(w, '[a-z0-9]+') AND NOT {s_in('w', x.STOPWORDS_BM25)})", "list")
_uniq = f"list_filter({_unicode}, lambda w: NOT {s_in('w', x.STOPWORDS_COLBERT)})"
on_chunks("txt11_unique_words", x.unique_words, f"list_filter({_uniq}, lambda w, i: list_position({_uniq}, w) = i)", "list")
_kw = rf"list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_\-]+'), lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_QUALITY)})"
on_chunks("txt12_keywords", x.keywords, _kw, "list")
on_chunks("txt13_eval_tokens", x.eval_tokens, r"list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_\-]+'), lambda w: length(w) > 2), lambda w: lower(w))", "list")
_judged = f"list_filter(list_transform({s_words('text')}, lambda w: lower(trim(w, '.,;:!?()[]{{}}\"''' ))), lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_CRAG)})"
on_chunks("txt14_judged_tokens", lambda c: F.array_sort(x.judged_tokens(c)), f"list_sort(list_distinct({_judged}))", "list")
on_chunks("txt15_answer_terms", lambda c: F.array_sort(x.answer_terms(c)), f"list_sort(list_distinct(list_filter({s_tokens('text')}, lambda w: length(w) > 2 AND NOT {s_in('w', x.STOPWORDS_ANSWER)})))", "list")
on_chunks("txt16_word_set", lambda c: F.array_sort(x.word_set(c)), f"list_sort(list_distinct({s_words('lower(text)')}))", "list")
on_chunks("txt17_sentences", x.sentences, s_sentences("text"), "list")
on_chunks("txt18_sentences_tight", x.sentences_tight, s_sentences_tight("text"), "list")
on_chunks("txt19_claim_parts", x.claim_parts, s_parts("text"), "list")
on_chunks("txt20_tail_words", lambda c: x.tail_words(c, 12), f"array_to_string(list_slice({s_words('text')}, greatest(len({s_words('text')}) - 11, 1), len({s_words('text')})), ' ')")
_tail = f"list_filter(list_transform(range(1, len({s_words('text')}) + 1), lambda i: array_to_string(list_slice({s_words('text')}, i, len({s_words('text')})), ' ')), lambda s: length(s) <= 40)"
on_chunks("txt21_tail_chars", lambda c: x.tail_chars(c, 40), f"coalesce(list_extract({_tail}, 1), '')")
on_chunks("txt22_split_words", lambda c: x.windows(x.split_words(c), 15, 15), f"list_transform(range(0, len({s_words('text')}), 15), lambda i: array_to_string(list_slice({s_words('text')}, i + 1, i + 15), ' '))", "list")
_long = f"list_filter({s_sentences('text')}, lambda s: len(regexp_extract_all(s, '[A-Za-z]')) >= 20)"
_first = f"coalesce(list_extract(list_filter({_long}, lambda s: regexp_matches(s, '^[A-Z0-9]')), 1), list_extract({_long}, 1), list_extract({s_sentences('text')}, 1))"
on_chunks("txt24_best_sentence", x.best_sentence, f"CASE WHEN len({s_sentences('text')}) = 0 THEN left(regexp_replace({s_collapse('text')}, '^[^A-Za-z0-9]+', ''), 240) ELSE {s_clean_claim(f'left({_first}, 240)')} END")
_keys = ("propose", "develop", "build", "evaluate", "result", "improve", "system", "introduce", "present", "achieve", "show", "demonstrate", "outperform", "state-of-the-art", "novel", "approach", "framework", "method", "model", "train", "fine-tune", "benchmark", "dataset", "experiment", "performance")
_over = f"list_transform({s_sentences('text')}, lambda s, i: {{'k': -({s_count('lower(s)', *_keys)} + 1 - CASE WHEN {s_any('lower(s)', 'copyright', 'conference', 'author', 'email')} THEN 2 ELSE 0 END), 'i': i, 't': {s_clean_claim('s')}}})"
_fit = f"list_filter({_over}, lambda r: length(r.t) >= 40 AND regexp_matches(r.t, '^[A-Z]') AND length(r.t) - length(replace(r.t, ' ', '')) >= 6 AND len(regexp_extract_all(r.t, '[A-Za-z]')) >= 25)"
query("txt25_overview_sentences", f"WITH {SQL_CHUNKS} SELECT chunk_id, array_to_string(list_transform(list_filter(list_slice(list_sort({_fit}), 1, 3), lambda r: r.k < 0), lambda r: {s_clean_claim('r.t')}), '|') AS out FROM chunks")(lambda t: chunks(t).select("chunk_id", F.array_join(x.overview_sentences(F.col("text")), "|").alias("out")))
_piece = f"list_transform(list_filter(list_transform(string_split(text, '. '), lambda p: {s_strip('p')}), lambda p: p <> ''), lambda p: CASE WHEN suffix(p, '.') THEN p ELSE p || '.' END)"
query("txt26_merge_small_parts", f"""WITH RECURSIVE d AS (SELECT doc_id, {_piece} AS u FROM documents), r AS (SELECT doc_id, u, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS done FROM d UNION ALL
 SELECT doc_id, u, i + 1, CASE WHEN i = len(u) OR length({s_strip("held || ' ' || u[i + 1]")}) >= 80 THEN '' ELSE {s_strip("held || ' ' || u[i + 1]")} END, CASE WHEN i = len(u) THEN nullif(held, '') WHEN length({s_strip("held || ' ' || u[i + 1]")}) >= 80 THEN {s_strip("held || ' ' || u[i + 1]")} END FROM r WHERE i <= len(u))
SELECT doc_id, coalesce(string_agg(done, '|' ORDER BY i) FILTER (done IS NOT NULL), '') AS out FROM r GROUP BY 1""")(lambda t: t("documents").select("doc_id", F.array_join(x.merge_small(x.split_keep(F.col("text"), ". ")), "|").alias("out")))
query("txt23_split_long_sentence")(lambda t: chunks(t).select("chunk_id", F.array_join(split_long(F.col("text"), 120, 30), "|").alias("out")))

_pair = f"WITH {SQL_CHUNKS}, n AS (SELECT chunk_id, text, lead(text) OVER (PARTITION BY paper_id ORDER BY ordinal) AS other FROM chunks), s AS (SELECT chunk_id, list_distinct({s_words('lower(text)')}) AS a, list_distinct({s_words('lower(other)')}) AS b FROM n WHERE other IS NOT NULL) "


def _pairs(t):
    from pyspark.sql import Window

    other = F.lead("text").over(Window.partitionBy("paper_id").orderBy("ordinal"))
    return chunks(t).withColumn("other", other).filter("other IS NOT NULL").select("chunk_id", x.word_set(F.col("text")).alias("a"), x.word_set(F.col("other")).alias("b"))


query("set03_overlap", _pair + "SELECT chunk_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared FROM s")(lambda t: _pairs(t).select("chunk_id", x.overlap(F.col("a"), F.col("b")).cast("long").alias("shared")))
_j = "round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 6) AS score FROM s"
query("set06_jaccard", _pair + f"SELECT chunk_id, {_j}")(lambda t: _pairs(t).select("chunk_id", F.round(x.jaccard(F.col("a"), F.col("b")), 6).alias("score")))
query("win12_adjacent_similarity", _pair + f"SELECT chunk_id, {_j}")(lambda t: _pairs(t).select("chunk_id", F.round(x.jaccard(F.col("a"), F.col("b")), 6).alias("score")))
query("set02_ordered_dedupe", f"WITH {SQL_CHUNKS}, w AS (SELECT chunk_id, {s_tokens('text')} AS t FROM chunks) SELECT chunk_id, array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i), '|') AS out FROM w")(lambda t: chunks(t).select("chunk_id", F.array_join(F.array_distinct(x.tokens(F.col("text"))), "|").alias("out")))

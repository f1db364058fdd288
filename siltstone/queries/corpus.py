"""Entities of the engine derived from the driver's tables, in Spark and (for the oracle) in DuckDB SQL.

papers: one for each document. chunks: the lines of a document, each with a synthetic statement, so that every rule of
the engine has something to act on. questions: one for each benchmark item, with a synthetic beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATEMENTS = (
    "We propose the HyperNet encoder, which outperforms ResNet on CIFAR10 by 3.4% and uses 92.1% fewer parameters than before.",
    "The method is not robust: it fails in Table 3 and Figure 2 when noise is high.",
    "Attention refers to a weighting of all tokens that the GPT-4 and BERT-large models learn during training on the benchmark dataset.",
    "We plan future work that might extend this evaluation to other corpora and metrics.",
    "[12] Vaswani et al. (2017) doi:10.1234/abc.DEF presented at NeurIPS 2017, copyright 2018, all rights reserved.",
    "See (Vaswani et al. 2017) and [3] for the loss $E = mc^2$ used here, compared to the baseline of 41.5 points.",
    "Write to jane.doe@example.org or call 555-123-4567; the id is 123-45-6789.",
    "Example Query 2: Mode: Multi-Hop. Confidence: High. Grounding: Verified after 12 seconds.",
    "The experience and skills in projects, education and Python are never described without numbers.",
    "Therefore our approach always improves accuracy, but it cannot be applied to small data.Next step:Train more models.",
    "",
)
SECTIONS = ("abstract", "introduction", "related_work", "method", "experiments", "results", "conclusion", "references", "table")
QUESTIONS = (
    "Compare the accuracy of HyperNet and ResNet versus the baseline, and then explain why?",
    "What is the main idea of this paper",
    "How to train the model, and what dataset and benchmark does the evaluation use?",
    "Which limitations and future work does table 3 show for the ablation component?",
    "Why does attention never cause degradation without noise?",
    "Give a survey of the evolution of retrieval over time; list the method architecture",
    "Summarize the key findings",
    "Is it ok",
)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index}) % {len(values)}]"


def papers(t) -> DataFrame:
    """paper_id, title, source_path, checksum, page_count, created_at, updated_at."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    d = t("documents")
    return d.select(
        F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("paper_id"), "doc_id",
        F.substring(F.split("text", "\n")[0], 1, 60).alias("title"), F.col("source").alias("source_path"), F.sha2("text", 256).alias("checksum"),
        (F.size(F.split("text", "\n"))).cast("long").alias("page_count"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("created_at"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.col("doc_id") * 7919, F.lit(5000)).cast("int"))).alias("updated_at"),
    )


SQL_PAPERS = """papers AS (
  SELECT 'p' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS paper_id, doc_id, left(string_split(text, chr(10))[1], 60) AS title, source AS source_path,
    sha256(text) AS checksum, CAST(len(string_split(text, chr(10))) AS BIGINT) AS page_count,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 5000 AS INTEGER)) AS updated_at
  FROM documents)"""


def chunks(t) -> DataFrame:
    """chunk_id, paper_id, doc_id, page_number, section, ordinal, text, content_type."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    ordinal = F.col("ordinal").cast("long")
    text = F.trim(F.concat(F.col("line"), F.lit(" "), pick(STATEMENTS, F.col("doc_id") + ordinal)))
    section = pick(SECTIONS, F.col("doc_id") + ordinal * 5)
    paper = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return lines.select(
        F.sha1(F.concat_ws(":", paper, ordinal.cast("string"), text)).alias("chunk_id"), paper.alias("paper_id"), "doc_id", (F.floor(ordinal / 10) + 1).alias("page_number"),
        section.alias("section"), ordinal.alias("ordinal"), text.alias("text"), F.when(section == "table", "table").otherwise("text").alias("content_type"),
    )


SQL_CHUNKS = f"""lines AS (
  SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents
), chunks0 AS (
  SELECT doc_id, ordinal, 'p' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS paper_id, trim(line || ' ' || {sql_pick(STATEMENTS, "doc_id + ordinal")}) AS text,
    {sql_pick(SECTIONS, "doc_id + ordinal * 5")} AS section FROM lines
), chunks AS (
  SELECT sha1(paper_id || ':' || ordinal || ':' || text) AS chunk_id, paper_id, doc_id, CAST(ordinal // 10 + 1 AS BIGINT) AS page_number, section, ordinal, text,
    CASE WHEN section = 'table' THEN 'table' ELSE 'text' END AS content_type FROM chunks0)"""


def questions(t) -> DataFrame:
    """query_id, question."""
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.concat(pick(QUESTIONS, F.col("item_id")), F.lit(" "), F.col("text")).alias("question"), pick(QUESTIONS, F.col("item_id")).alias("short"))


SQL_QUESTIONS = f"questions AS (SELECT item_id AS query_id, {sql_pick(QUESTIONS, 'item_id')} || ' ' || text AS question, {sql_pick(QUESTIONS, 'item_id')} AS short FROM benchmark)"


def hits(t) -> DataFrame:
    """query_id, list, chunk_id, doc_id, score: ranked lists made of events (each chunk once a list)."""
    return (
        t("events").groupBy(F.pmod("user_id", F.lit(200)).alias("query_id"), F.col("event_type").alias("list"), F.pmod("event_id", F.lit(40)).alias("chunk"))
        .agg(F.round(F.max("value"), 6).alias("score"))
        .select("query_id", "list", F.concat(F.lit("c"), F.lpad(F.col("chunk").cast("string"), 2, "0")).alias("chunk_id"), F.concat(F.lit("d"), F.pmod("chunk", F.lit(9)).cast("string")).alias("doc_id"), "score")
    )


SQL_HITS = """hits AS (
  SELECT user_id % 200 AS query_id, event_type AS list, 'c' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') AS chunk_id, 'd' || CAST((event_id % 40) % 9 AS VARCHAR) AS doc_id, round(max(value), 6) AS score
  FROM events GROUP BY 1, 2, 3, 4)"""


# DuckDB counterparts of the text functions.
def s_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def s_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9]+')"


def s_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w_: w_ <> '')"


def s_sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s_: {s_strip('s_')}), lambda s_: s_ <> '')"


def s_sentences_tight(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s_: {s_strip('s_')}), lambda s_: s_ <> '')"


def s_parts(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]'), lambda s_: {s_strip('s_')}), lambda s_: s_ <> '')"


def s_clean_claim(x: str) -> str:
    out = s_collapse(x)
    out = rf"regexp_replace({out}, '\[SECTION:[^\]]*\]', '', 'g')"
    out = rf"regexp_replace({out}, '>>>+\s*', '', 'g')"
    out = rf"regexp_replace({out}, '^[^A-Za-z0-9]+', '')"
    out = rf"translate({out}, '●•', '')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'), ' -' || chr(9))"


def s_any(x: str, *needles: str) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, n.replace("'", "''")) for n in needles) + ")"


def s_count(x: str, *needles: str) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INTEGER)".format(x, n.replace("'", "''")) for n in needles) + ")"


def s_in(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(f"'{v}'" for v in values) + ")"

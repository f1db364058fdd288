"""Chunkers. The packers fold a document's units in order inside one expression; state never leaves the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.functions.extract import claim_confidence, claim_entities, claim_type, is_claim, section_heading

STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(STRINGS)


def pack_words(units: Column, size: int, overlap: int) -> Column:
    """Units packed to at most ``size`` words; a chunk starts with the last words of the one before if that still fits."""

    def step(s: Column, unit: Column) -> Column:
        n = F.size(x.split_words(unit))
        full = (s["text"] != "") & (s["n"] + n > size)
        seed = x.tail_words(s["text"], overlap) if overlap else F.lit("")
        k = F.least(s["n"], F.lit(overlap))
        fits = full & (k + n <= size) & (k > 0)
        text = F.when(full, F.when(fits, F.concat(seed, F.lit(" "), unit)).otherwise(unit)).otherwise(F.trim(F.concat(s["text"], F.lit(" "), unit)))
        count = F.when(full, F.when(fits, k + n).otherwise(n)).otherwise(s["n"] + n)
        return F.struct(text.alias("text"), count.alias("n"), F.when(full, F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), none().alias("out"))
    return F.aggregate(units, zero, step, lambda s: F.when(s["text"] != "", F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"]))


def sentence_units(text: Column, size: int) -> Column:
    """Sentences, those longer than ``size`` words cut into windows."""
    return F.flatten(F.transform(x.sentences(text), lambda s: x.windows(x.split_words(s), size, size)))


def chunk_by_words(pages: DataFrame, size: int = 220, overlap: int = 40) -> DataFrame:
    """document_id, page_number, ordinal, text, token_count, chunk_id from (document_id, page_number, text); never across pages."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    packed = pages.select("document_id", "page_number", F.posexplode(pack_words(sentence_units(x.normalize_lines(F.col("text")), size), size, overlap)).alias("at", "text"))
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at")) - 1
    rows = packed.withColumn("ordinal", ordinal.cast("long")).withColumn("token_count", F.size(x.split_words(F.col("text"))).cast("long"))
    return rows.select("document_id", "page_number", "ordinal", "text", "token_count", F.sha1(F.concat_ws(":", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("ordinal").cast("string"), "text")).alias("chunk_id"))


def split_long(sentence: Column, chars: int, overlap: int) -> Column:
    """Words packed to at most ``chars`` characters, each part seeded with the last words of the one before."""

    def step(s: Column, w: Column) -> Column:
        joined = F.trim(F.concat(s["text"], F.lit(" "), w))
        fits = F.length(joined) <= chars
        seeded = F.trim(F.concat(x.tail_chars(s["text"], overlap), F.lit(" "), w))
        return F.struct(F.when(fits, joined).otherwise(F.when(s["text"] == "", w).otherwise(seeded)).alias("text"), F.when(fits | (s["text"] == ""), s["out"]).otherwise(F.concat(s["out"], F.array(s["text"]))).alias("out"))

    zero = F.struct(F.lit("").alias("text"), none().alias("out"))
    return F.aggregate(x.split_words(sentence), zero, step, lambda s: F.when(s["text"] != "", F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"]))


def pack_chars(sentences: Column, chars: int, overlap: int) -> Column:
    """Sentences packed to at most ``chars`` characters; longer ones are split; overlap by a budget of characters."""

    def step(s: Column, sentence: Column) -> Column:
        long = F.length(sentence) > chars
        joined = F.when(s["text"] == "", sentence).otherwise(F.concat(s["text"], F.lit(" "), sentence))
        fits = F.length(joined) <= chars
        flushed = F.when(s["text"] != "", F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"])
        seeded = F.trim(F.concat(x.tail_chars(s["text"], overlap), F.lit(" "), sentence))
        text = F.when(long, F.lit("")).when(fits, joined).otherwise(seeded)
        out = F.when(long, F.concat(flushed, split_long(sentence, chars, overlap))).when(fits, s["out"]).otherwise(flushed)
        return F.struct(text.alias("text"), out.alias("out"))

    zero = F.struct(F.lit("").alias("text"), none().alias("out"))
    return F.aggregate(sentences, zero, step, lambda s: F.when(s["text"] != "", F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"]))


def chunk_by_sections(pages: DataFrame, chars: int = 600, overlap: int = 80) -> DataFrame:
    """paper_id, page_number, section, ordinal, text, char_count, chunk_id from (paper_id, page_number, text).

    Lines join into blocks between blank lines and headings. All chunks of a page get the section that holds at its end.
    """
    lines = pages.select("paper_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line", x.clean_line(F.col("raw")))
    marked = lines.withColumn("head", F.when(F.col("line") != "", section_heading(F.col("line"))))
    order = Window.partitionBy("paper_id").orderBy("page_number", "line_no")
    page = Window.partitionBy("paper_id", "page_number").orderBy("line_no")
    stop = (F.col("line") == "") | F.col("head").isNotNull()
    marked = marked.withColumn("section", F.coalesce(F.last("head", True).over(order), F.lit("body"))).withColumn("block", F.sum(stop.cast("int")).over(page)).withColumn("stop", stop)
    blocks = marked.filter("NOT stop").groupBy("paper_id", "page_number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ").alias("text"))
    sentences = blocks.groupBy("paper_id", "page_number").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: x.sentences_tight(b["text"]))).alias("sentences"))
    last = marked.groupBy("paper_id", "page_number").agg(F.max_by("section", "line_no").alias("section"))
    packed = sentences.join(last, ["paper_id", "page_number"]).select("paper_id", "page_number", "section", F.posexplode(pack_chars(F.col("sentences"), chars, overlap)).alias("at", "text")).filter("trim(text) <> ''")
    rows = packed.withColumn("ordinal", (F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "at")) - 1).cast("long"))
    return rows.select("paper_id", "page_number", "section", "ordinal", "text", F.length("text").cast("long").alias("char_count"), F.sha1(F.concat_ws(":", "paper_id", F.col("page_number").cast("string"), "section", F.col("ordinal").cast("string"), "text")).alias("chunk_id"))


def recursive_parts(text: Column, size: int = 512) -> Column:
    """Parts longer than ``size`` split by paragraph, line, sentence and word; small neighbours merged."""

    def split(splitter: str):
        return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(x.split_keep(p, splitter))

    parts = F.array(text)
    for splitter in ("\n\n", "\n", ". ", " "):
        parts = F.flatten(F.transform(parts, split(splitter)))
    return x.merge_small(parts)


def semantic_parts(text: Column, threshold: float = 0.7, least: int = 100) -> Column:
    """Sentences joined until the next one is unlike the last and the part has ``least`` characters; small parts merged."""
    units = F.split(text, r"(?<=[.!?])\s+")

    def words(s: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))

    def step(s: Column, unit: Column) -> Column:
        def go(own: Column, cut: Column) -> Column:
            return F.struct(F.when(cut | (s["text"] == ""), unit).otherwise(F.concat(s["text"], F.lit(" "), unit)).alias("text"), own.alias("last"), F.when(cut, F.concat(s["out"], F.array(s["text"]))).otherwise(s["out"]).alias("out"))

        # words and the comparison are each bound once, and nothing is compared in a part that is too short to be cut
        return x.let(words(unit), lambda own: x.let((s["text"] != "") & (F.length(s["text"]) >= least) & (x.jaccard(s["last"], own) < threshold), lambda cut: go(own, cut)))

    zero = F.struct(F.lit("").alias("text"), none().alias("last"), none().alias("out"))
    return x.merge_small(F.aggregate(units, zero, step, lambda s: F.concat(s["out"], F.array(s["text"]))), least)


def sliding_parts(text: Column, size: int = 512, overlap: int = 64) -> Column:
    window = max(16, size)
    return x.windows(x.split_words(text), window, max(8, window - overlap))


def chunk_sections(documents: DataFrame, strategy: str = "section", size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, section, chunk_index, total_chunks, char_start, char_end, is_caption, text, chunk_id.

    ``documents`` has doc_id, raw_text, sections (array of name, text, page_start, page_end) and captions (array of strings).
    """
    if strategy == "section":
        wide = F.lower("s.name").rlike("method|result|discussion|experiment")
        sections = documents.select("doc_id", F.posexplode(F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.array(F.struct(F.lit("Document").alias("name"), F.col("raw_text").alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))))).alias("at", "s"))
        parts = sections.select("doc_id", "at", F.col("s.name").alias("section"), F.when(wide, recursive_parts(F.col("s.text"), size)).otherwise(F.array("s.text")).alias("parts"), F.lit(False).alias("is_caption"))
        captions = documents.select("doc_id", F.posexplode("captions").alias("at", "c")).select("doc_id", (F.col("at") + 1_000_000).alias("at"), F.lit("Figure Caption").alias("section"), F.array("c").alias("parts"), F.lit(True).alias("is_caption"))
        parts = parts.unionByName(captions)
    else:
        column = {"recursive": lambda c: recursive_parts(c, size), "semantic": semantic_parts, "sliding": lambda c: sliding_parts(c, size, overlap)}[strategy](F.col("raw_text"))
        parts = documents.select("doc_id", F.lit(0).alias("at"), F.lit("Document").alias("section"), column.alias("parts"), F.lit(False).alias("is_caption"))
    # of an outer explode Spark infers no filter on the size of ``parts``, for which it would make them a second time
    rows = parts.select("doc_id", "at", "section", "is_caption", F.posexplode_outer("parts").alias("i", "raw")).filter(F.col("raw").rlike(r"\S")).withColumn("text", x.strip(F.col("raw")))
    group = Window.partitionBy("doc_id", "at").orderBy("i")
    order = Window.partitionBy("doc_id").orderBy("at", "i")
    start = F.sum(F.length("text") + 1).over(group) - F.length("text") - 1
    return rows.select(
        "doc_id", "section", (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total_chunks"),
        start.alias("char_start"), (start + F.length("text")).alias("char_end"), "is_caption", "text", F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("at").cast("string"), F.col("i").cast("string"), "text")).alias("chunk_id"),
    )


STRATEGIES = ("section", "recursive", "semantic", "sliding")


def chunk_dispatch(documents: DataFrame, strategy: str = "strategy", size: int = 512, overlap: int = 64) -> DataFrame:
    """The chunks of ``chunk_sections``, every document by the strategy that its own column names; by section where that is null or unknown."""
    known = F.when(F.col(strategy).isin(*STRATEGIES), F.col(strategy)).otherwise(F.lit(STRATEGIES[0]))
    marked = documents.withColumn("_strategy", known)
    out = None
    for name in STRATEGIES:
        own = chunk_sections(marked.filter(F.col("_strategy") == name), name, size, overlap).withColumn("strategy", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def extract_claims(chunks: DataFrame) -> DataFrame:
    """claim_id, paper_id, chunk_id, claim, claim_type, section, page_number, entities, confidence of every claim-like sentence."""
    s = chunks.select("paper_id", "chunk_id", "section", "page_number", F.posexplode(x.sentences(F.col("text"))).alias("i", "claim")).filter(is_claim(F.col("claim")))
    kind = claim_type(F.col("claim"), F.col("section"))
    return s.select(F.sha1(F.concat_ws(":", "chunk_id", F.col("i").cast("string"), "claim")).alias("claim_id"), "paper_id", "chunk_id", "claim", kind.alias("claim_type"), "section", "page_number", claim_entities(F.col("claim")).alias("entities"), claim_confidence(F.col("claim"), kind).alias("confidence"))

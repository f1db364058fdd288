"""Text functions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the tokenizers (fixed values).
STOPWORDS_BM25 = ("a", "an", "the", "and", "or", "to", "of", "in", "for", "on", "is", "are", "was", "were", "be", "with", "as", "by", "at")
STOPWORDS_COLBERT = ("the", "a", "an", "of", "to", "in", "and", "or", "for", "on", "is", "are")
STOPWORDS_QUALITY = ("the", "is", "are", "a", "an", "of", "in", "on", "to", "for", "what", "how", "why", "does", "do")
STOPWORDS_CRAG = ("a", "an", "the", "of", "to", "in", "on", "for", "with", "and", "or", "is", "are", "was", "were", "be", "that", "this")
STOPWORDS_ANSWER = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "what", "when", "where", "which", "who", "why", "with")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def has_any(text: Column, *needles: str) -> Column:
    """Whether any of the strings occurs in ``text``."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def count_any(text: Column, *needles: str) -> Column:
    """How many of the strings occur in ``text``."""
    return sum((text.contains(n).cast("int") for n in needles), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_lines(text: Column) -> Column:
    """Lines stripped, blank ones dropped, runs of blanks and tabs made one."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "))


def clean_line(text: Column) -> Column:
    """White space collapsed; spaces restored after punctuation before a capital and between aA."""
    out = F.regexp_replace(collapse(text), r"([.!?;:,])([A-Z])", "$1 $2")
    return collapse(F.regexp_replace(out, r"([a-z])([A-Z])", "$1 $2"))


def clean_claim(text: Column) -> Column:
    """Markers, leading junk and bullets removed."""
    out = collapse(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"\[SECTION:[^\]]*\]", "")
    out = F.regexp_replace(out, r">>>+\s*", "")
    out = F.regexp_replace(out, r"^[^A-Za-z0-9]+", "")
    out = F.translate(out, "●•", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -\t"))


def clean_extracted(text: Column) -> Column:
    """Artifacts of extracted text repaired (for text that is already in normal form KC)."""
    out = F.translate(text, "\u00ad\u200b\ufeff", "")
    out = F.regexp_replace(out, r"([a-zA-Z])-\s*\n\s*([a-z])", "$1$2")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(out, r"([.,;:!?])([A-Za-z])", "$1 $2"))


def clean_pdf(text: Column) -> Column:
    """Ligatures, hyphens at line ends, zero-width characters, double spaces and extra line feeds repaired."""
    out = F.coalesce(text, F.lit(""))
    for ligature, plain in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi")):
        out = F.replace(out, F.lit(ligature), F.lit(plain))
    out = F.regexp_replace(out, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    out = F.translate(out, "\u200b\u200c\u200d\ufeff", "")
    out = F.regexp_replace(F.regexp_replace(out, "  +", " "), r"\n{3,}", "\n\n")
    return strip(out)


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def split_words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def quality_by_word_length(text: Column) -> Column:
    """Extraction quality from word length, spaces and letters (0..1)."""

    def score(words: Column) -> Column:
        n = F.greatest(F.length(text), F.lit(1)).cast("double")
        mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w)) / F.size(words)
        spaces = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / n
        shape = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(mean - 6.0) / 6.0) * 0.4
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shape + F.least(spaces / 0.15, F.lit(1.0)) * 0.3 + F.least(letters(text) / n / 0.65, F.lit(1.0)) * 0.3))

    return let(split_words(text), score)


def quality_by_spacing(text: Column) -> Column:
    """Extraction quality from the share of spaces, of letters and the mean word (0..1)."""

    def score(words: Column) -> Column:
        n = F.greatest(F.length(text), F.lit(1)).cast("double")
        mean = F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w)) / F.size(words))
        spaces = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / n
        space = F.lit(1.0) - F.least(F.lit(1.0), F.abs(spaces - 0.17) / 0.17)
        word = F.when((mean >= 3) & (mean <= 8), 1.0).when((mean >= 2) & (mean <= 12), 0.6).otherwise(0.2)
        return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), space * 0.4 + F.least(letters(text) / n / 0.6, F.lit(1.0)) * 0.35 + word * 0.25)))

    return let(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), score)


def tokens(text: Column) -> Column:
    """ASCII letters and digits, lower-cased, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))


def without(words: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def index_tokens(text: Column) -> Column:
    """Whole words of ASCII letters and digits, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return without(F.filter(words, lambda w: w.rlike("^[a-z0-9]+$")), STOPWORDS_BM25)


def unique_words(text: Column) -> Column:
    """Distinct words of any letters, in order, without stop words."""
    return F.array_distinct(without(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), STOPWORDS_COLBERT))


def keywords(text: Column) -> Column:
    return F.filter(without(F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0)), STOPWORDS_QUALITY), lambda w: F.length(w) > 2)


def eval_tokens(text: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0)), lambda w: F.length(w) > 2), F.lower)


def judged_tokens(text: Column) -> Column:
    """Words without punctuation around them, longer than two, without stop words, distinct."""
    words = F.transform(split_words(text), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()[]{}\"'"))))
    return F.array_distinct(without(F.filter(words, lambda w: F.length(w) > 2), STOPWORDS_CRAG))


def answer_terms(text: Column) -> Column:
    return F.array_distinct(without(F.filter(tokens(text), lambda w: F.length(w) > 2), STOPWORDS_ANSWER))


def word_set(text: Column) -> Column:
    return F.array_distinct(split_words(F.lower(text)))


def sentences(text: Column) -> Column:
    """Sentences, split after . ! ? before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def sentences_tight(text: Column) -> Column:
    """Sentences, split after every . ! ? even without white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s*"), strip), lambda s: s != "")


def claim_parts(text: Column) -> Column:
    """Parts between . ! ?, which are dropped."""
    return F.filter(F.transform(F.split(text, "[.!?]"), strip), lambda s: s != "")


def tail_words(text: Column, n: int) -> Column:
    """The last ``n`` words."""
    return let(split_words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " "))


def tail_chars(text: Column, budget: int) -> Column:
    """As many last words as fit a number of characters."""

    def step(s: Column, w: Column) -> Column:
        more = F.length(w) + F.when(s["n"] > 0, 1).otherwise(0)
        fits = s["go"] & (s["n"] + more <= budget)
        return F.struct(F.when(fits, s["n"] + more).otherwise(s["n"]).alias("n"), fits.alias("go"), F.when(fits, F.concat(F.array(w), s["out"])).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.reverse(split_words(text)), zero, step, lambda s: s["out"]), " ")


def windows(words: Column, size: int, step: int) -> Column:
    """Word windows of ``size`` that start every ``step`` words."""
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " ")))


def best_sentence(text: Column) -> Column:
    """First sentence that starts like one and has 20 letters, else any with 20, else the first; cleaned, 240 characters."""

    def pick(s: Column) -> Column:
        long = F.filter(s, lambda x: F.regexp_count(x, F.lit("[A-Za-z]")) >= 20)
        good = F.filter(long, lambda x: x.rlike("^[A-Z0-9]"))
        first = F.coalesce(F.get(good, F.lit(0)), F.get(long, F.lit(0)), F.get(s, F.lit(0)))
        bare = F.substring(F.regexp_replace(collapse(text), "^[^A-Za-z0-9]+", ""), 1, 240)
        return F.when(F.size(s) == 0, bare).otherwise(clean_claim(F.substring(first, 1, 240)))

    return let(sentences(text), pick)


def overview_sentences(text: Column) -> Column:
    """The three best scored sentences of an overview."""
    keys = ("propose", "develop", "build", "evaluate", "result", "improve", "system", "introduce", "present", "achieve", "show", "demonstrate", "outperform", "state-of-the-art", "novel", "approach", "framework", "method", "model", "train", "fine-tune", "benchmark", "dataset", "experiment", "performance")

    def scored(s: Column, i: Column) -> Column:
        low = F.lower(s)
        score = count_any(low, *keys) + 1 - F.when(has_any(low, "copyright", "conference", "author", "email"), 2).otherwise(0)
        return F.struct((-score).alias("key"), i.alias("i"), clean_claim(s).alias("t"))

    rows = F.transform(sentences(text), scored)
    kept = F.filter(rows, lambda r: (F.length(r["t"]) >= 40) & r["t"].rlike("^[A-Z]") & (F.length(r["t"]) - F.length(F.replace(r["t"], F.lit(" "), F.lit(""))) >= 6) & (F.regexp_count(r["t"], F.lit("[A-Za-z]")) >= 25))
    return F.transform(F.filter(F.slice(F.array_sort(kept), 1, 3), lambda r: r["key"] < 0), lambda r: clean_claim(r["t"]))


def split_keep(text: Column, splitter: str) -> Column:
    """Parts between a splitter; sentence parts keep their full stop."""
    if splitter == " ":
        return F.split(text, " ")
    if splitter == ". ":
        parts = F.filter(F.transform(F.split(text, r"\. "), strip), lambda p: p != "")
        return F.transform(parts, lambda p: F.when(p.endswith("."), p).otherwise(F.concat(p, F.lit("."))))
    return F.filter(F.split(text, splitter), lambda p: p != "")


def merge_small(parts: Column, least: int = 80) -> Column:
    """Neighbouring parts joined until they have ``least`` characters."""
    zero = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        def go(c: Column) -> Column:
            small = F.length(c) < least
            return F.struct(F.when(small, c).otherwise(F.lit("")).alias("held"), F.when(small, s["out"]).otherwise(F.concat(s["out"], F.array(c))).alias("out"))

        return let(strip(F.concat(s["held"], F.lit(" "), p)), go)

    return F.aggregate(parts, zero, step, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)).cast("double")

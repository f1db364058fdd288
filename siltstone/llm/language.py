"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cut into words (runs of
letters, lower-cased), each framed by spaces, and every word is spelled by greedy longest matches (phrases) against each automaton. The language
whose automaton needs the fewest phrases, times the logarithm of its sample's size and per character, wins.

The model is fitted on every labelled language, each with at most ``SAMPLE_CHARS`` characters, and an equal share of
``TOTAL_CHARS`` where there are more than 64 of them. About 2 * ``SAMPLE_DOCS`` documents a language are drawn by a hash of id and
text; long texts give windows spread over their length. Every whole text is then predicted.

Defined results: null text and text without a letter give ``und`` and score 0; where nothing could be learned all
texts do; ties go to the language that sorts first; repeated rows are kept, but teach once; null ids are never held out, so their
rows teach as others do (rows without lang never do); other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.automata import SuffixAutomaton
from siltstone.llm.common import table

SAMPLE_DOCS, SAMPLE_CHARS = 96, 60_000
#: Characters of all languages together; windows of a long text, at most.
TOTAL_CHARS, WINDOWS = 64 * SAMPLE_CHARS, 5
#: Words remembered by a worker, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
_LANE = 40
_letters = re.compile(r"[^\W\d_]+")
#: Words that the cuts of a window may have broken.
_first_word, _last_word = re.compile(r"^\S+\s"), re.compile(r"\s\S+$")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spread(width: int) -> Column:
    """The whole text where it has at most so many characters; else as many in windows spread evenly over it."""
    n = max(1, min(WINDOWS, width // 200))
    part = max(1, width // n)
    windows = F.array(*(F.substring("text", F.floor((F.length("text") - part) * (i + 0.5) / n).cast("int") + 1, F.lit(part)) for i in range(n)))
    return F.when(F.length("text") <= width, F.array("text")).otherwise(windows)


def _joined(windows: list[str]) -> str:
    """The windows without the words that their cuts broke."""
    return " ".join(_last_word.sub("", _first_word.sub("", w)) for w in windows) if len(windows) > 1 else windows[0]


def sample(docs: DataFrame) -> dict[str, str]:
    """Text per language from training rows only, of a size that does not grow with the table."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    wide = 1 << 20
    chars = max(1, min(SAMPLE_CHARS, TOTAL_CHARS // len(counts)))
    drawn = min(SAMPLE_DOCS, max(8, chars * SAMPLE_DOCS // SAMPLE_CHARS))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(wide, -(-wide * 2 * drawn // r["count"]))) for r in counts], "lang string, _siltstone_share long")
    draw = F.xxhash64("doc_id", "text")
    rows = known.select("lang", "doc_id", "text").join(F.broadcast(shares), "lang").filter(F.pmod(draw, F.lit(wide)) < F.col("_siltstone_share"))  # a row a language
    rows = rows.select("lang", "doc_id", draw.alias("draw"), _spread(2 * chars // drawn).alias("windows")).dropDuplicates(["lang", "doc_id", "draw"])
    texts: dict[str, list] = {}
    for r in rows.collect():
        texts.setdefault(r["lang"], []).append((r["draw"], _joined(r["windows"])))
    return {lang: " ".join(_letters.findall(" ".join(t for _, t in sorted(own)).lower()))[:chars] for lang, own in texts.items()}


class Model(dict):
    """Phrase counts of all languages, packed into one integer per word; as a dictionary, a bounded cache of words."""

    def __init__(self, texts: dict[str, str]):
        super().__init__()
        self.languages = sorted(lang for lang, t in texts.items() if t)
        self.automata = [SuffixAutomaton(f" {texts[lang]} ") for lang in self.languages]
        self.weights = [math.log2(len(texts[lang]) + 2) for lang in self.languages]

    def __missing__(self, word: str) -> int:
        framed = f" {word} "
        packed = sum(a.phrases(framed) << (_LANE * i) for i, a in enumerate(self.automata))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def entropies(self, text: str) -> list[float]:
        """Bits per character of the cross-parse by each language."""
        words = _letters.findall(text.lower())
        total = sum(map(self.__getitem__, words))
        chars = sum(map(len, words)) + len(words) or 1
        return [((total >> (_LANE * i)) & ((1 << _LANE) - 1)) * w / chars for i, w in enumerate(self.weights)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _letters.search(text):
            return "und", 0.0
        ranked = sorted(zip(self.entropies(text), self.languages, strict=True))
        second = ranked[1][0] if len(ranked) > 1 else math.inf
        return ranked[0][1], 1.0 if second == math.inf else second / ((ranked[0][0] + second) or 1.0)


@functools.lru_cache(maxsize=2)
def _model(texts: tuple) -> Model:
    return Model(dict(texts))


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))  # at most TOTAL_CHARS characters
    kind = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, sample(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

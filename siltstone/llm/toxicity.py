"""Toxicity scores behind a noisy channel.

Words written in leetspeak, with repeated or spaced-out characters, are lattices of possible letters. A Viterbi search
under a character language model (trigrams counted over all documents) finds the likeliest spelling; the score is then
a logistic model on the words and word beginnings of the restored text. Plain words stay beside the restored ones. Words
of any length are restored; only those without a single letter ("455") are taken for numbers.

The classifier is fitted on at most about ``TRAIN_DOCS`` labelled documents, drawn by a hash of the id; counts of the
language model cover every document. Labels of held-out rows (crc32 of the id as text modulo 5 is 0) are never read.

Defined results: null and empty texts score the model's base rate; where no label can be learned from every score is 0;
repeated rows are kept; labels of one id count as one (1 if any is), and of several texts with that id one teaches; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import forget, table, written
from siltstone.llm.language import held_out

TRAIN_DOCS, MOST_FEATURES = 6000, 3000
#: A feature needs so many documents of label 1 and so large a log ratio; RIDGE is the penalty of its weight.
LEAST_DOCS, LEAST_PULL, RIDGE = 4, 2.0, 0.3
#: Words remembered by a worker, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: What a character may stand for (fixed values): letter and cost in nats.
LEET = {"0": (("o", 1.0),), "1": (("i", 1.0), ("l", 1.2)), "2": (("z", 2.0),), "3": (("e", 1.0),), "4": (("a", 1.0),), "5": (("s", 1.0),), "6": (("g", 2.0),), "7": (("t", 1.0),), "8": (("b", 1.5),), "9": (("g", 1.5),), "@": (("a", 0.7),), "$": (("s", 0.7),), "!": (("i", 0.9),), "|": (("i", 1.2), ("l", 1.2)), "+": (("t", 1.2),), "(": (("c", 1.5),), "€": (("e", 1.0),)}
#: Characters that may be dropped between letters.
FILLERS = frozenset(".-*_~'")
DROP, KEEP_RUN = 0.7, 3.0

_symbols = re.escape("".join(c for c in LEET if not c.isdigit()))
_clean = re.compile(r"[^\W\d_]+")
_any, _blur, _stand = rf"[\w{_symbols}.*~'-]", rf"[\d{_symbols}.*~'_-]", rf"[\d{_symbols}]"
_letter = r"[^\W\d_]"
#: A word with something odd inside: a stand-in beside a letter, a filler between letters, or a letter three times in a row.
_odd = re.compile(rf"(?<!{_any})(?:{_any}*(?:{_letter}(?:{_blur}+(?={_letter})|[.*~'_-]*{_stand})|({_letter})\1\1)|[.*~'_-]*{_stand}{_blur}*(?={_letter})){_any}*")
#: Single characters spaced out.
_single = rf"(?:[^\W_]|[{_symbols}])"
_spaced = re.compile(rf"(?<!\w)(?:{_single}[ .*_-]{{1,2}}){{3,}}{_single}(?!\w)")


def _kind(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c in ("", " ") else 27


_GAP = [("", 0, 0.0), (" ", 0, 0.0)]


def codes(text: str) -> np.ndarray:
    """Bytes of lower-cased text as classes: 1-26 letters, 27 other non-ASCII, 0 the rest."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.where((raw >= 97) & (raw <= 122), raw - 96, 0).astype(np.int64)
    out[raw >= 128] = 27
    return out


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """How often each trigram of classes occurs over all documents (28^3 counts)."""
    kind = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(28**3, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                c = codes(f" {text.as_py() or ''} ")
                for at in range(0, len(c), 1 << 20):
                    part = c[at : at + (1 << 20) + 2]
                    total += np.bincount(part[:-2] * 784 + part[1:-1] * 28 + part[2:], minlength=28**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=kind)

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(28**3, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


class Channel:
    """Restores the likeliest letters of an odd word; words of the lexicon are looked for in spaced-out phrases."""

    def __init__(self, trigrams: np.ndarray, lexicon: Iterable[str] = ()):
        n = trigrams.reshape(28, 28, 28).astype(float)
        self.cost = (-np.log((n + 0.05) / (n + 0.05).sum(2, keepdims=True))).tolist()
        self.lexicon = frozenset(w for w in lexicon if len(w) >= 4)
        self.longest = max(map(len, self.lexicon), default=0)
        self.cache: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """Candidates of each position; '' drops the character."""
        steps: list[list[tuple[str, float]]] = []
        at = 0
        while at < len(word):
            c = word[at]
            run = at
            while run < len(word) and word[run] == c:
                run += 1
            n = run - at
            if c.isalpha():
                if n >= 3:
                    steps += [[(c, 0.0)], [(c, KEEP_RUN / 3), ("", 0.0)]]
                else:
                    steps += [[(c, 0.0)]] * n
            elif c in LEET:
                options = [*LEET[c], ("", 12.0 if c.isdigit() else 4.0)]
                steps += [options] if n >= 3 else [options] * n
            else:
                steps += [[("", DROP if c in FILLERS else 3.0)]]
            at = run
        return steps

    def restored(self, token: str) -> tuple[str, ...]:
        """The restored forms of the odd words of a token without white space."""
        found = self.cache.get(token)
        if found is None:
            found = tuple(self._viterbi(m[0]) for m in _odd.finditer(token))
            if len(token) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[token] = found
        return found

    def split(self, spaced: str) -> set[str]:
        """The words of characters spaced out: the whole, what wider gaps part, the likeliest words of those parts, and the lexicon's inside."""
        parts = {spaced}
        if re.search(r"(?<![ .*_-])[ .*_-](?![ .*_-])", spaced):
            parts.update(re.split(r"[ .*_-]{2}", spaced))
        found = set()
        for joined in {re.sub(r"[ .*_-]", "", part) for part in parts}:
            whole = self._viterbi(joined)
            found.add(whole)
            found.update(self._viterbi(joined, gaps=True).split())
            if self.lexicon:
                found.update(whole[i : i + n] for i in range(len(whole)) for n in range(4, self.longest + 1) if whole[i : i + n] in self.lexicon)
        return found

    def _viterbi(self, word: str, gaps: bool = False) -> str:
        """The likeliest spelling; with ``gaps`` words may end between any two steps."""
        costs = self.cost
        steps = [[(c, _kind(c), extra) for c, extra in options] for options in self.lattice(word)]
        if gaps:
            steps = [s for options in steps for s in (options, _GAP)][:-1]
        best: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # cost, and the letters as links to the ones before: the search stays linear
        for options in steps:
            after: dict[tuple[int, int], tuple] = {}
            for state, (cost, spelled) in best.items():
                p, q = state
                row = costs[p][q]
                for c, k, extra in options:
                    if c:
                        to, new = (q, k), cost + extra + row[k]
                        if to not in after or new < after[to][0]:
                            after[to] = (new, (spelled, c))
                    else:
                        new = cost + extra
                        if state not in after or new < after[state][0]:
                            after[state] = (new, spelled)
            best = after
        _, spelled = min(((cost + costs[p][q][0], spelled) for (p, q), (cost, spelled) in best.items()), key=lambda x: x[0])
        out = []
        while spelled:
            spelled, c = spelled
            out.append(c)
        return "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """Distinct words of the text, and the restored forms of the odd ones."""
        lowered = text.lower()
        found = set(_clean.findall(lowered))
        found.update(*map(self.restored, set(lowered.split())))
        found.update(*(self.split(m[0]) for m in _spaced.finditer(lowered)))
        return found


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings of four to eight letters."""
    return words | {f"{w[:n]}*" for w in words for n in range(4, 9) if len(w) > n}


def fit(hits: list[list[int]], labels: list[int], names: list[str]) -> tuple[dict[str, float], float]:
    """Weights of the named features and the intercept, by penalised logistic regression over rows of feature places."""
    ones = sum(labels)
    zeros = len(labels) - ones
    if not ones or not zeros:
        return {}, (30.0 if ones else -30.0)
    at_row = np.repeat(np.arange(len(labels)), [len(h) for h in hits])
    at_col = np.array([j for h in hits for j in h], np.int64)
    want = np.array(labels, float)
    w, b = np.zeros(len(names)), math.log(ones / zeros)
    gw, gb = np.zeros_like(w), 0.0
    for _ in range(400):
        z = b + np.bincount(at_row, w[at_col], len(labels)) if len(at_col) else np.full(len(labels), b)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(at_col, (p - want)[at_row], len(names)) + RIDGE * w if len(names) else w
        h = (p - want).sum()
        gw, gb = gw + g * g, gb + h * h
        w = w - 0.5 * g / np.sqrt(gw + 1e-8)
        b = b - 0.5 * h / math.sqrt(gb + 1e-8)
    return dict(zip(names, w.tolist(), strict=True)), float(b)


class Model:
    def __init__(self, trigrams: np.ndarray, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.begins = frozenset(f[:-1] for f in weights if f.endswith("*"))
        self.full = frozenset(f for f in weights if not f.endswith("*"))
        self.channel = Channel(trigrams, self.full)
        self.fours = frozenset(f[:4] for f in weights)

    def score(self, text: str | None) -> float:
        words = self.channel.words(text or "")
        near = {w for w in words if w[:4] in self.fours}
        z = self.intercept + sum(self.weights.get(f, 0.0) for f in features(near))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def drawn_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y and text of about ``TRAIN_DOCS`` labelled training documents: a row an id, whatever repeats."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_siltstone_y"))
    total = known.count()
    wide = 1 << 20
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < min(wide, wide * TRAIN_DOCS // max(total, 1) + 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about TRAIN_DOCS ids by the draw above
    one = rows.groupBy("doc_id", F.col("_siltstone_y").alias("y")).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "y", "t.text")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The language model from all documents; the classifier from a bounded sample of labelled training rows.

    Executors restore the drawn texts, count their features and choose among them; the driver gets the chosen names and, for
    each drawn row, which of them it has.
    """
    spark = docs.sparkSession
    trigrams = count_trigrams(docs)
    costs = spark.sparkContext.broadcast(trigrams)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(costs.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([sorted(features(channel.words(t.as_py() or ""))) for t in batch.column("text")], pa.list_(pa.string()))], names=["y", "f"])

    rows = drawn_rows(docs, labels).repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    found = written(rows.select("y", "text").mapInArrow(read, "y int, f array<string>"), "toxic-features")
    sizes = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    ones, zeros = sizes["ones"], sizes["n"] - sizes["ones"]
    counts = found.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") >= LEAST_DOCS)
    pull = F.log((F.col("a") + 0.3) / (ones + 0.6)) - F.log((F.col("b") + 0.3) / (zeros + 0.6))
    names = [r["f"] for r in counts.withColumn("pull", pull).filter(F.col("pull") > LEAST_PULL).orderBy(F.desc(F.round(F.col("a") * F.col("pull"), 9)), "f").limit(MOST_FEATURES).collect()]
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = place.value
        for batch in batches:
            hits = [[own[x] for x in f.as_py() if x in own] for f in batch.column("f")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(hits, pa.list_(pa.int32()))], names=["y", "hits"])

    drawn = sorted((r["y"], list(r["hits"])) for r in found.mapInArrow(chosen, "y int, hits array<int>").collect())  # about TRAIN_DOCS rows of a few places
    forget(found)
    return Model(trigrams, *fit([h for _, h in drawn], [int(bool(y)) for y, _ in drawn], names))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 28^3 costs and at most MOST_FEATURES weights
    kind = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([own.score(t.as_py()) for t in batch.column("text")], pa.float64())], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

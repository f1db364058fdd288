"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Base kinds are assign, access and hex (leftmost, non-overlapping for each kind; matches that are too short are consumed
and dropped). The battery adds spans of kind ``random``: runs of 20 or more base64 or URL characters, whatever classes they mix,
with what base spans cover cut out. Each gets an inferred encoding (``ALPHABETS``) and three tests against "uniformly random over that
alphabet": chi-squared of the symbols, runs above and below the middle, and serial correlation. The cube root of their
summed negative logarithms is the token's departure from randomness, near normal for ordinary text and small for keys.

False alarms are what must be controlled, so a token's p-value is the chance that ordinary text of its length departs as
little: every document gives a window of its own letters, at a place and of a length drawn by its hash, spelled in
one of the encodings and put through the same battery, and ``ORDINARY`` adds windows so that small tables have a null,
too. Means and deviations by length class and encoding turn departures into p-values, and within each length class the false
discovery rate over all documents is held at ``RATE`` (Benjamini-Hochberg on a fixed grid of p-values). A short token must
therefore look more random than a long one to be reported.

Defined results: null text counts as empty: no spans; repeated rows are kept; an empty table gives no rows; other columns are
ignored. Positions are code points, end exclusive. Matches are gathered over blocks, so a text may hold very many.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table, written
from siltstone.llm.multiset import let

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RANDOM, LEAST = r"[A-Za-z0-9+/_-]+", 20
RATE = 0.05
#: Grid of the false-discovery thresholds: p = 10 ** -(i / 10).
GRID = 400
#: Length classes are half octaves; tokens of the last one or longer are judged as its windows are.
LAST_CLASS = 14
#: Windows of ``ORDINARY`` for each class and encoding (about), and the least deviation of a departure.
WINDOWS, LEAST_SPREAD = 48, 0.15
_digits, _lower, _upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings in the order in which they are tried: the first that has all of a token's characters.
ALPHABETS = (_digits, _digits + "abcdef", _digits + "ABCDEF", _lower, _upper, _upper + "234567", _digits + _lower, _digits + _upper, _digits + _upper + _lower, _upper + _lower + _digits + "+/", _upper + _lower + _digits + "-_", _digits + _upper + _lower + "+/_-")
_CLASSES = ("[0-9]", "[0-9a-f]", "[0-9A-F]", "[a-z]", "[A-Z]", "[A-Z2-7]", "[0-9a-z]", "[0-9A-Z]", "[0-9A-Za-z]", "[0-9A-Za-z+/]", "[0-9A-Za-z_-]")
#: Ordinary prose for the null of small tables.
ORDINARY = (
    "When the morning ferry came in late again, nobody on the quay was surprised. Baskets of bread stood beside the ropes, a dog slept under the bench, and the old harbour master wrote the hour "
    "into his book as he had done for forty years. The children who waited for the post asked him whether the weather would hold. He looked across the water, folded his glasses and answered that clouds "
    "of this kind usually break before noon, though one should never promise anything to people who are about to go fishing. In the afternoon the market opened. Farmers sold apples, cheese and honey; "
    "a teacher bought paper, string and a small brass bell for her classroom. Someone played a quiet song near the church, and for a while even the busiest traders stopped counting their change. "
    "Later that evening the council met to discuss the bridge, which needed new planks, better lamps and somebody patient enough to paint it properly before the winter storms arrived from the north."
)
_OPEN, _CLOSE, _ELSE = "\ue000", "\ue001", "\ue002"
_MATCH = "array<struct<start:int,end:int,piece:string>>"
#: Pieces of a text that are folded at once (even, as every second piece is a match).
_BLOCK = 128


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches: every second piece is one."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")


def _matches(text: Column, probe: str, pattern: str, keep) -> Column:
    """start, end and text of the matches that ``keep`` accepts; ``probe`` must find something in every text that has one."""
    none = F.array().cast(_MATCH)

    def step(s: Column, piece: Column) -> Column:
        end = s["at"] + F.length(piece)
        own = F.struct(s["at"].alias("start"), end.alias("end"), piece.alias("piece"))
        return F.struct(end.alias("at"), (~s["match"]).alias("match"), F.when(s["match"] & keep(piece), F.concat(s["out"], F.array(own))).otherwise(s["out"]).alias("out"))

    def blocks(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda i: F.aggregate(F.slice(pieces, i * _BLOCK + 1, F.lit(_BLOCK)), zero, step))

    def placed(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, zero, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.transform(p["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["piece"].alias("piece")))))

    return F.when(text.rlike(probe), let(_pieces(text, pattern), lambda pieces: let(blocks(pieces), placed))).otherwise(none)


def _as_spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind."""
    found = [
        _matches(text, ASSIGN, ASSIGN, lambda p: F.length(F.regexp_extract(p, ASSIGN, 2)) >= 6),
        _matches(text, r"AKIA[A-Z0-9]{16}", ACCESS, lambda p: F.length(p) >= 20),
        _matches(text, r"(?<![0-9a-f])[0-9a-f]{24}", HEX, lambda p: F.length(p) >= 24),
    ]
    return F.array_sort(F.concat(*(_as_spans(m, k) for k, m in enumerate(found))))


def _outside(match: Column, base: Column) -> Column:
    """The stretches of a match, as (start, end, piece), that no base span covers."""
    zero = F.struct(match["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, cut: Column) -> Column:
        own = F.struct(s["at"].alias("start"), cut["start"].alias("end"))
        return F.struct(F.greatest(s["at"], cut["end"]).alias("at"), F.when(cut["start"] > s["at"], F.concat(s["out"], F.array(own))).otherwise(s["out"]).alias("out"))

    cuts = F.filter(base, lambda b: (b["start"] < match["end"]) & (match["start"] < b["end"]))
    stretches = F.aggregate(cuts, zero, step, lambda s: F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), match["end"].alias("end")))))
    return F.transform(stretches, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substr(match["piece"], x["start"] - match["start"] + 1, x["end"] - x["start"]).alias("piece")))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (logistic approximation)."""
    return let(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(x * 1.5976 + x * x * x * 0.070565992)))


def _both(z: Column) -> Column:
    return F.least(F.lit(1.0), _tail(F.abs(z)) * 2)


def encoding(token: Column) -> Column:
    """Place in ``ALPHABETS`` of the token's inferred encoding."""
    out = F.lit(len(ALPHABETS) - 1)
    for i in range(len(_CLASSES) - 1, -1, -1):
        out = F.when(token.rlike(f"^{_CLASSES[i]}+$"), i).otherwise(out)
    return out


def departure(token: Column, kind: Column) -> Column:
    """How far a token of characters of an alphabet departs from uniform randomness over it."""
    alphabet = F.element_at(F.array(*(F.lit(a) for a in ALPHABETS)), kind + 1)

    def battery(s: Column) -> Column:
        idx, k, text, n, upper, centre = (s[c] for c in ("idx", "k", "text", "n", "upper", "centre"))
        squares = F.aggregate(F.array_distinct(F.split(text, "(?<=.)(?=.)")), F.lit(0.0), lambda a, c: a + F.pow((F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"), F.lit(2.0)))
        df = k - 1
        chi = k / n * squares - n
        third = F.lit(2.0) / (df * 9)
        z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (F.lit(1.0) - third)) / F.sqrt(third)
        n1 = F.size(F.filter(upper, lambda b: b)).cast("double")
        turns = F.size(F.filter(F.zip_with(F.slice(upper, F.lit(1), F.size(upper) - 1), F.slice(upper, F.lit(2), F.size(upper) - 1), lambda a, b: a != b), lambda x: x)) + 1
        z_runs = let(n1 * (n - n1) * 2 / n + 1, lambda mean: F.coalesce(F.try_divide(turns - mean, F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0)))), F.lit(8.0)))
        spread = F.aggregate(idx, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
        lagged = F.aggregate(F.zip_with(F.slice(idx, F.lit(1), F.size(idx) - 1), F.slice(idx, F.lit(2), F.size(idx) - 1), lambda a, b: (a - centre) * (b - centre)), F.lit(0.0), lambda a, x: a + x)
        z_serial = F.coalesce(F.try_divide(lagged, spread), F.lit(1.0)) * F.sqrt(n)
        logs = F.log(F.greatest(_tail(z_chi), F.lit(1e-12))) + F.log(F.greatest(_both(z_runs), F.lit(1e-12))) + F.log(F.greatest(_both(z_serial), F.lit(1e-12)))
        return F.cbrt(F.greatest(-logs, F.lit(0.0)))

    def measured(s: Column) -> Column:  # what a fold looks at must be a value by then: it would be computed for every symbol
        idx, n = s["idx"], F.size(s["idx"]).cast("double")
        return F.struct(idx.alias("idx"), s["k"].alias("k"), s["text"].alias("text"), n.alias("n"), F.transform(idx, lambda x: x * 2 >= s["k"]).alias("upper"), (F.aggregate(idx, F.lit(0.0), lambda a, x: a + x) / n).alias("centre"))

    def parts(s: Column) -> Column:
        idx = F.transform(F.split(s["text"], "(?<=.)(?=.)"), lambda c: (F.instr(s["a"], c) - 1).cast("double"))
        return F.struct(idx.alias("idx"), F.length(s["a"]).cast("double").alias("k"), s["text"].alias("text"))

    return let(F.struct(alphabet.alias("a"), token.alias("text")), lambda s: let(parts(s), lambda x: let(measured(x), battery)))


def length_class(length: Column) -> Column:
    return F.least(F.floor(F.log2(length.cast("double")) * 2).cast("int"), F.lit(LAST_CLASS))


def _spelled(letters: Column, kind: Column) -> Column:
    """Letters in the symbols of an encoding: those it has stand for themselves, others go round its alphabet."""
    every = string.ascii_letters
    to = F.array(*(F.lit("".join(c if c in a else a[ord(c) % len(a)] for c in every)) for a in ALPHABETS))
    return F.call_function("translate", letters, F.lit(every), F.element_at(to, kind + 1))


def ordinary(text: Column, draw: Column) -> Column:
    """Length class, encoding and departure of the window of the text's letters that a 64-bit draw chooses (null where it is too short)."""
    first = length_class(F.lit(LEAST))
    classes = F.lit(LAST_CLASS) - first + 1

    def window(s: Column) -> Column:
        wide = s["n"] * 4 + 200
        at = F.pmod(F.shiftright(s["draw"], 24), F.greatest(F.length(text) - wide, F.lit(1)).cast("long")).cast("int")
        letters = F.regexp_replace(F.substr(text, at + 1, wide), r"[A-Za-z0-9+/_=-]{20,}|[^A-Za-z]+", "")
        return let(F.substr(letters, F.lit(1), s["n"]), lambda w: F.when(F.length(w) == s["n"], F.struct(s["size"].alias("size"), s["kind"].alias("kind"), departure(_spelled(w, s["kind"]), s["kind"]).alias("y"))))

    def cell(d: Column) -> Column:
        size = first + F.pmod(d, classes.cast("long")).cast("int")
        n = F.ceil(F.pow(F.lit(2.0), (size + F.pmod(F.shiftright(d, 16), F.lit(256)) / 256.0) / 2)).cast("int")
        return F.struct(d.alias("draw"), size.alias("size"), n.alias("n"), F.pmod(F.shiftright(d, 8), F.lit(len(ALPHABETS))).cast("int").alias("kind"))

    return let(let(draw, cell), window)


def _cell(size: Column, kind: Column) -> Column:
    return size * 16 + kind


def null_model(windows: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean and deviation of the departure by cell, from windows of the documents (size, kind, y) and of ``ORDINARY``."""
    spark = windows.sparkSession
    own = spark.range((LAST_CLASS - int(2 * math.log2(LEAST)) + 1) * len(ALPHABETS) * WINDOWS)
    built = own.select(ordinary(F.lit(ORDINARY), F.xxhash64("id")).alias("w")).select("w.*")
    sums = windows.unionByName(built).filter(F.col("y").isNotNull()).groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("d")).collect()  # a row a cell
    return {r["size"] * 16 + r["kind"]: (r["m"], max(r["d"], LEAST_SPREAD)) for r in sums}


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, base and spans for every row of ``docs``: arrays of (start, kind, end). One pass over the texts."""
    held = F.translate(F.coalesce("text", F.lit("")), _OPEN + _CLOSE, _ELSE + _ELSE)
    text = F.col("_siltstone_text")
    likely = _matches(text, rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST}}}", RANDOM, lambda p: F.length(p) >= LEAST)
    both = docs.select(*keep, held.alias("_siltstone_text")).select(*keep, base_spans(text).alias("base"), likely.alias("likely"), ordinary(text, F.xxhash64(text)).alias("window"))
    stretches = F.filter(F.flatten(F.transform("likely", lambda m: _outside(m, F.col("base")))), lambda x: x["end"] - x["start"] >= LEAST)
    judged = F.transform(stretches, lambda x: let(encoding(x["piece"]), lambda e: F.struct(x["start"].alias("start"), x["end"].alias("end"), _cell(length_class(x["end"] - x["start"]), e).alias("cell"), departure(x["piece"], e).alias("y"))))
    found = written(both.select(*keep, "base", judged.alias("judged"), "window"), "secrets")
    if found.filter(F.size("judged") > 0).isEmpty():
        return found.select(*keep, "base", F.col("base").alias("spans"))
    model = null_model(found.select("window.*"))
    means, spreads = (F.create_map(*(x for c, v in sorted(model.items()) for x in (F.lit(c), F.lit(float(v[i]))))) for i in (0, 1))

    def p_of(t: Column) -> Column:
        return _tail((means[t["cell"]] - t["y"]) / spreads[t["cell"]])

    step = F.least(F.floor(F.log10(F.greatest(p_of(F.col("t")), F.lit(1e-300))) * -10), F.lit(GRID)).cast("int")
    counts = found.select(F.explode("judged").alias("t")).groupBy(F.shiftright("t.cell", 4).alias("size"), step.alias("step")).count().collect()  # classes * GRID rows at most
    limits = false_discovery({(r["size"], r["step"]): r["count"] for r in counts})
    limit = F.create_map(*(x for c, p in sorted(limits.items()) for x in (F.lit(c), F.lit(p))))
    added = F.transform(F.filter("judged", lambda t: p_of(t) <= limit[F.shiftright(t["cell"], 4)]), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return found.select(*keep, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def false_discovery(counts: dict[tuple[int, int], int]) -> dict[int, float]:
    """Per length class, the largest grid value up to which "random" is declared (0: nothing is)."""
    out = {}
    for size in {s for s, _ in counts}:
        own = {i: n for (s, i), n in counts.items() if s == size}
        total, below, limit = sum(own.values()), 0, 0.0
        for i in range(GRID, -1, -1):
            below += own.get(i, 0)
            if below and math.pow(10, -i / 10) <= RATE * below / total:
                limit = math.pow(10, -i / 10)
        out[size] = limit
    return out


def as_text(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        between = F.substr(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
        return F.when(span["start"] < s["at"], F.struct(F.greatest(s["at"], span["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(span["end"].alias("at"), F.concat(s["out"], between, F.lit(mark)).alias("out")))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), "doc_id")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

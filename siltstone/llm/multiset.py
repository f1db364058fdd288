"""Document fingerprints: a homomorphic multiset hash of paragraphs, built of DataFrame functions only.

A paragraph (between line feeds) hashes to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2^32. So the order of paragraphs does not matter, a paragraph can be added or taken away
without the others (``combine``), and the fingerprint of two texts joined by a line feed is the sum of theirs. A vector has

* 8 identity lanes, from two 64-bit hashes of the whole paragraph: equality of multisets;
* one lane that counts the paragraph's runs of three consecutive words (a shorter one that has a word is one run);
* 96 likeness lanes: how many of those runs have a given bit of their hashes set. Twice a lane less the number of runs is a
  sum of random signs, so the cosine of two such vectors estimates that of the documents' multisets of word runs.

All of it stays within the row: bits are counted eight lanes to a long over slices of at most 127 runs, which cannot carry,
and the slices are summed lane by lane.

Defined results: null text counts as empty; empty text is one empty paragraph, which has no runs; repeated rows and ties in doc_id
are kept, ordered by (doc_id, hash of the text, text), null ids first; the only document is its own next one; likeness is 1
where the identity lanes agree and 0 where a side has no run; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table
from siltstone.llm.ordering import LEAST, buckets, tie_of, weight

RUN = 3
IDENTITY, LANES = 8, 96
#: Bits that one long counts at once, eight lanes of eight bits, and the most runs that such a lane can count.
BYTES, SLICE = 0x0101010101010101, 127
LOW = (1 << 32) - 1
#: Units of weight of a bucket, and those up to which buckets grow before there are more of them.
BUCKET, MOST = 1024, 32768
SPACE = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n")


def word_runs(paragraph: Column) -> Column:
    """Hashes of the runs of three words; of all words where there are fewer; none without a word."""
    words = F.split(F.btrim(paragraph, F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    none = F.array().cast("array<bigint>")
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.btrim(paragraph, F.lit(SPACE)) == "", none)
        .when(F.size(h) < RUN, F.array(F.xxhash64(F.get(h, F.lit(0)), F.coalesce(F.get(h, F.lit(1)), F.lit(0)))))
        .otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - (RUN - 1)), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))),
    )


def identity_lanes(found: Column) -> Column:
    """The eight sums over an array of paragraphs."""

    def total(hashes: Column, seed: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.xxhash64(h, F.lit(seed)).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))

    return let(
        F.struct(F.transform(found, lambda p: F.xxhash64(p)).alias("a"), F.transform(found, lambda p: F.xxhash64(F.lit("b"), p)).alias("b")),
        lambda s: F.array(*(total(s["a"], seed) for seed in range(IDENTITY // 2)), *(total(s["b"], seed) for seed in range(IDENTITY // 2, IDENTITY))),
    )


def likeness_lanes(runs: Column) -> Column:
    """How many of the hashes have a bit set, for 64 bits of each and 32 of a second hash of it."""

    def counted(part: Column) -> Column:
        def total(hashes: Column, shift: int) -> Column:
            return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(BYTES)))

        return let(F.transform(part, lambda h: F.xxhash64(h, F.lit(1))), lambda second: F.array(*(total(part, j) for j in range(8)), *(total(second, j) for j in range((LANES - 64) // 8))))

    def lane(parts: Column, i: int) -> Column:
        word, byte = divmod(i, 8)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.shiftrightunsigned(F.get(p, F.lit(word)), 8 * byte).bitwiseAND(F.lit(255))).bitwiseAND(F.lit(LOW))

    slices = F.when(F.size(runs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / SLICE).cast("int")), lambda i: counted(F.slice(runs, i * SLICE + 1, F.lit(SLICE)))))
    return let(F.coalesce(slices, F.array().cast("array<array<bigint>>")), lambda parts: F.array(*(lane(parts, i) for i in range(LANES))))


def vector(text: Column) -> Column:
    """The fingerprint as an array of lanes: identity, number of runs, likeness."""
    return let(
        paragraphs(F.coalesce(text, F.lit(""))),
        lambda found: let(F.flatten(F.transform(found, word_runs)), lambda runs: F.concat(identity_lanes(found), F.array(F.size(runs).cast("long")), likeness_lanes(runs))),
    )


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (1) or deleting (-1) the paragraphs of another."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + b * sign, F.lit(LOW + 1)))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the signed likeness lanes of two fingerprints, cut to 0..1; 1 where the identity lanes are equal."""

    def signed(v: Column) -> Column:
        n = F.get(v, F.lit(IDENTITY))
        return F.transform(F.slice(v, IDENTITY + 2, LANES), lambda c: (F.pmod(c * 2 - n + (LOW + 1) // 2, F.lit(LOW + 1)) - (LOW + 1) // 2).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    cosine = let(
        F.struct(signed(a).alias("x"), signed(b).alias("y")),
        lambda s: F.coalesce(F.try_divide(dot(s["x"], s["y"]), F.sqrt(dot(s["x"], s["x"]) * dot(s["y"], s["y"]))), F.lit(0.0)),
    )
    return F.when(F.slice(a, 1, IDENTITY) == F.slice(b, 1, IDENTITY), F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def as_hex(lanes: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``lanes`` for every row of ``docs``. Nothing is shuffled."""
    return docs.select(*keep, vector(F.col("text")).alias("lanes"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses (see op9_document_fingerprints).

    Documents are dealt once, by buckets of neighbouring ids; the first row of each bucket is also dealt to the bucket
    before it, so the next document is always at hand.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie_of(F.col("text")))
    made = buckets(rows.withColumn("weight", weight(F.col("text"))), BUCKET, MOST)
    own = made.assign(rows).withColumn("guest", F.lit(0))
    guests = own.filter("starts").withColumn("bucket", made.before(F.col("bucket"))).withColumn("guest", F.lit(1))
    order = Window.partitionBy("bucket").orderBy("guest", "k", "tie", "text")
    near = own.unionByName(guests).withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    both = near.select(
        "bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        vector(F.col("text")).alias("lanes"), F.when(F.col("guest") == 0, vector(edited)).alias("edited"),
    )
    beside = both.withColumn("x", F.lead("lanes").over(Window.partitionBy("bucket").orderBy("rn"))).filter("guest = 0")
    return beside.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("lanes")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("x")).alias("near_next"),
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))

"""Importance resampling towards a target distribution over hashed word features.

1. Every text becomes a row of a sparse document-by-bucket count matrix: the runs of one and two words, hashed to ``BUCKETS`` buckets.
   The matrix is persisted as CSR blocks (row pointers, ascending column indices as gaps, counts), one for each Arrow batch of texts.
2. Column sums of the blocks give the documents' distribution, those of the target's texts the target's. Both are tables of ``BUCKETS``
   rows at most, whatever the input; from them the driver makes one gain a bucket.
3. The product of each block with the gains, divided by the row's number of features, gives the weights.
4. A Gumbel key from the id is added; of the documents with enough words the highest scores are drawn. Scores are whole numbers, and
   the logarithm bounds how many of them there are, so the cut and the ranks come from a count by score: no row passes through one
   task for its rank.

Defined results: null and empty texts have no words, no features and weight 0, and are never drawn; repeated rows are counted and drawn
as often as they are there; ties go to the smaller id, a null one last (its key is that of the empty string); an empty table of documents gives
no rows, an empty target one without counts; other columns are ignored. No text is too long: a row has ``BUCKETS`` entries at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table, written

BUCKETS = 10_000
LEAST_WORDS, PERCENT = 20, 25
_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CSR = "ids array<bigint>, words array<bigint>, features array<bigint>, ends binary, gaps binary, counts binary"


def buckets_of(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of every feature, in order: first those of single words, then those of pairs."""
    words = _words.findall((text or "").encode("utf-8", "surrogatepass").lower())
    singles = np.fromiter(map(crc32, words), np.uint32, len(words))
    pairs = np.fromiter(map(crc32, map(b" ".join, pairwise(words))), np.uint32, max(0, len(words) - 1))
    return len(words), np.concatenate([singles, pairs]) % BUCKETS


def count_matrix(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """CSR blocks of the counts of ``docs`` (key, text): of each row its id, words and features; ends of rows, gaps between columns, counts."""
    lists = [pa.field(c, pa.list_(pa.int64())) for c in ("ids", "words", "features")]
    kind = pa.schema([*lists, *(pa.field(c, pa.binary()) for c in ("ends", "gaps", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, features, columns, counts = [], [], [], []
            for text in batch.column("text"):
                n, found = buckets_of(text.as_py())
                column, count = np.unique(found, return_counts=True)
                sizes.append(n)
                features.append(len(found))
                columns.append(np.diff(column.astype(np.int64), prepend=0).astype("<u2"))
                counts.append(count.astype("<u4"))
            ends = np.cumsum([len(c) for c in columns]).astype("<i8")
            values = [batch.column(key).cast(pa.int64()).to_pylist(), sizes, features]
            blobs = [ends.tobytes(), np.concatenate(columns).tobytes(), np.concatenate(counts).tobytes()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.list_(pa.int64())) for v in values), *(pa.array([b], pa.binary()) for b in blobs)], schema=kind)

    return docs.select(key, "text").mapInArrow(run, CSR)


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each row (and an end), columns and counts of a block."""
    first = np.concatenate([[0], np.frombuffer(row["ends"], "<i8")])
    gaps = np.cumsum(np.frombuffer(row["gaps"], "<u2").astype(np.int64))
    before = np.concatenate([[0], gaps])[first[:-1]]  # every row's gaps begin at zero again
    return first, gaps - np.repeat(before, np.diff(first)), np.frombuffer(row["counts"], "<u4").astype(np.int64)


def column_sums(matrix: DataFrame) -> DataFrame:
    """bucket and n: the sums of the columns that have any count."""
    kind = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, columns, counts = _block(row)
                np.add.at(total, columns, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=kind)

    return matrix.select("ends", "gaps", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """By bucket, a thousand times the logarithm of the smoothed ratio of the target's share and the source's, floored. Both tables have ``BUCKETS`` rows at most."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for sums, into in ((source, s), (target, t)):
        for r in sums.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((y + 1) * all_s) / ((x + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, as the floored mean of a row's features."""
    names = ("doc_id", "n_words", "n_features", "weight")
    kind = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, columns, counts = _block(row)
                sums = np.concatenate([[0], np.cumsum(counts * gain[columns])])[first]
                features = np.array(row["features"], np.int64)
                weight = np.diff(sums) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["words"], pa.int64()), pa.array(features), pa.array(weight)], schema=kind)

    return matrix.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def with_scores(weighed: DataFrame, seed: str = "7") -> DataFrame:
    """``weighed`` and score: the weight and a Gumbel key of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    key = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weighed.withColumn("score", F.col("weight") + key)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) for every row of ``scored``, a stored table."""
    fits = F.col("n_words") >= least_words
    counted = scored.filter(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = total * percent // 100
    down = Window.orderBy(F.desc("score"))  # some ten thousand scores at most, by their logarithms
    levels = counted.withColumn("before", F.sum("n").over(down) - F.col("n")).filter(F.col("before") < most).select("score", "before")
    cut = levels.agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    inside = fits & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    out = scored.filter(~F.coalesce(inside, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    if cut is None:
        return out
    same = scored.filter(inside).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    placed = same.join(F.broadcast(levels), "score").withColumn("first", F.col("before") + F.sum("copies").over(order) - F.col("copies"))
    each = placed.select(*columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("rank"))
    return out.unionByName(each.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))))


def resample(docs: DataFrame, target: DataFrame, target_key: str, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn to look like the texts of ``target``."""
    matrix = written(count_matrix(docs), "csr")
    gain = gains(column_sums(matrix), column_sums(count_matrix(target, target_key)))
    return draw(written(with_scores(weights(matrix, gain)), "weights"), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id")


#: CRC-32 is affine: that of a text is the exclusive or of what each byte gives at its distance from the end.
OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT b AS byte, b AS v, 0 AS i FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM step WHERE i < 8
), bytes AS (SELECT byte, v FROM step WHERE i = 8),
w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w
), kinds AS (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM f),
far AS (
  SELECT 0 AS d, byte, v FROM bytes
  UNION ALL
  SELECT far.d + 1, far.byte, xor(far.v >> 8, b.v) FROM far JOIN bytes b ON b.byte = far.v & 255 WHERE far.d < (SELECT max(length(x)) // 2 FROM kinds)
), start AS (
  SELECT 0 AS n, 4294967295 AS v
  UNION ALL
  SELECT n + 1, xor(start.v >> 8, b.v) FROM start JOIN bytes b ON b.byte = start.v & 255 WHERE n < (SELECT max(length(x)) // 2 FROM kinds)
), spelled AS (
  SELECT feature, length(x) // 2 AS n, i, substr(x, 2 * i + 1, 2) AS h FROM (SELECT feature, x, unnest(range(length(x) // 2)) AS i FROM kinds)
), sums AS (
  SELECT feature, any_value(n) AS n, bit_xor(far.v) AS v FROM spelled JOIN (SELECT d, v, printf('%02X', byte) AS h FROM far) far ON far.h = spelled.h AND far.d = spelled.n - 1 - i GROUP BY feature
), hashed AS (
  SELECT feature, xor(xor(sums.v, start.v), 4294967295) % 10000 AS bucket FROM sums JOIN start USING (n)
), each AS (SELECT side, id, bucket FROM f JOIN hashed USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM each GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM counts, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts)
), mean AS (SELECT id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM each JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) AS n_words,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN mean USING (id) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fits FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fits // 100 THEN place END AS rank FROM ranked
"""

"""Buckets of neighbouring rows in the order of (id, hash of the text), of bounded weight however ids are spread.

Bounds are quantiles over rows, each counted by its weight, moved to the first row that lies behind them. There are about
``LEVEL`` of them on the first level, as literals; where the table needs more buckets than that, every first-level bucket gets
inner bounds, in a small table that is broadcast. An id that fills buckets of its own (null ids, too) is cut by the hash of its texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 4096
#: Bits of a bucket's number for its place inside the first-level bucket.
INNER = 20
LEAST = -(1 << 63)
_STEP = 64
#: The least weight of a row, and bytes of one unit of weight.
UNIT = 4096


def weight(text: Column) -> Column:
    """Units of ``UNIT`` bytes, at least one."""
    return (F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / UNIT) + 1).cast("int")


def _before(ks: Column, ties: Column, k: Column, tie: Column) -> Column:
    """How many of the bounds (arrays of equal length) are at most (k, tie)."""
    return F.size(F.filter(F.zip_with(ks, ties, lambda a, b: (a < k) | ((a == k) & (b <= tie))), lambda x: x))


def tie_of(text: Column) -> Column:
    """52 bits of the text's hash: quantiles are computed in double precision."""
    return F.shiftrightunsigned(F.xxhash64(text), 12)


@dataclass(frozen=True)
class Buckets:
    """First-level bounds, each the first row of a bucket, and the table of inner ones (_top, _ks, _ties), if any."""

    bounds: list[tuple[int, int]]
    inner: DataFrame | None = None
    #: Ids that fill buckets which hold no other id.
    alone: frozenset[int] = frozenset()
    #: By first-level bucket, how many buckets are inside beside the first.
    inside: tuple[int, ...] = ()

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with k and tie) and bucket, order and starts.

        Buckets ascend as (k, tie) does. Those with the same ``order`` hold one id; else a smaller order means smaller ids.
        ``starts`` marks the first row of a bucket, and its equals.
        """
        k, tie = F.col("k"), F.col("tie")

        def literal(values: list[int]) -> Column:
            return F.array(*(F.lit(v).cast("long") for v in values))

        every = self.bounds[::_STEP]
        coarse = F.greatest(_before(literal([b[0] for b in every]), literal([b[1] for b in every]), k, tie), F.lit(1))
        near = [F.slice(literal([b[i] for b in self.bounds]), (F.col("_coarse") - 1) * _STEP + 1, F.lit(_STEP)) for i in (0, 1)]
        top = F.greatest((F.col("_coarse") - 1) * _STEP + _before(*near, k, tie) - 1, F.lit(0))
        out = rows.withColumn("_coarse", coarse).withColumn("_top", top.cast("long")).drop("_coarse")
        at = (F.col("_top") + 1).cast("int")
        starts = (k == F.element_at(literal([b[0] for b in self.bounds]), at)) & (tie == F.element_at(literal([b[1] for b in self.bounds]), at))
        inside = F.lit(0)
        if self.inner is not None:
            out = out.join(F.broadcast(self.inner), "_top", "left")  # a row for each first-level bound
            out = out.withColumn("_inside", F.coalesce(_before(F.col("_ks"), F.col("_ties"), k, tie), F.lit(0)))
            inside = F.col("_inside")
            starts = F.when(inside == 0, starts).otherwise((k == F.get("_ks", inside - 1)) & (tie == F.get("_ties", inside - 1)))
        number = F.shiftleft(F.col("_top"), INNER) + inside
        order = number
        for a in sorted(self.alone):
            order = F.when(k == a, F.lit(min(i for i, b in enumerate(self.bounds) if b[0] == a) << INNER).cast("long")).otherwise(order)
        return out.withColumns({"bucket": number, "order": order, "starts": starts}).drop("_top", "_ks", "_ties", "_inside")

    def before(self, bucket: Column) -> Column:
        """The bucket before; that of the first one is the last."""
        top = F.shiftright(bucket, INNER)
        last = F.array(*(F.lit((t << INNER) + (self.inside[t] if self.inside else 0)).cast("long") for t in range(len(self.bounds))))
        return F.when(bucket.bitwiseAND(F.lit((1 << INNER) - 1)) > 0, bucket - 1).when(top > 0, F.element_at(last, top.cast("int"))).otherwise(F.element_at(last, -1))


def buckets(rows: DataFrame, target: int, most: int | None = None, isolate: bool = False) -> Buckets:
    """Buckets of about ``target`` units of weight for ``rows`` (k, tie, weight); up to ``most`` units before inner bounds are made.

    With ``isolate``, an id that fills a bucket shares it with no other.
    """
    keys = rows.select("k", "tie", "weight")
    total, least = keys.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.min("k")).first()
    if not total:
        return Buckets([(LEAST, LEAST)])
    n = max(1, min(LEVEL, -(-total // target)))
    weighed = keys.select("k", "tie", F.explode(F.array_repeat(F.lit(0), F.col("weight"))))

    def quantiles(of: str, parts: int) -> Column:
        return F.percentile_approx(of, [i / parts for i in range(parts)], max(10_000, 20 * parts))

    found = weighed.agg(quantiles("k", n)).first()[0]
    full = [k for k, c in Counter(found).items() if c > 1]  # such an id fills more than a bucket
    bounds = {(least, LEAST), *((k, LEAST) for k in found)}
    if full:
        for r in weighed.filter(F.col("k").isin(full)).groupBy("k").agg(quantiles("tie", max(Counter(found).values()) + 1).alias("t")).collect():
            bounds |= {(r["k"], t) for t in r["t"]}
            if isolate and r["k"] < -LEAST - 1:
                bounds.add((r["k"] + 1, LEAST))
    made = Buckets(sorted(bounds))
    if (m := -(-total // ((most or target) * n))) > 1:
        tops = made.assign(keys).select(F.shiftright("bucket", INNER).alias("_top"), "k", "tie", F.explode(F.array_repeat(F.lit(0), F.col("weight"))))
        inner = tops.groupBy("_top").agg((F.min("k") == F.max("k")).alias("s"), F.array_distinct(quantiles("k", m)).alias("ks"), F.array_distinct(quantiles("tie", m)).alias("ts"))
        inner = inner.select("_top", F.when(F.col("s"), F.transform("ts", lambda _: F.col("ks")[0])).otherwise(F.col("ks")).alias("_ks"), F.when(F.col("s"), F.col("ts")).otherwise(F.transform("ks", lambda _: F.lit(LEAST).cast("long"))).alias("_ties"))
        made = Buckets(made.bounds, rows.sparkSession.createDataFrame(inner.collect(), inner.schema))  # m bounds for each first-level one
    firsts = made.assign(keys).groupBy("bucket").agg(F.min(F.struct("k", "tie")).alias("f")).collect()  # a row a bucket
    by_top: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(firsts, key=lambda r: r["bucket"]):
        by_top.setdefault(r["bucket"] >> INNER, []).append((r["f"]["k"], r["f"]["tie"]))
    parts = [by_top[t] for t in sorted(by_top)]
    inner = None
    if any(len(p) > 1 for p in parts):
        inner = rows.sparkSession.createDataFrame([(t, [k for k, _ in p[1:]], [x for _, x in p[1:]]) for t, p in enumerate(parts)], "_top long, _ks array<long>, _ties array<long>")
    return Buckets([p[0] for p in parts], inner, frozenset(full if isolate else ()), tuple(len(p) - 1 for p in parts))

"""SimHash near-duplicates with pigeonring candidates.

Fingerprints of 64 bits are cut into five segments on a ring. If two of them differ in at most four bits, some chain of
consecutive segments keeps every prefix of l segments within floor(4 l / 5) differences. Nodes meet where the first segment is
equal and the second differs in at most one bit; of the pairs that do, those whose chain leaves its budget at three or four
segments are pruned (another start of theirs keeps it, if they are near at all), and the rest get the full Hamming check.

Equal fingerprints are one node from the start, so groups of copies cost one row. Nodes are dealt by (segment, value), which a
task streams value by value. A value of more than ``GROUP`` nodes is split by the chain's own budget: the second segment may show one
difference, so of its two halves one is equal; the third may show two, so one of its three parts is; the fourth three, one of four.
Parts that are still too large are split by the next segment. Where many nodes share a chain, a task links them over blocks and
passes on a spanning forest, never all pairs. Components come from alternating stars over the links, written to the shared folder between rounds; what is joined
by a key that may be hot is a table of its own, so that adaptive execution can split the hot side.

Defined results: null or empty text has fingerprint zero and links like any other; repeated rows are kept; a null
doc_id never names a component unless all its documents have none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import MARKS, forget, marks, table, written

MOST_BITS = 4
#: (shift, width) of the segments, in ring order.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Chains shared by more nodes than this are linked over blocks.
BLOCK = 64
CHUNK = 100_000
#: Nodes that share a key, at most, unless they agree in a part of all four segments of a chain.
GROUP = 250_000
#: Bits that a split adds to a key: the part's number and its value. The number of splits stands above bit 60.
PART, LEVELS = 10, 3


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 majority bits of the XXH64 of all word shingles (A-Z lower-cased, joined by one space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words))
    hashes = np.fromiter((digest(joined[starts[i] : ends[i + width - 1] - 1], seed) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *carried: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the carried columns of longs."""
    kind = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64()), *(batch.column(c) for c in carried)], schema=kind)

    return docs.select("doc_id", "text", *carried).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining labels a[i] and b[i] (a small union-find over distinct labels)."""
    parent = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    if not parent:
        return labels
    used, at = np.unique(labels, return_inverse=True)
    return np.array([find(x) for x in used.tolist()])[at]


def _forest(fps: np.ndarray) -> np.ndarray:
    """For each of many fingerprints, the index of its component's root, over links of at most four bits."""
    n = len(fps)
    labels = np.full(n, -1)
    while (left := np.flatnonzero(labels < 0)).size:  # balls around leaders: cheap links first
        near = left[np.bitwise_count(fps[left] ^ fps[left[0]]) <= MOST_BITS]
        labels[near] = left[0]
    for at in range(0, n, 256):  # the rest of the links join labels
        if labels.max() == labels.min():
            break
        rows = slice(at, at + 256)
        hit = (np.bitwise_count(fps[rows, None] ^ fps[None, :]) <= MOST_BITS) & (labels[rows, None] != labels[None, :])
        i, j = np.nonzero(hit)
        if i.size:
            labels = _roots(labels, labels[rows][i], labels[j])
    return labels


def _chain_masks(length: int) -> np.ndarray:
    """By first segment, the bits of a chain of so many segments."""
    masks = [((1 << w) - 1) << s for s, w in SEGMENTS]
    return np.array([sum(masks[(i + j) % len(masks)] for j in range(length)) for i in range(len(masks))], np.uint64)


#: Masks of the chains of three and four segments, and the differences that they may show.
CHAINS = [(_chain_masks(n), MOST_BITS * n // len(SEGMENTS)) for n in (3, 4)]


def links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each key: pairs, or a forest where many share a chain.

    A key is segment number * 2^13 + value, then what splits added. Equal keys are neighbours.
    """
    segment = (keys >> (PART * (keys >> 60)) & 0xFFFF) >> 13
    shift = np.array([s for s, _ in SEGMENTS], np.uint64)
    width = np.array([w for _, w in SEGMENTS], np.uint64)
    follow = (segment + 1) % len(SEGMENTS)
    value = (fps >> shift[follow]) & ((np.uint64(1) << width[follow]) - np.uint64(1))
    group = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]).astype(np.uint64) << np.uint64(13)
    left, right = [], []
    for bit in range(13):  # the second segment with one bit left out: at most one difference there
        chain = group | (value & ~(np.uint64(1) << np.uint64(bit)))
        order = np.argsort(chain, kind="stable")
        c, f, start = chain[order], fps[order], segment[order]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        sizes = np.diff(np.r_[starts, len(c)])
        big = sizes > BLOCK
        for s, n in zip(starts[big], sizes[big], strict=True):
            part = np.unique(f[s : s + n])
            root = _forest(part)
            own = root != np.arange(len(part))
            left.append(part[own])
            right.append(part[root[own]])
        small = np.repeat(~big, sizes)
        for gap in range(1, int(sizes[~big].max(initial=1))):
            same = (c[gap:] == c[:-gap]) & small[gap:] & small[:-gap]
            if not same.any():
                break
            i = np.flatnonzero(same)
            for masks, budget in CHAINS:
                i = i[np.bitwise_count((f[i] ^ f[i + gap]) & masks[start[i]]) <= budget]
            i = i[np.bitwise_count(f[i] ^ f[i + gap]) <= MOST_BITS]
            left.append(f[i])
            right.append(f[i + gap])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    keep = a != b
    both = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], 1), axis=0)
    return both[:, 0], both[:, 1]


def _bits(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def _split(dealt: DataFrame, level: int) -> DataFrame:
    """``dealt`` (key, fp) with each key replaced by one for each part of the chain's segment number ``level``, counted from 0.

    The chain allows ``level`` differences there, so fingerprints of a chain agree in one of ``level + 1`` parts.
    """
    ways = []
    for i in range(len(SEGMENTS)):
        shift, width = SEGMENTS[(i + level) % len(SEGMENTS)]
        cuts = [width * p // (level + 1) for p in range(level + 2)]
        ways.append(F.array(*(_bits(shift + lo, hi - lo) + F.lit(p << 7) for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))))
    own = F.col("key").bitwiseAND(F.lit((1 << 60) - 1))
    segment = F.shiftright(own, 13 + PART * (level - 1))
    parts = F.coalesce(*(F.when(segment == i, way) for i, way in enumerate(ways)))
    split = dealt.select(own.alias("own"), "fp", F.explode(parts).alias("part"))
    return split.select((F.shiftleft("own", PART) + F.col("part") + F.lit(level << 60)).alias("key"), "fp")


def dealt(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """key, fp: the groups in which links are looked for; more than ``most`` nodes share a key only where no split is left."""
    most = most or GROUP
    keys = F.explode(F.array(*(_bits(s, w) + F.lit(i << 13) for i, (s, w) in enumerate(SEGMENTS))))
    left = nodes.select(keys.alias("key"), "fp")
    whole = None
    for level in range(1, LEVELS + 1):
        large = written(left.groupBy("key").count().filter(F.col("count") > most).select(F.col("key").alias("large")), "large")
        if large.isEmpty():
            break
        if level == 1:
            large = F.broadcast(large)  # at most 2^13 values for each of the segments
        same = left["key"] == large["large"]
        fits = left.join(large, same, "left_anti")
        whole = fits if whole is None else whole.unionByName(fits)
        left = written(_split(left.join(large, same, "left_semi"), level), "split")
    return left if whole is None else whole.unionByName(left)


def links(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct ``fp`` within four bits."""
    groups = dealt(nodes.select("fp"), most).repartition(F.col("key")).sortWithinPartitions("key")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks: list[np.ndarray] = []
        fs: list[np.ndarray] = []
        held = 0

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = links_of(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=kind)

        for batch in batches:
            ks.append(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64))
            fs.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            held += len(ks[-1])
            if held >= CHUNK and len(ks[-1]) and ks[0][0] != ks[-1][-1]:
                k, f = np.concatenate(ks), np.concatenate(fs)
                cut = int(np.searchsorted(k, k[-1]))
                yield out(k[:cut], f[:cut])
                ks, fs, held = [k[cut:]], [f[cut:]], held - cut
        if held:
            yield out(np.concatenate(ks), np.concatenate(fs))

    return groups.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes that have edges (columns a, b).

    Alternating large and small stars until nothing changes: every round only lowers what nodes point to, so the rounds end, after
    about the logarithm of the longest path. A hub's neighbours are reduced to their least one before they are joined back.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        for old in (now, least, large, low):
            forget(old)
        now, before = after, state
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _rooted(prints: DataFrame, order: Column) -> DataFrame:
    """fp, least and root: each fingerprint's least value of ``order`` and the root of its component."""
    nodes = written(prints.groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    prints = written(fingerprints(docs, shingle), "simhash")
    rooted = written(_rooted(prints, F.col("doc_id")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    classes = written(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, a null one last.

    Rows are told apart by id and text, on which alone their component depends, so that other texts of the same id stay.
    """
    marked = docs.withColumns(marks(F.col("text")))
    prints = written(fingerprints(marked, shingle, *MARKS), "simhash")
    rooted = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *MARKS))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    found = written(firsts.select("doc_id", *MARKS), "firsts")
    first = found.select(*(F.col(c).alias(f"{c}_first") for c in found.columns)).hint("merge")  # one plan at every size: the ids are not bounded
    same = [marked[c].eqNullSafe(first[f"{c}_first"]) if c == "doc_id" else marked[c] == first[f"{c}_first"] for c in found.columns]
    kept = marked.join(first, same, "left_semi")
    repeated = prints.groupBy("doc_id", *MARKS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", *MARKS]) if repeated else kept).drop(*MARKS)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

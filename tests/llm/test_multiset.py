import hashlib
import math
import re
import statistics
import struct

import xxhash
from helpers import SF, documents
from pyspark.sql import functions as F

from siltstone.llm import multiset, ordering

BIG = 1 << 32


def xx(*values):
    """Spark's xxhash64 of strings and of 64- and 32-bit numbers (pairs of value and bits)."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<Q" if v[1] == 64 else "<I", v[0] % (1 << v[1]))
        h = xxhash.xxh64_intdigest(raw, h)
    return h


def plain(text):
    """The lanes of a text, paragraph by paragraph."""
    lanes = [0] * (9 + 96)
    for p in text.split("\n"):
        a, b = xx(p), xx("b", p)
        for seed in range(8):
            lanes[seed] += xx((a if seed < 4 else b, 64), (seed, 32)) % BIG
        words = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]+", p)]
        if not words:
            continue
        runs = [xx(*((w, 64) for w in words[i : i + 3])) for i in range(len(words) - 2)] if len(words) > 2 else [xx((words[0], 64), (words[1] if len(words) > 1 else 0, 64))]
        lanes[8] += len(runs)
        for r in runs:
            both = r | xx((r, 64), (1, 32)) << 64
            for i in range(96):
                word, byte = divmod(i, 8)
                lanes[9 + i] += both >> (64 * (word // 8) + word % 8 + 8 * byte) & 1
    return [x % BIG for x in lanes]


def like(a, b):
    if a[:8] == b[:8]:
        return 1.0
    x, y = ([2 * c - v[8] for c in v[9:]] for v in (a, b))
    size = math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / size)) if size else 0.0


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        h = len(t) // 2
        out.append(t[: len(t) - h] + nxt[:h])
    return out


def in_order(rows):
    return sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1]) >> 12, r[1]))


def check(got, rows):
    ordered = in_order(rows)
    want = []
    for (d, t), e, nxt in zip(ordered, edited([t for _, t in ordered]), ordered[1:] + ordered[:1], strict=True):
        a, b, c = plain(t), plain(e), plain(nxt[1])
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{x:08X}" for x in a), "".join(f"{x:08X}" for x in b), round(like(a, b), 9), round(like(a, c), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = multiset.op9_document_fingerprints(spark, SF).collect()
    check(got, rows)
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got if r.n_chars > 200]
    assert statistics.mean(r.near_edited > r.near_next for r in long) > 0.95


ODD = [(i * i, f"text {i} of many words here\nand there {i}") for i in range(40)] + [(25, None), (9, ""), (9, ""), (None, "no id at all")]


def test_many_buckets_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multiset, "BUCKET", 3)
    monkeypatch.setattr(multiset, "MOST", 3)
    check(multiset.edited_fingerprints(documents(spark, ODD)).collect(), ODD)
    assert multiset.edited_fingerprints(documents(spark, ODD).limit(0)).count() == 0


def test_inner_bounds_and_an_id_that_fills_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "LEVEL", 4)
    monkeypatch.setattr(multiset, "BUCKET", 2)
    monkeypatch.setattr(multiset, "MOST", 2)
    rows = [*ODD, *((None, f"a null id {i}") for i in range(30)), *((300, f"one id {i}") for i in range(30)), (1 << 60, "far"), ((1 << 60) + 1, "beside"), ((1 << 60) + 3, "last")]
    check(multiset.edited_fingerprints(documents(spark, rows)).collect(), rows)
    made = ordering.buckets(documents(spark, rows).select(F.coalesce("doc_id", F.lit(ordering.LEAST)).alias("k"), ordering.tie_of(F.col("text")).alias("tie"), F.lit(1).alias("weight")), 2, 2)
    assert made.inner is not None and len(made.bounds) > 4


def test_paragraphs_commute_and_can_be_added_and_taken_away(spark):
    parts = ["one two three four", "five six seven", "", "five six seven", "eight"]
    texts = ["\n".join(parts), "\n".join(reversed(parts)), "\n".join(parts[:2]), "\n".join(parts[2:]), parts[0]]
    lanes = [r.lanes for r in multiset.fingerprints(documents(spark, list(enumerate(texts))), "doc_id").orderBy("doc_id").collect()]
    assert lanes[0] == lanes[1] == plain(texts[0])
    df = spark.createDataFrame([tuple(lanes)], "a array<long>, b array<long>, c array<long>, d array<long>, e array<long>")
    r = df.select(multiset.combine(F.col("c"), F.col("d")).alias("plus"), multiset.combine(F.col("a"), F.col("d"), -1).alias("minus"), multiset.likeness(F.col("a"), F.col("b")).alias("same")).first()
    assert r.plus == lanes[0] and r.minus == lanes[2] and r.same == 1.0


def test_very_long_texts(spark):
    text = "\n".join(f"word{i} and{i % 7} more{i % 1000}" * 40 for i in range(2000))
    got = multiset.fingerprints(documents(spark, [(1, text)]), "doc_id").first()
    assert got.lanes == plain(text)

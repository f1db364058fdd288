import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from helpers import SF, documents

from siltstone.llm import resample

duckdb = pytest.importorskip("duckdb")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), Counter(crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])


def plain(docs, target):
    """doc_id, n_features, weight, score, rank by the contract's words, row by row."""
    own = [(i, *features(t)) for i, t in docs]
    s, t = sum((c for _, _, c in own), Counter()), sum((features(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    rows = []
    for i, n, c in own:
        size = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    fits = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = 25 * len(fits) // 100
    place = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(fits, 1)]
    return Counter(place + [(*r[:4], None) for r in rows if r[4] < 20])


def test_query_against_plain_python_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Counter(map(tuple, resample.op11_importance_resampling(spark, SF).collect()))
    assert got == plain([(r.doc_id, r.text) for r in docs], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert got == Counter(c.sql(resample.OP11_SQL).fetchall())


@pytest.mark.parametrize("copies", [1, 7])
def test_odd_rows(spark, copies):
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "Éa ÀB " * 12), (None, "one two three " * 9), (4, long), (5, "a-b_c " * 8), *[(6, "same words as before " * 6)] * copies, *[(7, "benchmark passage of the target set " * 5)] * copies]
    target = spark.createDataFrame([(1, "Benchmark passage of the target"), (1, None), (2, "set")], "item_id long, text string")
    got = resample.resample(documents(spark, rows), target, "item_id")
    assert Counter(map(tuple, got.collect())) == plain(rows, [r.text for r in target.collect()])


def test_empty_tables(spark):
    target = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    none = documents(spark, [(1, "x")]).limit(0)
    assert resample.resample(none, target, "item_id").count() == 0
    rows = [(i, f"some words {i} " * 10) for i in range(9)]
    assert Counter(map(tuple, resample.resample(documents(spark, rows), target.limit(0), "item_id").collect())) == plain(rows, [])


def test_blocks_hold_the_counts(spark):
    rows = [(1, "a b a b"), (2, ""), (3, "b c " * 500)]
    found = {}
    for block in resample.count_matrix(documents(spark, rows)).collect():
        first, columns, counts = resample._block(block.asDict())
        for k, i in enumerate(block.ids):
            found[i] = dict(zip(columns[first[k] : first[k + 1]].tolist(), counts[first[k] : first[k + 1]].tolist(), strict=True))
    assert found == {i: dict(features(t)[1]) for i, t in rows}

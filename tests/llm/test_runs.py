import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest
from helpers import SF, documents, words

from siltstone.llm import runs


def smallest_period(w):
    """By the prefix function."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def plain(w):
    """Every run, lag by lag and word by word."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and smallest_period(w[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def row(doc_id, w):
    """The query's row from the words."""
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def plant(doc_id, w):
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_against_every_lag(seed):
    r = random.Random(seed)
    for _ in range(40):
        n, kinds = r.randrange(350), r.choice([1, 2, 3, 5, 40])
        w = [str(r.randrange(kinds)) for _ in range(n)]
        for _ in range(r.randrange(5)):
            a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
            p = r.randint(1, max(1, (b - a) // 2))
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
        if r.random() < 0.4:
            u, v = w[: r.randrange(100)], w[-7:]
            w = (u + v + u + u) * 2
        assert runs.runs_of(w) == plain(w)


@pytest.mark.parametrize("w", [["a"] * 12, ["a"] * 11, ["a", "b"] * 6, [str(i) for i in range(6)] * 2, [str(i) for i in range(40)] * 2 + ["x"], (["a"] * 80 + ["b"]) * 5, (["a"] * 50 + ["b"] * 50) * 3, ["a", "b"] * 60 + ["b", "a"] * 60, ["a"] * 90 + ["b"] + ["a"] * 90, ([str(i) for i in range(33)] * 4 + ["x"]) * 3])
def test_chosen(w):
    assert runs.runs_of(w) == plain(w)


def test_a_long_text_of_one_word():
    n = 300_000
    assert runs.runs_of(["w"] * n) == [(0, n, 1)]
    assert len(runs.runs_of((["w"] * 100 + ["x"]) * 1500)) == 1501


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = Counter(row(r.doc_id, plant(r.doc_id, words(r.text))) for r in docs if len(words(r.text)) < 2500)
    short = {r.doc_id for r in docs if len(words(r.text)) < 2500}
    got = Counter(tuple(r) for r in runs.op12_periodic_runs(spark, SF).collect() if r.doc_id in short)
    assert got == want and sum(r[1] > 0 for r in want) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "ä\u2003ö " * 13), (4, "ä\u2003ö " * 13), (5, "\n".join(["one line of a licence"] * 40) + " end")]
    got = runs.periodic_runs(documents(spark, rows)).collect()
    want = Counter((i, len(words(t)), tuple(plain(words(t)))) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs))) for r in got) == want
    assert {r.collapsed for r in got} == {"", "x", "ä\u2003ö", "one line of a licence end"}
    assert runs.periodic_runs(documents(spark, rows).limit(0)).count() == 0

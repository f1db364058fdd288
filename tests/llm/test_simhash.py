import random

import numpy as np
import xxhash
from helpers import SF, documents, words

from siltstone.llm import simhash


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    parent = {f: f for f in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for d, f in sorted(prints.items()):
        least.setdefault(find(f), d)
    return {d: least[find(f)] for d, f in prints.items()}


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: plain(t) for d, t in docs.items()}
    want = classes(prints)
    got = simhash.op8_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_dense_groups_keep_their_links(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {rng.getrandbits(64) for _ in range(500)}
    for c in centre:
        for _ in range(400):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = classes(dict(enumerate(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    seen = {}
    for i, f in enumerate(signed):
        seen.setdefault(roots.get(f, f), []).append(i)
    assert sorted(map(tuple, seen.values())) == sorted(tuple(d for d in want if want[d] == k) for k in set(want.values()))


def test_chains_find_every_near_pair():
    rng = random.Random(12)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << bit
        fps = np.array([a, b] * len(simhash.SEGMENTS), np.uint64)
        keys = np.array([(i << 13) | (x >> s & ((1 << w) - 1)) for i, (s, w) in enumerate(simhash.SEGMENTS) for x in (a, b)])
        order = np.argsort(keys, kind="stable")
        left, right = simhash.links_of(keys[order], fps[order])
        assert {int(left[0]), int(right[0])} == {a, b}


def test_hot_values_are_split_without_losing_a_link(spark):
    rng = random.Random(9)
    fps = set()
    for start in range(5):  # many nodes that share a segment's value, some of them near each other
        s, w = simhash.SEGMENTS[start]
        mask = ((1 << w) - 1) << s
        value = rng.getrandbits(64) & mask
        for _ in range(150):
            a = rng.getrandbits(64) & ~mask | value
            b = a
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                b ^= 1 << bit
            fps |= {a, b}
    fps |= {rng.getrandbits(8) << 3 | rng.getrandbits(2) << 20 for _ in range(300)}  # alike in nearly all bits
    fps = sorted(fps)
    want = classes(dict(enumerate(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for most, levels in ((20, {0, 1, 2, 3}), (10**6, {0})):
        groups = simhash.dealt(nodes, most).groupBy("key").count().collect()
        assert {r.key >> 60 for r in groups} == levels and all(r["count"] <= most for r in groups if r.key >> 60 < 3)
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, most)).collect()}
        seen = {}
        for i, f in enumerate(fps):
            f = f - (1 << 64) if f >> 63 else f
            seen.setdefault(roots.get(f, f), []).append(i)
        assert sorted(map(tuple, seen.values())) == sorted(tuple(d for d in want if want[d] == k) for k in set(want.values()))


def test_long_paths_and_hubs_become_components(spark):
    n = 3000
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, n)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{10_000 + i: 10_000 for i in range(n)}}


def test_odd_rows(spark):
    df = documents(spark, [(5, None), (3, ""), (4, " \n"), (7, "One two"), (8, "one  TWO"), (8, "one  TWO"), (None, "z")])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("4", "3"), ("5", "3"), ("7", "7"), ("8", "7"), ("8", "7"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0

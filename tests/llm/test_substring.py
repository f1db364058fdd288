import hashlib
import random

from helpers import SF, documents, words

from siltstone.llm import substring


def brute(rows, window=13):
    ordered = [(i if i is not None else -(1 << 63), words(t)) for i, t in rows]
    first = {}
    for i, w in ordered:
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in ordered:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)]
    assert sorted(map(tuple, substring.op3_substring_dedup(spark, SF).collect())) == want


def test_many_batches_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH", 3)
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randint(0, 6)}" for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = [(rng.randint(0, 40), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for _ in range(80)]
    rows += [(None, pool[0]), (7, None), (8, ""), (9, " \t\n"), (9, "\x1c".join("abcdefghijklmnop"))]
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(documents(spark, rows)).collect())
    assert got == brute(rows)
    assert substring.remove_repeats(documents(spark, rows).limit(0)).count() == 0


def test_inner_bounds_and_an_id_that_fills_batches(spark, monkeypatch):
    from siltstone.llm import ordering

    monkeypatch.setattr(substring, "BATCH", 2)
    monkeypatch.setattr(ordering, "LEVEL", 3)
    rng = random.Random(3)
    text = [f"t{i}" for i in range(60)]

    def cut():
        return " ".join(text[(s := rng.randint(0, 40)) : s + 20])

    rows = [(i * 7, cut()) for i in range(50)] + [(100, cut()) for _ in range(25)] + [(None, cut()) for _ in range(25)] + [(101, cut()), (1 << 60, cut()), ((1 << 60) + 1, cut())]
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_pieces_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 50)
    rng = random.Random(4)
    long = " ".join(rng.choice(["a", "bb", "\tccc", "é" * 40, "d" * 120, "\n"]) for _ in range(400))
    assert substring.word_hashes(long.encode()).tolist() == [substring._hashed(__import__("numpy").frombuffer(w, "u1"))[0] for w in long.encode().split()]
    big = " ".join(f"w{rng.randint(0, 99)}" for _ in range(200_000))
    rows = [(1, big[5000:9000]), (2, big), (3, big[100_000:])]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_strings_of_an_automaton_stay_apart():
    from siltstone.llm.automata import SuffixAutomaton

    rng = random.Random(8)
    for _ in range(60):
        held = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(5)]
        a = SuffixAutomaton()
        for h in held:
            a.extend(h)
        q = "".join(rng.choice("abc") for _ in range(30))
        want = [max(n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in h for h in held)) for i in range(len(q))]
        assert a.statistics(q) == want
        assert all(a.reached(q, least) == [i for i, n in enumerate(want) if n >= least] for least in (1, 2, 3, 5))


def test_automata_of_a_reference(spark):
    rng = random.Random(6)
    reference = [" ".join(f"v{rng.randint(0, 4)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, " ".join(["x"] * i + reference[i % 6].split()[i : i + 8 + i] + ["y"])) for i in range(20)] + [(50, None)]
    grams = {tuple(r.split()[p : p + 13]) for r in reference for p in range(48)}
    for r in substring.remove_known(documents(spark, rows), reference, shard_words=100).collect():
        w = words(dict(rows)[r.doc_id])
        gone = {q for p in range(len(w) - 12) if tuple(w[p : p + 13]) in grams for q in range(p, p + 13)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))

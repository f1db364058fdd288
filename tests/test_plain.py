"""Queries without SQL against second implementations in plain Python, value by value, at the smallest scale."""

import hashlib
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.extract import section_heading
from siltstone.functions.text import clean_line
from siltstone.plans import evaluate, retrieve
from siltstone.queries import QUERIES, stored
from siltstone.queries.corpus import chunks, questions
from siltstone.queries.registry import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def seeded(text, dim, algorithm):
    v = np.random.default_rng(int.from_bytes(hashlib.new(algorithm, text.encode()).digest()[:8], "big")).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def close(told, vector):
    return np.allclose([float(x) for x in told.split()], vector, atol=1.1e-6)


def tokens(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_seeded_vectors(spark, t):
    texts = {r.doc_id: r.text for r in t("documents").collect()}
    got = QUERIES["mth06_seeded_vectors"](spark, SF).collect()
    assert len(got) == len(texts) and all(close(r.vector, seeded(texts[r.doc_id], 384, "sha256")) for r in got)


def test_token_vectors_and_their_index(spark, t):
    texts = {r.item_id: r.text for r in t("benchmark").collect()}
    got = QUERIES["mth07_token_vectors"](spark, SF).collect()
    assert all(close(r.vector, seeded(r.token, 64, "md5")) for r in got)
    words = {(r.item_id, r.token) for r in got}
    assert len(words) == len(got) and {i for i, _ in words} == set(texts)
    asked = {tokens(r.question)[0] for r in questions(t).collect()} | {"refreshed"}
    found = QUERIES["hlp19_token_index"](spark, SF).collect()
    want = {(i, w) for i, w in words if w in asked} | {(i, "refreshed") for i in texts if i % 5 == 0}
    assert {(r.item_id, r.token) for r in found} == want and all(close(r.vector, seeded(r.token, 64, "md5")) for r in found)


def test_embedding_noise_is_normal_and_repeats(spark, t):
    held = {r.vec_id: np.array(r.embedding, float) for r in t("embeddings").collect()}
    first, again = ({r.vec_id: np.array(r.noised) for r in QUERIES["mth11_embedding_noise"](spark, SF).collect()} for _ in range(2))
    noise = np.concatenate([first[i] - held[i] for i in held])
    assert all((first[i] == again[i]).all() for i in held)
    assert abs(noise.mean()) < 4 * 0.01 / math.sqrt(len(noise)) and abs(noise.std() / 0.01 - 1) < 0.05
    assert 0.66 < (abs(noise) < 0.01).mean() < 0.71 and (np.sign(noise[1:]) == np.sign(noise[:-1])).mean() == pytest.approx(0.5, abs=0.03)


# chunkers
def tail_chars(text, budget):
    out, n = [], 0
    for w in reversed(text.split()):
        more = len(w) + (n > 0)
        if n + more > budget:
            break
        out, n = [w, *out], n + more
    return " ".join(out)


def split_long(sentence, chars, overlap):
    text, out = "", []
    for w in sentence.split():
        if len(f"{text} {w}".strip()) <= chars:
            text = f"{text} {w}".strip()
        elif not text:
            text = w
        else:
            out.append(text)
            text = f"{tail_chars(text, overlap)} {w}".strip()
    return [*out, text] if text else out


def pack(sentences, chars, overlap):
    text, out = "", []
    for s in sentences:
        if len(s) > chars:
            out += [text] * bool(text) + split_long(s, chars, overlap)
            text = ""
        elif len(f"{text} {s}".strip()) <= chars:
            text = f"{text} {s}" if text else s
        else:
            out += [text] * bool(text)
            text = f"{tail_chars(text, overlap)} {s}".strip()
    return out + [text] * bool(text)


def test_split_long_sentences(spark, t):
    texts = {r.chunk_id: r.text for r in chunks(t).collect()}
    got = QUERIES["txt23_split_long_sentence"](spark, SF).collect()
    assert len(got) == len(texts) and all(r.out == "|".join(split_long(texts[r.chunk_id], 120, 30)) for r in got)


def test_section_chunks(spark, t):
    raw = {r.doc_id: r.text for r in t("documents").collect()}
    lines = spark.createDataFrame([(x,) for x in {line for text in raw.values() for line in text.split("\n")}], "raw string").select("raw", clean_line(F.col("raw")).alias("line"))
    known = {r.raw: (r.line, r.head) for r in lines.select("raw", "line", section_heading(F.col("line")).alias("head")).collect()}
    want = []
    for i, text in raw.items():
        section, blocks, now = "body", [], []
        for line, head in (known[x] for x in text.split("\n")):
            if not line or head is not None:
                blocks, now = [*blocks, now], []
                section = head or section
            else:
                now.append(line)
        sentences = [s.strip() for b in [*blocks, now] for s in re.split(r"(?<=[.!?])\s*", " ".join(b)) if s.strip()]
        want += [(f"p{i}", section, n, c) for n, c in enumerate(x for x in pack(sentences, 600, 80) if x.strip())]
    assert sorted((r.paper_id, r.section, r.ordinal, r.text) for r in QUERIES["cmp02_section_chunks"](spark, SF).collect()) == sorted(want)


def merged(parts, least):
    held, out = "", []
    for p in parts:
        held = f"{held} {p}".strip()
        if len(held) >= least:
            out, held = [*out, held], ""
    return out + [held] * bool(held)


def recursive(text, size=512):
    parts = [text]
    for splitter in ("\n\n", "\n", ". ", " "):
        new = []
        for p in parts:
            if len(p) <= size:
                new.append(p)
            elif splitter == ". ":
                new += [x if x.endswith(".") else x + "." for x in (y.strip() for y in p.split(". ")) if x]
            else:
                new += [x for x in p.split(splitter) if x or splitter == " "]
        parts = new
    return merged(parts, 80)


def semantic(text, threshold=0.7, least=100):
    words = lambda s: set(re.findall(r"\w+", s.lower()))
    now, last, out = "", set(), []
    for s in re.split(r"(?<=[.!?])\s+", text):
        own = words(s)
        if now and len(last & own) / max(1, len(last | own)) < threshold and len(now) >= least:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
        last = own
    return merged([*out, now], least)


def sliding(text, size=512, overlap=64):
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


def sectioned(text):
    return [("Abstract", [text[:300]], False), ("Results", recursive(text[300:]), False), ("Figure Caption", ["Figure 1: " + text[:20]], True)]


def spelled(strategy, text):
    parts = sectioned(text) if strategy == "section" else [("Document", {"recursive": recursive, "semantic": semantic, "sliding": sliding}[strategy](text), False)]
    return [(name, cap, p.strip()) for name, ps, cap in parts for p in ps if p.strip()]


@pytest.mark.parametrize("name", ["cmp03_chunk_dispatch", "cmp04_section_aware", "cmp05_recursive", "cmp06_semantic"])
def test_chunk_strategies(spark, t, name):
    four = ("section", "recursive", "semantic", "sliding")
    raw = {r.doc_id: r.text for r in t("documents").collect()}
    of = lambda i: four[i % 4] if name.startswith("cmp03") else {"cmp04": "section", "cmp05": "recursive", "cmp06": "semantic"}[name[:5]]
    want = sorted((i, n, *c) for i, text in raw.items() for n, c in enumerate(spelled(of(i), text)))
    got = QUERIES[name](spark, SF).collect()
    assert sorted((r.doc_id, r.chunk_index, r.section, r.is_caption, r.text) for r in got) == want
    if name.startswith("cmp03"):
        assert {r.strategy for r in got} == set(four) and all(r.strategy == of(r.doc_id) for r in got)


def test_ablation_reads_texts_once(spark, t):
    few = questions(t).filter("query_id % 20 = 0")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    c = stored.chunks(t)
    relevant = few.select("query_id", F.lit("none").alias("item"))
    got = evaluate.ablation(few, relevant, c.withColumn("text", counted("text")), stored.claims(t), stored.postings(t), 10, stored.chunk_vectors(t), stored.claim_vectors(t)).collect()
    assert len(got) == few.count() * len(evaluate.CONFIGURATIONS)
    assert 0 < read.value <= c.count()


def test_texts_that_hold_the_first_words(spark):
    from siltstone.queries.composites import _holding

    texts = [("a", "so the old man said"), ("b", "xthe old manx"), ("c", "the old  man"), ("d", "old man the"), ("e", None), ("f", "one"), ("g", "§ é ü then"), ("h", "the old man the old man"), ("i", "to be"), ("j", "yon to bed"), ("k", "the old\nman")]
    asked = [(1, ["the", "old", "man"]), (2, ["one"]), (3, ["§", "é", "ü"]), (4, ["to", "be"]), (5, ["old", "man", "said"]), (6, ["the", "old", "man"])]
    got = _holding(spark.createDataFrame(texts, "chunk_id string, text string"), spark.createDataFrame(asked, "query_id long, w array<string>").withColumn("words", F.array_join("w", " ")))
    terms = lambda s: set(re.findall("[a-zA-Z0-9]+", s.lower()))
    want = {(q, c) for q, w in asked for c, s in texts if s and " ".join(w) in s and terms(s) & terms(" ".join(w))}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {(1, "b"), (4, "j"), (6, "h")} <= want


def test_ablation_runs_real_configurations(spark, t):
    few = questions(t).filter("query_id % 8 = 0")
    index, c, claims = stored.postings(t), stored.chunks(t), stored.claims(t)
    relevant = retrieve.lexical(few, index, 30).filter("rank % 3 = 1").select("query_id", F.col("chunk_id").alias("item"))
    known = {}
    for r in relevant.collect():
        known.setdefault(r.query_id, set()).add(r.item)
    got = {(r.config, r.query_id): r.recall for r in evaluate.ablation(few, relevant, c, claims, index, 10, stored.chunk_vectors(t), stored.claim_vectors(t)).collect()}
    assert {x for x, _ in got} == set(evaluate.CONFIGURATIONS)
    full = retrieve.hybrid(few, c, claims, index, 10, vectors=stored.chunk_vectors(t), claim_vectors=stored.claim_vectors(t)).collect()
    for q, items in known.items():
        hit = {r.chunk_id for r in full if r.query_id == q}
        assert got["full", q] == pytest.approx(len(hit & items) / len(items))
    assert any(got["full", q] != got["no_bm25", q] for q in known) and any(got["full", q] != got["no_rerank", q] for q in known)

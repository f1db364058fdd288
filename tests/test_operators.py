"""Literal cases of the operators: fusion, stores, chunkers, index, metrics, graphs, layout, readers, streams, plans."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone import ports
from siltstone.functions import vectors as v
from siltstone.operators import bm25, chunking, fusion, graph, layout, metrics, stores
from siltstone.plans import answer, ingest, retrieve
from siltstone.queries import QUERIES
from siltstone.queries.corpus import STATEMENTS
from siltstone.sources import readers
from siltstone.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def lists(spark):
    data = [(1, "a", "c1", "d1", 2.0), (1, "a", "c2", "d2", 1.0), (1, "b", "c2", "d2", 5.0), (1, "b", "c1", "d1", 4.0)]
    return spark.createDataFrame(data, "query_id long, list string, chunk_id string, doc_id string, score double")


def test_reciprocal_rank_fusion(lists):
    got = fusion.reciprocal_rank(lists).collect()
    assert len(got) == 2 and all(r.score == pytest.approx(1 / 61 + 1 / 62) for r in got) and {r.source for r in got} == {"b"}


def test_fusion_does_not_depend_on_list_order(lists):
    flipped = lists.withColumn("list", F.when(F.col("list") == "a", "b").otherwise("a"))
    assert rows(fusion.reciprocal_rank(lists), "chunk_id", "score") == rows(fusion.reciprocal_rank(flipped), "chunk_id", "score")


def test_weighted_scores_stay_between_zero_and_one(lists):
    assert all(0 <= r.score <= 1 for r in fusion.weighted(lists, "a", "b").collect())


def test_diversity_caps_documents(spark):
    data = [(1, f"c{i}", f"d{i % 2}", 1.0 - i / 10, f"text {i}") for i in range(6)]
    got = fusion.diversify(spark.createDataFrame(data, "query_id long, chunk_id string, doc_id string, score double, text string"), 1).collect()
    assert sorted(r.doc_id for r in got) == ["d0", "d1"]


def test_section_cap_fills_up(spark):
    data = [(1, f"c{i}", "s", i + 1) for i in range(5)] + [(1, "z", "t", 6)]
    df = spark.createDataFrame(data, "query_id long, chunk_id string, section string, rank int")
    got = {r.chunk_id: r.position for r in fusion.cap_and_fill(df, ["query_id"], "section", 3, 5).collect()}
    assert got == {"c0": 1, "c1": 2, "c2": 3, "z": 4, "c3": 5}


def test_neighbours_are_assembled(spark):
    c = spark.createDataFrame([("p", "method", i, f"part {i}") for i in range(3)], "paper_id string, section string, ordinal int, text string")
    text = fusion.neighbours(c).filter("ordinal = 1").select(fusion.assemble(F.col("section"), F.col("preceding"), F.col("text"), F.col("following")).alias("t")).first()["t"]
    assert text == "[SECTION: method]\npart 0\n>>> part 1\npart 2"


def test_upsert_keeps_the_first_date(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "k string, value int, created_at int")
    new = spark.createDataFrame([("a", 9, 20), ("c", 3, 20)], "k string, value int, created_at int")
    assert rows(stores.upsert(old, new, "k"), "k", "value", "created_at") == [("a", 9, 10), ("b", 2, 10), ("c", 3, 20)]


def test_word_chunks_overlap_and_cover(spark):
    text = " ".join(f"Sentence number {i} has six words." for i in range(12))
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "tail page")], "document_id string, page_number int, text string")
    got = chunking.chunk_by_words(pages, 20, 5).orderBy("ordinal").collect()
    assert len(got) >= 3 and all(r.token_count <= 20 for r in got) and got[-1].text == "tail page"
    assert got[1].text.split()[:5] == got[0].text.split()[-5:]
    assert {w for r in got for w in r.text.split()} == set(text.split()) | {"tail", "page"}


def test_section_chunks_take_the_last_section_of_a_page(spark):
    pages = spark.createDataFrame([("p", 1, "Abstract\nFirst text here.\n1. Introduction\nSecond text."), ("p", 2, "Third text.")], "paper_id string, page_number int, text string")
    got = chunking.chunk_by_sections(pages).orderBy("ordinal").collect()
    assert [(r.page_number, r.section) for r in got] == [(1, "introduction"), (2, "introduction")]
    assert got[0].text == "First text here. Second text."


def test_character_chunks_split_long_sentences(spark):
    pages = spark.createDataFrame([("p", 1, " ".join(f"word{i}" for i in range(60)) + ".")], "paper_id string, page_number int, text string")
    got = chunking.chunk_by_sections(pages, 80, 20).orderBy("ordinal").collect()
    assert len(got) > 3 and all(r.char_count <= 110 for r in got)


def test_recursive_semantic_and_sliding(spark):
    df = spark.createDataFrame([(1, "token " * 220)], "doc_id long, raw_text string").select("doc_id", "raw_text", F.array().cast("array<struct<name:string,text:string,page_start:int,page_end:int>>").alias("sections"), F.array().cast("array<string>").alias("captions"))
    assert chunking.chunk_sections(df, "recursive", 60).count() >= 1
    assert chunking.chunk_sections(df, "sliding", 20, 8).count() > 1
    topical = df.withColumn("raw_text", F.lit("Cats sleep all day long and purr in the warm sun near the window sill of our old house. Dogs bark loudly. Quantum fields fluctuate in the vacuum of deep space and carry energy far from here forever. Stars shine."))
    assert chunking.chunk_sections(topical, "semantic").count() >= 2


@pytest.mark.parametrize("strategy", ["recursive", "semantic", "sliding"])
def test_parts_are_made_once(spark, tmp_path, strategy):
    spark.createDataFrame([(1, "Cats sleep. Dogs bark."), (2, ""), (3, None), (4, " \n ")], "doc_id long, raw_text string").write.parquet(f"{tmp_path}/d")
    got = chunking.chunk_sections(spark.read.parquet(f"{tmp_path}/d"), strategy)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") == (1 if strategy == "semantic" else 0)
    assert not [line for line in plan.split("\n") if "Filter (" in line and "size(" in line]
    assert {r.doc_id for r in got.collect()} == {1}


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "cat sat mat"), ("b", "cat cat dog"), ("c", "cat bird")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "cat dog dog")], "query_id long, question string")
    index = bm25.build(chunks)
    df = {"cat": 3, "sat": 1, "mat": 1, "dog": 1, "bird": 1}
    raw = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    mean = 8 / 3

    def part(t, tf, dl):
        return idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))

    want = {"a": part("cat", 1, 3), "b": part("cat", 2, 3) + 2 * part("dog", 1, 3), "c": part("cat", 1, 2)}
    assert {r.chunk_id: r.score for r in bm25.search(index, q).collect()} == pytest.approx(want)
    smaller = bm25.remove(index, chunks.filter("chunk_id = 'b'"))
    assert {r.term: r.df for r in smaller.terms.collect()} == {"cat": 2, "sat": 1, "mat": 1, "bird": 1}


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, r, i) for r, i in enumerate("abcd", 1)], "query_id long, rank int, item string")
    relevant = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "query_id long, item string")
    m = metrics.retrieval_metrics(ranked, relevant, 5).first()
    assert (m.precision, m.recall, m.reciprocal_rank) == pytest.approx((2 / 5, 2 / 3, 1 / 2)) and m.average_precision == pytest.approx((1 / 2 + 2 / 4) / 3)
    graded = spark.createDataFrame([(1, r, g) for r, g in enumerate((0, 2, 1), 1)], "query_id long, rank int, grade int")
    assert metrics.ndcg(graded, 3).first().ndcg == pytest.approx((2 / math.log2(3) + 1 / 2) / (2 + 1 / math.log2(3)))


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b")], "src string, dst string")
    assert rows(graph.degrees(e), "id", "out_degree", "in_degree") == [("a", 2, 0), ("b", 0, 1), ("c", 0, 1)]
    assert sum(r["rank"] for r in graph.pagerank(e)[0].collect()) == pytest.approx(1)
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert rows(graph.betweenness(path), "id", "betweenness") == [("a", 0.0), ("b", pytest.approx(2 / 6)), ("c", pytest.approx(2 / 6)), ("d", 0.0)]


def test_drift(spark):
    base = spark.createDataFrame([([0.0, 0.0],), ([0.1, 0.0],)], "x array<double>")
    far = spark.createDataFrame([([5.0, 5.0],), ([5.1, 5.0],)], "x array<double>")
    assert v.mmd(base, base, "x").first().mmd == pytest.approx(0) and v.mmd(base, far, "x").first().mmd > 0.2


def test_two_columns_are_found(spark):
    words = [(1, 60.0, i * 12.0, 100.0, i * 12.0 + 10, f"l{i}", 1, i, i) for i in range(20)] + [(1, 620.0, i * 12.0, 660.0, i * 12.0 + 10, f"r{i}", 2, i, 20 + i) for i in range(20)]
    df = spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, token string, block int, line int, word int")
    assert layout.columns(df, 1000.0).first()["columns"] == 2
    assert layout.page_text(df, 1000.0).first()["text"].split("\n")[:2] == ["l0", "l1"]


def test_readers(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    assert sorted(r.text for r in readers.docx(readers.files(spark, str(tmp_path), "*.docx")).collect()) == ["", "One\nTwo"]
    (tmp_path / "t.csv").write_text("k,v\na,1\nb,2\n")
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).first().text == "Row 1: k=a, v=1\nRow 2: k=b, v=2"
    (tmp_path / "e.json").write_text(json.dumps([{"question": " q ", "expected_keywords": ["a"]}, {"question": " "}]))
    (tmp_path / "l.json").write_text('{"question": "x", "paper_ids": ["p"]}\nnot json\n')
    assert [r.question for r in readers.eval_cases(spark, str(tmp_path / "e.json")).collect()] == ["q"]
    assert [(r.question, r.paper_ids) for r in readers.eval_cases(spark, str(tmp_path / "l.json")).collect()] == [("x", ["p"])]
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2501.12345v2</id><title>A  title</title><summary>S</summary><updated>2026-03-20T00:00:00Z</updated><category term="cs.AI"/><link href="http://x/pdf" title="pdf"/></entry><entry><id>x</id></entry></feed>')
    got = readers.feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.entry_id, r.title, r.categories, r.pdf_url) for r in got] == [("2501.12345", "A title", ["cs.AI"], "http://x/pdf")]
    assert readers.selected_text("<body><nav>menu</nav><article>" + "word " * 60 + "</article></body>") == ("word " * 60).strip()


def test_breaker_opens_after_three_failures(spark):
    calls = spark.createDataFrame([("m", i, ok) for i, ok in enumerate([False, False, True, False, False, False, True, False])], "model string, seq long, ok boolean")
    want = [(i, i == 5) for i in range(8)]
    assert [(r.seq, r.open) for r in streams.breaker_table(calls).orderBy("seq").collect()] == want


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (2, "2024-01-03 00:00:00"), (1, "2024-01-05 00:00:00")], "id long, ts string").select("id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.arrivals(spark, str(tmp_path / "in"), "id long, ts timestamp, value double")
    assert sorted(r.n for r in streams.run_to_memory(streams.windows(stream, "ts", []), "w_all", "complete").collect()) == [1, 1, 2]
    assert len(streams.run_to_memory(streams.unique(stream, "ts", "id"), "u_all").collect()) >= 2
    seen = []
    known = spark.createDataFrame([(2,)], "id long")
    streams.ingest(stream, lambda: known, lambda df: seen.extend(r.id for r in df.collect()), "id", str(tmp_path / "ck")).awaitTermination()
    assert seen == [1]


def test_ports(spark):
    ring = ports.KeyRing(["a", "b"])

    def use(key):
        if key == "a":
            raise PermissionError
        return key

    assert ring.call(use) == "b" and ports.EchoGenerator().generate("x") == ""
    assert (v.seeded_vector("t", 8) == v.seeded_vector("t", 8)).all()


def test_ingest_query_and_merge(spark):
    pages = spark.createDataFrame([("p1", "One", 1, "Abstract\nOur encoder reaches 91.2 percent accuracy on CIFAR10 and outperforms the baseline. It is small."), ("p2", "Two", 1, "Results\nGroundedness is measured by overlap of answers with their retrieved contexts.")], "paper_id string, title string, page_number int, text string")
    c = ingest.sections(pages, "2024-01-01 00:00:00")
    assert c.claims.count() >= 1 and {r.paper_id for r in ingest.report(c).collect()} == {"p1", "p2"}
    q = spark.createDataFrame([(1, "How is groundedness measured?")], "query_id long, question string")
    body = c.chunks.withColumn("content_type", F.lit("text"))
    hits = retrieve.hybrid(q, body, c.claims, c.index, 3)
    assert hits.filter("position = 1").first().paper_id == "p2"
    assert "roundedness" in answer.answer_batch(q, body, c.claims, c.index).first().answer
    newer = ingest.merge(c, ingest.sections(pages.filter("paper_id = 'p2'").withColumn("text", F.lit("Results\nNothing of the kind remains in this version of the text.")), "2024-02-01 00:00:00"))
    assert newer.papers.filter("paper_id = 'p2'").first().created_at.month == 1
    assert not retrieve.lexical(q.withColumn("question", F.lit("groundedness")), newer.index, 3).count()


def test_parameter_rules(spark):
    rows = spark.createDataFrame([(0.2, 0.5, 0.5, 0.3, 1), (0.9, 0.2, 0.2, 0.9, 2)], "r double, d double, c double, o double, a int").orderBy("r")
    low, high = (r.p for r in rows.select(answer.tuned(*(F.col(c) for c in "rdcoa"), F.lit(True)).alias("p"), "r").orderBy("r").collect())
    assert low.k_vector == 45 and low.use_hyde and low.rerank_threshold == 0.24 and low.max_per_doc == 2 and not low.use_colbert
    assert (high.k_vector, high.k_bm25, high.max_per_doc, high.use_colbert, high.expand) == (24, 24, 1, True, True)
    got = spark.createDataFrame([("Low", 1), ("High", 1), ("Low", 3)], "l string, a int").select(answer.retry(answer.label_score(F.col("l")), F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False]


def test_adaptive_loop_tunes_and_stops(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"p{i % 7}", "results" if i % 3 else "method", i, f"The HyperNet model {w} reaches accuracy on GPT-4 data number {i}") for i, w in enumerate(["trains", "tests", "scores", "ranks"] * 8)], "chunk_id string, paper_id string, section string, ordinal long, text string")
    questions = spark.createDataFrame([(1, "what accuracy does the HyperNet model reach on GPT-4 data"), (2, "entirely unrelated cooking recipes and gardens")], "query_id long, question string")
    edges = stores.entity_edges(chunks.select("paper_id", F.array(F.lit("GPT-4"), F.lit("HyperNet")).alias("e")), "paper_id", "e")
    seen = []

    def written(df):
        path = str(tmp_path / f"t{len(seen)}")
        df.write.parquet(path)
        seen.append(path)
        return spark.read.parquet(path)

    got = {r.query_id: r for r in answer.adaptive(questions, chunks, bm25.build(chunks), edges, attempts=2, written=written).collect()}
    assert set(got) == {1, 2} and got[2].attempts == 2 and len(seen) == 4
    near = {r.chunk_id for r in retrieve.related(questions, edges, chunks, 4).filter("query_id = 1").collect()}
    assert near == {"c0", "c7", "c14", "c1"}


def test_blocks_against_all_pairs(spark, monkeypatch):
    import random

    from siltstone.operators import blocks

    monkeypatch.setattr(blocks, "QUESTIONS", 3)
    rng = random.Random(1)
    asked = [(q, p, rng.choice([-1.0, 0.0, 0.5, 2.0])) for q in range(8) for p in rng.sample(range(12), 4)]
    held = [(f"r{r:02}", p, float(rng.randint(1, 3))) for r in range(60) for p in rng.sample(range(14), 3)]
    got = blocks.top(spark.createDataFrame(asked, "query_id long, place int, w double"), spark.createDataFrame(held, "row string, place int, w double"), "row", 5).collect()
    want = {}
    for q in range(8):
        own = {p: w for x, p, w in asked if x == q}
        scores = {}
        for r, p, w in held:
            if p in own:
                scores[r] = scores.get(r, 0.0) + own[p] * w
        want[q] = [(r, round(s, 9)) for r, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]]
    for q in range(8):
        assert [(r.row, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want[q]


def test_longest_common_substring_on_long_lines(spark, tmp_path):
    def brute(a, c):
        a, c = a[:4000], c[:4000]
        return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in c), default=0)

    lines = ["short line", "wörds " * 150, "ab " * 400 + STATEMENTS[4][:30], "x" * 3990, "y" * 5000, ""]
    spark.createDataFrame([(2, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.longest for r in QUERIES["mth19_longest_common_substring"](spark, str(tmp_path)).collect()]
    own = [STATEMENTS[(2 + i) % len(STATEMENTS)] for i in range(len(lines))]
    want = [brute(a, f"{line} {a}".strip(" ")) for a, line in zip(own, lines, strict=True)]
    assert sorted(got) == sorted(want) and want[1:3] == [len(own[1]), len(own[2])]


def test_sources_are_read_in_one_pass_and_handed_on_in_pieces(spark):
    from siltstone.sources import readers

    assert [len(p) for p in readers._pieces(((i, "x" * 1000) for i in range(10)), 3000)] == [3, 3, 3, 1]
    assert list(readers._pieces(iter([]), 10)) == []
    given = spark.createDataFrame([("a.pdf", b"one\ftwo"), ("b.json", b"{}"), ("c.json", b"no")], "path string, content binary")
    read = readers.dispatch(given)
    assert read._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, read.collect())) == [("json", "b.json", 1, "{}"), ("json", "c.json", 1, ""), ("pdf", "a.pdf", 1, "one"), ("pdf", "a.pdf", 2, "two")]

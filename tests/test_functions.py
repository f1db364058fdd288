"""Literal cases of the text, extraction and verification functions."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import extract as e
from siltstone.functions import text as x
from siltstone.functions import vectors as v
from siltstone.functions import verify as check
from siltstone.sources import readers


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **given):
        row = spark.range(1).select(*(F.lit(c).alias(n) for n, c in given.items())) if given else spark.range(1)
        return row.select(column.alias("v")).first()["v"]

    return value


def test_sentences_split_with_and_without_space(one):
    assert one(x.sentences(F.lit("A b. C d? E"))) == ["A b.", "C d?", "E"]
    assert one(x.sentences_tight(F.lit("scores 91.2% here. Next"))) == ["scores 91.", "2% here.", "Next"]


def test_non_ascii_words(one):
    assert one(x.tokens(F.lit("Café naïve"))) == ["caf", "na", "ve"]
    assert one(x.index_tokens(F.lit("Café the cat9"))) == ["cat9"]


def test_readable_text_scores_higher_and_camel_case_is_repaired(one):
    good, bad = "This is a readable sentence with several plain words.", "Thisisagarbledsentence%%%withoutanyspaces###inthemiddle"
    for score in (x.quality_by_word_length, x.quality_by_spacing):
        assert one(score(F.lit(good))) > one(score(F.lit(bad)))
    assert one(x.clean_extracted(F.lit("neuralNetwork train-\n ing.Next"))) == "neural Network training. Next"


def test_tail_words(one):
    assert one(x.tail_words(F.lit("a b c d"), 2)) == "c d"
    assert one(x.tail_words(F.lit("a"), 2)) == "a"
    assert one(x.tail_chars(F.lit("alpha beta gamma"), 10)) == "beta gamma"


def test_headings(one):
    for line, section in (("1. Introduction", "introduction"), ("Abstract", "abstract"), ("3.1 Model Architecture Design", "method"), ("References", "references"), ("This is not a heading of anything at all here", None)):
        assert one(e.section_heading(F.lit(line))) == section
    assert one(e.plain_heading(F.lit("Conclusions and future work"))) == "conclusion"


def test_claims(one):
    s = "Our model reaches 91.2% accuracy on CIFAR10 and outperforms the strong baseline by 3.4%."
    assert one(e.is_claim(F.lit(s))) and one(e.claim_type(F.lit(s), F.lit("results"))) == "comparison"
    assert "91.2" in one(e.claim_entities(F.lit(s))) and "CIFAR10" in one(e.claim_entities(F.lit(s)))
    assert not one(e.is_claim(F.lit("We plan future work on other corpora and metrics for this task.")))


@pytest.mark.parametrize("question, expected", [("compare models with accuracy > 90%", True), ("table 3 scores", True), ("what is the main idea of the paper", False)])
def test_table_questions(one, question, expected):
    assert one(e.is_table_question(F.lit(question))) is expected


def test_query_rules(one):
    assert one(e.hop_type(F.lit("Compare A and B"))) == "multi_hop"
    assert one(e.hops(F.lit("Explain A and then B"))) == ["Explain A", "B"]
    assert one(e.sub_questions(F.lit("What is A, and why B?"))) == ["What is A?", "why B?"]
    assert one(e.query_type(F.lit("how to train it"))) == "procedural"
    assert "transformer" in one(e.expanded_terms(F.lit("attention")))
    assert {r["section"]: r["weight"] for r in one(e.intent_weights(F.lit("table of accuracy")))}["results"] == 0.018


def test_redaction(one):
    text = "Mail a.b@c.com or call 555-123-4567, id 123-45-6789."
    assert one(e.redact(F.lit(text))) == "Mail [REDACTED_EMAIL] or call [REDACTED_PHONE], id [REDACTED_SSN]."
    assert "a.b@c.com" in one(e.redact(F.lit(text), compat=True))


def test_tables(one, spark):
    rows = spark.createDataFrame([([["Model", "Accuracy", "Params"], ["A", "91.2", "3M"], ["", None]],)], "r array<array<string>>")
    clean = rows.select(e.table_rows(F.col("r")).alias("r"))
    assert clean.first()["r"] == [["Model", "Accuracy", "Params"], ["A", "91.2", "3M"]]
    md, nl, numeric = clean.select(e.table_markdown(F.col("r")), e.table_sentences(F.col("r"), F.lit(3)), e.table_is_numeric(F.col("r"))).first()
    assert md == "| Model | Accuracy | Params |\n| --- | --- | --- |\n| A | 91.2 | 3M |"
    assert nl.startswith("Table on page 3.") and "Row 1: Model=A, Accuracy=91.2, Params=3M." in nl and numeric


@pytest.mark.parametrize(
    "answer, context, field",
    [("The score is 99.9 on this benchmark for sure today.", "the score is 94.2 on this benchmark", "numeric"), ("HyperNovaEncoder works on this benchmark for sure today.", "works on this benchmark", "entity"), ("It works [missing_chunk_42] on this benchmark for sure.", "it works on this benchmark", "citation"), ("Works well.", "works well", "completeness")],
)
def test_verification_stages(one, answer, context, field):
    assert one(check.verification(F.lit(answer), F.lit(context)))[field] < 1


def test_noise_answers_are_not_supported(one):
    v_ = one(check.verification(F.lit("Example Query 2: Multi-Hop. Confidence: High. Grounding: Verified."), F.lit("anything")))
    assert not v_["supported"] and v_["confidence"] < 0.5


def test_choose_k_adds_six_on_the_first_pass(one):
    assert one(check.choose_k(F.lit(0.0), F.lit(0), F.lit("simple"))) == 18
    assert one(check.choose_k(F.lit(0.9), F.lit(3), F.lit("multi_hop"))) == 25


def test_corrective_labels(one):
    def label(q, c):
        return one(check.corrective_label(F.lit(q), F.lit(c)))

    assert label("alpha beta", "nothing shared here") == "IRRELEVANT"
    assert label("alpha beta", "alpha is not beta") == "CONTRADICTORY"
    assert label("alpha beta", "alpha and beta") == "CORRECT"


def test_self_verification(one):
    ok = one(check.self_verification(F.lit("what"), F.lit("retrieval grounds generation."), F.lit("Retrieval grounds generation."), F.array(F.lit("c1"))))
    assert ok["passed"] and ok["action"] == "none"
    bad = one(check.self_verification(F.lit("what"), F.lit("Zebra quantum entanglement [c9]."), F.lit("retrieval"), F.array(F.lit("c1"))))
    assert not bad["passed"] and bad["action"] == "re_retrieve"


def test_coverage_never_exceeds_seven_tenths(one):
    assert one(check.coverage(F.lit("alpha beta"), F.lit("alpha beta"))) == pytest.approx(0.7)


def test_vectors(one):
    a, b, q = (F.array(*(F.lit(x_) for x_ in t)) for t in ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.9, 0.1, 0.0]))
    assert one(v.cosine(a, q)) == pytest.approx(0.9939, abs=1e-4) and one(v.cosine(b, q)) == pytest.approx(0.1104, abs=1e-4)
    assert one(v.cosine(a, F.array(F.lit(1.0)))) == 0 and one(v.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]


def test_hash_embedding_against_hashlib(spark):
    import hashlib

    words = ["alpha", "beta", "alpha", "gamma"]
    for weighted, dim in ((True, 384), (False, 1024)):
        want = {}
        for w in words:
            d = hashlib.sha256(w.encode()).digest()
            sign = 1 if d[2 if weighted else 3] % 2 == 0 else -1
            i = int.from_bytes(d[:2], "big") % dim
            want[i] = want.get(i, 0) + sign * (1 + d[3] / 255 if weighted else 1)
        norm = sum(w * w for w in want.values()) ** 0.5
        df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
        got = {r.idx: r.w for r in v.hash_embedding(df, "id", "text", dim, weighted).collect()}
        assert got == pytest.approx({i: w / norm for i, w in want.items() if w})


def test_references_without_a_semicolon_stand_for_themselves(spark):
    page = "<title>a &amp; b &amp</title><article>" + "x &amp; y&amp " * 30 + "</article>"
    rows = spark.createDataFrame([(1, page), (2, "<p>a &amp; b&amp</p>")], "page_id long, html string")
    want = {1: " ".join(["x & y&amp"] * 30), 2: "a & b&amp"}
    assert {r.page_id: r.text for r in readers.main_texts(rows, "page_id", "html").collect()} == want
    assert {r.page_id: r.text for r in readers.page_backends(rows, "page_id", "html").collect()} == want


def test_sub_questions_are_parted_as_in_sql(spark):
    rows = spark.createDataFrame([("and so what, or not",), ("éand b",), ("one and and two",), ("this and that; more",)], "q string")
    assert [r[0] for r in rows.select(e.sub_questions(F.col("q"))).collect()] == [["and so what?", "or not?"], ["éand b"], ["one?", "and two?"], ["this?", "that?", "more?"]]


def test_hash_vectors_join_rows_of_a_key_and_exchange_no_texts(spark):
    rows = spark.createDataFrame([("a", "x y"), ("a", "x z"), ("b", None), ("c", "!"), (None, "x x")], "k string, t string")
    once = spark.createDataFrame([("a", "x y x z"), (None, "x x")], "k string, t string")
    got, want = (sorted(((r.k, r.idx, round(r.w, 12)) for r in v.hash_embedding(d, "k", "t", 64).collect()), key=repr) for d in (rows, once))
    assert got == want and len(got) > 1
    assert "Exchange" not in v.hash_embedding(once, "k", "t", 64)._jdf.queryExecution().executedPlan().toString()

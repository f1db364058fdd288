import random
import zlib

from helpers import SF, documents

from siltstone.llm import language
from siltstone.llm.automata import SuffixAutomaton


def test_automaton_against_brute_force():
    text = "abracadabra"
    a = SuffixAutomaton(text)
    for q in ("cadab", "xbrac", "aaaa", "abrak", ""):
        want = [max(n for n in range(i + 2) if q[i + 1 - n : i + 1] in text) for i in range(len(q))]
        assert a.statistics(q) == want
        at = phrases = 0
        while at < len(q):
            n = max(k for k in range(len(q) - at + 1) if q[at : at + k] in text)
            at, phrases = at + max(n, 1), phrases + 1
        assert a.phrases(q) == phrases


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    got = language.op4_language_id(spark, SF.replace("0.001", "0.01")).collect()
    assert {r.doc_id for r in got} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in out) / len(out) > 0.97


def test_odd_rows(spark):
    df = documents(spark, [(1, None), (1, ""), (2, "1 2 3 !"), (3, "word"), (3, "word"), (None, "word")])
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(df, {"en": "some word here", "de": "ein ganz anderes wort"}).collect())
    assert got == [(0, "en"), (1, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en")]
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.sample(df.limit(0)) == {} and language.identify(df.limit(0), {}).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    words = {f"l{n:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for n in range(70)}
    rows = [(1000 * n + i, " ".join(rng.choices(own, k=20)), lang) for n, (lang, own) in enumerate(words.items()) for i in range(6 if n else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = language.sample(docs)
    assert set(texts) == set(words) and sum(map(len, texts.values())) <= language.TOTAL_CHARS
    truth = {d: lang for d, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in language.identify(docs, texts).collect())


def test_texts_teach_beyond_their_opening(spark):
    head = "the same english header opens each and every page " * 40
    rows = [(i, head + "une phrase entièrement française continue ici longtemps " * 200, "fr") for i in range(10)] + [(100 + i, "this is the plain english header of a page " * 30, "en") for i in range(10)]
    texts = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "entièrement française" in texts["fr"] and len(texts["fr"]) <= language.SAMPLE_CHARS
    assert not set(texts["fr"].split()) - set(f"{head} {rows[0][1]}".split())
    got = language.identify(spark.createDataFrame([(1, "une phrase française ici")], "doc_id long, text string"), texts).first()
    assert got.lang_pred == "fr"


def test_rows_of_one_id_or_of_none_teach_in_a_bounded_sample(spark):
    rows = [(None, f"rien que des mots sans numéro {i}", "fr") for i in range(3000)] + [(7, f"one id for all of these {i}", "en") for i in range(3000)] + [(8, "the same row again and again", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = language.sample(docs)
    assert 20 < texts["fr"].count("rien") < 400 and texts["en"].count("again and again") <= 1

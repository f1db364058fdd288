import zlib

import numpy as np
import pytest
from helpers import SF, documents

from siltstone.llm import toxicity


@pytest.fixture(scope="module")
def channel():
    c = toxicity.codes(" the idiot and the moron are stupid losers in the trash of disgusting worthless scum " * 20)
    return toxicity.Channel(np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3))


@pytest.mark.parametrize("text, word", [("1d10t", "idiot"), ("an id.i.ot!", "idiot"), ("w0rthl3ss", "worthless"), ("stuuuupid", "stupid"), ("you $cum", "scum"), ("s t u p i d", "stupid"), ("STUPID", "stupid")])
def test_channel_restores(channel, text, word):
    assert word in channel.words(text)


def test_plain_words_pass_unchanged(channel):
    assert channel.words("The quick brown fox, and 12 dogs.") == {"the", "quick", "brown", "fox", "and", "dogs"}


def test_viterbi_against_all_paths(channel):
    import itertools

    def cost(path):
        p = q = 0
        total, out = 0.0, ""
        for c, extra in path:
            total += extra
            if c:
                k = ord(c) - 96
                total += channel.cost[p][q][k]
                p, q, out = q, k, out + c
        return total + channel.cost[p][q][0], out

    for word in ("1d10t", "m0r0n", "l0oo0ser", "s-c.um"):
        want = min(cost(path) for path in itertools.product(*channel.lattice(word)))
        assert channel._viterbi(word) == want[1]


def test_trigram_counts_cover_all_documents(spark):
    df = documents(spark, [(1, "abc"), (2, None), (3, "Ünd abc")])
    want = np.zeros(28**3, int)
    for t in ("abc", "", "Ünd abc"):
        c = toxicity.codes(f" {t} ")
        for x in zip(c, c[1:], c[2:]):
            want[x[0] * 784 + x[1] * 28 + x[2]] += 1
    assert (toxicity.count_trigrams(df) == want).all()


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op5_toxicity(spark, sf).collect()
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    found = sum(r.predicted and labels[r.doc_id] for r in out)
    assert found / sum(labels[r.doc_id] for r in out) > 0.8 and found / sum(r.predicted for r in out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_odd_rows(spark):
    df = documents(spark, [(1, None), (1, ""), (None, "x"), (2, "y" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, none)
    assert [r.score < 0.5 for r in toxicity.score(df, model).collect()] == [True] * 4
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), none)).count() == 0


@pytest.mark.parametrize("text, word", [("scum5", "scum"), ("some m0r0n5 there", "morons"), ("57up1d", "stupid"), ("57upid", "stupid"), ("id107!", "idiot"), ("l0$3", "lose"), ("stu" + "p" * 40 + "id", "stupid"), ("y o u  s t u p i d  w o r t h l e s s  i d i o t  a n d  t h e  m o r o n", "worthless"), ("y o u a r e a s t u p i d w o r t h l e s s i d i o t", "worthless")])
def test_long_and_trailing_disguises_are_restored(text, word):
    c = toxicity.codes(" the idiot and the moron or morons are stupid losers who lose in the trash of disgusting worthless scum " * 20)
    model = toxicity.Model(np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=28**3), {word: 9.0}, -4.0)
    assert word in model.channel.words(text) and model.score(text) > 0.5


def test_decoding_is_linear_and_keeps_plain_words(channel):
    import time

    start = time.monotonic()
    assert "moron" in channel.words("moron " + "m0r0n" * 20_000)
    for run in ("-" * 100_000, "$" * 100_000 + " ", "a" + "-" * 100_000, "_" * 200 + "ab", "a b " * 50_000):
        channel.words(f"m0r0n {run}")
    assert {"covid", "page"} <= channel.words("covid19, page3") and time.monotonic() - start < 20

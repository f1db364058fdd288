import hashlib
import random

import numpy as np
import pytest
from helpers import SF, documents

from siltstone.llm import bpe
from siltstone.llm.automata import WordAutomaton

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    with open(bpe.tokenizer_file(), encoding="utf-8") as f:
        spec = f.read()
    return bpe.Coder(spec, bpe.compile_lexicon(bpe.Vocabulary(spec), ("zebra crossing", "erthtion"))), tokenizers.Tokenizer.from_file(bpe.tokenizer_file())


def test_word_automaton_numbers_every_word_and_shares_suffixes():
    words = sorted({b"nation", b"station", b"ration", b"rat", b"", b"st"})
    flat = WordAutomaton(words).flat()
    assert len(flat["final"]) < sum(map(len, words))


def test_equal_to_the_library(pair):
    own, library = pair
    rng = random.Random(3)
    letters = "ab cd\n\t\x1c\x85 　é1２'s'll#日本\U0001d4b3́\x00\r"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, "erthtion" * 300, " " * 3000]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == want
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_query(spark, pair):
    got = {r.doc_id: r for r in bpe.op10_bpe_codec(spark, SF).collect()}
    library = pair[1]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(spark):
    df = documents(spark, [(1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "c")])
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe.encode_documents(df, bpe.tokenizer_file()).collect())
    assert [x[2] for x in got] == ["", "", "a b", "a b", "c"]
    assert bpe.encode_documents(df.limit(0), bpe.tokenizer_file()).count() == 0

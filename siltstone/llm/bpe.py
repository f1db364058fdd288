"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The lexicon maps words (pre-tokens) to their ids: the frequent words are those that the vocabulary itself holds, and
callers may add more. It is a shared-suffix automaton whose words are numbered, with the ids in one array by number;
workers write its arrays once, map the file into memory and unlink it at once, so nothing stays behind. A word that the
lexicon lacks is merged exactly, by rank. A bounded cache stands before both.

Defined results: null text is encoded as empty (0 ids); empty text likewise; repeated rows and repeated doc_id stay as
rows of their own; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.automata import WordAutomaton
from siltstone.llm.common import table

#: Words kept by the cache of one worker, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 400_000, 40
_WS = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern (fixed by the vocabulary), with white space spelled out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from code 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(c): b for c, b in zip(shown + [256 + i for i in range(len(hidden))], shown + hidden, strict=True)}


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, self.alphabet = d["model"], byte_alphabet()
        self.raw = lambda token: bytes(self.alphabet[c] for c in token)
        ids = model["vocab"]
        self.ids = {self.raw(t): i for t, i in ids.items()}
        self.bits = len(ids).bit_length()
        #: Of a pair, first id << bits | second id: rank << bits | merged id.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << self.bits | ids[b]] = rank << self.bits | ids[a + b]
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.bytes_of = dict(zip(self.ids.values(), self.ids, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        self.unit = [self.ids[bytes([b])] for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest-ranked pair is merged first, the leftmost of equals."""
        bits, mask, never = self.bits, (1 << self.bits) - 1, 1 << 62
        find, ids = self.merges.get, [self.unit[b] for b in word]
        n = len(ids)
        best = [find(a << bits | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        if n <= 64:
            while best and (least := min(best)) != never:
                i = best.index(least)
                ids[i] = least & mask
                del ids[i + 1], best[i]
                if i < len(best):
                    best[i] = find(ids[i] << bits | ids[i + 1], never)
                if i:
                    best[i - 1] = find(ids[i - 1] << bits | ids[i], never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i, m in enumerate(best) if m != never]
        heapq.heapify(heap)
        while heap:
            m, i, first, second = heapq.heappop(heap)
            j = after[i]
            if ids[i] != first or j >= n or ids[j] != second:
                continue
            ids[i], ids[j] = m & mask, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := find(ids[k] << bits | ids[after[k]], never)) != never:
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]


def compile_lexicon(vocabulary: Vocabulary, words: tuple[str, ...] = ()) -> bytes:
    """The transducer of the vocabulary's own words, and of ``words``, as one block of int32 arrays with a header."""
    chosen = {}
    for w in {*vocabulary.ids, *(x.encode() for x in words)}:
        try:
            whole = PIECES.findall(w.decode())
        except UnicodeDecodeError:
            continue
        if len(whole) == 1:
            chosen[w] = vocabulary.merge(w)
    ordered = sorted(chosen)
    flat = WordAutomaton(ordered).flat()
    starts = np.cumsum([0, *(len(chosen[w]) for w in ordered)])
    parts = [*(np.asarray(flat[k]) for k in ("first", "label", "target", "skip", "final")), starts, np.asarray([i for w in ordered for i in chosen[w]])]
    return b"".join([np.asarray([len(p) for p in parts], "<i4").tobytes(), *(np.asarray(p, "<i4").tobytes() for p in parts)])


class Lexicon:
    """Reads a compiled transducer through a memory map."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # unlinked from the start; the map keeps it alive
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, "<i4", 7)
        at, parts = 28, []
        for n in sizes:
            parts.append(memoryview(self.map)[at : at + 4 * int(n)].cast("i"))
            at += 4 * int(n)
        self.first, self.label, self.target, self.skip, self.final, self.starts, self.ids = parts

    def get(self, word: bytes) -> list[int] | None:
        first, label = self.first, self.label
        s = rank = 0
        for x in word:
            a, b = first[s], first[s + 1]
            while a < b and label[a] < x:
                a += 1
            if a == b or label[a] != x:
                return None
            rank += self.skip[a]
            s = self.target[a]
        return list(self.ids[self.starts[rank] : self.starts[rank + 1]]) if self.final[s] else None


class Coder(dict):
    """Text to ids and back. As a dictionary it is the bounded cache of words; what it held before is its second chance."""

    def __init__(self, spec: str, block: bytes):
        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        self.vocabulary, self.lexicon = Vocabulary(spec), Lexicon(block)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.table = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(self.vocabulary.bytes_of) + 1)]

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            raw = word.encode()
            ids = self.lexicon.get(raw)
            found = tuple(self.vocabulary.merge(raw) if ids is None else ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        at = 0
        for hit in self.special.finditer(text):
            self._encode(text[at : hit.start()], ids)
            ids.append(self.vocabulary.special[hit[0]])
            at = hit.end()
        self._encode(text[at:] if at else text, ids)
        return np.asarray(ids, "<u4")

    def _encode(self, text: str, ids: list[int]) -> None:
        if len(text) < 1 << 20:
            for found in map(self.__getitem__, PIECES.findall(text)):
                ids += found
        else:
            for piece in PIECES.finditer(text):
                ids += self[piece[0]]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _coder(key: str, spec, block) -> Coder:
    return Coder(spec.value, block.value)


class _Held:
    """A broadcast, hashed by what it holds, so that a worker builds its coder once."""

    def __init__(self, sent, key: str):
        self.sent, self.key = sent, key

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.sent.value


def encode_documents(docs: DataFrame, tokenizer_path: str, digests: bool = False, words: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, decoded; with ``digests``: doc_id, n_tokens, ids_sha256, decoded_sha256. The file is read by the driver."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    block = compile_lexicon(Vocabulary(spec), words)
    key = hashlib.sha256(spec.encode() + block).hexdigest()
    spec_sent, block_sent = (_Held(spark.sparkContext.broadcast(x), key) for x in (spec, block))
    kind = pa.schema([("doc_id", pa.int64()), *([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int64())), ("decoded", pa.string())])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, spec_sent, block_sent)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) if digests else (ids.astype("i8"), decoded))
            columns = list(zip(*rows, strict=True)) or [()] * (len(kind) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(columns, list(kind)[1:], strict=True))], schema=kind)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<long>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(code, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file(), digests=True)

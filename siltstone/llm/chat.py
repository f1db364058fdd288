"""Chat formatting by a grammar round trip.

A conversation renders as a sequence of turn segments::

    <|turn|>ROLE<|body|>TEXT<|end|>\\n

Control strings inside roles and texts are escaped by one backslash after their first character, which is
reversible whatever the text holds (a run of k backslashes there becomes k + 1). Every rendered segment is parsed
again by a deterministic parser; a segment is escaped only when its plain form does not come back identical or
holds a control string.

Defined results: null role or text counts as empty; turns sort by (turn, role, text), nulls first, so ties and
repeated rows have a fixed order and are kept; a null conv_id is one conversation of its own; no rows give no rows;
columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Strings that steer a model or this grammar (fixed values).
CONTROL = ("<|turn|>", "<|body|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_rests = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_escape = re.compile(rf"([<\[])(\\*)(?=(?:{_rests}))")
_unescape = re.compile(rf"([<\[])\\(\\*)(?=(?:{_rests}))")
_segment = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _escape.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2", text)


def render_turn(role: str, text: str) -> str:
    """The segment of one turn, checked by parsing it again."""
    plain = f"{TURN}{role}{BODY}{text}{END}"
    if not _escape.search(role) and not _escape.search(text) and list(parse(plain)) == [(role, text)]:
        return plain
    escaped = f"{TURN}{escape(role)}{BODY}{escape(text)}{END}"
    if list(parse(escaped)) != [(role, text)]:
        raise AssertionError("the turn does not survive the round trip")
    return escaped


def parse(rendered: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; raises ValueError where the text leaves the grammar."""
    at = 0
    while at < len(rendered):
        found = _segment.match(rendered, at)
        if not found:
            raise ValueError(f"not a turn at {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, seq, segment, loss_start, loss_end: the rendered turns, in order within each conversation.

    loss_start and loss_end are code points of the segment (null for turns other than the assistant's). Rows of a
    conversation lie in one partition, sorted; they are streamed, so a long conversation needs no memory of its size.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seq = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                seq = seq + 1 if conv == last else 0
                last = conv
                segment = render_turn(role, text)
                end = len(segment) - len(END)
                start = segment.index(BODY) + len(BODY)
                loss = (start, end) if role == "assistant" else (None, None)
                out.append((conv, seq, segment, *loss))
            frame = pd.DataFrame(out, columns=["conv_id", "seq", "segment", "loss_start", "loss_end"])
            yield frame.astype({"conv_id": "Int64", "loss_start": "Int64", "loss_end": "Int64"})

    return dealt.mapInPandas(render, "conv_id long, seq long, segment string, loss_start long, loss_end long")


def digest(segments: DataFrame) -> DataFrame:
    """Per conversation, from the rendered segments alone (see op2_chat_formatting)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []

        def close() -> tuple:
            conv, turns, sha, loss, loss_sha, chars = now
            return conv, turns, sha.hexdigest(), loss, loss_sha.hexdigest(), chars

        for batch in batches:
            out = []
            columns = (batch["conv_id"].astype("Int64"), batch["seq"], batch["segment"], batch["loss_start"].astype("Int64"), batch["loss_end"].astype("Int64"))
            for conv, seq, segment, start, end in zip(*columns, strict=True):
                if seq == 0:
                    if now:
                        out.append(close())
                    now = [None if conv is pd.NA else int(conv), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if start is not pd.NA:
                    learned = unescape(segment[int(start) : int(end)])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(segment)
            yield frame(out)
        if now:
            yield frame([close()])

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return segments.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digest(format_turns(rows))


#: The digests of the source rows, which the parsed output must equal; formatted_chars counts the markers and one
#: backslash for each control string.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, '<(\\*)(\|turn\|>|\|body\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])|\[(\\*)(\|turn\|>|\|body\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])' AS p FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, p)) + len(regexp_extract_all(role, p))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|turn|>role<|text|>text<|end|>`` per turn. The three marks are special tokens of the
encoder, so no token reaches over a mark. Control strings inside a text (``CONTROLS``) are broken by a backslash after
their first character and backslashes are doubled, which is undone exactly; roles are percent-encoded.

The rendering is encoded once, with offsets. The text spans of the assistant's turns and the token offsets are both
sorted, so the tokens of a span are found by two binary searches; their ranges are the loss mask.

Long conversations are cut at borders of turns: turns are dealt by conversation and block of ``BLOCK_TURNS`` turn
numbers, and a task closes a segment beyond ``SEGMENT_CHARS`` characters. So a conversation of any length is rendered by
many tasks and none holds more than a segment; as no token reaches over a mark, the ids are those of the whole.

Defined cases: a null text or role is empty; turns are ordered by turn number (null first), role and text, and repeated
rows stay; a null conversation id is a conversation of its own; an empty table has no segments.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates.
CONTROLS = [
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|im_sep|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|user|>",
    "<|assistant|>", "<|system|>", "<|endoftext|>", "<|startoftext|>", "<start_of_turn>", "<end_of_turn>", TURN, TEXT, END,
]
LOSS_ROLE = "assistant"
BLOCK_TURNS = 64
SEGMENT_CHARS = 1 << 18

_BREAK = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROLS) + ")(.)", re.S)
_UNDO = re.compile(r"\\(\\?)")
_PARSED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character spans of the texts under the loss, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{quote(role, safe='')}{TEXT}", escape(text)
        parts += [head, body, END]
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unquote(role), unescape(text)) for role, text in _PARSED.findall(formatted)]


@lru_cache(maxsize=2)
def chat_encoder(path: str):
    """The byte-level encoder with the three marks as special tokens and offsets that keep white space."""
    from tokenizers import AddedToken, Tokenizer, processors

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    tool.post_processor = processors.ByteLevel(trim_offsets=False)
    tool.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
    return tool


def align(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each sorted span the range of tokens whose offsets lie in it; an empty span has an empty range."""
    starts = [a for a, _ in offsets]
    return [(bisect_left(starts, a), bisect_left(starts, b)) for a, b in spans]


SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
    ("token_ids", pa.list_(pa.int32())),
    ("loss", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
])
SEGMENTS_DDL = ("conv_id long, block long, part long, formatted string, token_ids array<int>, "
                "loss array<struct<first:int,end:int>>")


def _segment(path: str, key: tuple, part: int, turns: list[tuple[str, str]]) -> pa.RecordBatch:
    formatted, spans = render(turns)
    encoding = chat_encoder(path).encode(formatted, add_special_tokens=False)
    loss = [{"first": a, "end": b} for a, b in align(encoding.offsets, spans)]
    row = {"conv_id": key[0], "block": key[1], "part": part, "formatted": formatted, "token_ids": encoding.ids, "loss": loss}
    return pa.RecordBatch.from_pylist([row], SEGMENTS)


def _render_sorted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, part, turns, size = None, 0, [], 0
    for batch in batches:
        for conv, block, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            role, text = role or "", text or ""
            if turns and ((conv, block) != key or size >= SEGMENT_CHARS):
                yield _segment(path, key, part, turns)
                part = part + 1 if (conv, block) == key else 0
                turns, size = [], 0
            elif (conv, block) != key:
                part = 0
            key = (conv, block)
            turns.append((role, text))
            size += len(text)
    if turns:
        yield _segment(path, key, part, turns)


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Segments of formatted conversations: text, token ids, and token ranges under the loss (one per assistant turn)."""
    prepare(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62))).alias("block"),
        F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(partial(_render_sorted, tokenizer), SEGMENTS_DDL)


DIGESTS_DDL = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long, n_tokens long, loss_tokens long")


def _digest_sorted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = chat_encoder(path)
    names = [c.split()[0] for c in DIGESTS_DDL.split(", ")]
    key, state, started = None, None, False
    rows: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            if not started or row["conv_id"] != key:
                if started:
                    rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
                key, started = row["conv_id"], True
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text in parse(row["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(tool.decode(row["token_ids"][span["first"]:span["end"]], skip_special_tokens=False))
                state[2] += len(text)
                state[3].update(text.encode())
                state[6] += span["end"] - span["first"]
            state[4] += len(row["formatted"])
            state[5] += len(row["token_ids"])
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
            rows = []
    if started:
        rows.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def digests(segments: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, read back from its segments. A digest of a whole is taken in order, so the segments of one
    conversation pass through one task, as a stream of which only the hash states are kept."""
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return dealt.mapInArrow(partial(_digest_sorted, tokenizer), DIGESTS_DDL)

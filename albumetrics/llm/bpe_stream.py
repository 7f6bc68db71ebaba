"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A piece of text is a run that the tokenizer's own pattern keeps together. Within a piece, merges are applied to a
window of symbols. A border between two tokens can only be undone by what follows within a fixed distance; that
distance, the sufficient lookahead, follows from the merge list:

* A rule ``(u, v)`` is undone at the right edge of ``v`` only by an earlier rule whose left operand ends there, that is
  by one whose left operand lies on the right spine of ``v`` (``v``, its right part, the right part of that, ...).
* So the rule looks ``ext(u, v) = max(len(v') + ext(u', v'))`` symbols beyond ``v``, over those earlier rules.
* The lookahead is the greatest ``len(v) + ext(u, v)`` of any rule.

A border with that many symbols after it is final: the tokens before it are emitted and forgotten, so memory does not
grow with the piece. Short pieces recur; their tokens are kept in a bounded memo.

Decoding is a state machine: ids become bytes, bytes become text as soon as a character is complete.

Defined cases: a null or empty text has no tokens and decodes to the empty text; strings of special tokens in a text
become their ids, as in the library; rows keep their order within a task, and repeated rows give repeated results.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache, partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import Memo, by_slices, prepare

#: White space as Unicode defines it (Python's own set also has four separators that are not in it).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SEGMENT_CHARS = 1 << 16
MEMO_CHARS = 64
NEVER = 1 << 30


@cache
def char_class(initial: str, end: int = 0x110000) -> str:
    """All characters below ``end`` of a general category, as the inside of a character class."""
    ranges, start = [], None
    for code in range(end + 1):
        inside = code < end and unicodedata.category(chr(code))[0] == initial
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append((start, code - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class MergeList:
    """Vocabulary, merges and special tokens of a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + suffix] for s in symbols]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.rules: list[tuple[int, int, int]] = []
        for left, right in model["merges"]:
            self.rules.append((self.vocab[left], self.vocab[right], self.vocab[left + right]))
        # One key per pair: no id reaches 2**20.
        self.rank = {(a << 20) | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        self.made = [made for _, _, made in self.rules]
        self.width = dict.fromkeys([*self.inner, *self.final], 1)
        for a, b, made in self.rules:
            self.width[made] = self.width[a] + self.width[b]
        self.lookahead = self._sufficient_lookahead()
        self.longest = max(self.width.values())

    def _sufficient_lookahead(self) -> int:
        spine: dict[int, set[int]] = {}
        reach: dict[int, int] = {}
        for a, b, made in self.rules:
            edge = spine.get(b, {b})
            ext = max(reach.get(token, 0) for token in edge)
            reach[a] = max(reach.get(a, 0), self.width[b] + ext)
            spine.setdefault(made, {made}).update(edge)
        return max(reach.values(), default=0)

    def merge(self, ids: Iterable[int]) -> list[int]:
        """Apply the merges to a window: the earliest rule first, its leftmost place first."""
        rank, made = self.rank.get, self.made
        ids = list(ids)
        found = [rank((a << 20) | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == NEVER:
                break
            k = found.index(best)
            ids[k:k + 2] = (made[best],)
            del found[k]
            if k < len(found):
                found[k] = rank((ids[k] << 20) | ids[k + 1], NEVER)
            if k:
                found[k - 1] = rank((ids[k - 1] << 20) | ids[k], NEVER)
        return ids


class PieceTransducer:
    """Symbols of one piece in, tokens out as soon as nothing that follows can change them."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self._merges = merges
        self._window = window or 4 * (merges.lookahead + merges.longest)
        self._held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for symbol in symbols:
            self._held.append(symbol)
            if len(self._held) >= self._window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        tokens = self._merges.merge(self._held)
        final = len(self._held) - self._merges.lookahead
        out = end = 0
        for token in tokens:
            if end + self._merges.width[token] > final:
                break
            end += self._merges.width[token]
            out += 1
        yield from tokens[:out]
        self._held = self._held[end:]

    def finish(self) -> Iterator[int]:
        yield from self._merges.merge(self._held)
        self._held = []


class TextDecoder:
    """Ids in, text out: bytes of a character are held until the character is complete."""

    def __init__(self, merges: MergeList, table: list[bytes]):
        self._table = table
        self._joint = b"" if merges.decoder == "ByteLevel" else b" "
        self._started = False
        self._bytes = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        data = self._joint.join(map(self._table.__getitem__, ids))
        if data and self._started:
            data = self._joint + data
        self._started |= bool(data)
        return self._bytes.decode(data)

    def finish(self) -> str:
        return self._bytes.decode(b"", True)


class Encoder:
    """Whole texts to ids, with the normalisation and pieces of ``word_bpe_49k.json``."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self._memo = Memo(self._piece, 200_000)
        # Two forms of one pattern: classes that end at U+00FF are much quicker, and most texts have nothing beyond.
        self._pieces, self._narrow_pieces = (
            re.compile(f"[{x}]+|[{d}]|'(?:s|t|re|ve|m|ll|d)|[^{WHITE}{x}{d}]+")
            for x, d in ((char_class("L", end), char_class("N", end)) for end in (0x110000, 0x100))
        )
        self._wide = re.compile("[^\x00-\xff]")
        self._specials = re.compile("|".join(re.escape(s) for s in sorted(self.merges.special, key=len, reverse=True)))
        self._cut = re.compile(f"[{WHITE}]")
        size = max(self.merges.strings) + 1
        self.decimal = [b"%d" % i for i in range(size)]
        if self.merges.decoder == "ByteLevel":
            value = {s: b for b, s in enumerate(byte_symbols())}
            self.bytes = [bytes(value[c] for c in self.merges.strings.get(i, "") if c in value) for i in range(size)]
        else:
            self.bytes = [self.merges.strings.get(i, "").encode() for i in range(size)]

    def _symbols(self, piece: str) -> list[int]:
        data = piece.encode()
        symbols = [self.merges.inner[byte] for byte in data]
        symbols[-1] = self.merges.final[data[-1]]
        return symbols

    def _stream(self, piece: str) -> Iterator[int]:
        machine = PieceTransducer(self.merges)
        yield from machine.feed(self._symbols(piece))
        yield from machine.finish()

    def _piece(self, piece: str) -> tuple[int, ...]:
        # No longer than a window, so that nothing is final before its end.
        return tuple(self.merges.merge(self._symbols(piece)))

    def _plain(self, text: str) -> Iterator[Iterable[int]]:
        for segment in self._segments(text):
            if not unicodedata.is_normalized("NFC", segment):
                segment = unicodedata.normalize("NFC", segment)
            # Lower case is taken character by character, without the context that a final sigma has.
            segment = segment.lower() if "Σ" not in segment else "".join(c.lower() for c in segment)
            pieces = (self._pieces if self._wide.search(segment) else self._narrow_pieces).findall(segment)
            if len(max(pieces, key=len, default="")) <= MEMO_CHARS:
                yield chain.from_iterable(map(self._memo.__getitem__, pieces))
            else:
                yield from (self._memo[piece] if len(piece) <= MEMO_CHARS else self._stream(piece) for piece in pieces)

    def _segments(self, text: str) -> Iterator[str]:
        """Parts cut at white space, where no piece and no composition can reach across."""
        start = 0
        while len(text) - start > SEGMENT_CHARS:
            found = self._cut.search(text, start + SEGMENT_CHARS)
            if found is None:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    def _runs(self, text: str) -> Iterator[Iterable[int]]:
        start = 0
        if "<|" in text:
            for found in self._specials.finditer(text):
                yield from self._plain(text[start:found.start()])
                yield (self.merges.special[found[0]],)
                start = found.end()
        yield from self._plain(text[start:] if start else text)

    def tokens(self, text: str) -> Iterator[int]:
        """The ids of ``text``, each as soon as it is final."""
        return chain.from_iterable(self._runs(text))

    def encode(self, text: str) -> list[int]:
        return list(self.tokens(text))

    def decode(self, ids: list[int], block: int = 1 << 14) -> str:
        machine = TextDecoder(self.merges, self.bytes)
        return "".join([*(machine.feed(ids[k:k + block]) for k in range(0, len(ids), block)), machine.finish()])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_batch(path: str, ids: list, texts: list[str]) -> pa.RecordBatch:
    tool = encoder(path)
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids, pa.int64()),
        "token_ids": pa.array([tool.encode(t) for t in texts], pa.list_(pa.int32())),
    })


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``token_ids array<int>``: one row per row of ``docs``; other columns are left out."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(by_slices(partial(_encode_batch, path)), "id long, token_ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _digest_batch(path: str, ids: list, texts: list[str]) -> pa.RecordBatch:
    tool = encoder(path)
    counts, id_hashes, text_hashes = [], [], []
    for text in texts:
        tokens = tool.encode(text)
        counts.append(len(tokens))
        id_hashes.append(hashlib.sha256(b" ".join(map(tool.decimal.__getitem__, tokens))).hexdigest())
        text_hashes.append(hashlib.sha256(tool.decode(tokens).encode()).hexdigest())
    return pa.RecordBatch.from_pydict({
        "id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
        "ids_sha256": id_hashes, "decoded_sha256": text_hashes,
    })


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, number of tokens, digest of the ids and digest of what they decode to; one row per row of ``docs``."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(
        by_slices(partial(_digest_batch, path)),
        "id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out.withColumnRenamed("id", id_col)

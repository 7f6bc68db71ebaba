"""Token ids in files of shuffled planes.

File layout, integers little-endian:

* ``PLN1``, then the chunks. A chunk holds a fixed number of ids (the last may hold fewer). Its ids are transposed into
  byte planes (or bit planes) and each plane is one zstandard frame, lowest plane first.
* The footer, one zstandard frame: a JSON header (plane kind, chunk size, counts) and three arrays: byte length of every
  plane of every chunk, ids of the documents, numbers of ids of the documents. A plane starts where the one before ends,
  so the lengths are the chunk index.
* The footer's length (8 bytes) and ``PLN1``.

Writing: documents are dealt by range of their id, so that file k precedes file k + 1; a task streams its range into one
file of its own name and returns a manifest row. Only files in the manifest count: a task that runs again leaves an
unlisted file and nothing else. Reading streams chunk by chunk, and finds a chunk through the index.

Encoding goes through the tokenizers library. In texts whose characters are all below U+0100 and that hold no special
string, pieces recur: each distinct piece is encoded once and remembered in a bounded memo. Any other text is encoded
whole.

Defined cases: a null or empty text has the end id alone; a null document id is stored as such and comes first;
repeated document ids keep all their rows, ordered by a hash of the text and the text; an empty table writes no file
and reads as no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from albumetrics.llm.bpe_stream import WHITE, char_class
from albumetrics.llm.common import Memo, prepare, slices
from albumetrics.sources.shared_files import locate
from albumetrics.sources.workspace import materialize, new_path

MAGIC = b"PLN1"
CHUNK_IDS = 1 << 16
NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """32-bit ids as 4 byte planes or 32 bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return locate(uri if ":" in uri else os.path.abspath(uri))


class PlaneWriter:
    """Streams documents into one file; holds one chunk of ids and 16 bytes per document."""

    def __init__(self, uri: str, kind: str = "byte", chunk: int = CHUNK_IDS, level: int = 3):
        filesystem, path = _store(uri)
        filesystem.create_dir(os.path.dirname(path), recursive=True)
        self._out = filesystem.open_output_stream(path)
        self._out.write(MAGIC)
        self._kind, self._chunk = kind, chunk
        self._zip = zstandard.ZstdCompressor(level=level)
        self._held: list[np.ndarray] = []
        self._n_held = self.n_tokens = 0
        self._lengths: list[int] = []
        self._docs: list[int] = []
        self._counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append(NULL_ID if doc_id is None else doc_id)
        self._counts.append(len(ids))
        self.n_tokens += len(ids)
        self._held.append(ids)
        self._n_held += len(ids)
        if self._n_held >= self._chunk:
            ids = np.concatenate(self._held)
            whole = len(ids) // self._chunk * self._chunk
            for start in range(0, whole, self._chunk):
                self._flush(ids[start:start + self._chunk])
            self._held, self._n_held = [ids[whole:]], len(ids) - whole

    def _flush(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self._kind):
            data = self._zip.compress(plane)
            self._lengths.append(len(data))
            self._out.write(data)

    def close(self) -> None:
        if self._n_held:
            self._flush(np.concatenate(self._held))
        head = json.dumps({"kind": self._kind, "chunk": self._chunk, "tokens": self.n_tokens,
                           "planes": len(self._lengths), "docs": len(self._docs)}).encode()
        footer = self._zip.compress(b"".join([
            len(head).to_bytes(4, "little"), head, np.array(self._lengths, "<u4").tobytes(),
            np.array(self._docs, "<i8").tobytes(), np.array(self._counts, "<u8").tobytes(),
        ]))
        self._out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self._out.close()


class PlaneReader:
    """Random access by chunk, and documents in order."""

    def __init__(self, uri: str):
        filesystem, path = _store(uri)
        self._in = filesystem.open_input_file(path)
        size = self._in.size()
        tail = self._in.read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole plane file")
        length = int.from_bytes(tail[:8], "little")
        data = zstandard.ZstdDecompressor().decompress(self._in.read_at(length, size - 12 - length))
        n = int.from_bytes(data[:4], "little")
        self.head = json.loads(data[4:4 + n])
        at = 4 + n
        lengths = np.frombuffer(data, "<u4", self.head["planes"], at).astype(np.int64)
        at += 4 * self.head["planes"]
        self.doc_ids = np.frombuffer(data, "<i8", self.head["docs"], at)
        self.counts = np.frombuffer(data, "<u8", self.head["docs"], at + 8 * self.head["docs"]).astype(np.int64)
        self._starts = np.concatenate([[0], np.cumsum(lengths)]) + len(MAGIC)
        self._per_chunk = 4 if self.head["kind"] == "byte" else 32
        self.n_chunks = len(lengths) // self._per_chunk

    def chunk(self, k: int) -> np.ndarray:
        unzip = zstandard.ZstdDecompressor()
        first = k * self._per_chunk
        edges = self._starts[first:first + self._per_chunk + 1]
        data = self._in.read_at(int(edges[-1] - edges[0]), int(edges[0]))
        planes = [unzip.decompress(data[a - edges[0]:b - edges[0]]) for a, b in zip(edges, edges[1:])]
        return from_planes(planes, min(self.head["chunk"], self.head["tokens"] - k * self.head["chunk"]), self.head["kind"])

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document with its ids in parts, none longer than a chunk; take them in order."""
        k, ids, at = -1, np.empty(0, np.uint32), 0

        def parts(count: int) -> Iterator[np.ndarray]:
            nonlocal k, ids, at
            while count:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.chunk(k)
                part = ids[at:at + count]
                at += len(part)
                count -= len(part)
                yield part

        for doc_id, count in zip(self.doc_ids.tolist(), self.counts.tolist()):
            yield (None if doc_id == NULL_ID else doc_id), parts(count)

    def close(self) -> None:
        self._in.close()


class LibraryEncoder:
    """Texts to arrays of ids through the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(path)
        self._tool.no_truncation()
        self._tool.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"].get("end_of_word_suffix")
        letters, digits = char_class("L", 0x100), char_class("N", 0x100)
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        #: Pieces are known only for this pattern; with any other, texts are encoded whole.
        self._by_piece = bool(suffix) and (parts[0].get("pattern") or {}).get("Regex") == pattern
        self._pieces = re.compile(f"[{letters}]+|[{digits}]|'(?:s|t|re|ve|m|ll|d)|[^{WHITE}{letters}{digits}]+")
        self._other = re.compile("[^\\x00-\\xff]|<\\|")
        size = self._tool.get_vocab_size(with_added_tokens=True)
        self._ends = np.zeros(size, bool)
        for token, k in spec["model"]["vocab"].items():
            self._ends[k] = bool(suffix) and token.endswith(suffix)
        self._memo = Memo(self._one, 200_000)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tool.encode(text, add_special_tokens=False).ids, "<u4")

    def _one(self, piece: str) -> bytes:
        return self.whole(piece).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces in one call; the ids that end a word part them."""
        memo = self._memo
        new = [p for p in set(pieces) if not memo.known(p)]
        for start in range(0, len(new), 2000):
            group = new[start:start + 2000]
            ids = self.whole(" ".join(group))
            borders = np.flatnonzero(self._ends[ids]) + 1
            if len(borders) == len(group):
                data, last = ids.tobytes(), 0
                for piece, border in zip(group, borders.tolist()):
                    memo.put(piece, data[4 * last:4 * border])
                    last = border

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self._by_piece:
            return [self.whole(t) for t in texts]
        split = [None if self._other.search(t) else self._pieces.findall(t.lower()) for t in texts]
        self._learn([p for pieces in split if pieces for p in pieces])
        get = self._memo.__getitem__
        return [
            self.whole(t) if pieces is None else np.frombuffer(b"".join(map(get, pieces)), "<u4")
            for t, pieces in zip(texts, split)
        ]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _write_range(path: str, folder: str, end_id: int, kind: str, chunk: int, batches: Iterator[pa.RecordBatch]):
    tool, end = library_encoder(path), np.array([end_id], "<u4")
    writer = uri = None
    for batch in batches:
        for ids, texts in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if writer is None:
                part = TaskContext.get().partitionId()
                uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.planes"
                writer = PlaneWriter(uri, kind, chunk)
            for doc_id, tokens in zip(ids, tool.encode(texts)):
                writer.add(doc_id, np.concatenate([tokens, end]))
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [uri],
            "n_docs": pa.array([len(writer._docs)], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64()),
        })


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, kind: str = "byte",
          chunk: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs`` in ascending id order; returns the manifest, kept beside the files."""
    spark = prepare(docs.sparkSession)
    folder = folder or new_path(spark, "planes")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = narrow.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    rows = dealt.mapInArrow(partial(_write_range, tokenizer, folder, end_id, kind, chunk), MANIFEST)
    return materialize(rows, "planes-manifest")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, start, rows = PlaneReader(row["path"]), row["base"], []
            for doc_id, parts in reader.documents():
                n = crc = 0
                for part in parts:
                    crc = zlib.crc32(part.tobytes(), crc)
                    n += len(part)
                rows.append((doc_id, start, n, crc))
                start += n
                if len(rows) == 4096:
                    yield _digest_rows(rows)
                    rows = []
            if rows:
                yield _digest_rows(rows)
            reader.close()


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))})


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its id, ids before it, number of ids, crc32 of the ids as 32-bit integers.

    The manifest has one row per file, so its running sum is over as many rows as there were tasks.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())
    dealt = files.select("part", "path", "base").repartitionByRange(n, "part")
    return dealt.select("path", "base").mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")

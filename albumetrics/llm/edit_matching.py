"""Benchmark decontamination: pigeonhole edit matching.

Texts are normalised (lower case, every run of other than letters and digits becomes one space). A test item of ``n``
characters has an error budget ``k`` of ``ERROR_RATE * n``, rounded down. If a document holds the item with at most ``k``
edits, one of ``k + 1`` pieces of the item is unharmed. An Aho-Corasick automaton over all pieces finds their exact hits
in one pass over the whole text. Pieces form pairs (three where one is left over); some pair has one edit at most, so a
hit beside which neither half of its partner stands is passed over. Each other hit names a window that the item would
fill, and windows of an item that overlap are joined. An edit harms at most ``GRAM`` of the item's grams of ``GRAM`` characters, so a window that holds too few of them
is passed over. For the others Myers' bit-parallel algorithm gives the least edit distance between the item and any part
of the window.

The items are split by size into blocks (``BLOCK_CHARS``); each is a broadcast of bounded size and one pass over the
documents, so a benchmark of any size is searched with bounded memory.

Defined cases: null and empty texts hold no item; items without letters or digits are passed over; items shorter than
``LEAST_PIECE`` (16) have no budget and must occur whole, at borders of words; equal items are all reported; rows of equal
document id are searched separately; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumetrics.llm.common import prepare

ERROR_RATE = 0.1
#: Shorter items have no budget.
LEAST_PIECE = 16
GRAM = 4
BLOCK_CHARS = 4 << 20

_BREAK = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _BREAK.sub(" ", text.lower()).strip() if text else ""


def budget(n: int, rate: float = ERROR_RATE, piece: int = LEAST_PIECE) -> int:
    return min(int(rate * n), n - 1) if n >= piece else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces that cover the item, with their starts; their sizes differ by one at most."""
    n = len(item)
    edges = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def partners(parts: list[tuple[int, str]]) -> list[list[tuple[str, int, int]]]:
    """Per piece what may stand near an unharmed one: (text, first place from the piece's start, further places); [] is anything.

    Of ``k + 1`` pieces with ``k`` edits some pair has one edit at most, or three pieces at the end have two: then two of
    them that are neighbours have one at most, or both edits lie in the middle one. A piece with one edit keeps its half
    on the near side in place, or the other half moved by one place at most.
    """
    texts = [part for _, part in parts]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    last = len(texts) - 3 if len(texts) % 2 else len(texts)
    for j in range(len(texts) - 1):
        if j % 2 and j <= last:
            continue
        left, right = texts[j], texts[j + 1]
        half = len(right) // 2
        out[j] += [(right[:half], len(left), 0), (right[half:], len(left) + half - 1, 2)]
        half = len(left) // 2
        out[j + 1] += [(left[half:], half - len(left), 0), (left[:half], -len(left) - 1, 2)]
    if last >= 0 and last < len(texts):
        out[last].append((texts[-1], len(texts[-3]) + len(texts[-2]) - 2, 4))
    return out


def edit_distance_within(item: str, text: str) -> tuple[int, int]:
    """Least distance between ``item`` and a part of ``text``, and where the first such part ends.

    Bit ``i`` of ``up`` (``down``) says that row ``i + 1`` is one more (less) than row ``i`` of the current column.
    """
    n = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text):
        same = masks.get(c, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right_up = down | ~(zero | up) & full
        right_down = up & zero
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | ~(zero | right_up) & full
        down = right_up & zero
        if distance < best:
            best, end = distance, j + 1
    return best, end


def grams(text: str) -> list[str]:
    return list(map("".join, zip(*(text[j:] for j in range(GRAM)))))


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, piece: int = LEAST_PIECE):
        import ahocorasick

        self._items: list[tuple[str, int, list[int]]] = []
        self._grams: list[list[str]] = []
        known: dict[str, int] = {}
        places: dict[str, list[tuple[int, int, list[tuple[str, int, int]]]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            if text in known:
                self._items[known[text]][2].append(item_id)
                continue
            known[text] = number = len(self._items)
            k = budget(len(text), rate, piece)
            self._items.append((text, k, [item_id]))
            self._grams.append(grams(text))
            parts = pieces(text, k)
            for (start, part), near in zip(parts, partners(parts)):
                places.setdefault(part, []).append((number, start, near))
        self._automaton = ahocorasick.Automaton()
        for part, where in places.items():
            self._automaton.add_word(part, (len(part), where))
        if places:
            self._automaton.make_automaton()
        self._empty = not places

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, distance) of every item that the text holds within its budget."""
        if self._empty or not text:
            return []
        text = normalise(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self._automaton.iter(text):
            begin = end + 1 - size
            for number, start, near in where:
                for part, at, more in near:
                    at += begin
                    if text.find(part, max(0, at), max(0, at + more + len(part))) >= 0:
                        break
                else:
                    if near:
                        continue
                item, k, _ = self._items[number]
                low = max(0, begin - start - k)
                high = min(len(text), begin - start + len(item) + k)
                held = windows.setdefault(number, [])
                # Hits come by their ends, so windows of an item start nearly in order; overlapping ones are joined.
                if held and low <= held[-1][1] and high >= held[-1][0]:
                    held[-1] = (min(low, held[-1][0]), max(high, held[-1][1]))
                else:
                    held.append((low, high))
        found = []
        for number, spans in windows.items():
            item, k, ids = self._items[number]
            least = None
            for low, high in spans:
                if k == 0:
                    at = text.find(item, low, high)
                    whole = at >= 0 and (len(item) >= LEAST_PIECE or f" {item} " in f" {text} ")
                    distance = 0 if whole else None
                elif not self._near(number, text[low:high]):
                    distance = None
                else:
                    distance = edit_distance_within(item, text[low:high])[0]
                if distance is not None and distance <= k and (least is None or distance < least):
                    least = distance
                if least == 0:
                    break
            if least is not None:
                found += [(item_id, least) for item_id in ids]
        return sorted(found)


    def _near(self, number: int, window: str) -> bool:
        """Whether the window holds as many of the item's grams as an occurrence within the budget leaves."""
        own, k = self._grams[number], self._items[number][1]
        return sum(map(set(grams(window)).__contains__, own)) >= len(own) - GRAM * k


def _matcher(block) -> Matcher:
    if block.id not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[block.id] = Matcher(*block.value)
    return _MATCHERS[block.id]


class Block:
    """A broadcast block of items; the id tells Python workers which automaton they hold."""

    def __init__(self, spark, items: list[tuple[int, str]], rate: float, piece: int):
        self._shared = spark.sparkContext.broadcast((items, rate, piece))
        self.id = self._shared._jbroadcast.id()

    @property
    def value(self) -> tuple:
        return self._shared.value

    def __getstate__(self):
        return {"_shared": self._shared, "id": self.id}


_MATCHERS: dict[int, Matcher] = {}


def _find_batch(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(block)
    for batch in batches:
        ids, items, distances = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for item_id, distance in matcher.find(text):
                ids.append(doc_id)
                items.append(item_id)
                distances.append(distance)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "item_id": pa.array(items, pa.int64()),
            "distance": pa.array(distances, pa.int64()),
        })


def _drop_batch(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(block)
    for batch in batches:
        keep = [not matcher.find(text) for text in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, piece: int,
            block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """Items in blocks of bounded size: only one block at a time is on the driver."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    held: list[tuple[int, str]] = []
    size = 0
    for row in rows.distinct().orderBy("item", "text").toLocalIterator():
        held.append((row["item"], row["text"]))
        size += len(row["text"])
        if size >= block_chars:
            yield Block(spark, held, rate, piece)
            held, size = [], 0
    if held:
        yield Block(spark, held, rate, piece)


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, piece: int = LEAST_PIECE,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``: every item that a document holds within the item's budget."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance long"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, rate, piece, block_chars):
        part = rows.mapInArrow(partial(_find_batch, block), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, piece: int = LEAST_PIECE,
                      item_col: str = "item_id", item_text_col: str = "text",
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (its column ``text``) that hold no item; all columns stay."""
    prepare(docs.sparkSession)
    for block in _blocks(benchmark, item_col, item_text_col, rate, piece, block_chars):
        docs = docs.mapInArrow(partial(_drop_batch, block), docs.schema)
    return docs

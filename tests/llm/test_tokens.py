"""op1, op6 and op7 against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from albumetrics.llm import bpe_stream, chat_format, token_planes
from albumetrics.llm.queries import BYTE_BPE, WORD_BPE, op1_chat_format
from tests.llm.conftest import odd_rows, prose

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.encoder(WORD_BPE)


def texts_at_random(n, seed=1):
    chance = random.Random(seed)
    alphabet = "abcdeé ßẞİΣσς'sStT’ 12²½\n\t\x1c\x85​́ä̈😀中文字<|endoftext|>|<>ก้ǅ"
    for _ in range(n):
        yield "".join(chance.choice(alphabet) for _ in range(chance.randint(0, 60)))


def test_encoding_equals_library(library, encoder):
    for text in [*texts_at_random(1500), "<|endoftext|>ab<|startoftext|>", prose(5, 3000), "x" * 9000, "haha" * 3000, ""]:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        assert encoder.decode(want, block=3) == library.decode(want, skip_special_tokens=False)


def test_streaming_window_never_changes_tokens(encoder):
    merges = encoder.merges
    chance = random.Random(3)
    for _ in range(60):
        piece = "".join(prose(chance.randint(0, 99), chance.randint(1, 150)).split())
        symbols = encoder._symbols(piece)
        machine = bpe_stream.PieceTransducer(merges, merges.lookahead + merges.longest + 1)
        assert [*machine.feed(symbols), *machine.finish()] == merges.merge(symbols)


def test_streaming_memory_is_bounded(encoder):
    merges = encoder.merges
    machine = bpe_stream.PieceTransducer(merges)
    most = 0
    for symbol in encoder._symbols("abcd" * 5000):
        list(machine.feed([symbol]))
        most = max(most, len(machine._held))
    assert most < 4 * (merges.lookahead + merges.longest)


def test_encode_odd_rows(odd, none, library):
    got = sorted((r.doc_id or -1, tuple(r.token_ids)) for r in bpe_stream.encode(odd, WORD_BPE).collect())
    want = sorted((r[0] or -1, tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert got == want
    assert bpe_stream.digests(none, WORD_BPE).collect() == []


def test_digest_of_empty_text(spark):
    row = bpe_stream.digests(spark.createDataFrame([(1, None)], "doc_id long, text string"), WORD_BPE).first()
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (1, 0, nothing, nothing)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind, tmp_path):
    chance = np.random.default_rng(0)
    docs = [(k, chance.integers(0, 2**32, int(n), dtype=np.uint32)) for k, n in enumerate([0, 1, 7, 250, 3, 0, 40])]
    docs.append((None, chance.integers(0, 50000, 100, dtype=np.uint32)))
    writer = token_planes.PlaneWriter(str(tmp_path / "a.planes"), kind, chunk=16)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = token_planes.PlaneReader(str(tmp_path / "a.planes"))
    got = [(d, np.concatenate([*parts, np.empty(0, np.uint32)])) for d, parts in reader.documents()]
    assert [d for d, _ in got] == [d for d, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    assert (reader.chunk(3) == np.concatenate([i for _, i in docs])[48:64]).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_of_odd_rows(spark, odd, none, library, kind):
    got = [tuple(r) for r in token_planes.read_digests(spark, token_planes.write(odd, WORD_BPE, kind=kind, chunk=64)).collect()]
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4"))
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in rows]
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at and (n, crc) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[doc_id]]
        at += n
    assert token_planes.read_digests(spark, token_planes.write(none, WORD_BPE)).collect() == []


def test_escapes_are_reversible_and_complete():
    chance = random.Random(0)
    parts = ["\\", "<s>", "</s>", "[INST]", "<", "|", "turn", "|>", "<|turn|>", "a", "[", "/INST]", "\n", "é", "<|"]
    for _ in range(3000):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 8)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROLS)


def expected_digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_equal_their_turns(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op1_chat_format(spark, SMALL).collect()}
    assert got == {c: expected_digests(t) for c, t in turns.items()}


def test_odd_conversations(spark):
    long_text = prose(4, 60000)
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} 😀 {prose(k, 9)}", 0) for k in range(200)]
    rows += [(2, None, "user", "first", 0), (2, 0, None, None, 0), (2, 0, None, None, 0), (2, 1, "assistant", "", 0),
             (2, 2, "assistant", long_text, 0), (None, 0, "assis\ntant %", "<|turn|>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int").repartition(5)
    segments = chat_format.format_conversations(df, BYTE_BPE)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in chat_format.digests(segments, BYTE_BPE).collect()}
    want = {1: [(r[2], r[3]) for r in rows[:200]], None: [("assis\ntant %", "<|turn|>")],
            2: [("user", "first"), ("", ""), ("", ""), ("assistant", ""), ("assistant", long_text)]}
    assert got == {c: expected_digests(t) for c, t in want.items()}
    assert segments.filter("conv_id = 1").count() == 4
    assert chat_format.digests(chat_format.format_conversations(df.limit(0), BYTE_BPE), BYTE_BPE).collect() == []

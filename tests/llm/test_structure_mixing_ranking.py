"""op11, op12 and op13 against plain Python."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from albumetrics.llm import source_mixing, structure_repair, term_pipeline
from albumetrics.llm.queries import op12_structure_repair, op13_source_mixing
from albumetrics.sources.workspace import Scratch, child_names

SMALL = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)
TURNS = "conv_id long, turn long, role string, text string, block long, part long, symbols string, audit string"


# --- op12 ---------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            out.append("" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Least (cost, audit, turns) over all edits, forwards over the initials written so far; no automaton."""
    machine = {"": {"s": "s", "u": "su"}, "s": {"u": "su"}, "su": {"a": "sua"}, "sua": {"u": "su"}}

    @lru_cache(None)
    def best(at, state, inserted):
        options = [(0, "", ())] if at == len(rows) and state in ("", "sua") else []
        if inserted < 3:
            for name in ("user", "assistant"):
                if name[0] in machine[state]:
                    cost, audit, turns = best(at, machine[state][name[0]], inserted + 1)
                    options.append((cost + 5, "I" + audit, (f"{name}:",) + turns))
        if at < len(rows):
            role, text = rows[at]
            cost, audit, turns = best(at + 1, state, 0)
            options.append((cost + 2, "D" + audit, turns))
            if faults[at] not in ("b", "d"):
                extra = 5 if faults[at] == "t" else 0
                if role[:1] in machine[state]:
                    cost, audit, turns = best(at + 1, machine[state][role[:1]], 0)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}",) + turns))
                for name in ("user", "assistant"):
                    if name[0] in machine[state]:
                        cost, audit, turns = best(at + 1, machine[state][name[0]], 0)
                        options.append((cost + extra + 1, "R" + audit, (f"{name}:{text}",) + turns))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def plain_report(rows, convs):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in convs:
        turns = sorted(by_conv[conv])
        pairs = [(role, text) for _, _, role, text in turns]
        faults = faults_of(pairs)
        known = [t for present, t, _, _ in turns if present]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, repaired = plain_repair(pairs, faults)
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def reported(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_repair_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = reported(op12_structure_repair(spark, SMALL))
    assert got == plain_report(plain_damage(rows), {r[0] for r in rows})
    assert len({v[5] for v in got.values()}) > 3


def odd_turns():
    chance = random.Random(4)
    rows = []
    for conv in range(60):
        for _ in range(chance.randint(1, 9)):
            rows.append((
                chance.choice([conv, conv, conv, None]), chance.choice([None, *range(5)]),
                chance.choice(["user", "assistant", "system", "tool", "", None, "s"]),
                chance.choice([None, "", "  \t", "Yes.", "No", "Yes.", "Über!", "a?", " ", "x\x0b"])))
    rows += [(900, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(-70, 200)]
    rows += [(901, 5, "user", "copy.")] * 40
    # Every row of conversation 2 is dropped where its only turns are.
    rows += [(950 + k, t, "user", "Gone.") for k in range(40) for t in [7]]
    return rows


@pytest.mark.parametrize("harm", [False, True])
def test_repair_of_odd_rows(spark, monkeypatch, harm):
    monkeypatch.setattr(structure_repair, "SEGMENT_ROWS", 3)
    rows = odd_turns()
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], TURNS).repartition(5)
    turns = structure_repair.damage(df) if harm else structure_repair.intact(df)
    plain = plain_damage(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    scratch = Scratch(spark, "test")
    got = reported(structure_repair.report(turns, scratch))
    want = plain_report(plain, {r[0] for r in rows})
    assert got == want
    if harm:
        assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())
    repaired = structure_repair.repair(turns, scratch).collect()
    lines = defaultdict(list)
    for r in sorted(repaired, key=lambda r: r["position"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]
        initials = "".join(line[0] for line in lines[conv])
        assert re.fullmatch("(s?(ua)+)?", initials)
    scratch.drop()


def test_repair_of_an_empty_table(spark):
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([], TURNS)
    assert structure_repair.report(structure_repair.damage(df), scratch).count() == 0


def test_automaton_makes_each_suffix_once():
    chance = random.Random(1)
    words = sorted({"".join(chance.choice("suaoxUA") for _ in range(chance.randint(0, 6))) for _ in range(400)}, key=lambda w: w[::-1])
    automaton = structure_repair.SuffixAutomaton()
    kinds = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for word in words:
        rows = [(kinds[c.lower()], "") for c in word]
        faults = ["b" if c == "x" else "t" if c.isupper() else "" for c in word]
        assert automaton.solve(word[::-1]) == plain_repair(rows, faults)[:2]
    assert automaton.made == len({w[k:] for w in words for k in range(len(w))})


# --- op13 ---------------------------------------------------------------------------------


def plain_targets(sizes):
    """Shares of the whole by weight, each stopped at three times its source; sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole, out = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        level = (whole - sum(out.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 3.0 * sizes[s] for s in over}


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, docs):
    """``rows`` (doc_id, size, source_size, target, taken) of ``docs`` (doc_id, text, source)."""
    sizes, source = defaultdict(int), defaultdict(list)
    for ident, text, name in docs:
        sizes[name] += word_count(text)
    want = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, word_count(t)) for i, t, _ in docs)
    names = {(sizes[n], round(want[n], 6)): n for n in sizes}
    for r in rows:
        source[names[r["source_size"], round(r["target"], 6)]].append(r)
    for name, mine in source.items():
        wanted = want[name] / sizes[name] if sizes[name] else 0.0
        for r in mine:
            assert r["taken"] in (r["size"] * math.floor(wanted + 1e-9), r["size"] * math.ceil(wanted - 1e-9))
        # What is rounded alone is one document.
        assert abs(sum(r["taken"] for r in mine) - want[name]) <= max(r["size"] for r in mine) + 1e-6


def test_mix_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = op13_source_mixing(spark, SMALL).collect()
    check_mix(rows, docs)
    again = op13_source_mixing(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


MIX = "doc_id long, text string, source string, size long, copy long, taken long, target double, p double"


def mixing_rows(n, seed):
    chance = random.Random(seed)
    out = []
    for k in range(n):
        size = chance.choice([0, 1, 3, 10, 30, 100])
        name = chance.choice(["hot"] * 6 + ["b", "Ä", "", None, "z"])
        out.append((k if chance.random() < 0.95 else None, "w " * size, name))
    out += [(77, "one two\tthree\x0bfour five", "tiny")] * 5 + [(78, None, "none"), (79, "", "none"), (80, "x " * 5000, "b")]
    return out


def test_mix_of_odd_rows_in_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "GROUP", 3)
    monkeypatch.setattr(source_mixing, "TOP", 4)
    docs = mixing_rows(900, 2)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(*d, 1, 2, 3, 0.5, 0.5) for d in docs], MIX).repartition(4)
    rows = source_mixing.mix(df, scratch).collect()
    check_mix(rows, docs)
    moved = source_mixing.mix(df.repartition(7, "source"), scratch).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, moved))
    scratch.drop()


def test_large_documents_are_not_left_to_the_end(spark):
    """The last residual is a small document wherever there are some."""
    docs = [(k, "w " * 4000, "a") for k in range(7)] + [(100 + k, "w " * (k % 40 + 1), "a") for k in range(1500)]
    docs += [(5000 + k, "w " * 30, "b") for k in range(800)]
    scratch = Scratch(spark, "test")
    rows = source_mixing.mix(spark.createDataFrame([(*d, 1, 2, 3, 0.5, 0.5) for d in docs], MIX), scratch).collect()
    for target in {r["target"] for r in rows}:
        mine = [r for r in rows if r["target"] == target]
        # The smallest class of source a has up to 7 words, source b has documents of 30 words only.
        assert abs(sum(r["taken"] for r in mine) - target) <= (7 if len(mine) == 1507 else 30)


def test_probabilities_are_kept_on_average(spark, monkeypatch):
    """Over many seeds every document is taken as often as its probability says."""
    sizes = [1] * 12 + [2] * 8 + [9, 9, 14]
    items = spark.createDataFrame(
        [(f"s{run}", k, 1, size, 0.4) for run in range(600) for k, size in enumerate(sizes)],
        "source string, doc_id long, copy long, size long, p double")
    # Documents of different runs differ, so that their draws do.
    items = items.withColumn("doc_id", F.col("doc_id") + 100 * F.substring("source", 2, 9).cast("long"))
    scratch = Scratch(spark, "test")
    rows = source_mixing.round_dependently(items, scratch).collect()
    taken = Counter()
    for r in rows:
        taken[r["doc_id"] % 100] += r["extra"]
    for k in range(len(sizes)):
        assert abs(taken[k] / 600 - 0.4) < 4 * math.sqrt(0.4 * 0.6 / 600)
    scratch.drop()


def test_mix_of_an_empty_table(spark):
    scratch = Scratch(spark, "test")
    assert source_mixing.mix(spark.createDataFrame([], MIX), scratch).count() == 0


# --- op11 ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(lower))


def plain_ranking(docs, items, top):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(words_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for ident, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if t in c)
            if score > 0:
                scored.append((-score, ident is not None, ident or 0, ident))
        scored.sort(key=lambda s: s[:3])
        out += [(item, k + 1, ident, -score) for k, (score, _, _, ident) in enumerate(scored[:top])]
    return out


DOCS = "doc_id long, text string, block long, item int, at int, score long, terms string"
ITEMS = "item_id long, text string, rank int, doc_id long, score long"


@pytest.mark.parametrize("bundle_bytes", [1 << 20, 60])
def test_ranking_equals_brute_force(spark, monkeypatch, bundle_bytes):
    monkeypatch.setattr(term_pipeline, "BUNDLE_BYTES", bundle_bytes)
    monkeypatch.setattr(term_pipeline, "STRETCH", 16)
    monkeypatch.setattr(term_pipeline, "RARITY", (0.02, 0.2))
    chance = random.Random(8)
    vocabulary = [*"the of and".split() * 8, *(f"w{k}" for k in range(60)), "Ärger", "ärger", "naïve", "中文", "a_b", "x-1"]
    text = lambda n: " ".join(chance.choice(vocabulary) for _ in range(n)).title()
    docs = [(k, text(chance.randint(0, 30))) for k in range(150)] + [(None, text(9)), (None, None), (3, text(5)), (7, ""), (8, "\x00!?")]
    docs += [(1000 + k, "same words here the") for k in range(30)] + [(1005, "same words here the")] * 2 + [(2000, "the " * 4000 + "w1")]
    items = [(k, text(6)) for k in range(12)] + [(None, "the w1"), (5, "same words"), (20, None), (21, "unheard"), (22, "")]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4, "t") for d in docs], DOCS).repartition(6)
    asked = spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEMS)
    scratch = Scratch(spark, "test")
    got = [tuple(r) for r in term_pipeline.search(df, asked, scratch, top=20).collect()]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(plain_ranking(docs, items, 20), key=key)
    scratch.drop()


def test_ranking_of_empty_tables(spark):
    scratch = Scratch(spark, "test")
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", 1, 1, 1)], ITEMS)
    assert term_pipeline.search(docs, some, scratch).count() == 0
    assert term_pipeline.search(docs, items, scratch).count() == 0


def test_scratch_goes_with_the_result(spark):
    scratch = Scratch(spark, "test")
    held = scratch.table(spark.range(5), "held")
    out = scratch.finish(held.filter("id > 2"))
    assert out.count() == 2 and child_names(spark, scratch.root) == []

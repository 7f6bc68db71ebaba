"""Repeated ids, clashing names, quotation marks and what a run leaves behind."""

import textwrap
import time

import duckdb
import pytest

import corpus_pipeline
from albumetrics.llm import language_spans, license_scan, toxicity, weighted_minhash
from albumetrics.sources.workspace import child_names, work_dir
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


def test_an_id_of_several_texts_counts_with_the_least(spark):
    a, b = "aaa " + prose(1, 40), "bbb " + prose(2, 40)
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (4, ""), (4, b), (5, None), (5, b)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in weighted_minhash.groups(df).collect()}
    # Document 4 is the empty text; a null text is none.
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2}
    assert {r.doc_id for r in weighted_minhash.keep_one(df).collect()} == {1, 2, 4}


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, prose(1, 40), "m", "other"), (2, prose(1, 40), "m", None), (3, prose(3, 40), None, "x")]
    return spark.createDataFrame(rows, "doc_id long, body string, mark string, text string")


def test_columns_named_like_ours(spark, clashing):
    kept = weighted_minhash.keep_one(clashing, text_col="body")
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {1, 3}
    scorer = toxicity.learn(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    kept = toxicity.keep_clean(clashing, scorer, text_col="body")
    assert kept.columns == clashing.columns and kept.count() == 3
    learnt = spark.createDataFrame([(k, prose(k, 60), "xx") for k in range(20)], "doc_id long, text string, lang string")
    kept = language_spans.keep_identified(clashing, language_spans.learn(learnt), text_col="body")
    assert kept.columns == clashing.columns and kept.count() == 3


@pytest.mark.parametrize(("text", "quoted"), [
    ("i don't care, you xyzzy, you can't hide", False),
    ("i do not care, you xyzzy, you cannot hide", False),
    ("the dogs' bone, you xyzzy, it's 'fine'", False),
    ("he said 'you xyzzy' to me", True),
    ("he said \"you xyzzy\" to me", True),
    ("\"well\" you xyzzy \"there\"", False),
    ("sie rief „du xyzzy“ laut", True),
    ("« toi xyzzy » dit-il", True),
    ("\"open, you xyzzy", False),
    ("‘it’s xyzzy’ he said", True),
    ("'\nyou xyzzy\n'", False),
])
def test_only_paired_marks_quote(text, quoted):
    at = text.index("xyzzy")
    assert toxicity.Scorer(toxicity.Lexicon({}))._quoted(text, at, at + 5) is quoted


def test_pipeline_leaves_its_result_only(spark):
    root = f"{work_dir(spark)}/albumetrics"
    before = set(child_names(spark, root))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    left = sorted(n.rsplit("-", 1)[0] for n in set(child_names(spark, root)) - before)
    # The ids of copies are read until the stage after them is written.
    assert left == ["minhash-copies", "minhash-result", "pipeline-result"]


def inline_notices():
    mit, bsd = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["BSD-3-Clause"]
    return {
        1: "Copyright 2024 Acme Corp. Released under the MIT License.", 2: prose(1, 9) + "\n" + textwrap.fill(mit[2], 60),
        3: textwrap.fill(mit[2], 24), 4: " ".join([prose(3, 700), bsd[1], prose(4, 50), mit[0], prose(5, 460), mit[2], prose(6, 9)]),
        5: prose(7, 30) + " released under no licence; the license of the software to the public " + prose(8, 30),
        6: "\n".join([mit[0], prose(9, 500), mit[0], bsd[0] + " " + bsd[0]]), 7: None, 8: "",
    }


@pytest.mark.parametrize("stretch", [512, 7])
def test_licence_windows_equal_sql(spark, monkeypatch, stretch):
    """Whatever the stretches that a text is cut into."""
    monkeypatch.setattr(license_scan, "STRETCH", stretch)
    rows = list(inline_notices().items())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {(r[0], r[1], round(r[2], 9), *r[3:]) for r in con.execute(license_scan.oracle()).fetchall()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r[0], r[1], round(r[2], 9), *r[3:]) for r in license_scan.scan(df).collect()} == want
    assert len(want) > 5


def test_licence_scan_is_linear_in_a_line(spark):
    def seconds(words):
        text = " ".join(["Released under the MIT License. " + prose(k % 50, 6) for k in range(words // 10)])
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
        df.count()
        started = time.perf_counter()
        assert license_scan.scan(df).first()["n_runs"] >= 1
        return time.perf_counter() - started

    seconds(20_000)
    assert seconds(200_000) < 10 * seconds(20_000)

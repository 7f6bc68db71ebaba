"""op2, op8 and op10: held-out accuracy, exact sub-steps against brute force, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumetrics.llm import cotraining, language_spans, toxicity
from albumetrics.llm.common import held_out
from albumetrics.llm.queries import op2_toxicity, op8_cotraining, op10_language_spans

DATA = "/root/testdata/sf0.01"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def test_automaton_on_trie_equals_edit_distance():
    terms = ["moron", "morons", "clown", "abcde", "abcdf", "aaaaa"]
    trie, chance = toxicity.Trie(terms), random.Random(1)
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    for _ in range(5000):
        word = list(chance.choice(terms))
        for _ in range(chance.randint(0, 2)):
            k, letter = chance.randint(0, max(0, len(word) - 1)), chance.choice("abcdefmorn")
            word[k:k + chance.randint(0, 1)] = [letter] * chance.randint(0, 1)
        word = "".join(word)
        want = sorted(t for t in terms if one_edit(word, t))
        assert sorted(trie.within_one_edit(word)) == want
        # Passing words over by their halves loses none.
        assert (lexicon.near(word) is not None) == bool(want)


def test_disguised_and_misspelt_terms_hit():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "stupid": 5.0}, frozenset(["idiots"]))
    for word in ("idiot", "1diot", "id1ot", "$tupid", "stuuupid", "stupd", "idlot"):
        assert any(lexicon.look_up(w) for w in toxicity.words_of(word) + [word]), word
    assert not lexicon.look_up("idiots") and not lexicon.look_up("stop")


def test_quotation_is_a_feature_of_its_own():
    scorer = toxicity.Scorer(toxicity.Lexicon({"idiot": 5.0}))
    said, quoted = scorer.features("you are an idiot today"), scorer.features('they wrote "you are an idiot" today')
    assert said[2] == 0 and quoted[2] > 0 and said[0] == quoted[0]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def held_out_accuracy(df, labels, label, predicted):
    rows = df.join(labels, "doc_id").filter("held_out").select(F.avg((F.col(label) == F.col(predicted)).cast("double")))
    return rows.first()[0]


def test_toxicity_held_out(spark, labels):
    df = op2_toxicity(spark, DATA)
    assert df.count() == 1000 and df.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert held_out_accuracy(df, labels, "toxic", "predicted") >= 0.9


def test_quality_held_out(spark, labels):
    df = op8_cotraining(spark, DATA)
    assert df.count() == 1000
    assert held_out_accuracy(df, labels, "quality", "predicted") >= 0.95


def test_language_held_out(spark):
    df = op10_language_spans(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    assert df.count() == 1000
    assert held_out_accuracy(df, docs, "lang", "lang_pred") >= 0.98


def test_labels_of_held_out_rows_change_nothing(spark, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    usable = ~held_out(F.col("doc_id"))
    a, b = (toxicity.learn(docs, x, usable) for x in (labels, turned))
    assert a._lexicon.weights == b._lexicon.weights and np.allclose(a.coefficients, b.coefficients)


def test_viterbi_shortcut_is_exact():
    chance = np.random.default_rng(0)
    shortcuts = 0
    for _ in range(500):
        n = int(chance.integers(1, 40))
        scores = chance.normal(size=(n, 3)) * 3 + np.array([chance.random() * 3, 0, 0])

        def value(path, scores=scores, n=n):
            return scores[np.arange(n), path].sum() - language_spans.SWITCH * (np.diff(path) != 0).sum()

        path = language_spans.best_path(scores)
        best, sure = language_spans.constant_texts(scores, np.array([0, n]))
        if n <= 7:
            every = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
            assert np.isclose(value(path), max(value(p) for p in every))
        if sure[0]:
            shortcuts += 1
            assert np.isclose(value(path), value(np.full(n, best[0])))
    assert shortcuts > 50


def test_mixed_text_has_spans(spark):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 30, "de" if k % 2 else "en") for k in range(40)]
    rows += [(100 + k, "привет мир и люди " * 20, "ru") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_spans.learn(docs)
    mixed = "the dog and the cat and the dog " * 4 + "der hund und die katze und der hund " * 4 + "привет мир"
    tool = language_spans.Labeller(model)
    spans = tool.spans([mixed])[0]
    assert [s["lang"] for s in spans] == ["en", "de", "ru"]
    assert mixed[spans[2]["start"]:spans[2]["end"]] == "привет мир"


def test_odd_rows(spark, odd, none, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, scorer = language_spans.learn(docs), toxicity.learn(docs, labels)
    found = {(r.doc_id, r.lang_pred == "und") for r in language_spans.predict(odd, model).collect()}
    assert {(1, True), (2, True), (3, True), (4, True), (5, False), (9, False)} <= found
    assert language_spans.predict(odd, model).count() == odd.count() == toxicity.score(odd, scorer).count()
    kept = language_spans.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 3, 4)").count() == 0
    assert toxicity.keep_clean(odd, scorer).columns == odd.columns
    quality = cotraining.learn(docs, labels)
    assert cotraining.score(odd, quality).count() == odd.count()
    for df in (language_spans.predict(none, model), language_spans.label_spans(none, model), toxicity.score(none, scorer),
               cotraining.score(none, quality), language_spans.keep_identified(none, model), toxicity.keep_clean(none, scorer)):
        assert df.collect() == []


def test_without_labels(spark, odd):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert language_spans.predict(docs, language_spans.learn(docs)).first().lang_pred == "und"
    assert toxicity.score(docs, toxicity.learn(docs, labels)).first().predicted == 0
    assert cotraining.score(docs, cotraining.learn(docs, labels)).first().score == 0.5


def test_unlearned_scripts_are_not_covered(spark):
    learned = [(k, "the cat and the dog went out", "en") for k in range(9)] + [(20 + k, "der Hund und die Katze", "de") for k in range(9)]
    model = language_spans.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    texts = {
        1: "the dog and the cat", 2: "собака и кошка", 3: "猫和狗出去了", 4: "the dog and the cat собака", 5: "dog собака и кошка",
        6: "x猫和狗出去了", 7: "", 8: None, 9: "12 !!", 10: "the собака",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in language_spans.keep_identified(df, model).collect()} == {1, 4}
    nothing = language_spans.LanguageModel({})
    assert language_spans.keep_identified(df, nothing).collect() == []

"""op3, op4, op5, op9 and the pipeline against brute force."""

import random
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from albumetrics.llm import edit_matching, graph_search, license_scan, weighted_minhash
from albumetrics.llm.queries import language_model, op3_graph_search, op4_license_scan, op9_weighted_minhash, toxicity_scorer
from tests.llm.conftest import odd_rows, prose

SMALL = "/root/testdata/sf0.001"


def exact_nearest(ids, vectors, query, k):
    own = vectors[ids.index(query)]
    scores = [(-float((v * own).sum()), i) for i, v in zip(ids, vectors) if i != query]
    return [i for _, i in sorted(scores)[:k]]


def recall(found, ids, vectors, k=20):
    hit = total = 0
    for query in {r.query_id for r in found}:
        rows = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        want = exact_nearest(ids, vectors, query, k)
        hit, total = hit + len({r.vec_id for r in rows} & set(want)), total + len(want)
    return hit / total


def test_graph_search_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = graph_search.build(rows, shard_rows=600)
    found = graph_search.nearest(index, rows.filter("vec_id % 20 = 0"), query_rows=30).collect()
    data = rows.collect()
    assert len(found) == 20 * sum(r.vec_id % 20 == 0 for r in data)
    assert recall(found, [r.vec_id for r in data], [np.array(r.embedding, float) for r in data]) >= 0.9


def test_graph_search_query(spark):
    found = op3_graph_search(spark, SMALL).collect()
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    assert recall(found, [r.vec_id for r in data], [np.array(r.embedding, float) for r in data]) >= 0.95


def test_graph_search_odd_vectors(spark):
    chance = np.random.default_rng(1)
    rows = [(k, chance.normal(size=4).tolist()) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(50)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 1.0, 0.0, 0.0]),
             (205, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (320, [2.0, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "'a' as dim")
    found = graph_search.nearest(graph_search.build(df, shard_rows=40), df.filter("vec_id % 20 = 0"), k=20).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 200}
    ids = list(good)
    by_query = Counter(r.query_id for r in found)
    assert set(by_query) == {0, 20, 40, 100, 120, 140, 300, 320}.intersection(by_query) and by_query[320] == 1
    assert {r.vec_id for r in found if r.query_id == 300} == {320}
    near = [r.vec_id for r in sorted((r for r in found if r.query_id == 100), key=lambda r: r.rank)]
    assert near == exact_nearest(ids, [good[i] for i in ids], 100, 20)
    empty = df.limit(0)
    assert graph_search.nearest(graph_search.build(empty), empty).collect() == []


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_equal_brute_force(spark, odd, none):
    notice = license_scan.TEMPLATES["MIT"][2]
    half = len(notice) // 2
    cut = notice.index(" ", half)
    texts = {
        1: prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 9),
        2: prose(3, 20) + "\n" + notice[:cut] + "\n" + notice[cut:] + "\n" + prose(4, 20),
        3: "licensed UNDER the apache license version 2.0",
        4: "This work is licensed under the GNU General Public License, version 7.\n\nReleased under the MIT License.",
        5: prose(5, 4000) + " released under license", 6: None, 7: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {}
    for doc, text in texts.items():
        lines = [license_scan.normalise(x) for x in (text or "").split("\n")]
        for n in range(1, license_scan.MAX_LINES + 1):
            for s in range(len(lines) - n + 1):
                if not lines[s] or not lines[s + n - 1]:
                    continue
                grams = set(license_scan.bigrams([w for x in lines[s:s + n] for w in x]))
                for name, forms in license_scan.TEMPLATES.items():
                    for form in forms:
                        d = dice(grams, set(license_scan.bigrams(license_scan.normalise(form))))
                        if d >= license_scan.LEAST_DICE:
                            want.setdefault((doc, name), set()).add((-d, s + 1, n))
    got = {(r.doc_id, r.license): r for r in license_scan.scan(df).collect()}
    assert set(got) == set(want) and {1, 2, 3, 4} == {d for d, _ in want}
    for key, runs in want.items():
        d, line, n = min(runs)
        assert (got[key].dice, got[key].line, got[key].n_lines) == (pytest.approx(-d), line, n)
        assert got[key].n_runs == len({(s, k) for _, s, k in runs})
    assert license_scan.scan(odd).collect() == [] and license_scan.scan(none).collect() == []


def test_licences_inside_lines_and_over_many_lines(spark):
    mit, bsd = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["BSD-3-Clause"]
    texts = {
        1: "Copyright 2024 Acme Corp. Released under the MIT License.",
        2: prose(1, 9) + "\n" + textwrap.fill(mit[2], 60) + "\n" + prose(2, 9),
        3: textwrap.fill(mit[2], 24),
        4: " ".join([prose(3, 200), bsd[1], prose(4, 50), mit[0], prose(5, 60), mit[2].replace("copy, modify", "alter"), prose(6, 9)]),
        5: prose(7, 30) + " released under no licence; the license of the software to the public " + prose(8, 30),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {}
    for doc, text in texts.items():
        words = license_scan.normalise(text)
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, forms in license_scan.TEMPLATES.items():
            for form in map(license_scan.normalise, forms):
                own = set(license_scan.bigrams(form))
                for i in range(len(grams)):
                    seen = set()
                    for g in grams[i:i + license_scan.longest_window(form, license_scan.LEAST_DICE)]:
                        seen.add(g)
                        if (d := dice(seen, own)) >= license_scan.LEAST_DICE:
                            want[doc, name] = max(d, want.get((doc, name), 0))
    got = {(r.doc_id, r.license): r for r in license_scan.scan(df).collect()}
    assert {k: r.dice for k, r in got.items()} == pytest.approx(want)
    assert set(want) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (4, "BSD-3-Clause")}
    assert (got[1, "MIT"].line, got[1, "MIT"].n_lines) == (1, 1)
    assert (got[2, "MIT"].line, got[2, "MIT"].n_lines) == (2, len(textwrap.wrap(mit[2], 60)))


def test_licence_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {(r[0], r[1], round(r[2], 9), *r[3:]) for r in con.execute(license_scan.oracle()).fetchall()}
    assert {(r[0], r[1], round(r[2], 9), *r[3:]) for r in op4_license_scan(spark, SMALL).collect()} == want


def least_distance(item, text):
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(new[-1] + 1, column[i] + 1, column[i - 1] + (x != c)))
        column, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance():
    chance = random.Random(2)
    for _ in range(1500):
        item = "".join(chance.choice("abc ") for _ in range(chance.randint(1, 80)))
        text = "".join(chance.choice("abc ") for _ in range(chance.randint(0, 90)))
        assert edit_matching.edit_distance_within(item, text)[0] == least_distance(item, text)


def test_items_equal_brute_force(spark, odd, none):
    chance = random.Random(4)
    items = {k: prose(50 + k, chance.randint(4, 25)) for k in range(12)} | {90: "zo", 91: None, 92: "!!", 93: prose(50, 4)}
    items[93] = items[0]
    docs = {}
    for k in range(60):
        item = list(edit_matching.normalise(items[k % 12]))
        for _ in range(chance.randint(0, 14)):
            p = chance.randrange(len(item))
            item[p:p + chance.randint(0, 1)] = chance.choice("abcxyz") * chance.randint(0, 1)
        docs[k] = f"{prose(k, 40).upper()}... {''.join(item)}, {prose(k + 7, 30)}"
    docs |= {70: None, 71: "", 72: "so zo."}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = set()
    for doc, text in docs.items():
        plain = edit_matching.normalise(text)
        for item_id, item in items.items():
            item = edit_matching.normalise(item)
            budget = edit_matching.budget(len(item))
            if item and len(item) < edit_matching.LEAST_PIECE:
                if f" {item} " in f" {plain} ":
                    want.add((doc, item_id, 0))
            elif item and plain and (d := least_distance(item, plain)) <= budget:
                want.add((doc, item_id, d))
    for block_chars in (1 << 20, 100):
        got = {tuple(r) for r in edit_matching.find_items(df, benchmark, block_chars=block_chars).collect()}
        assert got == want
    kept = {r.doc_id for r in edit_matching.drop_contaminated(df, benchmark).collect()}
    assert kept == set(docs) - {d for d, _, _ in want} and len(want) > 20
    assert edit_matching.find_items(odd, benchmark.limit(0)).collect() == []
    assert edit_matching.find_items(none, benchmark).collect() == []
    assert edit_matching.drop_contaminated(odd, benchmark).columns == odd.columns


def test_items_are_found_up_to_the_stated_rate():
    chance, items = random.Random(8), {k: edit_matching.normalise(prose(700 + k, 4 + k)) for k in range(24)}
    matcher = edit_matching.Matcher(list(items.items()))
    edits = Counter()
    for trial in range(96):
        item_id = trial % len(items)
        item = list(items[item_id])
        # Edits at even distances leave the shortest unharmed pieces.
        n = int(0.1 * len(item)) + chance.randint(-1, 2)
        for j in range(n):
            item[len(item) * j // n] = chance.choice("abcxyz")
        text = f"{prose(trial, 30)} {''.join(item)} {prose(trial + 7, 30)}"
        whole = items[item_id]
        d = least_distance(whole, text)
        within = len(whole) >= edit_matching.LEAST_PIECE and d <= int(0.1 * len(whole))
        assert dict(matcher.find(text)).get(item_id) == (d if within else None)
        edits[within and d > len(whole) / 16] += 1
    assert edits[True] > 20


def brute_groups(docs, least=weighted_minhash.LEAST, weights=None):
    ids = list(docs)
    plain = [weighted_minhash.plain_words(docs[i] or "") for i in ids]
    owner, hashes, often = weighted_minhash.shingles(plain)
    weight = weights.of(hashes, often)
    sets = [(hashes[owner == k], weight[owner == k]) for k in range(len(ids))]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if len(sets[x][0]) and len(sets[y][0]) and weighted_minhash.similarity(sets[x], sets[y]) >= least:
                a, b = root(ids[x]), root(ids[y])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_shingles_equal_word_tuples():
    texts = [prose(k, n) for k, n in enumerate([0, 1, 4, 5, 6, 60])] + ["a a a a a a a a"]
    owner, hashes, often = weighted_minhash.shingles(texts)
    seen = {}
    for k, text in enumerate(texts):
        words = text.split()
        want = Counter(tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))) if words else {}
        assert sorted(often[owner == k].tolist()) == sorted(want.values())
    assert len(seen) == 0 and len(set(zip(owner.tolist(), hashes.tolist()))) == len(hashes)


def test_samples_estimate_weighted_similarity():
    chance = np.random.default_rng(3)
    hashes = np.sort(chance.integers(0, 2**63, 400).astype(np.uint64))
    weight = chance.uniform(0.5, 3, 400)
    agree, exact = [], []
    for _ in range(40):
        left, right = chance.random(400) < 0.9, chance.random(400) < 0.9
        a, b = (hashes[left], weight[left]), (hashes[right], weight[right])
        exact.append(weighted_minhash.similarity(a, b))
        agree.append((weighted_minhash.samples(*a) == weighted_minhash.samples(*b)).mean())
    assert abs(np.mean(agree) - np.mean(exact)) < 0.03


def near_copies():
    docs, chance = {}, random.Random(6)
    for k in range(30):
        docs[k] = prose(k, chance.randint(3, 120))
    for k in range(90):
        words = docs[k % 9].split()
        for _ in range(chance.randint(0, 3)):
            words[chance.randrange(len(words))] = chance.choice(["new", "other", "word"])
        docs[100 + k] = " ".join(words)
    docs |= {500: None, 501: "", 502: "...", 503: docs[3].upper() + "!"}
    return docs


@pytest.mark.parametrize("block", [weighted_minhash.BLOCK, 4])
def test_groups_equal_brute_force(spark, block):
    docs = near_copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in weighted_minhash.groups(df, block=block).collect()}
    want = brute_groups(docs, weights=weighted_minhash.learn_weights(df))
    assert set(got) == set(want)
    wrong = sum(got[i] != want[i] for i in want)
    # Small blocks meet through their leaders only.
    assert wrong == 0 if block > 4 else wrong <= 3


def test_blocks_of_a_bucket_meet_with_all_members(spark):
    # A chain of drifting copies; its ends' neighbours are likely links, but the middles of its halves are far apart.
    halves = {0: [], 1: []}
    for r in spark.range(200).selectExpr("id", "pmod(xxhash64(id), 2) AS own").collect():
        halves[r.own].append(r.id)
    ids = halves[0][:4] + halves[1][:4]
    rows = [(i, [7], np.where(np.arange(80) < 10 * k, 2, 1).astype("<u2").tobytes()) for k, i in enumerate(ids)]
    classes = spark.createDataFrame(rows, "doc_id long, bands array<long>, drawn binary")
    for block in (weighted_minhash.BLOCK, 4):
        roots = weighted_minhash.components(weighted_minhash.candidate_pairs(classes, block)).collect()
        assert {r.doc_id: r.root for r in roots} == {i: min(ids) for i in ids}


def test_small_blocks_lose_no_link(spark):
    docs = near_copies()
    for start in range(4):
        words = prose(900 + start, 300).split()
        for k in range(25):
            words[10 * k:10 * k + 3] = ["drift", str(start), str(k)]
            docs[1000 + 100 * start + k] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in weighted_minhash.groups(df, block=4).collect()}
    assert got == brute_groups(docs, weights=weighted_minhash.learn_weights(df))


def test_groups_of_the_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    weights = weighted_minhash.learn_weights(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.doc_id: (r.class_id, r.keep) for r in op9_weighted_minhash(spark, SMALL).collect()}
    assert got == {i: (c, i == c) for i, c in brute_groups(docs, weights=weights).items()}


def test_groups_of_odd_rows(spark, odd, none):
    got = {r.doc_id: r.class_id for r in weighted_minhash.groups(odd).collect()}
    assert set(got) == {r[0] for r in odd_rows()}
    assert got[6] == 5 and all(got[i] == i for i in (1, 2, 3, 4, 7, 8, 9, 10)) and got[None] is None
    kept = weighted_minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert weighted_minhash.groups(none).collect() == []


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(200, 100 + k) for k in range(50)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.doc_id: r.root for r in weighted_minhash.components(df).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in [*range(100, 150), 200]}


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tool = corpus_pipeline.language_spans.Labeller(language_model(spark, SMALL))
    docs = {i: t for i, t in docs.items() if tool.predict([t])[0] != ["und"] and tool.predict([t])[1][0] >= 0.5}
    scorer = toxicity_scorer(spark, SMALL)
    docs = {i: t for i, t in docs.items() if scorer.score([t])[0] < 0.5}
    left = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    classes = brute_groups(docs, weights=weighted_minhash.learn_weights(left))
    docs = {i: t for i, t in docs.items() if classes[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    matcher = edit_matching.Matcher(items)
    docs = {i: t for i, t in docs.items() if not matcher.find(t)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_spans", "toxicity", "weighted_minhash", "edit_matching", "bpe_stream"]
    assert 0 < len(docs) < 200

"""op8 against a co-training run in plain Python over all rows at once."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from albumetrics.llm import cotraining
from albumetrics.llm.common import held_out
from albumetrics.llm.queries import op8_cotraining

DATA = "/root/testdata/sf0.01"


def plain_features(text, lang, source):
    words = text.split()
    n = len(words)
    first = [0.0] * 8
    if n:
        kinds = len(set(words))
        repeats = sum(words[i] == words[i - 1] for i in range(1, n))
        first = [1.0, kinds / n, math.log1p(kinds) / math.log1p(n), repeats / n, sum(w.isupper() for w in words) / n,
                 sum(w.isalpha() for w in words) / n, (len(text) - n) / n / 10, math.log1p(n) / 10]
    data = text.encode()
    groups = [0] * 11
    for byte in data:
        sign = chr(byte)
        if byte >= 128:
            k = 10
        elif sign.isalpha():
            k = 1 if sign.islower() else 2
        else:
            k = next((k for k, signs in {3: "0123456789", 4: " \t", 5: "\n", 6: ".,;:'\"?-()", 7: "!", 8: "|",
                                         9: "#$%&*+=@^_~<>[]{}/\\`"}.items() if sign in signs), 0)
        groups[k] += 1
    second = [0.0] * 31
    if data:
        second[:4] = [1.0, math.log1p(len(data)) / 10, math.log1p(groups[5] + 1) / 5, math.log1p(len(data) / (groups[5] + 1)) / 10]
        second[4:15] = [math.sqrt(g / len(data)) for g in groups]
    for at, value in ((15, lang), (23, source)):
        if value is not None:
            second[at + zlib.crc32(value.encode()) % 8] = 0.1
    return first, second


def solve(rows, y, weights, ridge):
    """Weighted ridge regression by many Newton steps; the first weight, of the constant, is free."""
    x = np.array([[1.0, *r] for r in rows])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x.T * (weights * p * (1 - p))) @ x + np.diag(penalty), x.T @ (weights * (p - y)) + penalty * beta)
        beta = beta - step * min(1.0, 5 / max(abs(step).max(), 1e-12))
    return beta


def odds(rows, beta):
    return np.array([beta[0] + float(np.dot(beta[1:], r)) for r in rows])


def plain_cotraining(docs, labels):
    """docs: {id: (text, lang, source)}, labels: {id: 0 or 1}; returns {id: score}."""
    features = {i: plain_features(*d) for i, d in docs.items()}
    fitted = [i for i in labels if zlib.crc32(f"calibrate {i}".encode()) % 1000 >= 300]
    kept = [i for i in labels if i not in set(fitted)]
    pool = sorted({(tuple(a), tuple(b)) for i, (a, b) in features.items() if i not in labels})
    own = [sum(labels[i] == c for i in fitted) for c in (0, 1)]
    handed = [{}, {}]  # per receiving view: place in the pool -> label
    betas = []
    for turn in range(1, 6):
        betas = []
        for k in (0, 1):
            count = [sum(v == c for v in handed[k].values()) for c in (0, 1)]
            each = [min(1.0, own[c] / max(count[c], 1)) for c in (0, 1)]
            total = [own[c] + each[c] * count[c] for c in (0, 1)]
            balance = [sum(total) / 2 / total[c] for c in (0, 1)]
            rows = [features[i][k] for i in fitted] + [pool[j][k] for j in handed[k]]
            y = [labels[i] for i in fitted] + list(handed[k].values())
            w = [balance[labels[i]] for i in fitted] + [balance[c] * each[c] for c in handed[k].values()]
            betas.append(np.round(solve(rows, np.array(y, float), np.array(w), 0.5), 7))
        if turn == 5:
            break
        new = [{}, {}]
        for k in (0, 1):
            bins = np.floor(np.arcsinh(odds([p[k] for p in pool], betas[k])) * 1000).astype(int)
            sure = math.floor(math.asinh(math.log(19)) * 1000) + 1
            for label, strength in ((1, bins), (0, -bins - 1)):
                for cut in sorted(set(strength[strength >= sure])):
                    if (strength >= cut).sum() <= int(0.1 * turn * len(pool)):
                        new[1 - k].update(dict.fromkeys(np.flatnonzero(strength >= cut).tolist(), label))
                        break
        if not new[0] and not new[1]:
            break
        handed = new
    y = np.array([labels[i] for i in kept], float)
    ones = np.ones(len(y))
    clipped = lambda ids, k: np.clip(odds([features[i][k] for i in ids], betas[k]), -20, 20)
    scales = [solve(clipped(kept, k)[:, None], y, ones, 1e-2) for k in (0, 1)]
    both = lambda ids: np.column_stack([scales[k][0] + scales[k][1] * clipped(ids, k) for k in (0, 1)])
    last = solve(both(kept), y, ones, 1e-2)
    ids = list(docs)
    return dict(zip(ids, 1 / (1 + np.exp(-odds(both(ids), last))))), handed


def test_query_equals_plain_cotraining(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter(~held_out(F.col("doc_id")))
    want, handed = plain_cotraining(
        {r.doc_id: (r.text or "", r.lang, r.source) for r in docs.collect()},
        {r.doc_id: int(r.quality) for r in labels.collect() if r.quality in (0, 1)},
    )
    got = {r.doc_id: r.score for r in op8_cotraining(spark, DATA).collect()}
    assert handed[0] and handed[1]
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_every_unlabelled_row_teaches(spark):
    """Few labels: the pool is all other rows, and what it teaches shows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("doc_id % 3 = 0")
    want, handed = plain_cotraining(
        {r.doc_id: (r.text or "", r.lang, r.source) for r in docs.collect()},
        {r.doc_id: int(r.quality) for r in labels.collect() if r.quality in (0, 1)},
    )
    got = {r.doc_id: r.score for r in cotraining.score(docs, cotraining.learn(docs, labels)).collect()}
    assert handed[0] or handed[1]
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_cutoffs_take_whole_bins():
    bins, counts = np.array([5000, 4000, 3000, -4000, -5000]), np.array([2, 3, 4, 10, 1])
    assert cotraining.cutoffs(bins, counts, 5) == (4000, 5, -5000, 1)
    assert cotraining.cutoffs(bins, counts, 1) == (None, 0, -5000, 1)
    assert cotraining.cutoffs(bins, counts, 100) == (3000, 9, -4000, 11)
    assert cotraining.cutoffs(np.array([], int), np.array([], int), 5) == (None, 0, None, 0)

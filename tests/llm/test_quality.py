"""The quality classifier: statistics and trees against plain versions, and accuracy on rows held out."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import texts

from bedside.llm import quality, queries


def plain(text):
    """Statistics of a text, word by word."""
    data = text.encode()
    w = [x.encode() for x in re.findall(texts.SPACES, text)]
    n, some = len(w), max(len(w), 1)
    counts, byte = Counter(w), Counter(data)
    mean = sum(map(len, w)) / some
    entropy = -sum(c / len(data) * math.log(c / len(data)) for c in byte.values())
    values = [
        math.log1p(n), math.log1p(len(data)), mean, math.sqrt(max(0, sum(len(x) ** 2 for x in w) / some - mean**2)),
        len(counts) / some, max(counts.values(), default=0) / some, len(set(zip(w, w[1:]))) / max(n - 1, 1), entropy,
        n / (byte[10] + 1), *[sum(c for b, c in byte.items() if t[b]) / max(len(data), 1) for t in quality.BYTES.values()],
    ]
    letter, small = rb"[A-Za-z\x80-\xff]", rb"[a-z]"
    kinds = [
        [bool(re.search(letter, x)) and not re.search(small, x) for x in w],
        [bool(re.search(rb"[#$%&*|<>{}\[\]@^~\\_/+=]", x)) for x in w],
        [i > 0 and x == w[i - 1] for i, x in enumerate(w)],
        [x in w[max(0, i - 8) : i] for i, x in enumerate(w)],
        [not re.search(letter, x) for x in w],
    ]
    values += [sum(k) / some for k in kinds]
    parts = max(1, (n + 16) // 32)
    of = [i * parts // some for i in range(n)]
    return values + [max((sum(x for x, p in zip(k, of) if p == q) / of.count(q) for q in set(of)), default=0) for k in kinds]


BODIES = ["", " \t", "one", "a a a b", "A | B | C\n\nd # é ÄÖ", "x " * 300 + "Y" * 50 + " end.", *[r[1] for r in texts.awkward() if r[1] and len(r[1]) < 1000]]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_statistics_against_a_plain_version(limit):
    got = quality.statistics([t.encode() for t in BODIES], limit)
    assert got.shape == (len(BODIES), len(quality.STATISTICS))
    assert got == pytest.approx(np.array([plain(t) for t in BODIES]), abs=1e-9)


@pytest.fixture(scope="module")
def learnt():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 1)  # ties
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    return x, y, quality.train(x, y, np.ones(600), trees=20, depth=3)


def test_flat_trees_score_like_a_walk_row_by_row(learnt):
    x, _, model = learnt

    def walk(row, t):
        at = 0
        while at < model.feature.shape[1]:
            at = 2 * at + 1 + (row[model.feature[t, at]] > model.threshold[t, at])
        return model.leaf[t, at - model.feature.shape[1]]

    want = [model.bias + sum(walk(row, t) for t in range(20)) for row in x]
    assert quality.margins(model, x) == pytest.approx(want, abs=1e-12)


def test_first_split_is_the_best_of_all(learnt):
    x, y, model = learnt
    p = y.mean()

    def gain(f, at):
        right = x[:, f] > at
        return sum(
            (p - y[side]).sum() ** 2 / (p * (1 - p) * side.sum() + 1) for side in (right, ~right) if side.any()
        )

    best = max(gain(f, at) for f in range(4) for at in quality._edges(x[:, f], 48))
    assert gain(model.feature[0, 0], model.threshold[0, 0]) == pytest.approx(best)


def test_learns_an_interaction_and_handles_one_class(learnt):
    x, y, model = learnt
    assert ((quality.margins(model, x) > 0) == y).mean() > 0.97
    alone = quality.train(x, np.ones(600), np.ones(600))
    assert quality.margins(alone, x) == pytest.approx(math.log(999))
    assert quality.margins(quality.train(x[:0], y[:0], y[:0]), x) == pytest.approx(0.0)


def test_held_out_rows(spark):
    # the next size up, for enough held-out rows of the rare class
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op12_quality"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    own = [(got[r.doc_id], r.quality) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    assert len(own) > 50 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got.values())
    good, bad = ([g.score for g, q in own if q == v] for v in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(g.predicted for g, q in own if q == 1) / len(good) > 0.95


def test_awkward_rows(spark):
    rows = texts.awkward()
    docs = texts.frame(spark).selectExpr("*", "1 AS id", "2 AS body", "3 AS score", "4 AS y", "5 AS found")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (5, 0), (6, 0), (9, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, least=0.1)
    got = quality.score_quality(docs, model)
    assert got.columns == docs.drop("score").columns + ["score"] and got.count() == len(rows)
    by_text = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert by_text[rows[0][1]] > by_text[""]
    for empty in (labels.where("false"), labels.where("doc_id = 99")):
        assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, empty)).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), quality.fit_quality(docs.where("false"), labels)).count() == 0

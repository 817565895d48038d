"""Substring dedup on repeated ids, and with the bounds of its tasks lowered."""

import itertools
import random

import pytest
import texts

from bedside.llm import substring


def two_texts_an_id(ids=40):
    rng, number = random.Random(11), itertools.count()

    def some(n):
        return [f"w{next(number)}" for _ in range(n)]

    rows = []
    for i in range(ids):
        passage = some(60)
        rows += [(i, " ".join(some(30) + passage + some(25))), (i, " ".join(some(12) + passage + some(40)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [{}, {"remembered": 1}, {"hot": 1}, {"index_words": 50, "remembered": 3}])
def test_a_passage_of_two_texts_of_one_id(spark, bounds):
    rows = two_texts_an_id()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in substring.remove_repeats(docs, **bounds).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got) == 40 and all(sorted(r.n_removed for r in own) == [0, 60] for own in got.values())
    for i, own in got.items():
        cut = next(r for r in own if r.n_removed)
        passage = set.intersection(*[set(t.split()) for j, t in rows if j == i])
        before = next(t for j, t in rows if j == i and len(t.split()) == cut.n_words)
        assert cut.kept_text.split() == [w for w in before.split() if w not in passage]


@pytest.mark.parametrize("bounds", [{"hot": 1}, {"remembered": 2}, {"index_words": 40}])
def test_bounds_do_not_change_the_result(spark, sf_dir, bounds):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in substring.remove_repeats(docs, **bounds).collect()}
    for i, n, removed, kept in texts.repeats([(r.doc_id, r.text) for r in docs.collect()]):
        assert (got[i].n_words, got[i].n_removed) == (n, removed)
        assert removed == 0 or got[i].kept_text == kept

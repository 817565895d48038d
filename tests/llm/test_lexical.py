"""Ranked search against a plain ranking of all documents."""

import math
import re
from collections import Counter

import pytest
import texts

from bedside.llm import lexical

TERM = re.compile(lexical.TERM)


def ranked(docs, items, top=10):
    """item -> [(doc, score)], best first."""
    counted = [(i, Counter(TERM.findall(texts.lower(t or "")))) for i, t in docs]
    holding = Counter(term for _, c in counted for term in c)
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(TERM.findall(texts.lower(text or "")))
    out = {}
    for item, terms in wanted.items():
        found = []
        for i, c in counted:
            n, score = sum(c.values()), 0
            for term in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                score += w * (10**9 * c[term] // (1000 * c[term] + 8 * (10 + 90 * n * n_docs // total)))
            if score > 0:
                found.append((i, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:top]
    return {k: v for k, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


ITEMS = [
    (1, "w1 w2 W3, w1"), (1, "w4"), (2, "ONE two"), (3, None), (4, "--"), (None, "w1"), (5, "äö É ÄÖ 😀 x z"), (6, "absent"),
    (7, " ".join(f"w{i}" for i in range(300))),
]


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_awkward_rows_and_blocks(spark, block_terms):
    docs = texts.frame(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS item", "'x' AS term", "2 AS score")
    want = ranked([(r[0], r[1]) for r in texts.awkward()], ITEMS, 4)
    found = lexical.rank_documents(docs.selectExpr("*", "1 AS body", "2 AS id", "3 AS part", "4 AS rank"), items, top=4, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == want and set(want) == {1, 2, 5, 7}


def test_empty_tables(spark):
    docs, items = texts.frame(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs.where("false"), items).count() == 0
    assert lexical.rank_documents(docs, items.where("false")).count() == 0


def test_texts_over_several_stretches(monkeypatch):
    monkeypatch.setattr(lexical, "_STRETCH", 16)
    terms = ["w1", "a", "longerthansixteenbytes", "é"]
    bodies = [b"", "a A,w1 longerthansixteenbytes é w11 a".encode() * 9, b"w1 zz", b"--"]
    sizes, doc, term, tf = lexical.count_terms(lexical.automaton(terms), bodies)
    want = [Counter(TERM.findall(texts.lower(b.decode()))) for b in bodies]
    assert list(sizes) == [sum(c.values()) for c in want]
    assert dict(zip(zip(doc, term), tf)) == {(i, terms.index(t)): n for i, c in enumerate(want) for t, n in c.items() if t in terms}


def test_few_cells_and_candidates_at_once(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(lexical, "_CELLS", 500)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:5]
    pairs = sorted({(i, t) for i, text in items for t in TERM.findall(texts.lower(text))})
    index = lexical._collected(spark.createDataFrame(pairs, "item long, term string"))
    counted = lexical.count_terms(lexical.automaton(index.terms), [t.encode() for _, t in docs])
    sizes, doc, term, _ = counted
    n_docs, total = int((sizes > 0).sum()), int(sizes.sum())
    weight = lexical.weights(n_docs, [int((term == t).sum()) for t in range(len(index.terms))])
    import pyarrow as pa

    monkeypatch.setattr(lexical, "_WAITING", 12)
    best, ids, parts = lexical.Best(len(index.ids), 10, pa.int64()), pa.array([i for i, _ in docs]), 0
    for start, matrix in lexical.scores(index, weight, n_docs, total, *counted):
        best.add(matrix, ids.slice(start, len(matrix)))
        parts += 1
    found = {}
    for r in best.kept().to_pylist():
        found.setdefault(index.ids[r["item"]].as_py(), []).append((r["doc"], r["score"]))
    assert parts > 3 and found == ranked(docs, items)

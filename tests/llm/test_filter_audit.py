"""The filter audit against filters applied one after the other."""

import re
from itertools import permutations

import pytest
import texts
from pyspark.sql import functions as F

from bedside.llm import filter_audit

LABELS = [(1, 1, 0), (1, 0, 1), (2, 0, 0), (3, 1, 1), (9, None, 1), (10, 1, None), (99, 1, 1), (None, 1, 1)]


def failing(docs):
    """Failed filters of each (id, text, part)."""
    out = []
    for i, text, _ in docs:
        text = text or ""
        w = re.findall(texts.SPACES, text)
        found = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        out.append({k for k, v in found.items() if v})
    return out


def audit(docs, labels):
    fails, rows = failing(docs), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in sorted({p or "" for _, _, p in docs}):
        own = [(i, f) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        of_part = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if k in f]
                left = [(i, f) for i, f in left if k not in f]
                failed = sum(k in f for _, f in own)
                of_part.append(
                    (part, order, step, len(left), len(gone), failed - len(gone), sum(f == {k} for _, f in own),
                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                )
        shares = {k: sum(r[4] for r in of_part if r[1][r[2] - 1] == k) for k in "ABCDE"}
        rows += [(*r, shares[r[1][r[2] - 1]]) for r in of_part]
    return sorted(rows)


def long_texts():
    """Texts that pass A, in all combinations of B, C and D, with copies."""
    rows = []
    for n in range(24):
        body = [("AB" if n & 1 else "ab") + str(i % (60 if n & 2 else 200)) for i in range(120)] + (["#"] if n & 4 else [])
        rows.append((100 + n, " \u000b".join(body), ("en", "de", "")[n % 3], "s", 1))
    return rows


@pytest.mark.parametrize("most_counters", [1 << 30, 1 << 15])
def test_awkward_rows(spark, most_counters):
    rows = texts.awkward() + long_texts()
    docs = texts.frame(spark, rows).selectExpr("*", "1 AS body", "2 AS id", "3 AS mask", "4 AS part", "5 AS same", "6 AS possible")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS id", "2 AS good", "3 AS n")
    got = filter_audit.audit_filters(docs, labels, most_counters=most_counters)
    assert sorted(map(tuple, got.collect())) == audit([r[:3] for r in rows], LABELS)


def test_empty_tables(spark):
    docs, labels = texts.frame(spark), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs.where("false"), labels).count() == 0
    got = filter_audit.audit_filters(docs, labels.where("false"))
    assert sorted(map(tuple, got.collect())) == audit([r[:3] for r in texts.awkward()], [])


def test_filter_clears_only_texts_without_an_equal(spark):
    rows = spark.range(4000).select(F.expr("CASE WHEN id < 3900 THEN concat('t', id) ELSE concat('t', id % 7) END").alias("body"))
    for width, most in ((17, 60), (15, 400)):
        hashed = rows.select("body", *filter_audit._hashes(width)).cache()
        bitmaps = filter_audit.repeated_counters(hashed)
        kept = {r.body: r.possible for r in filter_audit.with_possible(hashed, bitmaps).collect()}
        repeated = {r.body for r in rows.groupBy("body").count().where("count > 1").collect()}
        assert all(kept[b] for b in repeated) and len(repeated) <= sum(kept.values()) <= len(repeated) + most


def test_masks_from_a_saturated_filter_are_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = sorted((i, sum(1 << "ABCDE".index(k) for k in f)) for (i, _, _), f in zip(rows, failing(rows)))
    many = docs.unionByName(docs.withColumn("text", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    for most in (1 << 30, 1 << 15):
        got = filter_audit.failure_masks(many, most_counters=most).where("id < 10000000")
        assert sorted((r.id, r["mask"]) for r in got.collect()) == want

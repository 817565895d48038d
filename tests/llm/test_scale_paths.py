"""The ways that only large inputs take, on small ones: same rows as the usual way and as plain versions."""

import gc
import re
import weakref
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
import texts
from pyspark.sql import functions as F

from bedside.llm import decontaminate, lexical, line_dedup, near_dedup, words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items, window=13):
    """Number of words, words inside a window's occurrence, items that occur, and the hit runs of the original."""
    found = list(WORDS.finditer(texts.lower(text or "")))
    ws = [m.group() for m in found]
    hit, names = set(), set()
    for item, body in items:
        own = WORDS.findall(texts.lower(body or ""))
        for at in range(max(1, len(own) - window + 1)) if own else ():
            part = own[at : at + window]
            for i in range(len(ws) - len(part) + 1):
                if ws[i] == part[0] and ws[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    names.add(item)
    runs = []
    for i in sorted(hit):
        if i - 1 in hit:
            runs[-1] = (runs[-1][0], found[i].end())
        else:
            runs.append((found[i].start(), found[i].end()))
    return len(ws), sorted(hit), sorted(names), runs


def marked(df):
    return Counter((r.text, r.n_words, tuple(r.hit_words), tuple(r.hit_items), tuple((s.start, s.end) for s in r.hit_spans)) for r in df.collect())


@pytest.mark.parametrize("characters", [500_000, 150, 1])
def test_decontamination_with_several_automata(spark, characters):
    passage = " ".join(f"Q{i}" for i in range(20))
    items = [("b1", passage), ("b2", "ä-Öl, w3"), ("b2", "ä-Öl, w3"), ("b3", "w1 w2"), ("b4", None), ("b5", "..."), (None, "w4"), ("b6", passage + " tail")]
    rows = [r for r in texts.awkward() if r[0] not in (7, 8)]
    rows += [(20, f"😀 {passage.lower()}! then {' '.join(passage.split()[3:17])}", "en", "s", 1), (21, "ä öL w3 ä Öl w3", "en", "s", 1), (22, "w1 w1 w2 w2", "en", "s", 1)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = marked(decontaminate.mark_contamination(texts.frame(spark, rows), benchmark, automaton_chars=characters))
    plain = [(r[1], *hits(r[1], [i for i in items if i[0] is not None])) for r in rows]
    assert got == Counter((t, n, tuple(h), tuple(i), tuple(s)) for t, n, h, i, s in plain)
    assert sum(bool(key[2]) for key in got) >= 3


def without_boilerplate(rows, ratio=line_dedup.RATIO, least=line_dedup.LEAST_PAGES):
    """Texts after the lines that a host repeats over its pages are gone, in the order of the rows."""
    pages, counts = Counter(), Counter()
    for text, host in rows:
        pages[host] += 1
        for line in {l.strip(" ") for l in (text or "").split("\n")} - {""}:
            counts[host, line] += 1
    out = []
    for text, host in rows:
        if text is not None:
            lines = text.split("\n")
            kept = [l for l in lines if not l.strip(" ") or counts[host, l.strip(" ")] < least or counts[host, l.strip(" ")] <= ratio * pages[host]]
            text = text if len(kept) == len(lines) else "\n".join(kept)
        out.append((text, host))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_boilerplate_by_broadcast_and_by_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rows = [(f"Menu\n own {i} \n\nMenu \n{'rare' if i < 4 else i}", "hot") for i in range(60)]
    rows += [("Menu\nprivacy", None)] * 6  # repeated rows are pages of their own; a null host is a host
    rows += [(f"{i}\nMenu", f"host {i}") for i in range(5)] + [(None, "hot"), ("", "hot"), (None, None), ("Menu", "n")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
        cleaned = line_dedup.drop_boilerplate(docs)
        plan = cleaned._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (broadcast > 0)
        got = cleaned.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert Counter((r.text, r.source) for r in got) == without_boilerplate(rows)
    assert sum(r.text == "" and r.source is None for r in got) == 6


def test_near_duplicates_hand_texts_over_in_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []

    def watched(run):
        def inner(df, *more):
            if "MapInArrow" in df._jdf.queryExecution().logical().toString():
                seen.append(spark.conf.get(key))
            return run(df, *more)

        return inner

    before = spark.conf.get(key)
    for name in ("written", "cut"):
        monkeypatch.setattr(near_dedup, name, watched(getattr(near_dedup, name)))
    body = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{body} {i % 7} tail {i % 3}") for i in range(40)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).where("kept").count() == 1
    assert len(seen) >= 3 and set(seen) == {"4m"} and spark.conf.get(key) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    long = spark.range(0, 8000, 1, 1).select(F.expr("repeat('word ', 400)").alias("body"))
    with words.small_batches(spark):
        assert max(r[0] for r in long.mapInArrow(sizes, "size long").collect()) < 5 << 20
    assert spark.conf.get(key) == before


def test_tasks_give_freed_memory_back():
    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) >> 10

    pins = []

    def run(batches):
        for batch in batches:
            blocks = [b"x" * 60_000 for _ in range(3_000)]  # too small to be mapped one by one
            pins.append(blocks[-1])  # what lies behind the freed blocks
            yield batch

    def kept(run):
        before = held()
        list(run(iter([None])))
        return held() - before

    assert kept(words.lean(run)) < 60
    assert kept(run) > 100  # 180 MB stay otherwise


def test_the_pipeline_writes_its_stages_in_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(corpus_pipeline, "load_table", lambda spark, sf_dir, name: spark.range(3))
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: seen.append(spark.conf.get(key)) or df)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: docs) for name in "abc"])
    before = spark.conf.get(key)
    assert corpus_pipeline.run(spark, "").count() == 3
    assert seen == ["4m", "4m"] and spark.conf.get(key) == before


def test_a_worker_keeps_one_thing_of_all_operators():
    class Large:
        pass

    first = words.kept("a job", Large)
    assert words.kept("a job", Large) is first
    gone = weakref.ref(first)
    del first
    assert gone() is not None
    list(words.lean(lambda batches: batches, "a job")(iter([None])))
    assert gone() is not None
    lexical._trie("another", ["term"])
    gc.collect()
    assert gone() is None
    gone = weakref.ref(words.kept("a job", Large))
    list(words.lean(lambda batches: batches, "another")(iter([None])))
    gc.collect()
    assert gone() is None


def test_marking_keeps_other_columns_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, None, 2**60 + 1)], "doc_id long, text string, more long")
    items = spark.createDataFrame([("x", "b")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.mark_contamination(docs, items).collect()}
    assert (got[1].more, got[2].more) == (None, 2**60 + 1)
    assert got[1].hit_words == [1] and got[1].hit_items == ["x"] and [tuple(h) for h in got[1].hit_spans] == [(2, 3)]
    assert got[2].hit_words == [] and got[2].n_words == 0

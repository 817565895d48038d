"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test questions and answers.

Texts are normalised to lower-case words with one blank between them; each text is scanned once, and hits
are mapped back to code-point offsets of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from ..sources.lineage import cut

WINDOW = 13
_CLEAN = bytes(words.LOWER[b] if words.ALNUM[words.LOWER[b]] else 32 for b in range(256))
_HITS = "hit_words array<long>, hit_items array<string>, hit_spans array<struct<start:long,end:long>>, n_words long"
_HIT_TYPES = {
    "hit_words": pa.list_(pa.int64()), "hit_items": pa.list_(pa.string()),
    "hit_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "n_words": pa.int64(),
}


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Windows of the items (an item of fewer words is one window) and the items each belongs to."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        ws = normalised(words.encoded([text])[0])
        for i in range(max(1, len(ws) - window + 1)) if ws else ():
            found.setdefault(b" ".join(ws[i : i + window]), set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def automaton(windows: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for key, item_ids in windows.items():
        # bytes as Latin-1 characters: one character is one byte of the normalised text
        trie.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, item_ids))
    trie.make_automaton()
    return trie


def scan(trie: ahocorasick.Automaton, text: bytes) -> tuple[np.ndarray, set[str], int]:
    """Numbers of the words inside occurrences, the items that occur, and the number of words."""
    ws = normalised(text)
    line = b" " + b" ".join(ws) + b" "
    matches = list(trie.iter(line.decode("latin-1"))) if ws and len(trie) else []
    if not matches:
        return np.zeros(0, dtype=np.int64), set(), len(ws)
    last = np.cumsum(np.frombuffer(line, dtype=np.uint8) == 32)
    cover = np.zeros(len(ws) + 1, dtype=np.int64)
    items: set[str] = set()
    for end, (n, item_ids) in matches:
        stop = last[end] - 1
        cover[stop - n] += 1
        cover[stop] -= 1
        items.update(item_ids)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0), items, len(ws)


def original_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the runs of hit words."""
    if not len(hit):
        return []
    w = words.split([text], words.ALNUM, lower=True)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    cuts = np.flatnonzero(np.diff(hit) > 1)
    begins, stops = hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])]
    return [(int(points[w.start[b]]), int(points[w.end[s]])) for b, s in zip(begins, stops)]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    automaton_chars: int = 500_000,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (numbers of the words inside an occurrence), ``hit_items``
    (sorted as strings) and ``hit_spans`` (code points of the original text).

    Rows stay one to one, repeated ones too. A null or word-free text has no words and no hits; benchmark
    rows without words or without an id are ignored; repeated item ids count once. Columns of ``docs`` that
    bear the new names are replaced.

    One automaton holds at most ``automaton_chars`` characters of benchmark text (each takes part in up to
    ``window`` windows). A larger benchmark is divided by a hash of its ids, and the documents are scanned
    once for each part; the driver never holds more than one part.
    """
    spark = docs.sparkSession
    new = ["n_words", "hit_words", "hit_items", "hit_spans"]
    rest = [c for c in docs.columns if c not in new]
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).where(
        "item IS NOT NULL AND body IS NOT NULL"
    )
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, -(-size // automaton_chars))
    out = docs.select(
        *rest,
        F.array().cast("array<long>").alias("hit_words"),
        F.array().cast("array<string>").alias("hit_items"),
        F.lit(0).cast("long").alias("n_words"),
    )
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else items
        # bounded by automaton_chars
        windows = spark.sparkContext.broadcast(item_windows([tuple(r) for r in mine.collect()], window))
        out = _scanned(out, windows, rest, text)
        if part + 1 < parts:
            out = cut(out)
    return out.select(*rest, *new)


def _scanned(docs: DataFrame, windows, rest: list[str], text: str) -> DataFrame:
    schema, key = docs.select(*rest)._jdf.schema().toDDL(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = words.kept(key, lambda: automaton(windows.value))
        for batch in batches:
            for part in words.slices(batch, text):
                hits, item_ids, spans, counts = [], [], [], []
                before = (part.column(c).to_pylist() for c in ("hit_words", "hit_items"))
                for body, hit, known in zip(words.encoded(part.column(text).to_pylist()), *before):
                    found, items, n = scan(trie, body)
                    merged = np.union1d(found, np.asarray(hit, dtype=np.int64)).astype(np.int64)
                    hits.append(merged)
                    item_ids.append(sorted(items.union(known)))
                    spans.append([{"start": b, "end": e} for b, e in original_spans(body, merged)])
                    counts.append(n)
                told = [pa.array(v, kind) for v, kind in zip((hits, item_ids, spans, counts), _HIT_TYPES.values())]
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), *told], [*rest, *_HIT_TYPES])

    return docs.mapInArrow(words.lean(run, key), ", ".join(x for x in (schema, _HITS) if x))


def contaminated(n_hit, n_words, share: int = 20):
    """The rule: some word is hit, and at least one word in ``share`` is."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    marked = mark_contamination(docs, benchmark, **options)
    return marked.where(~contaminated(F.size("hit_words"), F.col("n_words"))).select(*docs.columns)

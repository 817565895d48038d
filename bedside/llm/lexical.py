"""Ranked lexical search: one Aho-Corasick automaton of all terms of the items is run over the texts themselves.

A term stands in the automaton between two blanks, so it is found as a whole word only, and its number leads to
the items that hold it. No index of the documents is built: a first scan counts, a second one counts again, scores
and keeps each task's best documents of every item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Length normalisation: a document's m is 10 + 90 n N / L.
BASE, SLOPE = 10, 90
_CLEAN = bytes(words.LOWER[b] if words.ALNUM[words.LOWER[b]] else 32 for b in range(256))
_STRETCH = 1 << 20  # bytes that the automaton reads at once
_CELLS = 1 << 21  # scores and contributions that a task holds at once
_WAITING = 100_000  # candidates that a task holds before it sorts them


class Terms(NamedTuple):
    """Terms of a block of items; those of term t are ``item[first[t]:first[t + 1]]``, numbers in ``ids``."""

    terms: list[str]
    first: np.ndarray
    item: np.ndarray
    ids: pa.Array


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Bytes as Latin-1 characters: one character is one byte of the cleaned text."""
    trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(terms):
        trie.add_word(f" {term.encode().decode('latin-1')} ", number)
    if terms:
        trie.make_automaton()
    return trie


def _stretches(clean: bytes, limit: int = _STRETCH) -> Iterator[tuple[int, bytes]]:
    """Parts of a text with their offsets; each begins and ends with a blank, which neighbours share."""
    start = 0
    while start < len(clean) - 1:
        stop = len(clean) - 1
        if stop - start > limit:
            stop = clean.rfind(b" ", start + 1, start + limit)
            if stop < 0:
                stop = clean.index(b" ", start + limit)
        yield start, clean[start : stop + 1]
        start = stop


def count_terms(trie: ahocorasick.Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text (with repeats, whether in the automaton or not), and (text, term, tf) in this order."""
    clean = b" %s " % b" ".join(texts).translate(_CLEAN)
    offset = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)])
    inside = np.frombuffer(clean, dtype=np.uint8) != 32
    begin = np.flatnonzero(inside[1:] & ~inside[:-1])  # the blank before a term
    sizes = np.diff(np.searchsorted(begin, offset))
    width = max(1, len(trie))
    keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for start, part in _stretches(clean) if len(trie) else ():
        found = np.fromiter(chain.from_iterable(trie.iter(part.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        owner = np.searchsorted(offset, found[:, 0] + start - 1, side="right") - 1
        key, n = np.unique(owner * width + found[:, 1], return_counts=True)
        keys.append(key)
        counts.append(n)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)  # a text may go over several stretches
    tf = np.zeros(len(key), dtype=np.int64)
    np.add.at(tf, at, np.concatenate(counts))
    return sizes, key // width, key % width, tf


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _trie(key: str, terms: list[str]) -> ahocorasick.Automaton:
    return words.kept(key, lambda: automaton(terms))


def _collected(block: DataFrame) -> Terms:
    """``block``: (item, term) pairs, as many as ``block_terms`` allows."""
    table = block.toArrow()
    ids = table["item"].combine_chunks().unique()
    item = pc.index_in(table["item"].combine_chunks(), ids).to_numpy().astype(np.int64)
    names = table["term"].combine_chunks().dictionary_encode()
    term = names.indices.to_numpy().astype(np.int64)
    order = np.lexsort((item, term))
    first = np.searchsorted(term[order], np.arange(len(names.dictionary) + 1))
    return Terms(names.dictionary.to_pylist(), first, item[order], ids)


def _statistics(texts: DataFrame, sent, key: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each term: a row a term and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value.terms
        trie = _trie(key, terms)
        holding = np.zeros(len(terms), dtype=np.int64)
        documents = total = 0
        for batch in batches:
            for part in words.slices(batch, "body"):
                sizes, _, term, _ = count_terms(trie, _bytes(part.column("body")))
                holding += np.bincount(term, minlength=len(terms))
                documents += int((sizes > 0).sum())
                total += int(sizes.sum())
        at = np.flatnonzero(holding)
        term, n = np.concatenate([at, [-1, -2]]), np.concatenate([holding[at], [documents, total]])
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    rows = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    known = {r["term"]: r["n"] for r in rows}
    holding = np.array([known.get(t, 0) for t in range(len(sent.value.terms))], dtype=np.int64)
    return known.get(-1, 0), known.get(-2, 0), holding


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    value = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding]
    return np.array(value, dtype=np.int64)


def scores(terms: Terms, weight: np.ndarray, documents: int, total: int, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of consecutive texts as matrices (texts x items), with the number of each one's first text."""
    many = len(terms.ids)
    m = (100 - SLOPE) + (SLOPE * sizes * documents) // max(total, 1)
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    fan = terms.first[term + 1] - terms.first[term]
    edge = np.searchsorted(doc, np.arange(len(sizes) + 1))
    cost = np.concatenate([[0], np.cumsum(np.maximum(np.diff(np.concatenate([[0], np.cumsum(fan)])[edge]), many))])
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(cost, cost[start] + _CELLS, side="right")) - 1)
        own = slice(edge[start], edge[stop])
        n = fan[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = terms.item[np.repeat(terms.first[term[own]], n) + place]
        matrix = np.zeros((stop - start, many), dtype=np.int64)
        np.add.at(matrix.reshape(-1), np.repeat((doc[own] - start) * many, n) + item, np.repeat(value[own], n))
        yield start, matrix
        start = stop


class Best:
    """The ``top`` best candidates of every item so far."""

    def __init__(self, items: int, top: int, kind: pa.DataType):
        self._top, self._floor, self._kind = top, np.ones(items, dtype=np.int64), kind
        self._held: list[pa.Table] = []
        self._waiting = 0

    def add(self, matrix: np.ndarray, ids: pa.Array) -> None:
        doc, item = np.nonzero(matrix >= self._floor)
        if len(doc):
            self._held.append(pa.table({"item": item, "score": matrix[doc, item], "doc": ids.take(pa.array(doc))}))
            self._waiting += len(doc)
            if self._waiting > _WAITING:
                self._held = [self.kept()]
                self._waiting = len(self._held[0])

    def kept(self) -> pa.Table:
        if not self._held:
            return pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "doc": pa.array([], self._kind)})
        table = pa.concat_tables(self._held).sort_by([("item", "ascending"), ("score", "descending"), ("doc", "ascending")])
        item = table["item"].to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = np.flatnonzero(place == self._top - 1)
        self._floor[item[last]] = table["score"].to_numpy()[last]  # an equal score may still come with a smaller id
        return table.filter(pa.array(place < self._top))


def _candidates(rows: DataFrame, sent, key: str, weight, documents: int, total: int, top: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        trie, best = _trie(key, terms.terms), None
        for batch in batches:
            if best is None:
                best = Best(len(terms.ids), top, batch.schema.field("id").type)
            for part in words.slices(batch, "body"):
                counted = count_terms(trie, _bytes(part.column("body")))
                for start, matrix in scores(terms, weight.value, documents, total, *counted):
                    best.add(matrix, part.column("id").slice(start, len(matrix)))
        if best is not None:
            table = best.kept().combine_chunks()
            item = terms.ids.take(table["item"].combine_chunks())
            yield from pa.table({"item": item, "score": table["score"], "doc": table["doc"]}).to_batches()

    return rows.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = 10,
    block_terms: int = 200_000,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` best documents of every item, with a score above 0.

    Every row of ``docs`` is a document, repeated rows too. Equal scores go by ascending id, null ids last; rows
    that agree in both take ranks in any order. Null and empty texts have no terms and are never found. Items
    without an id or a term have no rows; several rows of an item id are one item with the terms of all.
    Without documents or items the result is empty. Other columns are not read.

    The items' terms are broadcast, at most about ``block_terms`` (item, term) pairs at once, but a whole item at least:
    more items are searched block by block, each with two scans. A task sends its ``top`` best documents an item.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    pairs = (
        items.select(F.col(item_id).alias("item"), F.translate(item_text, UPPER, LOWER).alias("body"))
        .where("item IS NOT NULL AND body IS NOT NULL")
        .select("item", F.explode(F.regexp_extract_all("body", F.lit(TERM), F.lit(0))).alias("term"))
        .distinct()
    )
    kinds = dict(rows.dtypes) | dict(pairs.dtypes)
    schema = f"item {kinds['item']}, score long, doc {kinds['id']}"
    blocks = -(-pairs.count() // block_terms)
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else pairs
        terms, key = _collected(own), uuid.uuid4().hex
        sent = spark.sparkContext.broadcast(terms)
        documents, total, holding = _statistics(rows.select("body"), sent, key)
        weight = spark.sparkContext.broadcast(weights(documents, holding))
        part = _candidates(rows, sent, key, weight, documents, total, top, schema)
        found = part if blocks == 1 else found.unionByName(part)
    # Candidates of an item grow with the number of tasks, so they are first ranked in as many parts as a shuffle has.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _first(found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts))), ["item", "part"], top)
    return _first(found, ["item"], top).select(
        F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score"
    )


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

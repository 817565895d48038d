"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are shares and rates over its whole text, and extremes over its passages of about ``PASSAGE``
words, so that a bad part of a long text shows. The trees are grown in numpy on binned statistics of a bounded
sample and flattened into arrays of one shape, which score a batch of texts in as many steps as a tree is deep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .language import sample_ids

PASSAGE = 32
_CHUNK = 1 << 20  # bytes that are split into words at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _table(chars) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


CAPITAL, SMALL, BEYOND = _table(range(65, 91)), _table(range(97, 123)), _table(range(128, 256))
SYMBOL = _table(b"#$%&*|<>{}[]@^~\\_/+=")
#: Shares of a text's bytes.
BYTES = {
    "capital": CAPITAL, "small": SMALL, "beyond": BEYOND, "symbol": SYMBOL, "digit": _table(b"0123456789"),
    "stop": _table(b".?"), "comma": _table(b",;:"), "bang": _table(b"!"), "bar": _table(b"|"),
    "newline": _table(b"\n"), "blank": ~words.NON_SPACE,
}
#: Shares of a text's words: without small letters; with a symbol; like the word before; like one of the eight
#: before; without a letter. Each also as the largest share in a passage.
WORDS = ("shouted", "marked", "again", "recent", "bare")
STATISTICS = (
    "log_words", "log_bytes", "word_size", "word_spread", "distinct", "top_word", "pairs", "entropy", "line_words",
    *BYTES, *WORDS, *(f"most_{k}" for k in WORDS),
)


def _chunks(texts: list[bytes], limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Parts of about ``limit`` bytes with the texts they are of; a longer text is cut at blanks."""
    owner, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            blank = _BLANK.search(text, start + limit)
            stop = blank.start() if blank else len(text)
            owner.append(i)
            parts.append(text[start:stop])
            size += stop - start
            start = stop
            if size >= limit:
                yield owner, parts
                owner, parts, size = [], [], 0
    if parts:
        yield owner, parts


def _runs(owner: np.ndarray, value: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: distinct values, and how often the most frequent one occurs."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (v[1:] != v[:-1]))) if len(o) else np.zeros(0, dtype=np.int64)
    most = np.zeros(many)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(o))))
    return np.bincount(o[first], minlength=many), most


def statistics(texts: list[bytes], limit: int = _CHUNK) -> np.ndarray:
    """Texts x STATISTICS; all 0 for an empty text."""
    many = len(texts)
    spread = np.zeros((many, 256))
    owners, hashes, sizes, letters, smalls, symbols = ([np.zeros(0, dtype=t)] for t in (np.int64, np.uint64, *[np.int64] * 4))
    for owner, parts in _chunks(texts, limit):
        w = words.split(parts, words.NON_SPACE, lower=False)
        raw = np.frombuffer(w.data, dtype=np.uint8)
        of_part = np.array(owner)
        of_byte = np.repeat(of_part, np.diff(w.offset))
        inside = np.ones(len(raw), dtype=bool)
        inside[w.offset[1:] - 1] = False  # the blanks that join the parts
        key, n = np.unique(of_byte[inside] * 256 + raw[inside], return_counts=True)
        spread.reshape(-1)[key] += n

        def of_words(table: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(table[raw])])
            return upto[w.end] - upto[w.start]

        small = of_words(SMALL)
        for found, value in (
            (owners, of_part[w.text]), (hashes, w.hashes), (sizes, w.end - w.start), (smalls, small),
            (letters, of_words(CAPITAL | BEYOND) + small), (symbols, of_words(SYMBOL)),
        ):
            found.append(value)
    owner, hashed, size, small, letter, symbol = map(np.concatenate, (owners, hashes, sizes, smalls, letters, symbols))

    def before(k: int) -> np.ndarray:
        same = np.zeros(len(owner), dtype=bool)
        same[k:] = (owner[k:] == owner[:-k]) & (hashed[k:] == hashed[:-k])
        return same

    again = before(1)
    recent = again.copy()
    for k in range(2, 9):
        recent |= before(k)
    kinds = {"shouted": (letter > 0) & (small == 0), "marked": symbol > 0, "again": again, "recent": recent, "bare": letter == 0}

    n = np.bincount(owner, minlength=many)
    some, total = np.maximum(n, 1), spread.sum(axis=1)
    share = spread / np.maximum(total, 1)[:, None]
    mean = np.bincount(owner, weights=size, minlength=many) / some
    square = np.bincount(owner, weights=size.astype(float) ** 2, minlength=many) / some
    distinct, top = _runs(owner, hashed, many)
    joined = owner[1:] == owner[:-1]
    pair = hashed[:-1] * words.powers(2)[1] + hashed[1:]
    pairs, _ = _runs(owner[1:][joined], pair[joined], many)
    first = np.searchsorted(owner, np.arange(many))
    parts = np.maximum(1, (n + PASSAGE // 2) // PASSAGE)  # passages of even length
    part = (np.arange(len(owner)) - first[owner]) * parts[owner] // some[owner]
    start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))) if len(owner) else first[:0]
    length = np.diff(np.append(start, len(owner)))

    values = [
        np.log1p(n), np.log1p(total), mean, np.sqrt(np.maximum(square - mean**2, 0)), distinct / some, top / some,
        pairs / np.maximum(n - 1, 1), -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1),
        n / (spread[:, 10] + 1), *[share @ table for table in BYTES.values()],
        *[np.bincount(owner, weights=kind, minlength=many) / some for kind in kinds.values()],
    ]
    for kind in kinds.values():
        most = np.zeros(many)
        if len(start):
            np.maximum.at(most, owner[start], np.add.reduceat(kind.astype(float), start) / length)
        values.append(most)
    return np.stack(values, axis=1)


class Trees(NamedTuple):
    """Complete trees of one depth, flattened: inner nodes in heap order, then leaves; a row goes right if above the threshold."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    bias: float


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds between distinct values, at even quantiles."""
    value = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (value[1:] + value[:-1]) / 2


def train(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15,
    bins: int = 48, penalty: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boost the weighted log loss with Newton steps; equal gains go to the first statistic and threshold.

    A node without a split that leaves ``least`` of the Hessian on both sides sends all rows left.
    """
    rows, p = x.shape
    total = weight.sum()
    prior = float(np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)) if rows else 0.5
    bias = float(np.log(prior / (1 - prior)))
    inner = (1 << depth) - 1
    if not rows or y.min() == y.max():
        return Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    edges = [_edges(x[:, f], bins) for f in range(p)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    slot = np.arange(p) * bins + binned
    usable = np.arange(bins - 1) < np.array([len(e) for e in edges])[:, None]
    feature, threshold = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    margin = np.full(rows, bias)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        g, h = weight * (chance - y), weight * chance * (1 - chance)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            many = 1 << level
            key = (node[:, None] * (p * bins) + slot).reshape(-1)
            of_g, of_h = (
                np.bincount(key, weights=np.repeat(v, p), minlength=many * p * bins).reshape(many, p, bins) for v in (g, h)
            )
            left_g, left_h = np.cumsum(of_g, axis=2)[:, :, :-1], np.cumsum(of_h, axis=2)[:, :, :-1]
            all_g, all_h = of_g.sum(axis=2)[:, :, None], of_h.sum(axis=2)[:, :, None]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
            gain = np.where(usable & (left_h >= least) & (right_h >= least), gain, -np.inf).reshape(many, -1)
            best = gain.argmax(axis=1)
            f, at = best // (bins - 1), best % (bins - 1)
            split = gain[np.arange(many), best] > 1e-9
            own = slice(many - 1, 2 * many - 1)
            feature[t, own] = np.where(split, f, 0)
            threshold[t, own] = [edges[a][b] if s else np.inf for a, b, s in zip(f, at, split)]
            node = 2 * node + (split[node] & (binned[np.arange(rows), f[node]] > at[node]))
        sum_g, sum_h = (np.bincount(node, weights=v, minlength=inner + 1) for v in (g, h))
        leaf[t] = -rate * sum_g / (sum_h + penalty)
        margin += leaf[t][node]
    return Trees(feature, threshold, leaf, bias)


def margins(model: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds of rows: all rows go down all trees one level at a time."""
    trees, inner = model.feature.shape
    base, row = np.arange(trees) * inner, np.arange(len(x))[:, None]
    node = np.zeros((len(x), trees), dtype=np.int64)
    for level in range(inner.bit_length()):
        at = base + (1 << level) - 1 + node
        node = 2 * node + (x[row, model.feature.reshape(-1)[at]] > model.threshold.reshape(-1)[at])
    return model.bias + model.leaf.reshape(-1)[np.arange(trees) * (inner + 1) + node].sum(axis=1)


def _with_statistics(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in words.slices(batch, text):
        yield part, statistics([t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()])


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", doc_id: str = "doc_id", per_class: int = 8000, **options
) -> Trees:
    """Learn from at most ``per_class`` labelled texts of each class, weighted to the classes' shares of all labels.

    Rows with a null label or id are left out; of several labels of one id the larger counts, of several texts of
    one id the one whose statistics sort first. A null text is empty. The statistics are taken in Spark tasks; the
    driver gets one row of them for each sampled text. Without labels every text scores 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect() if r["y"] in (0, 1)}  # two rows
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    parts = [sample_ids(known.where(F.col("y") == v), "id", per_class).withColumn("y", F.lit(v)) for v in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _with_statistics(batch, "body"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(list(found), pa.list_(pa.float64()))], ["id", "y", "found"]
                )

    chosen = rows.join(ids, "id")
    measured = chosen.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, y int, found array<double>")
    table = measured.groupBy("id", "y").agg(F.min("found").alias("found")).orderBy(F.xxhash64("id"), "id").select("y", "found").toArrow()
    x = np.array(table["found"].to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    y = table["y"].to_numpy().astype(float)
    weight = np.ones(len(y))
    for value, n in shares.items():
        weight[y == value] = n / max(1, (y == value).sum())
    return train(x, y, weight * len(y) / max(weight.sum(), 1e-9), **options)


def score_quality(docs: DataFrame, model: Trees, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the chance of label 1, for every whole text; null and empty texts have statistics of 0.

    Rows stay one to one, repeated rows too, and equal texts score alike. A column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # trees x 2^depth numbers
    rest = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _with_statistics(batch, text):
                score = 1 / (1 + np.exp(-margins(sent.value, found)))
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), pa.array(score)], [*rest, "score"])

    given = docs.select(*rest)
    return given.mapInArrow(run, given._jdf.schema().toDDL() + ", score double")

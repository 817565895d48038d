"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (its borders marked), so an unseen
misspelling shares most of its vectors with the word it stands for. A passage of ``PASSAGE`` words is the mean
of its words, a softmax layer scores it, and a text scores as its most toxic passage: an average over a whole
long text would drown single words. Vectors and softmax are trained together: first every passage bears the
label of its text, then of a toxic text only the passages that score highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import ngrams, words
from .language import sample_ids

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
PASSAGE = 16
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ToxicityModel(NamedTuple):
    """``weight``: what each bucket adds to the log-odds (vectors times the difference of the softmax rows); ``bias``."""

    weight: np.ndarray
    bias: float


def tokens(text: str) -> list[str]:
    return [w for w in (t.strip(_STRIP) for t in text.lower().split()) if w]


def _passages(lengths: list[int], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Start of each passage among all tokens, and the text it belongs to."""
    starts, owner, at = [], [], 0
    for i, n in enumerate(lengths):
        own = range(at, at + n, size)
        starts += own
        owner += [i] * len(own)
        at += n
    return np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64)


def train(
    texts: list[str],
    toxic: np.ndarray,
    *,
    prior: float | None = None,
    dim: int = 4,
    epochs: tuple[int, int] = (8, 52),
    rate: float = 0.3,
    decay: float = 1e-3,
    damp: float = 0.3,
    least_share: float = 0.004,
    seed: int = 7,
) -> ToxicityModel:
    """Fit vectors and softmax on four texts in five, and the scale of the scores on the fifth.

    Full-batch Adam. ``prior`` is the share of toxic texts to calibrate for (that of the
    sample if not given). With one label only, or no words, the model is constant.
    """
    share = (float(np.sum(toxic)) + 0.5) / (len(texts) + 1.0)
    prior = min(max(share if prior is None else prior, 1e-4), 1 - 1e-4)
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))))
    aside = np.zeros(len(texts), dtype=bool)
    for y in (0, 1):  # every fifth text of a label
        aside[np.flatnonzero(toxic == y)[4::5]] = True
    weight, bias = _fit_passages([t for t, out in zip(texts, aside) if not out], toxic[~aside], dim, epochs, rate, decay, damp, least_share, seed)
    judged = aside if len(set(toxic[aside].tolist())) == 2 else np.ones(len(texts), dtype=bool)
    odds = passage_odds([t for t, in_ in zip(texts, judged) if in_], ngrams.WordValues(weight[:, None], SIZES), bias)
    scale, shift = _calibrate(odds, toxic[judged].astype(float), prior)
    return ToxicityModel((weight * scale).astype(np.float32), float(bias * scale + shift))


def _calibrate(odds: np.ndarray, label: np.ndarray, prior: float, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of the log-odds by logistic regression, the labels weighted to the prior."""
    weight = np.where(label > 0, prior / label.sum(), (1 - prior) / (1 - label).sum())
    center, spread = float(np.mean(odds)), float(np.std(odds)) + 1e-6
    x, a, b = (odds - center) / spread, 1.0, float(np.log(prior / (1 - prior)))
    for _ in range(steps):  # Newton steps, a ridge keeps separable labels finite
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        e, h = weight * (p - label), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([np.sum(e * x) + 1e-3 * a, np.sum(e)])
        m = np.array([[np.sum(h * x * x) + 1e-3, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = a - step[0], b - step[1]
    a = max(a, 1e-3)
    return a / spread, b - a * center / spread


def _fit_passages(texts: list[str], toxic: np.ndarray, dim, epochs, rate, decay, damp, least_share, seed) -> tuple[np.ndarray, float]:
    split = [tokens(t) for t in texts]
    flat = [w for s in split for w in s]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), dtype=np.int64, count=len(flat))
    word, bucket = ngrams.entries(words.encoded(list(number)), SIZES, BUCKETS)
    if not len(word):
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    start, owner = _passages([len(s) for s in split])
    # n-grams of few texts say nothing: only those of at least ``least`` texts get a vector
    at = np.searchsorted(word, np.arange(len(number) + 1))
    spread = np.zeros(BUCKETS, dtype=np.int64)
    begin = 0
    for own in split:
        mine = np.unique(ids[begin : begin + len(own)])
        begin += len(own)
        if len(mine):
            spread[np.unique(np.concatenate([bucket[at[w] : at[w + 1]] for w in mine]))] += 1
    common = spread >= max(3, int(least_share * len(split)))
    keep = common[bucket]
    present = np.unique(word)  # a word too short for any n-gram is a zero vector
    first = np.searchsorted(word, present)
    grams = np.maximum(np.bincount(word, minlength=len(number)), 1).astype(float)
    size = np.diff(np.append(start, len(flat)))
    label = toxic[owner].astype(float)
    head = np.flatnonzero(np.diff(owner, prepend=-1))  # the first passage of each text
    many = np.diff(np.append(head, len(owner)))

    rng = np.random.default_rng(seed)
    state = [rng.normal(0, 0.1, (BUCKETS, dim)) * common[:, None], rng.normal(0, 0.1, (dim, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    for epoch in range(sum(epochs)):
        vectors, out, bias = state
        of_word = np.zeros((len(number), dim))
        of_word[present] = np.add.reduceat(vectors[bucket], first, axis=0)
        of_word /= grams[:, None]
        mean = np.add.reduceat(of_word[ids], start, axis=0) / size[:, None]
        logits = mean @ out + bias
        odds = logits[:, 1] - logits[:, 0]
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        weight = np.repeat(1 / many, many)  # a text counts once
        if epoch >= epochs[0]:
            top = (odds >= np.repeat(np.maximum.reduceat(odds, head), many) - 0.5).astype(float)
            top /= np.repeat(np.add.reduceat(top, head), many)
            weight = np.where(label > 0, top, 0.5 * weight + 0.5 * top)
        for y in (0.0, 1.0):
            weight[label == y] /= max(weight[label == y].sum(), 1e-9)
        error = np.stack([label - p, p - label], axis=1) * weight[:, None]
        g_mean = (error @ out.T) / size[:, None]
        g_word = np.stack([np.bincount(ids, weights=np.repeat(g_mean[:, d], size), minlength=len(number)) for d in range(dim)], axis=1)
        g_word /= grams[:, None]
        g_vectors = np.stack([np.bincount(bucket, weights=g_word[word, d], minlength=BUCKETS) for d in range(dim)], axis=1)
        g_vectors *= common[:, None]
        for k, g in enumerate((g_vectors, mean.T @ error, error.sum(axis=0))):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8 + damp * float(np.sqrt(v.max())))
            state[k] = state[k] * (1 - decay) - rate * move
    vectors, out, bias = state
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", per_class: int = 2000, most_chars: int = 200_000
) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled texts of each class, each of at most ``most_chars`` characters.

    Rows with a null label, id or text are left out; of several labels of one id the larger counts. Only
    the bounded sample reaches the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_toxic"))
    rows = docs.select(doc_id, text).where(F.col(text).isNotNull() & (F.length(text) <= most_chars))
    parts = []
    for value in (0, 1):
        ids = sample_ids(known.where(F.col("_toxic") == value), doc_id, per_class)  # per_class ids
        own = rows.join(F.broadcast(ids), doc_id, "left_semi")
        # an id may come with several texts
        parts.append(own.select(doc_id, text, F.lit(value).alias("_toxic")).orderBy(F.xxhash64(doc_id), doc_id, text).limit(per_class))
    sample = parts[0].unionByName(parts[1]).toPandas()
    return train(list(sample[text]), sample["_toxic"].to_numpy())


def passage_odds(texts: list[str], known: ngrams.WordValues, bias: float) -> np.ndarray:
    """Log-odds of the most toxic passage of each text."""
    split = [tokens(t) for t in texts]
    flat = [w for s in split for w in s]
    odds = np.full(len(texts), bias)
    if flat:
        number = known.numbers(flat)
        value = known.values[number, 0].astype(np.float64)
        start, owner = _passages([len(s) for s in split])
        passage = np.add.reduceat(value, start) / np.diff(np.append(start, len(flat))) + bias
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        odds[owner[head]] = np.maximum.reduceat(passage, head)
    return odds


def score_texts(texts: list[str], known: ngrams.WordValues, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(passage_odds(texts, known, bias), -700, 700)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) for every whole text; a null or empty text has no passage and scores by the bias alone.

    Rows stay one to one; columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.weight)  # one number a bucket
    bias = model.bias
    rest = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ngrams.WordValues(sent.value[:, None], SIZES)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text]]
            scores = [score_texts(part, known, bias) for part in ngrams.batches(texts)]
            yield batch[rest].assign(score=np.concatenate(scores) if scores else np.zeros(0))

    return docs.select(*rest).mapInPandas(run, docs.select(*rest)._jdf.schema().toDDL() + ", score double")

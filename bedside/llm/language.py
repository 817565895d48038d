"""Language ID by multilingual mixture inference.

Each language has hashed n-gram probabilities. A document is a mixture of languages: expectation-maximisation
estimates the proportions from the likelihoods of its words (mean log-probability of a word's n-grams, times its
length in n-grams of one size). From all languages the one with the least proportion is taken away again and
again; of the sets passed on the way, the one with the best penalised likelihood is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ngrams, words

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_ids(rows: DataFrame, doc_id: str, bound: int) -> DataFrame:
    """The ``bound`` ids with the least hashes: the same choice at every size."""
    return rows.select(doc_id).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(bound)


def fit_language_model(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 2500, smoothing: float = 0.2
) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (buckets x languages), from the rows of at most ``per_language`` ids of each language.

    ``docs`` holds only rows that may be learned from. The sampled rows are counted in Spark tasks; the driver
    gets one sum per language and bucket. Without labelled rows there are no languages.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    order = Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id)
    ids = rows.select(lang, doc_id).distinct().withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_language)
    chosen = F.broadcast(ids.select(lang, doc_id))  # per_language ids a language
    rows = rows.join(chosen, [lang, doc_id], "left_semi").select(text, lang)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, own in batch.groupby(lang)[text]:
                for texts in ngrams.batches(list(own)):
                    tokens = _WORD.findall("\n".join(texts).lower())
                    _, bucket = ngrams.entries(words.encoded(tokens), SIZES, BUCKETS)
                    totals.setdefault(value, np.zeros(BUCKETS, dtype=np.int64))
                    totals[value] += np.bincount(bucket, minlength=BUCKETS)
        for value, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": value, "bucket": at, "n": total[at]})

    counted = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # languages x BUCKETS at most
    langs = sorted(table["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), smoothing)
    for k, value in enumerate(langs):
        own = table[table["lang"] == value]
        counts[own["bucket"].to_numpy(dtype=np.int64), k] += own["n"].to_numpy(dtype=float)
    return langs, np.log(counts / counts.sum(axis=0)) if langs else counts


def mixture(
    likelihood: np.ndarray, scale: np.ndarray, count: np.ndarray, first: np.ndarray, *, penalty: float, steps: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) of the chosen language sets.

    ``likelihood``: entries x languages, divided by exp(``scale``); ``count``: occurrences; ``first``: start of each
    document's entries, none of them empty.
    """
    docs, k = len(first), likelihood.shape[1]
    owner = np.repeat(np.arange(docs), np.diff(np.append(first, len(count))))
    n = np.add.reduceat(count, first)
    base = np.add.reduceat(count * scale, first)
    theta = np.full((docs, k), 1.0 / k)
    best, kept = np.full(docs, -np.inf), theta
    for size in range(k, 0, -1):
        for _ in range(steps[0] if size == k else steps[1]) if size > 1 else ():
            joint = theta[owner] * likelihood
            joint *= (count / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            theta = np.add.reduceat(joint, first, axis=0) / n[:, None]
        fit = base + np.add.reduceat(count * np.log(np.maximum((theta[owner] * likelihood).sum(axis=1), 1e-300)), first)
        score = fit - penalty * (size - 1) * np.log1p(n)
        better = score > best
        best = np.where(better, score, best)
        kept = np.where(better[:, None], theta, kept)
        # the least proportion goes; languages that went already are at zero and stay out
        least = np.where(theta > 0, theta, np.inf).argmin(axis=1)
        theta = theta.copy()
        theta[np.arange(docs), least] = 0
        left = theta.sum(axis=1)
        alive = np.where(left > 0, left, 1)
        theta = theta / alive[:, None]
        if not (left > 0).any():
            break
    return kept, best


def identify_languages(
    docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", penalty: float = 3.0, steps: tuple[int, int] = (8, 4)
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its proportion) and ``lang_set`` (``lang:proportion``, largest first).

    Null texts and texts without a letter are ``und`` with score 0 and an empty set, and so is everything if
    the model knows no language. Equal proportions go to the language that sorts first. The whole text counts.
    """
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))  # BUCKETS x languages
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_set")]
    schema = docs.select(*rest)._jdf.schema().toDDL() + ", lang_pred string, score double, lang_set string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ngrams.WordValues(sent.value, SIZES)
        for batch in batches:
            for part in words.slices(batch, text):
                found = _identify([t or "" for t in part.column(text).to_pylist()], known, langs, penalty, steps)
                told = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), *told], [*rest, "lang_pred", "score", "lang_set"])

    return docs.select(*rest).mapInArrow(words.lean(run), schema)


def _identify(texts: list[str], known: ngrams.WordValues, langs: list[str], penalty, steps) -> list[tuple[str, float, str]]:
    tokens, lengths = [], []
    for t in texts:
        own = _WORD.findall(t.lower()) if any(map(str.isalpha, t)) else []
        tokens += own
        lengths.append(len(own))
    out = [(UNDETERMINED, 0.0, "")] * len(texts)
    if not tokens or not langs:
        return out
    number = known.numbers(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.float64, count=len(tokens)) + 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    width = len(known.values)
    key, at, count = np.unique(owner * width + number, return_index=True, return_counts=True)
    log = known.values[number[at]].astype(np.float64) * sizes[at, None]
    top = log.max(axis=1)
    doc, first = np.unique(key // width, return_index=True)
    theta, _ = mixture(np.exp(log - top[:, None]), top, count.astype(float), first, penalty=penalty, steps=steps)
    for d, share in zip(doc, theta):
        order = sorted((k for k in range(len(langs)) if share[k] > 0.005), key=lambda k: (-share[k], k))
        out[d] = (langs[order[0]], float(min(1.0, share[order[0]])), ",".join(f"{langs[k]}:{share[k]:.3f}" for k in order))
    return out


def keep_identified(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without those whose language cannot be told: no letter, or no language with ``least_share`` of the text."""
    model = fit_language_model(docs.where(~held_out(doc_id)), text=text, lang=lang, doc_id=doc_id)
    found = identify_languages(docs.select("*"), model, text=text, **options)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_share)).select(*docs.columns)

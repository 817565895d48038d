"""Document fingerprints: quartile bucket digests over hashed byte triplets.

Every window of four bytes gives three triplets; each is hashed into one of ``BUCKETS`` counters. A counter is
encoded by the quartile of the text's counters that it falls into (two bits), and the text's length by a
logarithmic code. Two digests are compared by a bounded difference score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import words

BUCKETS = 256
_LEVELS = np.array([0, 1, 2, 4])  # distance of quartile codes by their difference: far ones count more
_CODE_OF_BYTE = np.array([[(b >> s) & 3 for s in (0, 2, 4, 6)] for b in range(256)])
_GAPS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_SALT = words.mix(np.arange(3 * 256, dtype=np.uint64) + np.uint64(17)).reshape(3, 256).astype(np.uint32)


def counts(texts: list[bytes]) -> np.ndarray:
    """Counters (texts x BUCKETS). Texts are scanned together; windows across a border are left out."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    total = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    if len(data) >= 4:
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        m = len(data) - 3
        same = owner[:m] == owner[3:]
        base = owner[:m].astype(np.int64) * BUCKETS
        for gap in _GAPS:
            h = np.zeros(m, dtype=np.uint32)
            for k, g in enumerate(gap):
                h = (h + _SALT[k][data[g : g + m]]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            total += np.bincount((base + (h >> np.uint32(24)))[same], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def length_code(n: np.ndarray) -> np.ndarray:
    """About eight steps for every doubling, 0 to 255."""
    return np.minimum(np.round(8 * np.log2(n + 1.0)), 255).astype(np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Hex of the length code and the quartile codes. Texts of fewer than four bytes have no triplets: their codes are zero, and those of one length are alike."""
    c = counts(texts)
    ordered = np.sort(c, axis=1)
    codes = np.zeros(c.shape, dtype=np.uint8)
    for q in (1, 2, 3):
        codes += c > ordered[:, q * BUCKETS // 4 - 1][:, None]
    packed = (codes.reshape(len(texts), -1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=2).astype(np.uint8)
    length = length_code(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    return [bytes([n]).hex() + row.tobytes().hex() for n, row in zip(length, packed)]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, 0 for a difference at least as large as that of unrelated random codes."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(d)), dtype=np.uint8).reshape(len(d), -1) for d in (a, b))
    steps = np.abs(_CODE_OF_BYTE[x[:, 1:]] - _CODE_OF_BYTE[y[:, 1:]]).reshape(len(a), -1)
    apart = _LEVELS[steps].sum(axis=1) + np.minimum(np.abs(x[:, 0].astype(int) - y[:, 0]), 40)
    bound = BUCKETS * float(np.mean(_LEVELS[np.abs(np.subtract.outer(range(4), range(4)))]))
    return np.clip(1 - apart / bound, 0, 1)


def add_fingerprint(docs: DataFrame, *, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text; null counts as empty. Equal texts have equal fingerprints."""
    rest = [c for c in docs.columns if c != to]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[rest].assign(**{to: _in_pieces(words.encoded(batch[text]))})

    return docs.select(*rest).mapInPandas(run, docs.select(*rest)._jdf.schema().toDDL() + f", `{to}` string")


def _in_pieces(texts: list[bytes]) -> list[str]:
    return [f for part in words.pieces([len(t) for t in texts]) for f in fingerprints(texts[part])]


def compare_with_next(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows_per_part: int = 4000
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The next document follows by ascending (id, hash of the text); the first follows the last. The edited text has
    the last half (rounded down) of the code points replaced by as many (or all) first code points of the next.
    Null ids come before all others, null texts count as empty, repeated rows follow each other, a single row follows
    itself.

    Rows are dealt out by ranges of (id, hash) of about ``rows_per_part`` rows, so a repeated id is cut as well; the
    first row of a range is also sent to the range before it. A task holds one batch of rows at a time.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).isNull().alias("no_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.coalesce(text, F.lit("")).alias("body"),
    )
    n = docs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_part))
    borders = (
        rows.select("id", "h")
        .repartitionByRange(parts, "id", "h")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct("id", "h")).alias("low"))
        .select("low.*")
        .orderBy("id", "h")
        .collect()
    )  # one row a range
    low = spark.sparkContext.broadcast(np.array([tuple(r) for r in borders], dtype=[("id", "i8"), ("h", "i8")]))
    dealt = rows.mapInPandas(_dealer(low), "part long, extra boolean, no_id boolean, id long, h long, body string")
    placed = dealt.repartition(parts, "part").sortWithinPartitions("part", "extra", "id", "h", "body")
    out = placed.mapInPandas(
        _comparer,
        "no_id boolean, id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), *out.columns[2:])


def _dealer(low):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = low.value
        for batch in batches:
            key = np.empty(len(batch), dtype=starts.dtype)
            key["id"], key["h"] = batch["id"], batch["h"]
            part = np.searchsorted(starts, key, side="right") - 1
            yield batch.assign(part=part, extra=False)
            # a row that opens a range also closes the one before; the very first closes the last
            opens = starts[part] == key
            if opens.any():
                yield batch[opens].assign(part=(part[opens] - 1) % len(starts), extra=True)

    return run


def _comparer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None  # the last row that still waits for its next
    for batch in batches:
        pairs = []
        for row in batch[["part", "extra", "no_id", "id", "body"]].itertuples(index=False):
            if held is not None and held.part == row.part:
                pairs.append((held, row.body))
            held = None if row.extra else row
        for part in words.pieces([len(a.body) for a, _ in pairs]):
            yield _compared(pairs[part])


def _compared(pairs: list[tuple]) -> pd.DataFrame:
    own = [a.body for a, _ in pairs]
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, (_, after) in zip(own, pairs)]
    # the next text is mostly the next row's own
    following = [after for i, (_, after) in enumerate(pairs) if i + 1 == len(pairs) or own[i + 1] is not after]
    marks = _in_pieces(words.encoded(own + edited + following))
    k = len(own)
    own_marks, edited_marks, rest = marks[:k], marks[k : 2 * k], iter(marks[2 * k :])
    next_marks = [next(rest) if i + 1 == k or own[i + 1] is not after else own_marks[i + 1] for i, (_, after) in enumerate(pairs)]
    return pd.DataFrame(
        {
            "no_id": [a.no_id for a, _ in pairs],
            "id": [a.id for a, _ in pairs],
            "n_chars": [len(t) for t in own],
            "edited_text": edited,
            "fingerprint": own_marks,
            "edited_fingerprint": edited_marks,
            "near_edited": likeness(own_marks, edited_marks),
            "near_next": likeness(own_marks, next_marks),
        }
    )

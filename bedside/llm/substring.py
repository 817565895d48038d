"""Substring dedup: words of repeated runs are removed, all but the first occurrence.

A window of ``WINDOW`` words belongs to its anchor, the run of ``ANCHOR`` words in it with the least hash, so equal windows
have equal anchors. Windows that follow each other and share an anchor form a segment. Only anchors that occur more
than once matter; their segments go to shards by the anchor. Equal segments are one entry of a shard; the entries that
share an anchor with another are put into a compressed FM-index, and every segment is streamed backwards through
it: its matching statistics say which of its windows occur elsewhere, the suffix interval where first.

An anchor with more than ``HOT`` occurrences (the edge of a passage that very many documents share) would fill
one task: its windows go out one by one, by a hash of the whole window, and meet only their equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import words
from .fm_index import FMIndex
from ..sources.lineage import written

WINDOW, ANCHOR = 20, 6
HOT = 20_000
#: Segments that a task remembers in order not to send equal ones, and words in one index.
REMEMBERED, INDEX_WORDS = 200_000, 1_000_000
_NO_ID = -(2**63)


def _segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of one document's segments."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = words.joined_hash(hashes, ANCHOR)
    # the high bits compare by hash, the low bits by place: of equal hashes the leftmost
    key = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = WINDOW - ANCHOR + 1
    least, span = key, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]].view(np.int64), first, np.diff(np.append(first, n))


def _documents(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
    """Digest of the word sequence, word hashes and words of each text."""
    for part in words.pieces([len(t) for t in texts]):
        w = words.split(texts[part], words.NON_SPACE, lower=False)
        for i, (a, b) in enumerate(zip(w.first, w.first[1:]), part.start):
            own = w.hashes[a:b]
            yield hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own, texts[i].split()


def _version(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for digest, own, ws in _documents(words.encoded(batch["body"])):
            out.append((len(ws), hashlib.sha256(b" ".join(ws)).hexdigest(), digest, _version(digest), _segments(own)[0]))
        yield pd.DataFrame(
            {"id": batch["id"], "no_id": batch["no_id"]}
            | {c: [o[i] for o in out] for i, c in enumerate(("n_words", "whole_sha256", "digest", "version", "anchors"))}
        )


def _send(batches: Iterator[pd.DataFrame], remembered: int) -> Iterator[pd.DataFrame]:
    """Segments of repeated anchors, with their words; later ones that equal a remembered one are settled here.

    One that comes earlier than the remembered one is sent too and takes its place: both meet again in the search.
    """
    seen: dict[bytes, tuple[int, int, int]] = {}
    for batch in batches:
        rows: list[tuple] = []
        for i, (digest, own, ws) in enumerate(_documents(words.encoded(batch["body"]))):
            if _version(digest) != batch["version"].iat[i]:
                continue  # another text of the same id
            doc = (int(batch["id"].iat[i]), int(batch["version"].iat[i]))
            anchor, first, count = _segments(own)
            hot = np.isin(anchor, np.asarray(batch["hot"].iat[i], dtype=np.int64))
            want = np.flatnonzero(np.isin(anchor, np.asarray(batch["cold"].iat[i], dtype=np.int64)) | hot)
            for s in want:
                a, f, n = int(anchor[s]), int(first[s]), int(count[s])
                for start, k in ((f, n),) if not hot[s] else ((j, 1) for j in range(f, f + n)):
                    run = own[start : start + k + WINDOW - 1].tobytes()
                    name = hashlib.blake2b(run, digest_size=16).digest()
                    known = seen.get(name)
                    if known is not None and known < (*doc, start):
                        rows.append((0, None, *doc, start, k))
                    elif known is None or (*doc, start) < known:
                        if known is None and len(seen) >= remembered:
                            seen.clear()
                        seen[name] = (*doc, start)
                        key = int.from_bytes(name[:8], "little", signed=True) if hot[s] else a
                        rows.append((key, b" ".join(ws[start : start + k + WINDOW - 1]), *doc, start, k))
        yield pd.DataFrame(rows, columns=["key", "body", "id", "version", "start", "n"])


def _search(batches: Iterator[pd.DataFrame], index_words: int) -> Iterator[pd.DataFrame]:
    """Windows that occur earlier, from rows sorted by (key, body, id, version, start)."""
    entries: list[tuple] = []  # different segments of shared anchors, for the next index
    size = 0
    group: list[tuple] = []  # different segments of the anchor at hand
    key = body = None
    for batch in batches:
        done: list[tuple] = []
        for row in batch.itertuples(index=False):
            if row.body is None:
                done.append((row.id, row.version, row.start, row.n))
                continue
            if row.key == key and row.body == body:
                if (row.id, row.version, row.start) != group[-1][1:4]:
                    done.append((row.id, row.version, row.start, row.n))
                continue
            if row.key != key:
                if len(group) > 1:
                    entries += group
                    size += sum(g[4] + WINDOW for g in group)
                    if size > index_words:
                        done += _indexed(entries)
                        entries, size = [], 0
                group = []
            key, body = row.key, row.body
            group.append((row.body, row.id, row.version, row.start, row.n))
        if done:
            yield pd.DataFrame(done, columns=["id", "version", "start", "n"])
    entries += group if len(group) > 1 else []
    if entries:
        yield pd.DataFrame(_indexed(entries), columns=["id", "version", "start", "n"])


def _indexed(entries: list[tuple]) -> list[tuple]:
    """One FM-index over different segments in the order of their places; their windows that occur earlier in it."""
    entries = sorted(entries, key=lambda e: e[1:4])
    split = [e[0].split(b" ") for e in entries]
    number: dict[bytes, int] = {}
    sequence = np.fromiter((number.setdefault(w, len(number) + 1) for s in split for w in s), dtype=np.int64)
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    index = FMIndex(sequence, lengths)
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    counts = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(entries)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = begin[owner] + offset + WINDOW
    length, low, high = index.matching_statistics(ends, WINDOW)
    full = np.flatnonzero(length == WINDOW)
    earlier = full[index.first_place(low[full], high[full]) < ends[full] - WINDOW]
    # neighbouring windows of a segment are one run
    cuts = np.flatnonzero((np.diff(earlier) != 1) | (np.diff(owner[earlier]) != 0)) + 1
    return [(*entries[owner[r[0]]][1:3], entries[owner[r[0]]][3] + int(offset[r[0]]), len(r)) for r in np.split(earlier, cuts) if len(r)]


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, (digest, own, ws) in enumerate(_documents(words.encoded(batch["body"]))):
            version = _version(digest)
            change = np.zeros(len(ws) + 1, dtype=np.int64)
            for m in batch["marks"].iat[i]:
                if m["version"] == version:
                    change[m["start"]] += 1
                    change[m["start"] + m["n"] + WINDOW - 1] -= 1
            keep = np.cumsum(change[:-1]) == 0
            kept = b" ".join(w for w, k in zip(ws, keep) if k)
            out.append((int(batch["id"].iat[i]), version, int(len(ws) - keep.sum()), kept.decode("utf-8", "replace")))
        yield pd.DataFrame(out, columns=["id", "version", "n_removed", "kept_text"])


def repeated_windows(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, remembered: int = REMEMBERED, index_words: int = INDEX_WORDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, survey, marks): the prepared rows, one row a text with its counts, and repeated runs of windows by (id, version).

    ``hot``, ``remembered`` and ``index_words`` bound what a task holds; the result does not depend on them.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _send(batches, remembered)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _search(batches, index_words)

    rows = docs.select(
        F.col(doc_id).isNull().alias("no_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(text, F.lit("")).alias("body")
    )
    survey = written(
        rows.mapInPandas(
            _survey, "id long, no_id boolean, n_words long, whole_sha256 string, digest binary, version long, anchors array<long>"
        )
    )
    # of texts with equal words only the first can hold a first occurrence
    first = survey.groupBy("digest").agg(F.min("id").alias("id"))
    places = survey.join(first, ["digest", "id"], "left_semi").select("id", "version", F.explode("anchors").alias("anchor"))
    often = written(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = (
        places.join(often, "anchor")
        .groupBy("id", "version")
        .agg(
            F.collect_set(F.when(F.col("n") <= hot, F.col("anchor"))).alias("cold"),
            F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"),
        )
    )
    sent = rows.select("id", "body").join(wanted, "id").sortWithinPartitions("id", "version").mapInPandas(
        send, "key long, body binary, id long, version long, start long, n long"
    )
    dealt = sent.repartition(F.when(F.col("body").isNull(), F.xxhash64("id", "start")).otherwise(F.col("key")))
    marks = dealt.sortWithinPartitions("key", "body", "id", "version", "start").mapInPandas(
        search, "id long, version long, start long, n long"
    )
    return rows, survey, marks


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for every row of ``docs``.

    A word is removed if a window that covers it also starts earlier: in a smaller id, or further left in the same
    text. ``kept_text`` joins the kept words by blanks; it is null where nothing was removed (the hash is always
    given). Null texts have no words. ``bounds`` are those of ``repeated_windows``. Null ids come before all others; different texts of one id follow each other by a
    hash, equal rows are one document.
    """
    rows, survey, marks = repeated_windows(docs, doc_id=doc_id, text=text, **bounds)
    gathered = marks.groupBy("id").agg(F.collect_list(F.struct("version", "start", "n")).alias("marks"))
    cut = rows.select("id", "body").join(gathered, "id").mapInPandas(_apply, "id long, version long, n_removed long, kept_text string")
    first = survey.groupBy("digest").agg(F.min("id").alias("first_id"))
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    out = survey.drop("anchors").join(first, "digest").join(cut.dropDuplicates(["id", "version"]), ["id", "version"], "left")
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        kept.alias("kept_text"),
        F.coalesce(F.sha2(kept, 256), F.col("whole_sha256")).alias("kept_sha256"),
    )

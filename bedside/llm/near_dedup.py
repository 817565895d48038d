"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A text's set is that of its distinct word shingles. One hash function fills ``BINS`` bins with the least hash that
falls into each; an empty bin borrows from the first filled bin of a random order of its own. Bands of ``ROWS`` bins
give buckets. Texts with equal sets are one class, and only the least id of a class goes on. In a bucket one centre
(the member whose buckets are fullest) is a candidate partner of every other member; candidates are confirmed on full
sets; what is linked becomes one component. In a group of copies of one text that settles nearly all. Members of buckets that still hold two or more
components are compared by an exact filter on their rarest shared shingles (``_close_pairs``), so every pair that
shares a bucket is in one component, was compared, or provably differs too much.
Two texts with similarity 0.8 share none of the 32 buckets with a probability of 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .graph import stars
from ..sources.lineage import cut, written

SHINGLE = 5
PERCENT = 80
BINS, ROWS = 128, 4
#: Bytes of text whose shingles a task has at a time.
PART = 1 << 18
_ORDER = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])
_BAND = words.mix(np.arange(BINS // ROWS, dtype=np.uint64) + np.uint64(99))


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``k`` words; fewer words are one run, no words none."""
    w = words.split(texts, words.NON_SPACE, lower=True)
    runs = words.joined_hash(w.hashes, k)
    for a, b in zip(w.first, w.first[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            # the run's length keeps it apart from longer ones
            yield words.mix(words.joined_hash(w.hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, dtype=np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """Least hash of each bin, empty bins filled by optimal densification. ``own`` is not empty."""
    key = np.sort((own << np.uint64(57)) | (own >> np.uint64(7)))  # the low seven bits choose the bin
    bins = (key >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled = np.zeros(BINS, dtype=bool)
    filled[bins[first]] = True
    values = np.zeros(BINS, dtype=np.uint64)
    values[bins[first]] = key[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


def buckets(own: np.ndarray) -> np.ndarray:
    rows = signature(own).reshape(-1, ROWS)
    return words.mix((rows * words.powers(ROWS)[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "body", PART):
                n, digest, bands = [], [], []
                for own in shingle_sets(words.encoded(part.column("body").to_pylist()), k):
                    n.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(buckets(own) if len(own) else [])
                found = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *found], ["id", "n_shingles", "set_hash", "bands"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "body", PART):
                # centres repeat: the texts of a part are split once each
                number: dict[str, int] = {}
                pairs = zip(part.column("centre_body").to_pylist(), part.column("body").to_pylist())
                at = [(number.setdefault(a, len(number)), number.setdefault(b, len(number))) for a, b in pairs]
                sets = list(shingle_sets(words.encoded(number), k))
                linked = [_similar(sets[a], sets[b], percent) for a, b in at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("centre"), part.column("node"), pa.array(linked, pa.bool_())], ["centre", "node", "linked"]
                )

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Linked are texts with ``100 * |intersection| >= percent * |union|`` of their shingle sets; ``component_id`` is
    the least id that links lead to, ``kept`` whether it is the row's own. Null and word-free texts have an empty set and
    are linked with nothing. Rows of one id are versions of one document: it is linked if any version is, and all its
    rows share its component. Null ids are linked with nothing, have a null component and are kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("body"))
    with words.small_batches(docs.sparkSession):
        signed = written(rows.mapInArrow(words.lean(_sign(shingle)), "id long, n_shingles long, set_hash binary, bands array<long>"))
    sets = signed.where("id IS NOT NULL AND n_shingles > 0")

    # classes of equal sets
    lead = written(sets.groupBy("set_hash").agg(F.min("id").alias("node")))
    banded = sets.select(F.col("id").alias("node"), "set_hash", "n_shingles", "bands").join(lead, ["node", "set_hash"], "left_semi")
    placed = banded.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket")).distinct()
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(placed.join(shared, "bucket"))
    # who shares most buckets with most others: of edited copies of one text, the text itself
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = members.drop("n").join(weight, "node").select("bucket", "node", "size", "weight")

    bodies = written(rows.withColumnRenamed("id", "node").join(members.select("node").distinct(), "node", "left_semi"))
    links = _linked(members, bodies, shingle, percent)

    # an id with several versions joins their classes
    same_id = sets.select("id", "set_hash").join(lead, "set_hash").where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    roots = stars(links.unionByName(same_id)).select(F.col("u").alias("id"), F.col("v").alias("root"))
    out = signed.select("id", "n_shingles").join(roots, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _linked(members: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) that connect all nodes which confirmed candidates connect. ``members``: bucket, node, size, weight."""
    # of every bucket the fullest member is the centre of a star
    centre = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "size")).alias("c"))
    star = members.join(centre.select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.size").alias("centre_size")), "bucket")
    pairs = star.where(
        f"node <> centre AND 100 * least(size, centre_size) >= {percent} * greatest(size, centre_size)"
    ).select("centre", "node").distinct()
    links = _confirmed(pairs, bodies, shingle, percent)
    root = stars(links)

    placed = members.join(root.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    # buckets of one component are done
    apart = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    live = placed.join(apart, "bucket").select("node", "root").distinct()
    rest = _confirmed(_close_pairs(live, bodies, shingle, percent), bodies, shingle, percent)
    return root.unionByName(rest)


def _confirmed(pairs: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (centre, node) whose full sets are similar enough."""
    both = pairs.join(bodies, "node").join(bodies.select(F.col("node").alias("centre"), F.col("body").alias("centre_body")), "centre")
    with words.small_batches(pairs.sparkSession):
        judged = cut(both.mapInArrow(words.lean(_confirm(shingle, percent)), "centre long, node long, linked boolean"))
    return judged.where("linked").select(F.col("node").alias("u"), F.col("centre").alias("v"))


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "body", PART):
                own = [s.view(np.int64) for s in shingle_sets(words.encoded(part.column("body").to_pylist()), k)]
                found = [pa.array(own, pa.list_(pa.int64())), pa.array([len(s) for s in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ("node", "root", "version")), *found], ["node", "root", "version", "tokens", "size"]
                )

    return run


def _close_pairs(nodes: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (centre, node) of different components that may be similar enough, by the rarest shingles they share.

    With all shingles in one order, the rarest first, the first that two sets share must come so early in both that
    what follows can still make up the overlap they need. Pairs that a centre could not settle, in groups of texts
    that share much and yet too little, mostly have no such shingle; none that is similar enough is lost.
    """
    with words.small_batches(nodes.sparkSession):
        tokens = written(
            nodes.join(bodies, "node")
            .withColumn("version", F.xxhash64("body"))
            .mapInArrow(words.lean(_tokens(shingle)), "node long, root long, version long, tokens array<long>, size long")
            .select("node", "root", "version", "size", F.explode("tokens").alias("token"))
        )
    rarity = tokens.groupBy("token").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("node", "version").orderBy("n", "token")  # one set
    early = (
        tokens.join(rarity, "token")
        .withColumn("at", F.row_number().over(in_order))
        .where(f"at <= size - (size * {percent} + 99) div 100 + 1 AND n > 1")
        .select("token", "node", "root", "size", "at")
    )
    early = written(early)
    other = early.select("token", *[F.col(c).alias(f"centre_{c}") for c in ("node", "root", "size", "at")])
    overlap = f"((size + centre_size) * {percent} + {99 + percent}) div {100 + percent}"
    return (
        early.join(other, "token")
        .where(
            f"(size < centre_size OR size = centre_size AND node < centre_node) AND root <> centre_root"
            f" AND 100 * size >= {percent} * centre_size"
            f" AND at <= size - {overlap} + 1 AND centre_at <= centre_size - {overlap} + 1"
        )
        .select(F.col("centre_node").alias("centre"), "node")
        .distinct()
    )


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the near duplicates: of each component the document with the least id stays, with all rows of that id."""
    found = near_duplicates(docs, doc_id=doc_id, **options).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(found, doc_id, "left_anti").select(*docs.columns)

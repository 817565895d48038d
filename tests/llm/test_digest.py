"""Fingerprints against a plain digest, and short texts."""

import random

import numpy as np
import pytest

from bedside.llm import digest

rng = random.Random(4)
BODIES = [b"", b"a", b"abc", b"xyz", b"abcd", b"aaaaaaaa", "Äpfel und Öl \U0001f600".encode(), *[bytes(rng.choices(b"abcdefgh \n", k=n)) for n in (5, 40, 700, 9000)]]


def plain(text):
    """Length code and quartile codes of one text, triplet by triplet."""
    count = [0] * 256
    for i in range(len(text) - 3):
        for gap in ((0, 1, 2), (0, 1, 3), (0, 2, 3)):
            h = 0
            for k, g in enumerate(gap):
                h = (h + int(digest._SALT[k][text[i + g]])) * 0x9E3779B1 % 2**32
                h ^= h >> 15
            count[h >> 24] += 1
    ordered = sorted(count)
    codes = [sum(c > ordered[q * 64 - 1] for q in (1, 2, 3)) for c in count]
    length = min(round(8 * float(np.log2(len(text) + 1.0))), 255)
    return length, codes


def unpacked(mark):
    data = bytes.fromhex(mark)
    return data[0], [b >> s & 3 for b in data[1:] for s in (0, 2, 4, 6)]


def test_fingerprints_against_a_plain_digest():
    for body, mark in zip(BODIES, digest.fingerprints(BODIES)):
        assert unpacked(mark) == plain(body)
        assert digest.fingerprints([body]) == [mark]  # alone and among others


def test_likeness_against_a_plain_score():
    marks = digest.fingerprints(BODIES)
    levels = [0, 1, 2, 4]
    bound = 256 * sum(levels[abs(a - b)] for a in range(4) for b in range(4)) / 16
    for a in marks:
        for b in marks:
            (n, x), (m, y) = unpacked(a), unpacked(b)
            apart = sum(levels[abs(p - q)] for p, q in zip(x, y)) + min(abs(n - m), 40)
            assert digest.likeness([a], [b])[0] == pytest.approx(max(0.0, 1 - apart / bound))


def test_short_texts_are_alike_by_length_only(spark):
    rows = [(1, "abc"), (2, "xyz"), (3, "ab"), (4, None), (5, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in digest.compare_with_next(docs).collect()}
    assert got[1].near_next == 1 and got[2].near_next < 1 and got[1].fingerprint == got[2].fingerprint == got[5].fingerprint
    assert got[1].edited_text == "abx" and got[4].edited_text == "" and got[3].edited_text == "a"

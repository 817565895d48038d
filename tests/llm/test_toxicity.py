"""Toxicity scores against a plain forward pass."""

import math

import numpy as np
import pytest
import texts

from bedside.llm import ngrams, toxicity, words


def plain_score(text, weight, bias):
    """The most toxic passage of 16 words; a word is the mean of its n-grams' weights."""

    def value(word):
        data = b"<" + word.encode() + b">"
        found = []
        for n in toxicity.SIZES:
            for i in range(len(data) - n + 1):
                total = n
                for k, b in enumerate(data[i : i + n]):
                    total = (total + int(words._WEIGHTS[b]) * int(words.powers(n)[k])) % 2**64
                h = words.mix(np.array([total], dtype=np.uint64))[0]
                found.append(weight[int(h) % toxicity.BUCKETS])
        return sum(found) / max(1, len(found))

    tokens = toxicity.tokens(text)
    odds = [sum(map(value, tokens[i : i + 16])) / len(tokens[i : i + 16]) + bias for i in range(0, len(tokens), 16)]
    return 1 / (1 + math.exp(-max(odds, default=bias)))


def test_scores_against_a_plain_forward_pass():
    weight = np.random.default_rng(3).normal(0, 2, toxicity.BUCKETS).astype(np.float32)
    bodies = ["", "a", "!!", "One, two: THREE", "é ß \U0001f600", *[r[1] for r in texts.awkward() if r[1] and len(r[1]) < 800]]
    got = toxicity.score_texts(bodies, ngrams.WordValues(weight[:, None], toxicity.SIZES), -0.3)
    assert got == pytest.approx([plain_score(t, weight, -0.3) for t in bodies], abs=1e-4)


def test_a_misspelling_shares_the_vectors_of_the_word():
    rows = [f"plain words number{i} here today" for i in range(60)] + [f"you are stupidfool number{i} here" for i in range(60)]
    model = toxicity.train(rows, np.repeat([0, 1], 60))
    known = ngrams.WordValues(model.weight[:, None], toxicity.SIZES)
    word, unseen, other = toxicity.score_texts(["stupidfool", "stupidfoool", "zebrawagon"], known, model.bias)
    assert word > unseen > other and unseen - other > 0.5 * (word - other)

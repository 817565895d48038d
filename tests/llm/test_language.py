"""Mixture inference against a plain version, with many languages and rare ones."""

import math
import random

import numpy as np
import pytest

from bedside.llm import language


def plain_mixture(likelihood, scale, count, penalty, steps):
    """Proportions of one document: expectation-maximisation for every size of the language set, the least language going each time."""
    k, n = len(likelihood[0]), sum(count)
    theta, best, kept = [1 / k] * k, -math.inf, None
    for size in range(k, 0, -1):
        for _ in range(steps[0] if size == k else steps[1]) if size > 1 else ():
            new = [0.0] * k
            for p, c in zip(likelihood, count):
                joint = [t * x for t, x in zip(theta, p)]
                for j in range(k):
                    new[j] += c * joint[j] / sum(joint)
            theta = [x / n for x in new]
        fit = sum(c * (s + math.log(sum(t * x for t, x in zip(theta, p)))) for p, c, s in zip(likelihood, count, scale))
        score = fit - penalty * (size - 1) * math.log1p(n)
        if score > best:
            best, kept = score, list(theta)
        least = min((t, j) for j, t in enumerate(theta) if t > 0)[1]
        theta[least] = 0.0
        if not sum(theta):
            break
        theta = [t / sum(theta) for t in theta]
    return kept, best


@pytest.mark.parametrize("k", [2, 4, 9])
def test_mixture_against_a_plain_version(k):
    rng = np.random.default_rng(k)
    sizes = [1, 5, 30, 12]
    log = rng.normal(-4, 1.5, (sum(sizes), k))
    scale = log.max(axis=1)
    count = rng.integers(1, 6, sum(sizes)).astype(float)
    first = np.cumsum([0, *sizes[:-1]])
    theta, best = language.mixture(np.exp(log - scale[:, None]), scale, count, first, penalty=0.3, steps=(8, 4))
    for d, (a, n) in enumerate(zip(first, sizes)):
        own = slice(a, a + n)
        want, score = plain_mixture(np.exp(log - scale[:, None])[own].tolist(), scale[own], count[own].tolist(), 0.3, (8, 4))
        assert theta[d] == pytest.approx(want, abs=1e-9) and best[d] == pytest.approx(score)


def test_nine_languages_one_of_them_rare(spark):
    rng = random.Random(2)
    alphabets = {f"l{j}": [f"{chr(97 + j)}{a}{b}" for a in "aeiou" for b in "kmnprst"] for j in range(9)}

    def text(lang, n):
        return " ".join(rng.choice(alphabets[lang]) + rng.choice(alphabets[lang]) for _ in range(n))

    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(rng.choice([f"l{j}" for j in range(8)]) for _ in range(600))]
    rows += [(1000 + i, text("l8", 30), "l8") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language_model(docs, per_language=20)
    assert model[0] == sorted(alphabets)
    asked = [(i, text(lang, 25), lang) for i, lang in enumerate(sorted(alphabets) * 3)]
    asked.append((99, text("l1", 40) + " " + text("l8", 20), "l1"))
    found = {r.doc_id: r for r in language.identify_languages(spark.createDataFrame(asked, docs.schema), model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in asked)
    assert found[99].lang_set.startswith("l1:") and ",l8:" in found[99].lang_set and 0.5 < found[99].score < 0.9


def test_a_rare_language_among_many_rows_of_another(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'zyx wvu zyx' ELSE 'abc def abc' END AS text", "CASE WHEN id = 7 THEN 'b' ELSE 'a' END AS lang")
    assert language.fit_language_model(docs, per_language=5)[0] == ["a", "b"]

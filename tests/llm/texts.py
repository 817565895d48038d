"""Small inputs with awkward rows, and brute-force versions of what operators return."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def awkward():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, equal texts, control characters."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    a, long = text(90), text(30_000)
    near = a.split()
    near[45] = "changed"
    return [
        (1, a, "en", "s1", 1),
        (2, " ".join(near), "en", "s1", 1),
        (3, a, "de", "s2", None),
        (3, a, "de", "s2", None),
        (4, None, "en", None, None),
        (5, "", None, "s1", 0),
        (6, " \t\n ", "fr", "s1", 4),
        (7, long, "en", None, 5),
        (8, long[:-3], None, "s3", 5),
        (None, a, "en", "s1", 1),
        (None, None, None, None, None),
        (9, "ÄÖ é ▁x\u0000y\r\nZ 😀 <|im_end|>", "es", "s1", 3),
        (10, "one", "en", "s1", 3),
        (10, "one two", "en", "s1", 7),
        (11, "ONE", "en", "s1", 3),
        (12, text(70) + " " + " ".join(a.split()[:60]), "en", "s4", 9),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def shingles(text, k):
    w = re.findall(SPACES, lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows, k=5, percent=80):
    """id -> least id reachable, over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return {i: find(i) for i in least}


def repeats(rows, window=20):
    """(id, words, words removed, kept words) in the order of ids: words in windows that start earlier go."""
    seen, found = set(), []
    for i, text in sorted(rows):
        w = re.findall(SPACES, text or "")
        keep = [True] * len(w)
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                keep[at : at + window] = [False] * window
            seen.add(key)
        kept = [x for x, k in zip(w, keep) if k]
        found.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return found

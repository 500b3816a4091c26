"""Periodic runs against a plain search over all periods."""

import hashlib
import random

import numpy as np
import pytest
from merchloom.llm import periodic


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def made(rng):
    words = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 90))]
    if words and rng.random() < 0.6:
        at, p = rng.randrange(len(words)), rng.randint(1, 15)
        words[at:] = [words[at + (i % p)] if at + i % p < len(words) else "z" for i in range(len(words) - at)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [made(rng) for _ in range(rng.randint(1, 9))]
        codes, bounds = periodic.coded([[w.encode() for w in t] for t in texts])
        rows = periodic.find_runs(codes, bounds)
        for k, words in enumerate(texts):
            assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == plain_runs(words)


@pytest.mark.parametrize("words", [fibonacci(400), ["x"] * 500, ["a", "b"] * 30 + ["c"] + ["a", "b"] * 30, ["x"] * 11, ["x"] * 12, list("abcdef") * 2, list("abcdef") * 2 + ["z"] + list("abcdefg") * 2, list("aab") * 5 + list("aab") * 5])
def test_runs_of_special_texts(words):
    codes, bounds = periodic.coded([[w.encode() for w in words]])
    assert [tuple(r[1:]) for r in periodic.find_runs(codes, bounds).tolist()] == plain_runs(words)


def test_every_leaf_is_walked_at_most_log_times():
    rng = random.Random(1)
    codes = np.array([rng.randrange(2) for _ in range(4096)])
    suffixes = periodic.Suffixes(codes, np.array([0, len(codes)]))
    _, _, _, start, stop, _ = periodic.nodes(suffixes)
    walked = np.zeros(len(codes), int)
    for a, b in zip(start, stop):
        walked[a:b] += 1
    assert walked.max() <= 12


def test_extensions():
    rng = random.Random(2)
    texts = [[rng.randrange(2) for _ in range(rng.randint(2, 70))] for _ in range(20)]
    codes = np.array(sum(texts, []))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    suffixes = periodic.Suffixes(codes, bounds)
    for k, t in enumerate(texts):
        i = np.array([a for a in range(len(t)) for b in range(a + 1, len(t))])
        j = np.array([b for a in range(len(t)) for b in range(a + 1, len(t))])
        ahead, behind = suffixes.forward(i + bounds[k], j + bounds[k]), suffixes.backward(i + bounds[k], j + bounds[k])
        for a, b, x, y in zip(i, j, ahead, behind):
            assert x == next((n for n in range(len(t) - b) if t[a + n] != t[b + n]), len(t) - b)
            assert y == next((n for n in range(a) if t[a - 1 - n] != t[b - 1 - n]), a)


def test_report_and_collapse(spark, docs, rows):
    rows = [*rows, *[(1000 + i, " ".join(w), *rows[0][2:]) for i, w in enumerate([fibonacci(200), ["x"] * 40, list("abcdefgh") * 3])], (None, "q " * 20, *rows[0][2:])]
    docs = spark.createDataFrame(rows, docs.schema).repartition(3)
    want, kept, listed = [], [], []
    for row in rows:
        words = (row[1] or "").encode().split()
        runs = plain_runs(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        rest = b" ".join(plain_collapse(words, runs))
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        want.append((row[0], len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4), digest, hashlib.sha256(rest).hexdigest()))
        kept.append((row[0], rest.decode() if runs else row[1]))
        listed += [(row[0], *r) for r in runs]
    assert sorted(map(repr, map(tuple, periodic.report(docs).collect()))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, periodic.collapse(docs).select("doc_id", "text").collect()))) == sorted(map(repr, kept))
    assert sorted(map(repr, map(tuple, periodic.runs(docs).collect()))) == sorted(map(repr, listed))
    assert periodic.collapse(docs).columns == docs.columns


def test_empty(empty):
    assert periodic.report(empty).collect() == [] and periodic.runs(empty).collect() == [] and periodic.collapse(empty).collect() == []

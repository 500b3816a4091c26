"""Class bigrams: exchange gains against the likelihood, pair counts and scores against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from merchloom.llm import brown


def texts():
    rng = random.Random(2)
    sets = [[f"{p}{i}" for i in range(12)] for p in ("noun", "verb", "adj")]
    rows = [" ".join(rng.choice(sets[k % 3]) for k in range(rng.randint(5, 60))) for _ in range(80)]
    return rows + [None, "", "rare word", "Rare " + "long" * 40, "long" * 40 + " again " + "long" * 41]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(t,) for t in texts()], "text string").repartition(3)


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(0)
    n, k = 30, 6
    bigrams = rng.poisson(0.7, (n, n)).astype(float)
    of = rng.integers(0, k, n)

    def of_classes(of):
        member = np.eye(k)[of]
        return member.T @ bigrams @ member

    member = np.eye(k)[of]
    now = of_classes(of)
    to = np.tile(np.arange(k), (n, 1))
    got = brown.gains(bigrams @ member, bigrams.T @ member, np.diag(bigrams), of, to, now)
    for w in range(n):
        for g in range(k):
            moved = of.copy()
            moved[w] = g
            assert math.isclose(got[w, g], brown.likelihood(of_classes(moved)) - brown.likelihood(now), rel_tol=1e-9, abs_tol=1e-7)


def test_neighbours_hold_every_pair(table):
    words = [b"", *sorted({w for t in texts() for w in brown.tokens((t or "").encode())} - {b"", b"rare"})]
    index, n = {w: i for i, w in enumerate(words)}, len(words)
    want = Counter()
    for t in texts():
        ids = [0, *[index.get(w, n) for w in brown.tokens((t or "").encode())]]
        want.update(zip(ids, ids[1:]))
    right, left = Counter(), Counter()
    near = brown.neighbours(table, words)
    for own in brown._rows(near.toArrow().to_batches()):
        w, at, other, counts, left_at, left_other, left_counts = own
        right.update({(int(w[a]), int(o)): int(c) for a, o, c in zip(at, other, counts)})
        left.update({(int(o), int(w[a])): int(c) for a, o, c in zip(left_at, left_other, left_counts)})
    assert right == want and left == want
    of = np.array([0, *[1 + i % 3 for i in range(n)]], np.uint8)
    table_ = brown.class_table(near, of, 4)
    assert all(table_[a, b] == sum(c for (x, y), c in want.items() if (of[x], of[y]) == (a, b)) for a in range(4) for b in range(4))


@pytest.mark.parametrize("sizes", [{}, {"classed": 9, "min_count": 1, "classes": 4}, {"min_count": 1000}])
def test_scores_match_plain_counting(spark, table, sizes):
    vocabulary = brown.word_counts(table)
    model = brown.learn(table, vocabulary, **sizes)
    items = brown.Items(model.classed, model.tail_bits, model.of)
    cls = lambda w: int(model.of[items[w]])
    train = [brown.tokens((t or "").encode()) for t in texts()]
    counts = Counter(w for t in train for w in t)
    assert {r["word"].encode(): r["c"] for r in vocabulary.collect()} == counts and (model.total, model.distinct) == (sum(counts.values()), len(counts))
    classes = len(model.log_size)
    assert cls(b"") == 0 and all(0 < cls(w) < classes for w in [*counts, b"unseen"] if w)
    pairs, size, types = np.zeros((classes, classes)), np.zeros(classes), np.zeros(classes)
    for own in train:
        for a, b in zip([b"", *own], own):
            pairs[cls(a), cls(b)] += 1
            size[cls(b)] += 1
    for w in counts:
        types[cls(w)] += 1
    share = size / size.sum()

    def log10(before, word):
        a, b = cls(before), cls(word)
        move = (pairs[a, b] + brown.BACK_OFF * share[b]) / (pairs[a].sum() + brown.BACK_OFF)
        return math.log10(move * (counts[word] - model.discount if word in counts else model.discount * types[b]) / size[b])

    # From every class the words that were seen, and one for all that were not, have the probability 1.
    for g in {cls(w) for w in counts}:
        before = next(w for w in counts if cls(w) == g)
        unseen = sum((pairs[g, b] + brown.BACK_OFF * share[b]) / (pairs[g].sum() + brown.BACK_OFF) * model.discount * types[b] / size[b] for b in range(classes) if size[b])
        assert math.isclose(sum(10 ** log10(before, w) for w in counts) + unseen, 1, rel_tol=1e-9)
    probe = [*texts(), "unseen noun1 Verb2 unseen"]
    docs = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown.score(docs, table, **sizes).collect()}
    for i, text in enumerate(probe):
        own = brown.tokens((text or "").encode())
        assert math.isclose(got[i]["score"], sum(log10(a, b) for a, b in zip([b"", *own], own)), rel_tol=1e-9)
        assert math.isclose(got[i]["perplexity"], 10 ** (-got[i]["score"] / len(own)), rel_tol=1e-9)


def test_classes_follow_contexts(spark, table):
    """Words that stand in the same places share classes, whether clustered by exchange or as other words."""
    for sizes in ({"classes": 5, "sweeps": 20}, {"classes": 5, "sweeps": 20, "classed": 25}):
        model = brown.learn(table, brown.word_counts(table), min_count=1, **sizes)
        items = brown.Items(model.classed, model.tail_bits, model.of)
        by_kind = [Counter(int(model.of[items[f"{p}{i}".encode()]]) for i in range(12)).most_common(1)[0] for p in ("noun", "verb", "adj")]
        assert len({k for k, _ in by_kind}) == 3 and sum(n for _, n in by_kind) >= 28


def test_the_best_class_of_all_without_a_shortlist():
    rng = np.random.default_rng(4)
    n, k = 40, 12
    bigrams = rng.poisson(0.7, (n, n)).astype(float)
    of = rng.integers(1, k, n)
    member = np.eye(k)[of]
    now, right, left, own = member.T @ bigrams @ member, bigrams @ member, bigrams.T @ member, np.diag(bigrams)
    to = np.tile(np.arange(1, k), (n, 1))
    gain = brown.gains(right, left, own, of, to, now).max(axis=1)
    for shortlist in (None, k, 3):
        place, got = brown.best_moves(right, left, own, of, now, k, shortlist)
        assert (got <= gain + 1e-9).all() and (shortlist == 3 or np.allclose(got, gain))
        assert ((place == of) | (got > 0)).all()


def test_more_classes_than_a_byte_holds_are_an_error(spark):
    with pytest.raises(ValueError, match="at most 255"):
        brown.exchange(None, np.ones(400, np.int64), classes=300)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 300}" for j in range(200))) for i in range(40)], "doc_id long, text string")
    assert brown.score(docs, docs, classes=255, sweeps=1, shortlist=None).count() == 40

"""The attention model: its forward pass against loops, its slopes against finite differences, and what bounds its training."""

import math
import random

import numpy as np
import pytest
from merchloom.llm import quality_mil as mil


def bags(seed=1, sizes=(1, 4, 2, 7)):
    rng = np.random.default_rng(seed)
    n = np.array(sizes)
    x = rng.normal(0, 1, (n.sum(), mil.N_FEATURES))
    p = {"W": rng.normal(0, 0.4, (mil.N_FEATURES, mil.HIDDEN)), "b": rng.normal(0, 0.3, mil.HIDDEN), "V": rng.normal(0, 0.5, (mil.HIDDEN, mil.GATE)), "U": rng.normal(0, 0.5, (mil.HIDDEN, mil.GATE)), "w": rng.normal(0, 1, mil.GATE), "c": rng.normal(0, 1, mil.HIDDEN), "d": np.array([0.2])}
    return p | {"mean": rng.normal(0, 0.1, mil.N_FEATURES), "scale": rng.uniform(0.5, 2, mil.N_FEATURES)}, x, n


def plain_score(p, passages):
    """One bag, number by number."""
    def row(v, m):
        return [sum(v[i] * m[i][j] for i in range(len(v))) for j in range(len(m[0]))]

    hidden = [[math.tanh(a + b) for a, b in zip(row([(v - u) / s for v, u, s in zip(x, p["mean"], p["scale"])], p["W"]), p["b"])] for x in passages]
    energy = [sum(math.tanh(t) / (1 + math.exp(-g)) * w for t, g, w in zip(row(h, p["V"]), row(h, p["U"]), p["w"])) for h in hidden]
    parts = [math.exp(e) for e in energy]
    pooled = [sum(a * h[j] for a, h in zip(parts, hidden)) / sum(parts) for j in range(mil.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(pooled, p["c"])) + p["d"][0]))), [a / sum(parts) for a in parts]


def test_forward_pass():
    p, x, n = bags()
    f = mil.forward(p, x, n)
    at = 0
    for k, size in enumerate(n):
        score, weights = plain_score(p, x[at : at + size].tolist())
        assert f["score"][k] == pytest.approx(score, rel=1e-9) and f["a"][at : at + size] == pytest.approx(weights, rel=1e-9)
        at += size


def test_slopes():
    p, x, n = bags(2)
    y, each = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.1, 0.4, 0.3, 0.2])

    def loss(q):
        s = mil.forward(q, x, n)["score"]
        return -(each * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    grads, rng = mil.gradients(p, x, n, y, each), random.Random(3)
    assert set(grads) == set(p) - {"mean", "scale"}
    for name, grad in grads.items():
        for _ in range(6):
            at = tuple(rng.randrange(k) for k in p[name].shape)
            low, high = ({**p, name: p[name].copy()} for _ in range(2))
            low[name][at] -= 1e-6
            high[name][at] += 1e-6
            assert grad[at] == pytest.approx((loss(high) - loss(low)) / 2e-6, rel=1e-4, abs=1e-9), (name, at)


SCHEMA = "doc_id long, text string, score string, y string, fold string"


def test_bounds_and_awkward_labels(spark):
    """Repeated rows and labels, clashing columns, and texts longer than the bound on passages."""
    rng = random.Random(4)
    good = [" ".join(rng.choice(("plain", "words", "here", "and", "there")) for _ in range(1500)) for _ in range(12)]
    bad = ["#$% ||| <<>> 123 " * 300 for _ in range(12)]
    rows = [(i, t, "x", "y", "f") for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([*rows, rows[0], (None, good[0], "x", "y", "f")], SCHEMA)
    labels = spark.createDataFrame([*[(i, int(i < 12), "t") for i in range(24)], (0, 1, "t"), (3, None, "t"), (5, 7, "t"), (None, 1, "t")], "doc_id long, quality int, text string")
    for passages in (2, mil.TRAIN_PASSAGES, None):
        found = mil.classify(docs, labels, passages=passages).collect()
        assert len(found) == 26 and all((r["score"] > 0.5) == (r["doc_id"] is None or r["doc_id"] < 12) for r in found), passages
        twice = [r["score"] for r in found if r["doc_id"] == 0]
        assert len(twice) == 2 and twice[0] == twice[1]

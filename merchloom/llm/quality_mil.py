"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded by what its
characters and words look like (shares of character classes, word length, variety of
words), a small layer embeds it, gated attention weighs the passages of a document, and
the weighted sum is classified:

    h_k = tanh(x_k W + b)      a_k ~ exp(w.(tanh(h_k V) * sigmoid(h_k U)))
    score = sigmoid(c.(sum_k a_k h_k) + d)

All weights, attention included, are learned from document labels alone, by gradient
descent on a bounded sample: at most ``SAMPLE`` labelled rows of each class, the ones with
the smallest hash of their id, and at most ``TRAIN_PASSAGES`` evenly spaced passages of
each (parameters of ``train`` and ``classify``; without the second all passages count). Scoring reads every passage of every document. Nothing but the text is an input.

Defined results: a null or empty text is one passage of zeros; without labelled rows of
both classes every score is the share of label 1 (0.5 without labels); null labels are
left out; repeated rows give repeated results; an empty table an empty one; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, renamed

PASSAGE_BYTES = 600
SAMPLE, TRAIN_PASSAGES = 2000, 48
HIDDEN, GATE, ROUNDS, RATE, DECAY = 12, 8, 120, 0.03, 1e-3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Bytes whose classes are counted at once.
BLOCK_BYTES = 4 << 20

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#*$%&", "<>{}[]\\^~=+_@", "\"'()-;:/`", "\t\r\x0b\x0c")
N_CLASSES = len(_CLASSES) + 2  # the last two: other ASCII, and bytes of non-ASCII characters
_CLASS = np.array([next((i for i, x in enumerate(_CLASSES) if chr(b) in x), N_CLASSES - 2) if b < 128 else N_CLASSES - 1 for b in range(256)], np.int64)
N_FEATURES = N_CLASSES + 4


def cuts(n: int, size: int = PASSAGE_BYTES) -> list[int]:
    """Where the passages of n bytes begin and end: equal parts of at most ``size`` bytes."""
    k = max(1, -(-n // size))
    return [n * i // k for i in range(k + 1)]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text."""
    bounds = [cuts(len(t)) for t in texts]
    lengths = np.array([b - a for c in bounds for a, b in zip(c, c[1:])], np.int64)
    counts = np.zeros((len(lengths), N_CLASSES))
    done, at = 0, 0
    block: list[bytes] = []
    held = 0

    def flush():
        nonlocal done, held
        k = at - done
        if k:
            codes = _CLASS[np.frombuffer(b"".join(block), np.uint8)]
            places = np.repeat(np.arange(k) * N_CLASSES, lengths[done:at]) + codes
            counts[done:at] = np.bincount(places, minlength=k * N_CLASSES).reshape(k, N_CLASSES)
        block.clear()
        done, held = at, 0

    variety = np.zeros((len(lengths), 3))
    for t, c in zip(texts, bounds):
        for a, b in zip(c, c[1:]):
            words = t[a:b].split()
            if words:
                n = len(words)
                variety[at] = len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, min(1.0, (b - a) / n / 20)
            at += 1
        block.append(t)
        held += len(t)
        if held >= BLOCK_BYTES:
            flush()
    flush()
    shares = counts / np.maximum(lengths, 1)[:, None]
    full = np.minimum(lengths / PASSAGE_BYTES, 1.0)[:, None]
    return np.hstack([np.sqrt(shares), variety, full]), np.array([len(c) - 1 for c in bounds], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Everything that the model computes for bags of n passages each with the features x."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    bag = np.repeat(np.arange(len(n)), n)
    x = (x - p["mean"]) / p["scale"]
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "starts": starts, "score": _sigmoid(z @ p["c"] + p["d"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
    """The slopes of the cross entropy of bags (x, n) with the labels y, weighed by ``each``, in all learnt weights."""
    f = forward(p, x, n)
    out = each * (f["score"] - y)
    dz = out[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(axis=1)
    mean = np.add.reduceat(f["a"] * da, f["starts"])
    de = f["a"] * (da - mean[f["bag"]])
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()]),
    }


def fit(x: np.ndarray, n: np.ndarray, y: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """The weights for bags (x, n) with the labels y, both classes weighing the same; Adam on all bags."""
    rng = np.random.default_rng(seed)
    p = {
        "W": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        grads = gradients(p | fixed, x, n, y, each)
        for k in p:
            grad = grads[k] + DECAY * p[k] / len(p)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def constant(share: float) -> dict[str, np.ndarray]:
    """A model that scores everything with one share."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    zeros = {"W": (N_FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": GATE, "c": HIDDEN, "mean": N_FEATURES}
    return {k: np.zeros(v) for k, v in zeros.items()} | {"scale": np.ones(N_FEATURES), "d": np.array([np.log(share / (1 - share))])}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int | None = TRAIN_PASSAGES) -> dict[str, np.ndarray]:
    """A model fitted to a bounded sample of the labelled rows outside the held-out fold: ``sample`` rows of each class, and of each
    at most ``passages`` of its passages, evenly spaced (None: all of them, as many as the longest texts have; the driver holds 88 bytes of each)."""
    usable = renamed(labels, doc_id=id_col, y=label_col).where(F.col("y").isin(0, 1) & ~F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("y = 0").orderBy(*order).limit(sample).union(usable.where("y = 1").orderBy(*order).limit(sample))
    # At most 2 * sample rows of two numbers are broadcast.
    texts = renamed(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                x, n = encode([text])
                pick = np.unique(np.linspace(0, n[0] - 1, passages).astype(int)) if passages and n[0] > passages else np.arange(n[0])
                yield pa.RecordBatch.from_arrays([pa.array([x[pick].astype(np.float32).tobytes()], pa.binary()), pa.array([int(y)], pa.int64())], ["x", "y"])

    rows = texts.select("doc_id", "text", "y").mapInArrow(encoded, "x binary, y long").collect()
    # Rows come in any order; sorted, the fit is the same in each run.
    rows = sorted((bytes(r["x"]), r["y"]) for r in rows)
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(r[0], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return fit(np.vstack(bags).astype(float), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", batch_texts: int = 1000) -> DataFrame:
    """(doc_id, score) per row of ``docs``: every passage of every text is weighed."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_texts):
                batch = whole.slice(at, batch_texts)
                x, n = encode(as_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forward(model, x, n)["score"], pa.float64())], ["doc_id", "score"])

    rows = renamed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, passages: int | None = TRAIN_PASSAGES) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; ``sample`` and ``passages`` bound what is learnt from."""
    scores = score(docs, train(docs, labels, id_col, text_col, label_col, sample, passages), id_col, text_col)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

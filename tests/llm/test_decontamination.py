"""Benchmark windows that very many items share, and windows whose keys agree."""

import time

import numpy as np
from merchloom.llm import decontaminate


def plain(items, text, window=10):
    words = decontaminate.words(text)
    hit, found = [False] * len(words), set()
    for name, body in items:
        own = decontaminate.words(body)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                found.add(name)
                hit[i : i + n] = [True] * n
    return hit, sorted(found)


def test_common_windows_are_verified_once():
    lead = " ".join(f"boiler{i}" for i in range(40))
    items = [(str(i), f"{lead} tail{i} more{i}".encode()) for i in range(20_000)]
    grams = decontaminate.Grams(items)
    text = decontaminate.words(lead.encode())
    grams.scan(text)
    began = time.perf_counter()
    for _ in range(20):
        hit, found = grams.scan(text)
    assert (time.perf_counter() - began) / 20 < 0.02  # a loop over owners takes seconds
    assert hit.all() and found == sorted(str(i) for i in range(20_000))
    assert len(grams.lists) < 2 * len(items) and sum(map(len, grams.lists)) < 4 * len(items)


def test_scan_against_plain_windows(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(6)]
    items = [(f"i{rng.integers(30)}", " ".join(rng.choice(words, rng.integers(0, 14))).encode()) for _ in range(60)]
    texts = [" ".join(rng.choice([*words, "other"], rng.integers(0, 80))).encode() for _ in range(60)]
    for few in (False, True):  # with keys of one bit, nearly all of them agree by chance
        if few:
            keys = decontaminate._keys
            monkeypatch.setattr(decontaminate, "_keys", lambda ids, n: keys(ids, n) & np.uint64(1))
        grams = decontaminate.Grams(items)
        for text in texts:
            hit, found = grams.scan(decontaminate.words(text))
            assert (hit.tolist(), found) == plain(items, text)

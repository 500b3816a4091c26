"""Words are split, counted and looked up by columns: as ``tokens`` and the items give them one by one, and each distinct word once."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from merchloom.llm import brown

LONG = "Ü" * 40


def awkward():
    rng = random.Random(7)
    pieces = ["a", "B", "Z9", "ä", "中文", "😀", LONG, LONG + "x", "b" * 64, "b" * 65, " ", "  ", "\t", "\n", "\x0b\x0c\r", "\x1c", "\x85", " ", " ", "\x00"]
    return [None, "", " ", " \n", "a", " a ", LONG, *("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(300))]


@pytest.mark.parametrize("part", [slice(None), slice(3, 9), slice(0, 3), slice(0, 0)])
def test_words_are_those_of_tokens(part):
    texts = awkward()[part]
    words, bounds = brown.split(pa.array(awkward(), pa.string())[part])
    own = words.to_pylist()
    assert [[*own[a:b], brown.END] for a, b in zip(bounds, bounds[1:])] == [brown.tokens((t or "").encode()) for t in texts]
    assert brown.endings(words).tolist() == [brown.ending(w) for w in own]
    assert brown.endings(words[2:]).tolist() == [brown.ending(w) for w in own[2:]]


@pytest.mark.parametrize("bits, known", [(0, None), (8, None), (8, 3)])
def test_items_are_those_of_single_words(bits, known):
    words, _ = brown.split(pa.array(awkward(), pa.string()))
    classed = [brown.END, b"a", b"b" * 64]
    of = None if known is None else np.arange(3 + 256 + brown.ENDINGS) % known
    one, items = brown.Items(classed, bits, of), brown.Items(classed, bits, of)
    ids, at, others = items.all_of(words)
    assert ids.tolist() == [one[w] for w in words.to_pylist()]
    assert at.tolist() == np.flatnonzero(ids >= 3).tolist() and others.to_pylist() == words.take(pa.array(at)).to_pylist()


def test_each_distinct_word_is_hashed_once(monkeypatch):
    looked_up = Counter()
    digest = brown.xxhash.xxh64_intdigest
    monkeypatch.setattr(brown.xxhash, "xxh64_intdigest", lambda word: looked_up.update([word]) or digest(word))
    texts = pa.RecordBatch.from_arrays([pa.array(["red green red blue green red"] * 400)], ["text"])
    ids = np.concatenate(list(brown._item_blocks(iter([texts]), brown.Items([brown.END, b"red"], 8))))
    assert len(ids) == 1 + 7 * 400 and looked_up == {b"green": 1, b"blue": 1}


def test_counts_are_plain_counts(monkeypatch):
    monkeypatch.setattr(brown, "FLUSH", 20)  # many parts
    texts = [t or "" for t in awkward()]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 50])], ["text"]) for i in range(0, len(texts), 50)]
    got = Counter()
    for batch in brown._counted(iter(batches)):
        for word, c in zip(*(x.to_pylist() for x in batch.columns)):
            got[word.encode()] += c
    assert got == Counter(w for t in texts for w in brown.tokens(t.encode()))

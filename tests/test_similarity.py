"""Entity resolution: candidates by pieces and the choice by local dominance, against plain versions."""

import random

import pytest
from merchloom.operators import categories, similarity
from test_operators import distance, plain_resolve

SCHEMA = "id long, key string, source string"


def names(rng, n, letters="ab", lead=("nagriv mat 0", "kabel dvozhil")):
    """Names of a few blocks, many of them changed copies of others."""
    keys = []
    while len(keys) < n:
        if keys and rng.random() < 0.7:
            key = list(rng.choice(keys))
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(12, len(key) + 1)
                key[at : at + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
            keys.append("".join(key))
        else:
            keys.append(rng.choice(lead)[:12] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
    return keys


@pytest.mark.parametrize("least", [0.9, 0.8, 0.75])
def test_both_ways_to_meet_find_all_near_keys(spark, least):
    rng = random.Random(7)
    keys = sorted({k for k in names(rng, 250, "abcd") if len(k) >= similarity.MIN_LENGTH})
    want = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[:12] == b[:12] and (s := 1 - distance(a, b) / max(len(a), len(b))) >= least:
                want[a, b] = round(s, 9)
    frame = spark.createDataFrame([(k[:12], k) for k in keys], "block string, key string")
    by_length = similarity.near_keys(frame, least)
    by_piece = similarity._verified(similarity.candidate_keys(frame, least).distinct(), least)
    for found in (by_length, by_piece):
        assert {(r.key_a, r.key_b): round(r.similarity, 9) for r in found.collect()} == want and want


def test_pieces_form_few_rows(spark):
    """One block of 3,000 names: the rows that meet are a small part of the 4.5 million pairs."""
    rng = random.Random(8)
    keys = {"nagriv mat 0" + " ".join("".join(rng.choice("abcdefghijklmnop0123") for _ in range(6)) for _ in range(4)) for _ in range(3000)}
    frame = spark.createDataFrame([(k[:12], k) for k in keys], "block string, key string")
    assert similarity.candidate_keys(frame, similarity.MERGE).count() < 0.01 * len(keys) ** 2 / 2


@pytest.mark.parametrize("seed, n, together", [(0, 24, 0), (1, 60, 20), (2, 60, similarity.TOGETHER)])
def test_rounds_choose_as_the_sequential_version(spark, seed, n, together):
    """Blocks in rounds to the end, in rounds until they are small, and in a task from the start."""
    rng, order = random.Random(seed), ["et_market", "in_heat", "vsesezon"]
    taken, rows = set(), []
    for key in names(rng, n):
        source = rng.choice(order)
        if (key, source) not in taken:
            taken.add((key, source))
            rows.append((len(rows), key, source))
    pointers = {r.loser: r.canonical for r in similarity.resolve(spark.createDataFrame(rows, SCHEMA), order, together=together).collect()}

    def end(x):
        while x in pointers:
            x = pointers[x]
        return x

    want = plain_resolve(rows, order, similarity.MERGE)
    assert {x: end(x) for x in pointers} == want and want


def test_samples_of_merges(spark):
    rows = spark.createDataFrame([(1, "the same long name of a mat", "et_market"), (2, "the same long name of a mat", "in_heat"), (3, "the same long name of a max", "vsesezon"), (4, "another long name of a mat", "vsesezon")], SCHEMA)
    pointers = similarity.resolve(rows, categories.SOURCES)
    slugs = spark.createDataFrame([(1, "one"), (2, "two")], "id long, slug string")
    found = [tuple(r) for r in similarity.merged_samples(rows, pointers, slugs).collect()]
    assert found == [("one", "two", 1.0), ("one", "3", 0.963)]
    assert similarity.merged_samples(rows, pointers, slugs, 1).count() == 1


def test_nothing_to_resolve(spark):
    rows = spark.createDataFrame([(1, None, "et_market"), (2, "short", "in_heat")], SCHEMA)
    assert similarity.resolve(rows, categories.SOURCES).count() == 0 and similarity.class_pairs(rows).count() == 0

"""Trees by jumps, against walks from node to node; deep, broad and broken ones."""

import random

import pytest
from merchloom.operators import consolidate, trees
from pyspark.sql import functions as F

SCHEMA = "id string, parent string, sort_order int, name string"


def forest(rng, n, loops=False):
    rows = [(f"n{i}", None if rng.random() < 0.1 else f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else "gone", rng.randrange(3), rng.choice("абвг")) for i in range(n)]
    if loops:
        rows += [("a", "c", 0, "x"), ("b", "a", 0, "x"), ("c", "b", 0, "x"), ("under", "b", 0, "x"), ("self", "self", 0, "x")]
    rng.shuffle(rows)
    return rows


def above(parent, x):
    seen = []
    while parent.get(x) is not None and parent[x] not in seen:
        x = parent[x]
        seen.append(x)
    return seen


def walk(rows):
    """(id, first, last, depth) in tree order."""
    ids = {r[0] for r in rows}
    children, out = {}, {}
    for r in rows:
        children.setdefault(r[1] if r[1] in ids else None, []).append(r)

    def visit(parent, depth, at):
        for r in sorted(children.get(parent, []), key=lambda r: (r[2], r[3], r[0])):
            end = visit(r[0], depth + 1, at + 1)
            out[r[0]] = (at, end - 1, depth)
            at = end
        return at

    visit(None, 0, 0)
    return out


@pytest.mark.parametrize("loops", [False, True])
def test_questions_about_ancestors(spark, loops):
    rng = random.Random(5)
    rows = forest(rng, 40, loops)
    parent = {r[0]: r[1] for r in rows}
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = walk(rows)
    assert {r["id"]: tuple(r)[1:] for r in trees.intervals(nodes).collect()} == want
    below = {x: {y for y in parent if x in above(parent, y)} for x in [*parent, "gone"]}
    assert {r["id"] for r in trees.descendants(nodes.select("id", "parent"), F.lit("n0")).collect()} == below["n0"]
    assert {r["id"] for r in trees.descendants(nodes.select("id", "parent"), F.lit("gone")).collect()} == below["gone"]
    choices = [r["id"] for r in trees.parent_choices(nodes, F.lit("n0")).collect()]
    assert choices == sorted(set(parent) - below["n0"] - {"n0"}, key=lambda x: next((r[2], r[3], r[0]) for r in rows if r[0] == x))
    moves = [(x, y) for x in rng.sample(sorted(parent), 12) for y in [*rng.sample(sorted(parent), 6), None, "nowhere", x]]
    if loops:
        moves += [("a", "under"), ("under", "a"), ("a", "n0"), ("self", "self"), ("c", "a")]
    verdict = {(r["id"], r["new_parent"]): r["verdict"] for r in trees.may_reparent(nodes.select("id", "parent"), spark.createDataFrame(sorted(set(moves), key=str), "id string, new_parent string")).collect()}
    for x, y in moves:
        plain = "ok" if y is None else "self" if x == y else "descendant" if y in below[x] else "missing" if y not in parent else "ok"
        assert verdict[x, y] == plain, (x, y)
    kept = {r["id"] for r in trees.prune(nodes, F.col("id").isin("n7", "n30"), F.col("id") == "n1").where("kept").collect()}
    looped = {x for x in parent if x in above(parent, x)}
    assert kept == {"n7", "n30", "n1", *above(parent, "n7"), *above(parent, "n30"), *above(parent, "n1"), *looped} & set(parent)


def test_a_long_chain(spark):
    """Each node below the one before: rows and rounds stay few, where all pairs would be 2 * 10^8."""
    n = 20_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    jumps = trees.Jumps(nodes)
    assert len(jumps.levels) == 15 and sum(level.count() for level in jumps.levels) < 15 * n
    kept = trees.prune(nodes, F.col("id") == "12345", F.lit(False)).where("kept")
    assert kept.count() == 12346


def test_ends_of_pointers(spark):
    pointers = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 52), (52, 50), (60, 61), (61, 50)]
    found = {r["loser"]: r["ultimate"] for r in trees.ultimate(spark.createDataFrame(pointers, "loser long, canonical long")).collect()}
    assert found == {i: 20 for i in range(20)} | {50: 51, 51: 52, 52: 50, 60: 61, 61: 50}


@pytest.mark.parametrize("limit", [1, 7, 400])
def test_chains_of_pages(spark, limit):
    links = [(f"a{i}", f"a{i + 1}") for i in range(30)] + [("a30", "missing"), ("b0", "b1"), ("b1", "b2"), ("b2", "b1"), ("c", "c"), ("d", None), ("e", "a25"), ("a3", "a4")]
    starts = ["a0", "b0", "c", "d", "e", "nowhere"]
    pages = spark.createDataFrame([(u, n, 2, u.upper()) for u, n in links], "url string, next_url string, n_rows long, title string")
    to, want = dict(links), {}
    for s in starts:
        url, seen = s, []
        while url in to and url not in seen and len(seen) < limit:
            seen.append(url)
            url = to[url]
        want |= {(s, u): k for k, u in enumerate(seen)}
    visited = consolidate.chains(pages, spark.createDataFrame([(s,) for s in starts], "start string"), limit)
    assert {(r["start"], r["url"]): r["place"] for r in visited.collect()} == want
    stats = {r["start"]: (r["pages"], r["rows"], r["title"]) for r in consolidate.chain_stats(visited, pages).collect()}
    assert stats["b0"] == (min(limit, 3), 2 * min(limit, 3), "B0") and set(stats) == {s for s, _ in want}

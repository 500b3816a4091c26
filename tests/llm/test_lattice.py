"""Links of embeddings against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from merchloom.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node long, x string, cell long, m string, meeting long, unit string, component string"


def plain(rows, cosine=0.98):
    """n_links and component_id of each row, over all pairs."""
    sound = [r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if s else None for r, s in zip(rows, sound)]
    near = [[k for k in range(len(rows)) if k != i and sound[i] and sound[k] and rows[k][2] == rows[i][2] and len(units[k]) == len(units[i]) and units[i] @ units[k] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None), rows[i][0] == min(ids, default=None)))
    return sorted(map(repr, out))


def vectors(seed=4):
    """Clusters of all tightness, chains, copies, and every awkward row."""
    rng = np.random.default_rng(seed)
    rows, n = [], 32
    for k in range(12):
        at = rng.standard_normal(n)
        at /= np.linalg.norm(at)
        for spread in rng.uniform(0.0, 0.3, 9):
            rows.append((at + spread * rng.standard_normal(n) / math.sqrt(n)).tolist())
        turn = rng.standard_normal(n)
        turn -= (turn @ at) * at
        turn /= np.linalg.norm(turn)
        rows += [(math.cos(a) * at + math.sin(a) * turn).tolist() for a in np.arange(0, 1, 0.15)]  # a chain: neighbours link, ends do not
        rows += [at.tolist(), at.tolist(), (3 * at).tolist(), (-at).tolist()]
    rows = [(i, x, i % 2 if i % 11 else None) for i, x in enumerate(rows)]
    one = [1.0] * n
    rows += [(9000 + i, x, 0) for i, x in enumerate([None, [], [0.0] * n, [None] * n, [math.nan, *one[1:]], [math.inf, *one[1:]], one, one, one[:8], one[:8], [1e30] * n, [1e-30] * n])]
    rows += [(None, one, 0), (None, [5.0] * 3, 7), (None, [5.0] * 3, 7), (0, one, 0), rows[3]]
    return [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows]


@pytest.mark.parametrize("part", [lattice.PART, 3])
def test_links(spark, part):
    """Also with cells dealt in parts of 3."""
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, "x", 2, "m", 3, "u", "c") for r in rows], SCHEMA).repartition(3)
    found = lattice.link(frame, part=part)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, found.collect()))) == plain(rows)


def test_empty(spark):
    assert lattice.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decode_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    z = np.floor(rng.uniform(-9, 9, (400, 8)) * 2 * lattice.STEP)
    point = lattice.decode(z)
    assert all((2 * p.astype(int) % 4 == p.astype(int)[0] * 2 % 4).all() and p.sum() % 4 == 0 for p in point)  # all even or all odd, and in E8
    rest = ((z - lattice.STEP * point) ** 2).sum(1)
    assert (rest <= (2 * lattice.STEP) ** 2).all()  # the covering radius
    around = ((z[:, None] - lattice.STEP * (point[:, None] + lattice.shortest())) ** 2).sum(2)
    assert (rest[:, None] <= around).all()


def test_cells_are_the_points_within_reach():
    rng = np.random.default_rng(2)
    units = rng.standard_normal((40, 16))
    units /= np.linalg.norm(units, axis=1)[:, None]
    grid = lattice.Lattice(16)
    z, home = grid.places(units)
    row, _, resident = grid.cells(z, home, 1, np.zeros(40, np.int64))
    assert sorted(row[resident]) == list(range(40))
    each = Counter(row.tolist())
    steps = np.concatenate([np.zeros((1, 8)), lattice.shortest()])
    for i in range(40):
        n = 1
        for b in range(grid.blocks):
            gone = ((z[i, 1, b] - lattice.STEP * (home[i, 1, b] + steps)) ** 2).sum(1)
            n *= (gone <= grid.reach2).sum()
        assert each[i] == n


def test_recall_at_the_threshold():
    """Pairs at exactly the least cosine meet in some table."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    p = rng.standard_normal(x.shape)
    p -= (p * x).sum(1)[:, None] * x
    p /= np.linalg.norm(p, axis=1)[:, None]
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * p
    grid = lattice.lattice(64)
    (za, ha), (zb, hb) = grid.places(x), grid.places(y)
    assert (grid.visits(za, hb) | grid.visits(zb, ha)).any(1).mean() > 0.9995

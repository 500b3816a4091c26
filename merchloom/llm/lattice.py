"""Embedding near-duplicates by hashing to E8 lattice cells.

Vectors of one label and length are linked at a cosine of ``COSINE`` or more. Equal vectors are
one node with a multiplicity, so exact copies never meet pairwise.

* Cells. Each of ``TABLES`` tables projects unit vectors by ``BLOCKS`` Gaussian matrices to 8
  coordinates, which are decoded to the nearest points of E8: the vector's home. Per block it also visits
  the neighbouring points (the 240 shortest vectors away) within ``REACH``. Two vectors
  meet in a table if one visits the home of the other. At a cosine of exactly 0.98 that
  happens with probability 0.90 in a table (simulated), so five tables miss 1 of 100,000 such
  pairs, and fewer of closer ones. Projections are rounded to integers: every task
  decides alike whether two vectors meet.
* Live cells. Only (table, cell, node) is written at first; vectors are sent to cells that
  hold a resident and another node.
* Parts. A cell above ``PART`` nodes is dealt in parts, and every two parts meet in one
  task of bounded size: a hot cell stays exact and no task grows with it.
* Counting. A pair counts where it meets first: in its first table, there at the home of the
  smaller node if both visit each other. So link counts are sums, no list of pairs is
  shuffled or stored; a task returns a count and one edge of a spanning forest for each node.

Defined results: vectors that are null, without components, zero or that hold null or non-finite components,
and those without a label, link with nothing; vectors of different length never link;
ids may be null or repeated, every row is a vector of its own; the component of a row is the
smallest id that is not null in it (null if all are); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, renamed
from .components import connected_components
from .simhash import _roots

COSINE = 0.98
TABLES, BLOCKS, SCALE, REACH = 5, 2, 0.7, 1.0
#: Nodes of a cell that one task compares with each other.
PART = 2048
#: Fixed point: steps of a unit vector's component, of a matrix entry, and of half a lattice coordinate.
UNIT, ENTRY, STEP = 1 << 20, 1 << 10, 1 << 12
#: Pairs held in memory at once.
PAIRS = 1 << 15
#: Classes with more than this share of the rows are joined by broadcast; there are fewer of them than its inverse.
HOT = 1 / 1000


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two coordinates of 2, or all of 1 with an even number of minus signs."""
    pairs = [np.bincount(at, weights=signs, minlength=8) for at in combinations(range(8), 2) for signs in product((-2, 2), repeat=2)]
    odd = [signs for signs in product((-1, 1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array([*pairs, *odd], float)


def decode(z: np.ndarray) -> np.ndarray:
    """The nearest E8 points (doubled integers) of integer rows; 2 * STEP is one unit."""
    best = None
    for half in (0, 1):
        x = z - half * STEP
        near = np.floor(x / (2 * STEP) + 0.5)
        rest = x - 2 * STEP * near
        odd = np.flatnonzero(near.sum(1) % 2)
        worst = np.abs(rest[odd]).argmax(1)
        away = np.where(rest[odd, worst] >= 0, 1, -1)
        near[odd, worst] += away
        rest[odd, worst] -= 2 * STEP * away
        cost, point = (rest**2).sum(1), 2 * near + half
        if best is None:
            best = cost, point
        else:
            best = np.minimum(best[0], cost), np.where((cost < best[0])[:, None], point, best[1])
    return best[1]


class Lattice:
    """The tables for vectors of ``n`` components. All numbers are integers, held as floats that are exact."""

    def __init__(self, n: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, reach: float = REACH, seed: int = 12):
        self.tables, self.blocks, self.reach2 = tables, blocks, np.floor((2 * STEP * max(reach, 1.0)) ** 2)
        entries = np.random.RandomState(seed).standard_normal((tables * blocks * 8, n))
        self.matrix = np.rint(entries * scale * ENTRY)
        self.mix = np.random.RandomState(seed + 1).randint(0, 2**63, (blocks, 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates, home points) of some unit vectors: rows by table, block and coordinate."""
        z = np.floor(np.rint(units * UNIT) @ self.matrix.T / (UNIT * ENTRY // (2 * STEP)))
        home = decode(z.reshape(-1, 8))
        shape = (len(units), self.tables, self.blocks, 8)
        return z.reshape(shape), home.reshape(shape)

    def visits(self, z: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether each place visits each home, by row: all blocks within reach."""
        return (((z - STEP * home) ** 2).sum(-1) <= self.reach2).all(-1)

    def cells(self, z: np.ndarray, home: np.ndarray, table: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key of the cell, resident) of all cells that some vectors are in or visit in a table."""
        n = len(z)
        key = (label.astype(np.int64).view(np.uint64) ^ np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15)
        row, resident = np.arange(n), np.ones(n, bool)
        for b in range(self.blocks):
            point = home[:, table, b]
            rest = z[:, table, b] - STEP * point
            gone = (rest**2).sum(1)[:, None] - 2 * STEP * (rest @ shortest().T) + 8 * STEP**2
            own, which = np.nonzero(np.concatenate([np.ones((n, 1), bool), gone <= self.reach2], axis=1))
            step = np.concatenate([np.zeros((1, 8)), shortest()])[which]
            part = ((point[own] + step).astype(np.int64).view(np.uint64) * self.mix[b]).sum(1, dtype=np.uint64)
            # Every cell so far goes on to each point of this block.
            first, count = np.searchsorted(own, np.arange(n)), np.bincount(own, minlength=n)
            at = np.repeat(np.arange(len(row)), count[row])
            to = first[row[at]] + np.arange(len(at)) - np.repeat(np.cumsum(count[row]) - count[row], count[row])
            key = (key[at] ^ part[to]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
            row, resident = row[at], resident[at] & (which[to] == 0)
        return row, key.view(np.int64), resident


@lru_cache(maxsize=16)
def lattice(n: int) -> Lattice:
    return Lattice(n)


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of list arrays, one for each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    return [(rows := np.flatnonzero(sizes == n), flat[first[rows][:, None] + np.arange(n)]) for n in np.unique(sizes).tolist()]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat = np.empty(len(column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())))
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        for rows, x in _vectors(column):
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            flat[offsets[rows][:, None] + np.arange(x.shape[1])] = x
        units = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns, units], [*batch.schema.names, "unit"])


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, label = (batch.column(k).to_numpy() for k in range(2))
        for rows, units in _vectors(batch.column(2)):
            grid = lattice(units.shape[1])
            z, home = grid.places(units)
            for t in range(grid.tables):
                row, key, resident = grid.cells(z, home, t, label[rows])
                yield pa.RecordBatch.from_arrays([pa.array(node[rows[row]]), pa.array(np.full(len(row), t, np.int8)), pa.array(key), pa.array(resident)], ["node", "t", "cell", "resident"])


def _compared(rows: list[pa.RecordBatch], cosine: float) -> pa.RecordBatch:
    """(node, links, root): each node's links to others, counted where the pair counts, and a spanning forest of them."""
    table = pa.Table.from_batches(rows).combine_chunks()
    part = {name: table.column(name).to_numpy() for name in ("meeting", "t", "resident", "side", "node", "m")}
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    nodes, dense = np.unique(part["node"], return_inverse=True)
    links, left_edges, right_edges = np.zeros(len(nodes), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for own, units in _vectors(table.column("unit").combine_chunks()):
        grid = lattice(units.shape[1])
        # Residents first: the left of a pair is one, the right any later row of the meeting.
        order = np.lexsort((~part["resident"][own], part["meeting"][own]))
        own, units = own[order], units[order]
        meeting, t, resident, side, node, m = (part[k][own] for k in ("meeting", "t", "resident", "side", "node", "m"))
        kind, place = label[own], dense[own]
        z, home = grid.places(units)
        end = np.searchsorted(meeting, meeting, side="right")
        count = np.where(resident, end - np.arange(len(own)) - 1, 0)
        starts = np.concatenate([[0], np.cumsum(count)])
        for at in range(0, int(starts[-1]), PAIRS):
            number = np.arange(at, min(at + PAIRS, int(starts[-1])))
            a = np.searchsorted(starts, number, side="right") - 1
            b = a + 1 + number - starts[a]
            meet = (kind[a] == kind[b]) & ((side[a] != side[b]) | (side[a] == 2)) & (node[a] != node[b])
            a, b = a[meet], b[meet]
            near = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
            a, b = a[near], b[near]
            if not len(a):
                continue
            ours, table_ = t[a], np.arange(grid.tables)
            from_a, from_b = grid.visits(z[a], home[b]), grid.visits(z[b], home[a])
            earlier = ((from_a | from_b) & (table_ < ours[:, None])).any(1)
            here_a, here_b = (x[np.arange(len(a)), ours] for x in (from_a, from_b))
            counts = ~earlier & here_b & (resident[b] | ~here_a | (node[a] < node[b]))
            a, b = a[counts], b[counts]
            np.add.at(links, place[a], m[b])
            np.add.at(links, place[b], m[a])
            root = _roots(len(nodes), np.concatenate([left_edges, place[a]]), np.concatenate([right_edges, place[b]]))
            left_edges = np.flatnonzero(root != np.arange(len(nodes)))
            right_edges = root[left_edges]
    found = np.flatnonzero(links)
    root = np.arange(len(nodes))
    root[left_edges] = right_edges
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[found], links[found], nodes[root[found]])], ["node", "links", "root"])


def _verified(cosine: float, most: int):
    """Rows come sorted by meeting; whole meetings are compared, several together up to ``most`` rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            meeting = batch.column(0).to_numpy()
            cut = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on in the next batch
            begun = held and held[-1].column(0)[-1].as_py() == meeting[-1]
            if held and sum(x.num_rows for x in held) + cut > most and not begun:
                yield _compared([*held, *([batch.slice(0, cut)] if cut else [])], cosine)
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield _compared(held, cosine)

    return of_task


def link_counts(nodes: DataFrame, cosine: float = COSINE, part: int = PART) -> DataFrame:
    """(node, links, root) of written ``nodes`` (node, label, m, unit): partial sums of the links of each node, weighted by
    the multiplicity ``m`` of the other end, and edges that connect all linked nodes."""
    labelled = nodes.select("node", F.xxhash64("label").alias("h"), "unit")
    cells = materialize(labelled.mapInArrow(_celled, "node long, t byte, cell long, resident boolean"), "cells")
    live = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("resident").alias("used")).where("n > 1 AND used").select("cell", "n")
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    placed = cells.join(live, "cell").select("node", "t", "cell", "resident", parts.alias("parts"), own.alias("own"))
    # Each part meets itself (side 2) and every other part.
    meetings = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("low"), F.greatest(o, F.col("own")).alias("high")))
    side = F.when(F.col("k.low") == F.col("k.high"), 2).when(F.col("own") == F.col("k.low"), 0).otherwise(1).cast("byte")
    met = placed.withColumn("k", F.explode(meetings)).select(F.xxhash64("cell", "k.low", "k.high").alias("meeting"), "t", "resident", side.alias("side"), "node")
    full = met.join(nodes.select("node", "m", F.col("label").cast("string").alias("label"), "unit"), "node").select("meeting", "t", "resident", "side", "node", "m", "label", "unit")
    spread = full.repartition(F.col("meeting")).sortWithinPartitions("meeting")
    return spread.mapInArrow(_verified(cosine, 4 * part), "node long, links long, root long")


def link(vectors: DataFrame, cosine: float = COSINE, part: int = PART, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links (other rows linked directly), component_id and kept (the row has the component's id)."""
    rows = renamed(vectors, vec_id=id_col, x=vector_col, label=label_col).withColumn("x", F.col("x").cast("array<double>"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    own = rows.where("sound").groupBy("label", "x").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    numbered = own.select(F.monotonically_increasing_id().alias("node"), "label", "m", "least", "x")
    schema = ", ".join(f"{c} {k}" for c, k in [*numbered.dtypes, ("unit", "array<double>")])
    nodes = materialize(numbered.mapInArrow(_unit, schema), "vectors")

    counted = materialize(link_counts(nodes, cosine, part), "links")
    sums = counted.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "label", "x", "m", "least").join(sums, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "component").select("label", "x", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    known = materialize(known, "known")

    # A class may hold a third of the rows: such few classes are broadcast, the other rows are joined by a shuffle.
    total = nodes.agg(F.sum("m")).first()[0] or 0
    hot = known.where(F.col("m") > HOT * total)
    named = rows.where("sound").join(F.broadcast(hot.drop("m")), ["label", "x"], "left")
    found = named.where("n_links IS NOT NULL").select("vec_id", "n_links", "component_id")
    rest = named.where("n_links IS NULL").select("vec_id", "label", "x").join(known.drop("m"), ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(rest).union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-duplicates with pivot distance tables.

Each text becomes a 64-bit SimHash of its word shingles. Equal fingerprints are one
node, so exact copies never meet pairwise. Between distinct fingerprints:

* Routing. A fingerprint is cut into ``BLOCKS`` blocks; two fingerprints that differ in
  at most 3 bits agree in at least ``BLOCKS`` - 3 of them, so each fingerprint goes to
  one bucket for each choice of that many blocks, and no link is lost.
* Pivot tables. Hamming distances to ``PIVOTS`` fixed reference fingerprints are computed
  for every fingerprint of a bucket. By the triangle inequality linked fingerprints
  differ by at most 3 in every coordinate: the bucket is ordered by the first coordinate,
  only pairs within 3 there are formed, pairs with a larger difference in another
  coordinate are discarded, and the survivors are verified on all 64 bits.
* Hot buckets. A bucket above ``PART`` fingerprints is cut into finer ones: its open bits make RADIUS + 1
  pieces, and linked fingerprints agree in one, so each fingerprint goes to RADIUS + 1 finer buckets, however hot
  the bucket is. A finer bucket above ``PART`` is dealt in parts; every pair of parts meets in one task
  of bounded size, so it is spread over tasks and stays exact.

A task returns a spanning forest of the links it found, at most one edge per fingerprint,
not the pairs. Components are joined across buckets by large-star and small-star rounds.

Defined results: null and empty texts have the fingerprint zero and are linked like any
other; repeated rows share a fingerprint and a component; an empty table gives an empty
one; texts are read whole; other columns are ignored. Rows with a null id link like others, and their component's id
is the smallest that is not null (null where it has none). ``drop_copies`` goes by the numbers of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, bitmap, marked, materialize, renamed
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
BLOCKS, PIVOTS, PART = 5, 16, 4096
#: Holds the numbers of rows.
ROW = "__row_number"
#: Candidate pairs that are held in memory at once.
CHUNK = 1 << 20

#: Reference fingerprints: spread out by a multiplicative rule, known to every task without a broadcast.
REFERENCES = np.array([(i * 0x9E3779B97F4A7C15 + 0x7F4A7C159E3779B9) % 2**64 for i in range(1, PIVOTS + 1)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of the lower-cased words, repeats included; a text with fewer words
    is one shingle, one without words gives 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, per row of ``docs``."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_fingerprinted, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def buckets_of(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """Array of the bucket keys of a fingerprint: one for each choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[j] for j in chosen)
        keys.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)).alias("bits")))
    return F.array(*keys)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, by the edges (left, right)."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def links(fps: np.ndarray, group: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for the fingerprints with a link of at most ``radius`` bits inside their group.

    ``side``: 0 or 1 where a group is two parts of a hot bucket that meet; pairs inside a part
    are then found where that part meets itself (side 2 marks those).
    """
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    _, dense = np.unique(group, return_inverse=True)
    place = dense.astype(np.int64) * 256 + table[:, 0]
    order = np.argsort(place, kind="stable")
    fps, place, table = fps[order], place[order], table[order]
    side = None if side is None else side[order]
    ends = np.searchsorted(place, place + radius, side="right")
    counts = ends - np.arange(len(fps)) - 1
    found_left, found_right = [], []
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(fps):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, side="right")) - 1)
        n = counts[at:upto]
        left = np.repeat(np.arange(at, upto), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(starts[at:upto] - starts[at], n)
        if side is not None:
            meet = (side[left] != side[right]) | (side[left] == 2)
            left, right = left[meet], right[meet]
        for k in range(1, table.shape[1]):
            if not len(left):
                break
            near = np.abs(table[left, k] - table[right, k]) <= radius
            if k > 3 and near.mean() > 0.9:  # a dense bucket: verifying costs less than more coordinates
                break
            left, right = left[near], right[near]
        linked = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        if linked.any():
            left, right = left[linked], right[linked]
            root = _roots(len(fps), np.concatenate([*found_left, left]), np.concatenate([*found_right, right]))
            moved = np.flatnonzero(root != np.arange(len(fps)))
            found_left, found_right = [moved], [root[moved]]  # a forest, however many pairs were linked
        at = upto
    if not found_left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return fps[found_left[0]], fps[found_right[0]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by meeting; whole meetings are taken together, in blocks of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(rows):
        fps, group, side = (np.concatenate(x) for x in zip(*rows))
        a, b = links(fps.view(np.uint64), group, side)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        fp, group, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = int(np.searchsorted(group, group[-1]))  # the last meeting may go on in the next batch
        if cut:
            yield flush([*held, (fp[:cut], group[:cut], side[:cut])])
            held = []
        elif held and held[-1][1][-1] != group[0]:
            yield flush(held)
            held = []
        held.append((fp[cut:], group[cut:], side[cut:]))
    if held:
        yield flush(held)


def finer_buckets(choice: Column, fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """Array of finer keys of a fingerprint in a bucket of ``buckets_of``: the bits that the bucket leaves open are cut
    into radius + 1 pieces, of which linked fingerprints have one in common."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        left = [b for j in range(blocks) if j not in chosen for b in range(cuts[j], cuts[j + 1])]
        pieces = [sum(1 << b for b in left[k :: radius + 1]) for k in range(radius + 1)]
        masks.append(F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in pieces]))
    own = F.get(F.array(*masks), choice)
    return F.transform(own, lambda mask, k: F.struct(k.alias("piece"), fp.bitwiseAND(mask).alias("bits")))


def meetings(prints: DataFrame, part: int = PART) -> DataFrame:
    """(fp, meeting, side) for distinct fingerprints ``prints`` (fp): linked ones meet at least once, in groups of ``part``
    or pairs of such groups. A bucket above ``part`` goes by its finer buckets; only those above ``part`` are dealt in parts."""
    keyed = prints.select("fp", F.explode(buckets_of(F.col("fp"))).alias("k")).select("fp", F.col("k.choice").alias("choice"), F.xxhash64("k.choice", "k.bits").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cold = keyed.join(sizes.where(F.col("n") <= part), "bucket").select("fp", F.col("bucket").alias("meeting"), F.lit(2).cast("byte").alias("side"))
    hot = keyed.join(sizes.where(F.col("n") > part).select("bucket"), "bucket")
    finer = hot.select("fp", "bucket", F.explode(finer_buckets(F.col("choice"), F.col("fp"))).alias("f")).select("fp", F.xxhash64("bucket", "f.piece", "f.bits").alias("bucket"))
    sized = finer.join(finer.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    # Parts of a finer bucket, and the meetings of a part: with itself (side 2) and with each other part.
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = sized.select("fp", "bucket", parts.alias("parts")).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("low"), F.greatest(o, F.col("own")).alias("high")))
    side = F.when(F.col("m.low") == F.col("m.high"), 2).when(F.col("own") == F.col("m.low"), 0).otherwise(1)
    met = dealt.select("fp", "bucket", "own", F.explode(pairs).alias("m"))
    return cold.union(met.select("fp", F.xxhash64("bucket", "m.low", "m.high").alias("meeting"), side.cast("byte").alias("side")))


def link_forest(prints: DataFrame, part: int = PART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``prints`` (fp) that connect all fingerprints
    linked by at most RADIUS differing bits."""
    return meetings(prints, part).repartition(F.col("meeting")).sortWithinPartitions("meeting").mapInArrow(_linked, "a long, b long")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest doc_id reachable by links."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link_forest(nodes.select("fp")))
    # Components are of fingerprints; their smallest document follows from each fingerprint's own.
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits of a signed fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the number of each row, written so that it stays, and the column of the numbers: ``ROW``, or
    a longer name where ``docs`` has such a column itself."""
    name, taken = ROW, {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def one_of_each(rows: DataFrame, placed: DataFrame, id_col: str, row_col: str = ROW) -> DataFrame:
    """Of each component of ``placed`` (row, component) the row of ``rows`` with the smallest id;
    null ids come last, and equal ids go by the number of the row."""
    ids = renamed(rows, row=row_col, id=id_col).join(placed, "row")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias(row_col))
    gone = materialize(placed.select(F.col("row").alias(row_col)).join(kept, row_col, "left_anti"), "gone")
    table, n = bitmap(gone.select(F.xxhash64(row_col).alias("key")), "key")
    if not n:
        return rows.drop(row_col)
    # Rows without a bit stay where they are; only those that may have to go are shuffled, and looked up exactly.
    may_go = marked(rows.sparkSession, table)(F.xxhash64(row_col))
    return rows.where(~may_go).union(rows.where(may_go).join(gone, row_col, "left_anti").select(*rows.columns)).drop(row_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id. Ids may be null or repeated."""
    rows, number = numbered(docs)
    placed = clusters(rows, number, text_col).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    return one_of_each(rows, placed, id_col, number)

"""Periodic runs of words by branching tandem repeats in a suffix tree.

A run is a stretch of words with smallest period q (words q apart are identical) that is
at least max(``MIN_LENGTH``, 2q) words long and that no neighbouring word extends. For
every text, after Stoye and Gusfield:

* Tree. The suffixes of the texts of an Arrow batch are sorted together by prefix doubling; only
  suffixes that still share a prefix are sorted again. The ranks of every doubling stay,
  so the common extension of two places, forward or backward, takes a look at each of them.
  The inner nodes of the suffix tree are the intervals of that order. A run of
  ``MIN_LENGTH`` words has a branching repeat of ``LEAST`` words or more (a multiple of its
  period, if the period is shorter), so nodes above that depth are not needed.
* Leaf lists. At each node of depth d all leaf lists but the longest are walked: leaf i
  starts a tandem repeat if i + d is a leaf of the node too, ends one if i - d is, and the repeat is
  branching if the words after its two halves differ. Every leaf is walked
  at most log2(n) times.
* Runs. A branching repeat is the last rotation of its run; rotating it to the left as far
  as the words allow (one backward extension) gives the run. Runs found from
  several multiples of a period are merged under the smallest.

A run has the same ``REPEATED`` words at two places, so texts without such a repetition need no
tree; they are told by hashes, and a chance agreement of hashes only builds a tree in vain.

A text is worked on in one piece: memory is that of its Arrow batch (4 MiB of texts, or one longer
text), some 150 bytes a word of texts that repeat themselves.

Defined results: null and empty texts have no words and no runs; ids may be null or repeated, every row
gets its own result; an empty table gives an empty one; other columns are ignored
(``collapse`` carries them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, renamed

#: Shortest run, in words.
MIN_LENGTH = 12
#: Half of it: in a run, so many words at least occur again one period later.
REPEATED = MIN_LENGTH // 2
#: Depth from which nodes are kept. Periods below it have a multiple d with LEAST <= d <= REPEATED, so 2d words fit into any run.
LEAST = MIN_LENGTH // 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeating(codes: np.ndarray, bounds: np.ndarray, width: int = REPEATED) -> np.ndarray:
    """Which texts (codes[bounds[k] : bounds[k + 1]]) may have the same ``width`` words twice."""
    n = np.diff(bounds)
    found = np.zeros(len(n), bool)
    if len(codes) < width:
        return found
    text = np.repeat(np.arange(len(n)), n)
    mixed, total = _mixed(codes), _mixed(text)[: len(codes) - width + 1]
    for k in range(width):
        total = total * np.uint64(0x100000001B3) + mixed[k : len(mixed) - width + 1 + k]
    inside = text[: len(total)] == text[width - 1 :]
    place = np.flatnonzero(inside)
    order = np.argsort(total[place], kind="stable")
    ordered = total[place][order]
    found[text[place[order[1:]][ordered[1:] == ordered[:-1]]]] = True
    return found


class Suffixes:
    """The sorted suffixes of some texts, with the ranks of all prefix lengths 1, 2, 4 …"""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        sizes = np.diff(bounds)
        self.codes = codes
        self.first = np.repeat(bounds[:-1], sizes)  # of the text of each place
        self.end = np.repeat(bounds[1:], sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max()) + 1) + codes
        self.levels: list[np.ndarray] = []
        ranks = np.zeros(n, np.int64)
        open_ = np.arange(n)  # places whose rank is shared
        step = 0
        while True:
            order = np.argsort(key, kind="stable")
            place, ordered = open_[order], key[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            head = np.concatenate([[True], ranks[place][1:] != ranks[place][:-1]])  # starts of the old groups
            at = np.arange(len(place))
            offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            ranks = ranks.copy()
            ranks[place] += offset
            self.levels.append(np.append(ranks, -1))  # a place after the last text
            alone = new & np.append(new[1:], True)
            open_ = place[~alone]
            if not len(open_):
                break
            step = step * 2 or 1
            after = open_ + step
            inside = after < self.end[open_]
            follows = np.where(inside, ranks[np.minimum(after, n - 1)] + 1, 0)
            key = ranks[open_] * (n + 1) + follows
        self.rank = ranks
        self.order = np.empty(n, np.int64)
        self.order[ranks] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i and from j on that agree; i and j differ."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same += (level[i + same] == level[j + same]).astype(np.int64) << k
        return same

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and before j (of one text, i < j) that agree."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, a = self.levels[k], i - same - (1 << k)
            inside = a >= self.first[i]
            a = np.where(inside, a, i)
            same += (inside & (level[a] == level[np.where(inside, a + (j - i), j)])).astype(np.int64) << k
        return same


def nodes(suffixes: Suffixes, least: int = LEAST) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
    """(low, high, depth) of the inner nodes with depth ``least`` or more, as intervals of the order, and
    (start, stop, node) of the leaf lists of their children, without the longest of each node."""
    order, level = suffixes.order, suffixes.levels[min(least.bit_length(), len(suffixes.levels)) - 1]  # of a prefix that is no longer than ``least``
    beside = np.flatnonzero(level[order[1:]] == level[order[:-1]]) + 1
    shared = suffixes.forward(order[beside - 1], order[beside])
    low, high, depth, start, stop, node = [], [], [], [], [], []
    stack: list[tuple[int, list[int]]] = []  # (depth, first places of the children) of the open nodes

    def close(down_to: int, upto: int) -> int:
        """Close the open nodes deeper than ``down_to``; returns the first place of the last one."""
        first = upto - 1
        while stack and stack[-1][0] > down_to:
            d, cuts = stack.pop()
            first = cuts[0]
            if len(cuts) == 2:
                a, b, c = first, cuts[1], upto
                start_, stop_ = (a, b) if b - a <= c - b else (b, c)
                start.append(start_), stop.append(stop_), node.append(len(low))
            else:
                edges = [*cuts, upto]
                sizes = [y - x for x, y in zip(edges, edges[1:])]
                longest = sizes.index(max(sizes))
                for k in range(len(sizes)):
                    if k != longest:
                        start.append(edges[k]), stop.append(edges[k + 1]), node.append(len(low))
            low.append(first), high.append(upto - 1), depth.append(d)
        return first

    before = -1
    for k, d in zip(beside.tolist(), shared.tolist()):
        if d < least:
            continue
        if k != before + 1:
            close(0, before + 1)
        before = k
        first = close(d, k)
        if stack and stack[-1][0] == d:
            stack[-1][1].append(k)
        else:
            stack.append((d, [first, k]))
    close(0, before + 1)
    return low, high, depth, start, stop, node


def branching_repeats(suffixes: Suffixes, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place, half): tandem repeats of half ``least`` words or more whose next word is not the one after their first half."""
    low, high, depth, start, stop, node = (np.array(x, np.int64) for x in nodes(suffixes, least))
    n = stop - start
    own = np.repeat(node, n)
    leaf = suffixes.order[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else np.empty(0, np.int64)
    half = depth[own]
    found = []
    for place in (leaf, leaf - half):
        other = place + half
        held = leaf - half if place is not leaf else other  # the half that must be a leaf of the node
        ok = (place >= suffixes.first[leaf]) & (other < suffixes.end[leaf])
        rank = suffixes.rank[np.where(ok, held, 0)]
        ok &= (rank >= low[own]) & (rank <= high[own])
        after = np.where(ok, other + half, 0)
        ends = after >= suffixes.end[leaf]
        ok &= ends | (suffixes.codes[np.where(ok & ~ends, after, 0)] != suffixes.codes[np.where(ok, other, 0)])
        found.append(np.stack([place[ok], half[ok]]))
    place, half = np.concatenate(found, axis=1)
    return place, half


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of some texts, in that order of columns; ``codes`` are the
    numbers of their words, text k has codes[bounds[k] : bounds[k + 1]]."""
    wanted = np.flatnonzero(repeating(codes, bounds))
    if not len(wanted):
        return np.empty((0, 4), np.int64)
    sizes = np.diff(bounds)[wanted]
    inner = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(bounds[wanted] - inner[:-1], sizes) + np.arange(inner[-1])
    suffixes = Suffixes(codes[place], inner)
    first, half = branching_repeats(suffixes)
    start = first - suffixes.backward(first, first + half)
    # One run from several multiples of its period: the smallest counts; below LEAST periods are tried.
    order = np.lexsort((half, first + 2 * half, start))
    start, end, half = start[order], (first + 2 * half)[order], half[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.empty(0, bool)
    start, end, period = start[new], end[new], half[new]
    for q in range(LEAST - 1, 0, -1):
        fits = (period % q == 0) & (end - start > q)
        j = np.where(fits, start + q, start)
        fits[fits] = suffixes.forward(start[fits], j[fits]) >= (end - start - q)[fits]
        period = np.where(fits, q, period)
    long = end - start >= np.maximum(MIN_LENGTH, 2 * period)
    start, end, period = start[long], end[long], period[long]
    text = np.searchsorted(inner, start, side="right") - 1
    rows = np.stack([wanted[text], start - inner[text], end - start, period], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all texts, bounds of the texts)."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    codes = np.fromiter((number(w, len(known)) for words in texts for w in words), np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)]).astype(np.int64)


def without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run (start, length, period) contains after its first ``period`` words."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def _of_batch(column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, rows of runs) of each text of a batch."""
    texts = [x.split() for x in as_bytes(column)]
    codes, bounds = coded(texts)
    rows = find_runs(codes, bounds)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for k, words in enumerate(texts):
        yield words, rows[cuts[k] : cuts[k + 1], 1:]


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for words, runs in _of_batch(batch.column(1)):
            best = min(((-n, s, q) for s, n, q in runs.tolist()), default=None)
            start, length, period = (best[1], -best[0], best[2]) if best else (None, None, None)
            out.append(
                (
                    len(runs), start, length, period, 1000 * length // period if best else None,
                    hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest(),
                )
            )
        columns = list(zip(*out)) or [()] * len(REPORT)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(columns, REPORT))], ["doc_id", *(name for name, _ in REPORT)])


REPORT = [(name, "long") for name in ("n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", "string"), ("collapsed_sha256", "string")]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: number of runs, the longest run (ties: smallest start, then period; nulls without runs), and the
    digests of all runs and of the collapsed text."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_reported, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *(f"{name} {kind}" for name, kind in REPORT)]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(k, runs) for k, (_, runs) in enumerate(_of_batch(batch.column(1))) if len(runs)]
        which = pa.array(np.repeat([k for k, _ in found], [len(r) for _, r in found]).astype(np.int64))
        rows = np.concatenate([r for _, r in found]) if found else np.empty((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), *(pa.array(rows[:, c]) for c in range(3))], ["doc_id", "start", "length", "period"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period): every run of every row of ``docs``."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_listed, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, period long")


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` in which texts with runs keep the first period of each; their words are then joined by one space.
    Texts without runs, null ones included, stay as they are."""
    at = docs.columns.index(text_col)

    def collapsed(batches):
        for batch in batches:
            old = batch.column(at)
            new = [b" ".join(without_repeats(words, found)).decode() if len(found) else old[k].as_py() for k, (words, found) in enumerate(_of_batch(old))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(collapsed, docs.schema)

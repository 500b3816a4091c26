"""Language-model scoring with Brown class-based bigrams.

    P(w_i | w_(i-1)) = P(class(w_i) | class(w_(i-1))) * P(w_i | class(w_i))

* Counts. Every word of every training text is counted; the vocabulary is a table, as
  large as the corpus makes it. A text is its lower-cased words and one end token.
* Words in classes by exchange. The ``classed`` most frequent words with at least ``MIN_COUNT`` occurrences get a class
  each by exchange clustering over the bigrams of all training tokens (other words are one item there). Bigram counts
  are summed by Spark and stand, for each word, beside its neighbours. A sweep is a pass over that table: the class
  table (classes x classes) goes to the tasks, each task finds for its words the class that raises the likelihood of
  the class bigrams most. The moves that gain most for each occurrence are made at once, up to a share of all tokens;
  a sweep that lowers the likelihood is undone, and the share becomes smaller. The end token keeps a class of its own.
* Other words belong to items by a hash of the whole word; there are at least eight times as many items as such words, up to
  2^``tail_bits``, so up to that size few words share one. An item takes the class under which its seen contexts, in
  all training texts, are likeliest; how the classes are spread over all words with its ending is the prior,
  which alone decides for words that were never seen. So each word has a class without a lookup in the vocabulary.
* Smoothing. Transitions back off to class frequencies; emissions are absolutely
  discounted, and what a class's words give up is the probability of its unseen words.
* Scoring. The classed words with their counts and a byte for each item are broadcast (at most 5 MB and
  2^``tail_bits`` bytes); the other words of a text are joined with the vocabulary by a shuffle, so
  the hottest words never reach it.

Words of more than ``KEY_BYTES`` bytes go by their digest, so no word is left out and tables stay small.

Defined results: null and empty texts are the end token alone; null ids count as
training rows; repeated rows are scored one by one; without training tokens all scores
are 0; an empty table gives an empty one; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, materialize, numbers, planes, renamed

FOLDS, HELD_OUT = 7, 2
CLASSED, MIN_COUNT, TAIL_BITS, CLASSES, SWEEPS = 65536, 5, 24, 64, 8
#: Buckets of endings (the last two bytes), and how much the prior of an ending weighs.
ENDINGS, PRIOR = 1024, 3.0
#: Share of the tokens whose words may change their class in the first sweep.
SHARE = 0.4
KEY_BYTES = 64
BACK_OFF = 50.0
#: The end token among the words: no word is empty.
END = b""
#: Distinct words or pairs that a task counts before it hands the counts on, and words kept in an item cache.
FLUSH, PAIRS, CACHE = 200_000, 2_000_000, 50_000
#: Texts at a time; parts that pairs of words are dealt to; items whose classes are one row.
BLOCK, PARTS, PAGE = 500, 1024, 1 << 13
#: Classes whose exact gain is computed for a word, after a look at all of them; None: all classes.
SHORTLIST = 6
#: A class is held in a byte, and one more stands for all words that are not classed.
MOST_CLASSES = 255


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, long ones as a digest that no word can equal, and the end token."""
    own = text.translate(LOWER).split()
    if own and max(map(len, own)) > KEY_BYTES:
        own = [w if len(w) <= KEY_BYTES else _digest(w) for w in own]
    own.append(END)
    return own


def _digest(word: bytes) -> bytes:
    return b" " + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one text after the other, as ``tokens`` gives them but without the end tokens, and where the words of each text
    begin and the last ones end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, bounds = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    if len(size) and not size.all():  # nothing before the first or after the last white space of a text
        words, bounds, size = words.filter(pa.array(size > 0)), np.concatenate([[0], np.cumsum(size > 0)])[bounds], size[size > 0]
    if len(size) and size.max() > KEY_BYTES:
        long = pa.array(size > KEY_BYTES)
        words = pc.replace_with_mask(words, long, pa.array([_digest(w) for w in words.filter(long).to_pylist()], pa.binary()))
    return words, bounds


def with_ends(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The items of the words of some texts with the end token's after each text."""
    return np.insert(ids, bounds[1:], end)


def ending(word: bytes) -> int:
    return (word[-1] * 251 + (word[-2] if len(word) > 1 else 0)) % ENDINGS


def endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each word."""
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, letters = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(letters, np.uint8)
    before = np.where(np.diff(at) > 1, letters[at[1:] - 2], 0).astype(np.int64)
    return (letters[at[1:] - 1].astype(np.int64) * 251 + before) % ENDINGS


class Items(dict):
    """word -> item: classed words by their place, the others by their hash, and where ``of`` tells that an item
    has no seen words, by their ending. The cache is bounded."""

    def __init__(self, classed: list[bytes], tail_bits: int, of: np.ndarray | None = None):
        super().__init__({w: i for i, w in enumerate(classed)})
        self.first, self.size, self.of = len(classed), 1 << tail_bits, of
        self.classed = pa.array(classed, pa.binary())

    def __missing__(self, word: bytes) -> int:
        item = self.first + (xxhash.xxh64_intdigest(word) & (self.size - 1))
        if self.of is not None and not self.of[item]:
            item = self.first + self.size + ending(word)
        if len(self) < self.first + CACHE:
            self[word] = item
        return item

    def all_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """The items of some words, the places of those that are not classed, and these words; each distinct one is hashed once."""
        ids = pc.index_in(words, value_set=self.classed).fill_null(-1).to_numpy().astype(np.int64)
        at = np.flatnonzero(ids < 0)
        coded = words.take(pa.array(at)).dictionary_encode()
        if self.size == 1 and self.of is None:
            ids[at] = self.first
        else:
            digests = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            items = self.first + (digests & np.uint64(self.size - 1)).astype(np.int64)
            if self.of is not None:
                items = np.where(self.of[items] == 0, self.first + self.size + endings(coded.dictionary), items)
            ids[at] = items[coded.indices.to_numpy()]
        return ids, at, coded


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    def handed_on(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from counts.set_column(0, "word", counts["word"].cast(pa.string())).to_batches()

    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            words, bounds = split(whole.slice(at, BLOCK).column(0))
            counts = words.value_counts()
            held.append(pa.table({"word": counts.field(0), "c": counts.field(1)}))
            held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([len(bounds) - 1], pa.int64())}))
            if sum(map(len, held)) > 2 * FLUSH:
                held = [summed()]
                if len(held[0]) > FLUSH:
                    yield from handed_on(held.pop())
    if held:
        yield from handed_on(summed())


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (text); the empty word is the end token."""
    return texts.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _item_blocks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[np.ndarray]:
    """The items of the tokens of some texts, each block behind an end token."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            words, bounds = split(whole.slice(at, BLOCK).column(0))
            yield np.concatenate([[items[END]], with_ends(items.all_of(words)[0], bounds, items[END])])


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Sums:
    """Sums of counts by key; what is pending is combined before it outgrows the distinct keys."""

    def __init__(self, limit: int = PAIRS):
        self.limit, self.size, self.pending = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit:
            keys, counts = self.all()
            self.pending, self.size, self.limit = [(keys, counts)], len(keys), max(self.limit, 2 * len(keys))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pending:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return combined(*(np.concatenate(x) for x in zip(*self.pending)))


_BLOBS = "part long, keys binary, counts binary"


def packed(x: np.ndarray) -> bytes:
    """Some 64-bit numbers, compressed: what a task holds of a batch stays small."""
    return len(x).to_bytes(8, "little") + pa.compress(planes(x.astype(np.int64)), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return numbers([pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True)], np.int64)


def _blobs(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ascending keys with their counts, as one row of blobs for each part."""
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    rows = [(int(part[a]), packed(np.diff(keys[a:b], prepend=0)), packed(counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["part", "keys", "counts"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Sums]]:
    """The sums of each part; rows come sorted by part."""
    now, sums = None, Sums()
    for batch in batches:
        for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if part != now:
                if now is not None:
                    yield now, sums
                now, sums = part, Sums()
            sums.add(np.cumsum(unpacked(keys.as_py())), unpacked(counts.as_py()))
    if now is not None:
        yield now, sums


def _dealt(rows: DataFrame, counted: Callable, schema: str) -> DataFrame:
    """Blobs brought together by part."""
    return rows.mapInArrow(counted, schema).repartition(F.col("part")).sortWithinPartitions("part")


def neighbours(texts: DataFrame, classed: list[bytes]) -> DataFrame:
    """(part, words, and for either side the number of neighbours of each word, the neighbours and their counts), as
    blobs: the bigrams of all texts between classed words, which all other words count in as one more word."""
    n = len(classed) + 1

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(classed, 0)  # one item for all other words
        sums, tokens_held = Sums(), 0
        for ids in _item_blocks(batches, items):
            sums.add(*np.unique(ids[:-1] * n + ids[1:], return_counts=True))
            tokens_held += len(ids)
            if tokens_held > 2 * PAIRS:
                keys, counts = sums.all()
                yield from _blobs(keys, counts, _spread(keys))
                sums, tokens_held = Sums(), 0
        keys, counts = sums.all()
        if len(keys):
            yield from _blobs(keys, counts, _spread(keys))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Summed pairs, to both of their words: the side is a bit below the other word. Parts have no pair in common."""

        def flush():
            keys, counts = (np.concatenate(x) for x in zip(*held))
            left, right = keys // n, keys % n
            both = np.concatenate([(left * n + right) * 2, (right * n + left) * 2 + 1])
            order = np.argsort(both, kind="stable")
            both = both[order]
            return _blobs(both, np.concatenate([counts, counts])[order], both // (2 * n) % PARTS)

        held, size = [], 0
        for _, sums in _by_part(batches):
            held.append(sums.all())
            size += len(held[-1][0])
            if size > PAIRS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sums in _by_part(batches):
            keys, counts = sums.all()
            word, other, side = keys // (2 * n), keys // 2 % n, keys & 1
            words = np.unique(word)
            row = [packed(words)]
            for s in (0, 1):
                own = side == s
                of = np.searchsorted(words, word[own])
                row += [packed(np.bincount(of, minlength=len(words))), packed(other[own]), packed(counts[own])]
            yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x], pa.binary()) for x in row)], ["part", *_SIDES])

    summed = _dealt(texts.select("text"), paired, _BLOBS)
    both = _dealt(summed, turned, _BLOBS)
    return materialize(both.mapInArrow(laid_out, "part long, " + ", ".join(f"{c} binary" for c in _SIDES)), "neighbours")


_SIDES = ("words", "n_right", "right", "c_right", "n_left", "left", "c_left")


def _spread(keys: np.ndarray) -> np.ndarray:
    """The part of each pair: pairs of a frequent word are dealt to all parts."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % PARTS


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(words, index of the word of each right pair, right neighbour, count, and the same to the left) of each part."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, *own = (unpacked(batch.column(k)[i].as_py()) for k in range(1, 8))
            out = [words]
            for k in (0, 3):
                out += [np.repeat(np.arange(len(words)), own[k]), own[k + 1], own[k + 2]]
            yield tuple(out)


def class_table(table: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """Bigram counts of the classes ``of`` the words."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for words, at, other, counts, *_ in _rows(batches):
            np.add.at(total, of[words][at].astype(np.int64) * k + of[other], counts)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "c"])

    return _cells(table.mapInArrow(summed, "cell long, c long"), k)


def _cells(counts: DataFrame, k: int) -> np.ndarray:
    rows = counts.groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(k * k)
    out[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood of class bigrams depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def gains(right: np.ndarray, left: np.ndarray, own: np.ndarray, now: np.ndarray, to: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the likelihood gains if word b moves from its class now[b] to the class to[b, c].

    ``right``, ``left``: counts of the classes that follow and precede each word; ``own``: of the word beside itself.
    """
    b, c = np.arange(len(now))[:, None], np.arange(to.shape[1])[None, :]
    g = now[:, None]
    sizes_right, sizes_left = table.sum(axis=1), table.sum(axis=0)
    n_right, n_left = right.sum(axis=1)[:, None], left.sum(axis=1)[:, None]
    r, s = right.copy(), left.copy()
    r[b[:, 0], now] -= own
    s[b[:, 0], now] -= own

    def change(old, new):
        return _xlogx(new) - _xlogx(old)

    # Rows and columns of both classes but for the four cells where they cross.
    total = change(table[g], table[g] - r[:, None, :]) + change(table.T[g], table.T[g] - s[:, None, :])
    total = np.broadcast_to(total, (len(now), to.shape[1], table.shape[0])) + change(table[to], table[to] + r[:, None, :]) + change(table.T[to], table.T[to] + s[:, None, :])
    total = total.copy()
    total[b, c, g] = 0
    total[b, c, to] = 0
    own = own[:, None]
    cells = change(table[g, g], table[g, g] - r[b, g] - s[b, g] - own)
    cells = cells + change(table[g, to], table[g, to] - r[b, to] + s[b, g]) + change(table[to, g], table[to, g] + r[b, g] - s[b, to])
    cells = cells + change(table[to, to], table[to, to] + r[b, to] + s[b, to] + own)
    sizes = change(sizes_right[g], sizes_right[g] - n_right) + change(sizes_right[to], sizes_right[to] + n_right)
    sizes = sizes + change(sizes_left[g], sizes_left[g] - n_left) + change(sizes_left[to], sizes_left[to] + n_left)
    return np.where(to == g, 0.0, total.sum(axis=2) + cells - sizes)


def best_moves(right: np.ndarray, left: np.ndarray, own: np.ndarray, now: np.ndarray, table: np.ndarray, classes: int, shortlist: int | None = SHORTLIST) -> tuple[np.ndarray, np.ndarray]:
    """The class each word gains most by, its own if by none, and that gain. Classes 1 to ``classes`` - 1 are open to words;
    the gains of the ``shortlist`` likeliest are compared, without it those of all."""
    log = np.log(table + 0.5)
    size = np.log(table.sum(axis=0) + table.sum(axis=1) + 1)
    # A first look: the likelihood of a word's contexts in each class.
    look = right @ log.T + left @ log - (right.sum(axis=1) + left.sum(axis=1))[:, None] * size[None, :]
    look = look[:, 1:classes]
    n = min(shortlist or look.shape[1], look.shape[1])
    to = 1 + np.argpartition(-look, n - 1, axis=1)[:, :n]
    gain = gains(right, left, own, now, to, table)
    best = np.argmax(gain, axis=1)
    row = np.arange(len(now))
    return np.where(gain[row, best] > 1e-9, to[row, best], now), gain[row, best]


def exchange(table: DataFrame, counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, shortlist: int | None = SHORTLIST) -> np.ndarray:
    """Class of each classed word, of which ``counts`` are the counts; class 0 is the end token's.
    ``table``: what ``neighbours`` gives."""
    if classes > MOST_CLASSES:
        raise ValueError(f"{classes} classes: at most {MOST_CLASSES} are possible")
    n, k = len(counts), classes + 1  # the last is the class of all other words
    of = np.zeros(n + 1, np.uint8)
    of[1:n] = 1 + np.arange(n - 1) % (classes - 1)
    of[n] = classes

    def moves(of: np.ndarray, bigrams: np.ndarray):
        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for words, right_at, right_id, right_c, left_at, left_id, left_c in _rows(batches):
                m = len(words)
                right = np.bincount(right_at * k + of[right_id], weights=right_c, minlength=m * k).reshape(m, k)
                left = np.bincount(left_at * k + of[left_id], weights=left_c, minlength=m * k).reshape(m, k)
                self_ = right_id == words[right_at]
                own = np.bincount(right_at[self_], weights=right_c[self_], minlength=m)
                mine = np.flatnonzero((words > 0) & (words < n))
                held.append((words[mine], right[mine], left[mine], own[mine]))
                size += len(mine)
                if size >= 512:
                    yield from found(held)
                    held, size = [], 0
            if size:
                yield from found(held)

        def found(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            words, right, left, own = (np.concatenate(x) for x in zip(*held))
            for at in range(0, len(words), 512):
                w = slice(at, at + 512)
                now = of[words[w]].astype(np.int64)
                to, gain = best_moves(right[w], left[w], own[w], now, bigrams, classes, shortlist)
                go = to != now
                yield pa.RecordBatch.from_arrays([pa.array(words[w][go], pa.int32()), pa.array(to[go], pa.int32()), pa.array(gain[go], pa.float64())], ["word", "class", "gain"])

        return moved

    bigrams = class_table(table, of, k)
    best, share, before = likelihood(bigrams), SHARE, None
    for _ in range(sweeps):
        # A row for each classed word at most.
        found = table.mapInArrow(moves(of, bigrams), "word int, class int, gain double").toArrow()
        word, to, gain = (found[c].to_numpy() for c in ("word", "class", "gain"))
        if not len(word):
            break
        order = np.lexsort((word, -gain / counts[word]))
        upto = max(1, int(np.searchsorted(np.cumsum(counts[word[order]]), share * counts.sum())))
        trial = of.copy()
        trial[word[order[:upto]]] = to[order[:upto]]
        tried = class_table(table, trial, k)
        now = likelihood(tried)
        if now <= best:
            share /= 3
            continue
        gained, share = now - best, min(1.0, 1.3 * share)
        of, bigrams, best = trial, tried, now
        before = before or gained
        if gained < 1e-3 * before:
            break
    return of[:n]


def tail_classes(texts: DataFrame, classed: list[bytes], of: np.ndarray, tail_bits: int, bigrams: np.ndarray) -> np.ndarray:
    """The class of each item of other words, 0 for items without seen words, and then of each ending: the one under
    which the contexts in ``texts`` (the classed words beside an item) are likeliest, given how the classes are spread
    over the words of its ending."""
    k, n = bigrams.shape[0], len(classed)
    log = np.log(bigrams + 0.5)
    size = np.log(bigrams.sum(axis=0) + 1)
    weights = np.vstack([log - size[None, :], log.T - size[None, :]])  # by context: a class before, or after
    codes = 2 * k + ENDINGS  # contexts, then endings

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(classed, tail_bits)
        sums, held = Sums(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                words, bounds = split(whole.slice(at, BLOCK).column(0))
                ids, _, others = items.all_of(words)
                ids = np.concatenate([[items[END]], with_ends(ids, bounds, items[END])])
                other = ids >= n
                cls = of[np.where(other, 0, ids)].astype(np.int64)
                mine = np.flatnonzero(other)
                ends = endings(others.dictionary)[others.indices.to_numpy()]
                after, before = np.flatnonzero(other[1:] & ~other[:-1]) + 1, np.flatnonzero(other[:-1] & ~other[1:])
                keys = np.concatenate([(ids[after] - n) * codes + cls[after - 1], (ids[before] - n) * codes + k + cls[before + 1], (ids[mine] - n) * codes + 2 * k + ends])
                sums.add(*np.unique(keys, return_counts=True))
                held += len(keys)
                if held > PAIRS:
                    keys, counts = sums.all()
                    yield from _blobs(keys, counts, keys // (codes * PAGE))
                    sums, held = Sums(), 0
        keys, counts = sums.all()
        if len(keys):
            yield from _blobs(keys, counts, keys // (codes * PAGE))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, sums in _by_part(batches):
            keys, counts = sums.all()
            yield from _blobs(keys, counts, np.full(len(keys), page))

    def scores(page: int, blob: bytes, times: bytes) -> tuple[np.ndarray, ...]:
        """The scores of the items of a page by class, and the (item, ending, count) of their words."""
        keys, counts = np.cumsum(unpacked(blob)), unpacked(times)
        item, code = keys // codes - page * PAGE, keys % codes
        near = code < 2 * k
        met = np.bincount(item[near] * 2 * k + code[near], weights=counts[near], minlength=PAGE * 2 * k)
        score = met.reshape(PAGE, 2 * k) @ weights
        score[:, 0] = -np.inf
        return score, item[~near], code[~near] - 2 * k, counts[~near]

    def added(total: np.ndarray, at: np.ndarray, rows: Callable) -> None:
        """Adds rows(i) to the rows at[i], some at a time."""
        for i in range(0, len(at), PAGE):
            part = slice(i, i + PAGE)
            np.add.at(total, at[part], rows(part))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ENDINGS, k))
        for batch in batches:
            for page, blob, times in zip(*(c.to_pylist() for c in batch.columns)):
                score, at, end, _ = scores(page, blob, times)
                chance = np.exp(score - score.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                added(total, end, lambda part: chance[at[part]])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "c"])

    pages = materialize(_dealt(texts.select("text"), met, _BLOBS).mapInArrow(merged, _BLOBS), "pages-of-items")
    rows = pages.mapInArrow(spread, "cell long, c double").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    held = np.zeros(ENDINGS * k)
    held[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    held = held.reshape(ENDINGS, k)
    overall = held.sum(axis=0) + 1e-3
    # Words without any are as many as there are words of each class.
    overall = overall + np.bincount(of, minlength=k) / max(1, len(of))
    prior = np.log((held + 5 * overall / overall.sum()) / (held.sum(axis=1, keepdims=True) + 5))
    prior[:, 0] = -np.inf

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, blob, times in zip(*(c.to_pylist() for c in batch.columns)):
                score, at, end, counts = scores(page, blob, times)
                share = counts / np.bincount(at, weights=counts, minlength=PAGE)[at]
                own = np.zeros_like(score)
                added(own, at, lambda part: share[part, None] * np.maximum(prior[end[part]], -1e6))
                classes = np.zeros(PAGE, np.uint8)
                classes[at] = 1 + np.argmax(score[at, 1:] + PRIOR * own[at, 1:], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([classes.tobytes()], pa.binary())], ["page", "classes"])

    out = np.zeros(max(PAGE, 1 << tail_bits), np.uint8)
    rows = pages.mapInArrow(chosen, "page long, classes binary").toArrow()
    for page, classes in zip(rows["page"].to_pylist(), rows["classes"].to_pylist()):
        out[page * PAGE : (page + 1) * PAGE] = np.frombuffer(classes, np.uint8)
    return np.concatenate([out[: 1 << tail_bits], np.argmax(prior, axis=1).astype(np.uint8)])


@dataclass
class Model:
    """What scoring needs: the classed words and their counts, the class of each item, log10 transitions, class sizes
    and probabilities of unseen words, the discount, and the totals of the vocabulary."""

    classed: list[bytes]
    counts: np.ndarray
    tail_bits: int
    of: np.ndarray
    transitions: np.ndarray
    log_size: np.ndarray
    log_unseen: np.ndarray
    discount: float
    total: int
    distinct: int


def smoothed(bigrams: np.ndarray, types: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the transitions, of the class sizes, and of what unseen words share of a class."""
    size = bigrams.sum(axis=0)
    share = size / size.sum()
    with np.errstate(divide="ignore"):
        return np.log10((bigrams + BACK_OFF * share[None, :]) / (bigrams.sum(axis=1) + BACK_OFF)[:, None]), np.log10(size), np.log10(discount * types)


def learn(texts: DataFrame, vocabulary: DataFrame, classed: int = CLASSED, min_count: int = MIN_COUNT, classes: int = CLASSES, sweeps: int = SWEEPS, tail_bits: int = TAIL_BITS, shortlist: int | None = SHORTLIST) -> Model | None:
    """The model of all ``texts`` (text), whose ``word_counts`` are ``vocabulary``; none without tokens."""
    total, distinct, once, twice = vocabulary.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    if not total:
        return None
    discount = once / (once + 2 * twice) if once and twice else 0.5
    top = vocabulary.where(F.col("c") >= min_count).orderBy(F.col("c").desc(), "word").limit(classed).toArrow()
    counts = dict(zip((x.encode() for x in top["word"].to_pylist()), top["c"].to_pylist()))
    words = [END, *[w for w in counts if w != END]]
    of_words = np.array([counts.get(END) or vocabulary.where("word = ''").first()["c"], *[counts[w] for w in words[1:]]], np.int64)
    others = max(1, distinct - len(words))
    tail_bits = min(tail_bits, max(8, (8 * others - 1).bit_length()))
    near = neighbours(texts, words)
    of = exchange(near, of_words, classes, sweeps, shortlist)
    head = class_table(near, np.append(of, np.uint8(classes)), classes + 1)[:classes, :classes]
    of = np.concatenate([of, tail_classes(texts, words, of, tail_bits, head)])
    shared = texts.sparkSession.sparkContext.broadcast((words, of))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value
        total = np.zeros(classes * classes, np.int64)
        for ids in _item_blocks(batches, Items(words, tail_bits, of)):
            cls = of[ids].astype(np.int64)
            total += np.bincount(cls[:-1] * classes + cls[1:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "c"])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value
        items = Items(words, tail_bits, of)
        found = np.zeros(classes, np.int64)
        for batch in batches:
            ids = items.all_of(batch.column(0).cast(pa.binary()))[0]
            found += np.bincount(of[ids], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(found)], ["cell", "c"])

    bigrams = _cells(texts.select("text").mapInArrow(paired, "cell long, c long"), classes)
    rows = vocabulary.select("word").mapInArrow(typed, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    types = np.zeros(classes)
    types[rows["cell"].to_numpy()] = rows["c"].to_numpy()
    return Model(words, of_words, tail_bits, of, *smoothed(bigrams, types, discount), discount, total, distinct)


_TAIL = pa.struct([("word", pa.string()), ("n", pa.int64()), ("k", pa.int32())])


def _scorer(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        items, n = Items(model.classed, model.tail_bits, model.of), len(model.classed)
        log_add, log_less = np.log10(model.counts + 1.0), np.log10(model.counts - model.discount)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                words, bounds = split(batch.column(1))
                ids, at_other, others = items.all_of(words)
                ids = with_ends(ids, bounds, items[END])
                cls, known = model.of[ids].astype(np.int64), ids < n
                # The token before a text's first is an end token, of class 0, as is the last of the text before.
                log = model.transitions[np.concatenate([[0], cls[:-1]]), cls] - model.log_size[cls]
                log[known] += log_less[ids[known]]
                base = np.zeros(len(ids))
                base[known] = log_add[ids[known]]
                size = np.diff(bounds) + 1
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                columns = [pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log, first))]
                # Other words of each text, with their numbers; the class goes with the word.
                distinct = len(others.dictionary)
                keys, times = np.unique((np.searchsorted(bounds, at_other, side="right") - 1) * max(1, distinct) + others.indices.to_numpy(), return_counts=True)
                text, word = keys // max(1, distinct), keys % max(1, distinct)
                kinds = np.zeros(distinct, np.int32)
                kinds[others.indices.to_numpy()] = cls[~known]
                flat = pa.StructArray.from_arrays([others.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(times.astype(np.int64)), pa.array(kinds[word])], fields=list(_TAIL))
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(size) + 1)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, tails], ["doc_id", "n_tokens", "n_known", "base", "log", "tail"])

    return scored


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int | None) -> DataFrame:
    """Per row of ``docs``: n_tokens, n_known, train_tokens, base_score (add-one unigrams), score
    (log10 probability under the class bigrams) and perplexity, learnt from the rows ``training``."""
    spark = docs.sparkSession
    texts = training.select(training[text_col].alias("text"))
    vocabulary = materialize(word_counts(texts), "vocabulary")
    model = learn(texts, vocabulary, **sizes)
    rows = renamed(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    if model is None:
        n = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long") + 1
        return rows.select("doc_id", n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(1.0).alias("perplexity"))
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, log double, tail array<struct<word:string,n:long,k:int>>"
    scored = materialize(rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(vocabulary, "word", "left")
    unseen = F.element_at(F.array(*[F.lit(float(x) if np.isfinite(x) else 0.0) for x in model.log_unseen]), F.col("k") + 1)
    more = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more_base"),
        F.sum(F.col("n") * F.coalesce(F.log10(F.col("c") - model.discount), unseen)).alias("more_log"),
    )
    score_ = F.col("log") + F.coalesce("more_log", F.lit(0.0))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.total + model.distinct + 1))
    return scored.drop("tail").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score_.alias("score"),
        F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"),
    )


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int | None) -> DataFrame:
    """All of ``docs`` scored by a model of the rows outside the held-out fold; held_out tells the fold."""
    held_out = F.coalesce(fold(F.col(id_col), FOLDS) == HELD_OUT, F.lit(False))
    scores = score(docs, docs.where(~held_out), id_col, text_col, **sizes)
    rest = [c for c in scores.columns if c != "doc_id"]
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), *rest)

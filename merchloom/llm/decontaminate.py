"""Benchmark decontamination with broadcast hash sets of test n-grams.

Every benchmark item is normalised to words (ASCII letters lower-cased, ASCII
punctuation and white space separate, everything else belongs to words); its windows
of ``WINDOW`` words - or the whole item, if it has fewer - are numbered by the items
they stem from. The documents are read once; each document's words become numbers of
the benchmark's own vocabulary, window keys are rolled over them with numpy, looked up
in the sorted key table, and every hit is verified word by word.

The benchmark is split into slices of at most ``SLICE_BYTES`` bytes of text, so what
is broadcast at once has a proven bound (some 20 bytes a window, below 100 MB for a slice in each worker); each slice is one pass over the documents,
and its hits are carried to the next as a bit per word. Benchmarks of ordinary size
are one slice.

Defined results: null or empty texts have no words and no hits; items without words
match nothing; items with equal windows are all counted, an item without id as one with an empty id; repeated rows are scanned one
by one; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, renamed

WINDOW = 10
SLICE_BYTES = 8 << 20

#: Bytes to bytes: digits, lower-case letters and bytes of non-ASCII characters stay, A-Z are lower-cased, the rest separates.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key for each window of n ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    m = len(ids) - n + 1
    key = np.zeros(m, np.uint64)
    for i in range(n):
        key = key * _BASE + ids[i : i + m].astype(np.uint64)
    return key


class Grams:
    """The distinct windows of some benchmark items, as arrays: the words of all items end to end as numbers, and for each
    length of window the sorted keys, the place of each window in the words and the number of its list of owners.

    Windows that many items share (boilerplate questions) stand once, and windows with the same owners share one list: a text is verified
    against a window once, whoever owns it, and its items are the union of the few different lists that it met."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        #: Item ids in order; owners are numbers of these.
        self.names = np.array(sorted({name for name, _ in items}), object)
        rank = {name: i for i, name in enumerate(self.names.tolist())}
        streams, found, at = [np.empty(0, np.int32)], {}, 0
        for name, text in items:
            own = words(text)
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own), np.int32, len(own))
            n = min(window, len(ids))
            if n:
                keys, other = _keys(ids, n), _keys(ids[::-1], n)[::-1]
                found.setdefault(n, []).append((keys, other, at + np.arange(len(keys), dtype=np.int32), np.full(len(keys), rank[name], np.int32)))
            streams.append(ids)
            at += len(ids)
        self.stream = np.concatenate(streams)
        self.tables, lists = [], {}
        for n in sorted(found):
            keys, other, starts, owners = (np.concatenate(x) for x in zip(*found[n]))
            order = np.lexsort((owners, other, keys))  # two keys tell windows apart; what they leave together is compared
            keys, other, starts, owners = keys[order], other[order], starts[order], owners[order]
            same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (other[1:] == other[:-1])])
            again = np.flatnonzero(same)
            for i in range(n):
                same[again] &= self.stream[starts[again] + i] == self.stream[starts[again - 1] + i]
            first = np.flatnonzero(~same)
            ends = np.append(first[1:], len(keys)).tolist()
            own_list = [lists.setdefault(np.unique(owners[a:b]).tobytes(), len(lists)) for a, b in zip(first.tolist(), ends)]
            self.tables.append((n, keys[first], starts[first], np.array(own_list, np.int32)))
        self.lists = [np.frombuffer(x, np.int32) for x in lists]

    def scan(self, text_words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words lie in an occurrence of a window, and the items with occurrences, in order."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in text_words), np.int64, len(text_words))
        edges, met = np.zeros(len(ids) + 1, np.int64), []
        for n, keys, starts, own_list in self.tables:
            own = _keys(ids, n)
            if not len(own):
                continue
            low = np.searchsorted(keys, own)
            place = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == own))
            at = low[place]
            while len(place):  # once, but for windows whose keys agree by chance
                equal = (self.stream[starts[at][:, None] + np.arange(n)] == ids[place[:, None] + np.arange(n)]).all(axis=1)
                np.add.at(edges, place[equal], 1)
                np.add.at(edges, place[equal] + n, -1)
                met.append(own_list[at[equal]])
                at = at + 1
                more = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own[place])
                place, at = place[more], at[more]
        owners = np.zeros(len(self.names), bool)
        for k in np.unique(np.concatenate(met)).tolist() if met else ():
            owners[self.lists[k]] = True
        return np.cumsum(edges[:-1]) > 0, self.names[owners].tolist()


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in slices of bounded size; one slice at a time is on the driver. An item above
    the bound is a slice of its own."""
    part, size = [], 0
    for row in benchmark.where("text IS NOT NULL").toLocalIterator():
        text = row["text"].encode()
        if part and size + len(text) > slice_bytes:
            yield part
            part, size = [], 0
        part.append(("" if row["item_id"] is None else str(row["item_id"]), text))
        size += len(text)
    if part:
        yield part


def excise(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words; each run of them leaves one space."""
    marks = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out, at = [], 0
    for first, beyond in zip(runs[::2], runs[1::2]):
        out += [text[at : starts[first]], b" "]
        at = ends[beyond - 1]
    return b"".join([*out, text[at:]])


def _scanner(grams, text_mode: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = grams.value
        for batch in batches:
            counts, n_hits, bits, items, texts = [], [], [], [], []
            for text, old_bits, old_items in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = words(text or b"")
                hit, found = table.scan(own)
                if old_bits:
                    hit |= np.unpackbits(np.frombuffer(old_bits, np.uint8), count=len(own)).astype(bool)
                any_hit = bool(hit.any())
                counts.append(len(own))
                n_hits.append(int(hit.sum()))
                bits.append(np.packbits(hit).tobytes() if any_hit else b"")
                items.append(sorted({*found, *old_items}) if old_items else found)
                if text_mode == "cut":
                    texts.append(excise(text, hit) if any_hit else text)
            text = {"keep": lambda: batch.column(1), "drop": lambda: pa.nulls(len(counts), pa.string()), "cut": lambda: pa.array(texts, pa.binary()).cast(pa.string())}[text_mode]()
            new = [pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string())), *batch.columns[4:], pa.array(counts, pa.int64()), pa.array(n_hits, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *new], [*batch.schema.names, "n_words", "n_hit"])

    return scan


def find_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slice_bytes: int = SLICE_BYTES, text_mode: str = "keep", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, text (kept, dropped or with the hit words cut out), hits (a bit per word), items
    (the ids hit, as sorted strings), the columns to carry as c0, c1, ..., n_words and n_hit."""
    spark = docs.sparkSession
    others = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"), *others)
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", n_words long, n_hit long"
    parts = _slices(renamed(benchmark, item_id=item_col, text=item_text_col), slice_bytes)
    part = next(parts, [])
    for following in parts:
        scanned = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(Grams(part, window)), "keep"), schema)
        rows, part = materialize(scanned.drop("n_words", "n_hit"), "hits"), following
    return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(Grams(part, window)), text_mode), schema)


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per row of ``docs``: words, words hit, items hit and their digest, and whether it is contaminated."""
    hits = find_hits(docs, benchmark, text_mode="drop", **names)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_hit_share: float = 0.8, **names) -> DataFrame:
    """``docs`` with benchmark passages cut out of the text column; documents of which more than
    ``max_hit_share`` of the words is benchmark text are left out. Other columns stay as they are."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    hits = find_hits(docs, benchmark, id_col=id_col, text_col=text_col, text_mode="cut", carry=others, **names)
    kept = hits.where(F.col("n_hit") <= max_hit_share * F.col("n_words"))
    back = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])

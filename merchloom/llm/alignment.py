"""Alignment of two tokenizers by a dictionary of token groups.

Tokens of A and of B that end at the same byte cut a text into groups; within a group
only the last tokens end together, so a group holds one link (no token of either
vocabulary is empty, which is checked). The work is done on distinct groups:

* Interning. A task takes texts in chunks of ``CHUNK`` bytes (or one longer text). Texts are cut before
  spaces and line feeds that follow another character than white space: neither
  tokenizer merges across such places, so every distinct piece is encoded once for a chunk. Groups of
  its pieces are interned; a text becomes the numbers and counts of its pieces. One row
  is written for each chunk: its distinct groups with their frequencies and numbers of texts, and the texts.
* Dictionary. The groups of all chunks are summed by key (the ids of the group). Links are
  expanded once for each distinct group, multiplied by its frequency (``weigh`` may also be the number of texts) and
  summed by id pair; the highest count of a B id is one row for each id of the vocabulary.
* Join back. Counts return to the groups by key, then to the chunks; a chunk's texts read
  them from an array. A key has at most one row for each chunk, so frequent groups are no hot keys.

That pieces can be encoded alone follows from the vocabularies: no token of B has a space
after another character or holds a line feed (checked when the model is loaded; texts are
encoded whole for a model without that property), and A's pre-tokenizer never joins white space to what stands before it.

Defined results: a text that is null, empty or whose A or B bytes are not those of a space
and the text has no tokens, zeros everywhere and an empty digest; that holds for
texts with U+2581, which B reads as a space. Ids may be null or repeated, each row counts.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, renamed

#: Files of the two tokenizers, at the same place on every machine.
FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose groups are interned together.
CHUNK = 16 << 20
#: Units handed to a tokenizer at once.
PORTION = 8192

#: White space up to a word, and the word: what stands before is no white space.
_PIECES = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, file_a: str, file_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        alphabet = byte_alphabet()
        with open(file_a, encoding="utf-8") as f:
            parsed = json.load(f)
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token in parsed["added_tokens"]:  # never met in a text, as their strings are plain text there
            self.bytes_a[token["id"]] = token["content"].encode()
        for token, i in parsed["model"]["vocab"].items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("a token without bytes: links would not be one for each group")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Whether pieces of a text may be encoded alone.
        self.apart = not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", p) for p in pieces)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """[A ids of all texts, their number in each, B ids, their number in each]. The texts begin with a space or, if the
        model keeps pieces apart, with a line feed. A text whose bytes do not come back has no ids."""
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(pieces), PORTION):
            part = pieces[at : at + PORTION]
            raw = [p.encode() for p in part]
            n = np.array([len(x) for x in raw])
            good = np.ones(len(part), bool)
            found = []
            # B's own space and a line feed are two tokens that nothing is merged with.
            texts = ["\n" + p for p in part] if self.apart else [p[1:] for p in part]
            for encoded, skip, table, sizes in (
                ((x.ids for x in self.a.encode_batch_fast(part, add_special_tokens=False)), 0, self.bytes_a, self.sizes_a),
                (self.b.encode(texts, num_threads=1), 2 * self.apart, self.bytes_b, self.sizes_b),
            ):
                lists = list(encoded)
                count = np.fromiter(map(len, lists), np.int64, len(lists))
                ids = np.fromiter(chain.from_iterable(lists), np.int64, count.sum())
                if skip:
                    own = np.ones(len(ids), bool)
                    first = np.cumsum(count) - count
                    own[first], own[first + 1] = False, False
                    ids, count = ids[own], count - skip
                ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(count)])]
                if (np.diff(ends) != n).any() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):
                    good &= [b"".join(map(table.__getitem__, x[skip:])) == y for x, y in zip(lists, raw)]
                found += [ids, count]
            for k in (0, 2):
                ids, count = found[k : k + 2]
                out[k].append(ids[np.repeat(good, count)].astype(np.int32))
                out[k + 1].append(np.where(good, count, 0))
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


@lru_cache(maxsize=2)
def pair_of(file_a: str, file_b: str) -> Pair:
    """Loaded once for each worker."""
    return Pair(file_a, file_b)


def _interned(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each group, keys by number). Group k has the ids a[cut_a[k] : cut_a[k + 1]] and likewise of b; its
    key: how many ids are A's, then all ids, each as a big-endian number of 4 bytes."""
    n_a, n_b = np.diff(cut_a), np.diff(cut_b)
    one_a, one_b = cut_a[:-1], cut_b[:-1]
    # Two ids of each side at most fit into one number and need no dictionary of Python's.
    small = (n_a <= 2) & (n_b <= 2) & (max(a.max(initial=0), b.max(initial=0)) < 65535)
    packed = np.zeros(len(n_a), np.uint64)
    for ids, first, n in ((a, one_a, n_a), (b, one_b, n_b)):
        for k in range(2):
            has = small & (n > k)
            packed <<= np.uint64(16)
            packed[has] += ids[first[has] + k].astype(np.uint64) + np.uint64(1)
    _, example, number = np.unique(packed[small], return_index=True, return_inverse=True)
    group = np.empty(len(n_a), np.int64)
    group[small] = number
    raw_a, raw_b = a.astype(">u4").tobytes(), b.astype(">u4").tobytes()

    def key(k: int) -> bytes:
        x, y = one_a[k], one_b[k]
        return int(n_a[k]).to_bytes(4, "big") + raw_a[4 * x : 4 * (x + n_a[k])] + raw_b[4 * y : 4 * (y + n_b[k])]

    keys = [key(k) for k in np.flatnonzero(small)[example].tolist()]
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = lambda: len(keys) + len(known)
    group[~small] = [known[key(k)] for k in np.flatnonzero(~small).tolist()]
    return group, keys + list(known)


class Interned:
    """The distinct pieces of a chunk and their groups."""

    def __init__(self, pair: Pair, pieces: list[str]):
        a, self.n_a, b, self.n_b = pair.encode(pieces)
        self.whole = self.n_a > 0  # both tokenizers give the piece's bytes back
        # Pieces that are whole have as many bytes in A as in B, so ends can be counted through all of them.
        ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
        _, cut_a, cut_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        cut_a, cut_b = np.concatenate([[0], cut_a + 1]), np.concatenate([[0], cut_b + 1])
        self.bounds = np.searchsorted(cut_a, np.concatenate([[0], np.cumsum(self.n_a)]))  # of the pieces' groups
        self.n_groups = np.diff(self.bounds)
        self.group, self.keys = _interned(a, b, cut_a, cut_b)

    def shown(self) -> list[str]:
        """The groups of each piece as `a1,a2|b1;a3|b2`."""
        def one(key: bytes) -> str:
            ids = np.frombuffer(key, ">u4").tolist()
            n = ids[0] + 1
            return ",".join(map(str, ids[1:n])) + "|" + ",".join(map(str, ids[n:]))

        groups = [one(k) for k in self.keys]
        each = [groups[g] for g in self.group.tolist()]
        edges = self.bounds.tolist()
        return [";".join(each[x:y]) for x, y in zip(edges, edges[1:])]


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype("<i4").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<i4").astype(np.int64)


def _chunk(pair: Pair, number: int, ids: list, texts: list[str]) -> dict:
    """The row of a chunk."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    each = []
    for text in texts:
        if not text or _SPACE in text:
            found = []
        elif pair.apart:
            found = _PIECES.findall(" " + text)
        else:
            found = [" " + text]
        each.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
    interned = Interned(pair, list(known))
    shown = interned.shown()
    del known
    report = []
    freq, in_texts = np.zeros(len(interned.keys), np.int64), np.zeros(len(interned.keys), np.int64)
    bag_sizes, bags, counts = [], [], []
    for pieces in each:
        if not interned.whole[pieces].all():
            pieces = pieces[:0]
        digest = hashlib.sha256(";".join([shown[p] for p in pieces.tolist()]).encode()).hexdigest() if len(pieces) else ""
        own, n = np.unique(pieces, return_counts=True)
        sizes = interned.n_groups[own]
        report.append((int(interned.n_a[own] @ n), int(interned.n_b[own] @ n), int(sizes @ n), digest))
        groups = interned.group[np.repeat(interned.bounds[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(own) else own[:0]
        np.add.at(freq, groups, np.repeat(n, sizes))
        in_texts[np.unique(groups)] += 1
        bag_sizes.append(len(own)), bags.append(own), counts.append(n)
    used = np.flatnonzero(freq)  # groups of texts that have no tokens go
    return {
        "chunk": number, "doc_id": ids,
        **{name: [r[k] for r in report] for k, name in enumerate(("n_a", "n_b", "n_groups", "groups_sha256"))},
        "local": used.tolist(), "key": [interned.keys[g] for g in used.tolist()], "freq": freq[used].tolist(), "docs": in_texts[used].tolist(),
        "bags": [_packed(np.array(x)) for x in (bag_sizes, np.concatenate(bags), np.concatenate(counts), interned.bounds, interned.group)],
    }


def chunks(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each chunk of ``docs``: its texts' counts, digests and pieces, and its distinct groups."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table in few files: encoding costs more than moving its texts
        rows = rows.repartition(cores)
    longs, array = T.ArrayType(T.LongType()), T.ArrayType
    schema = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("doc_id", array(rows.schema["doc_id"].dataType))]
        + [T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups")]
        + [T.StructField("groups_sha256", array(T.StringType())), T.StructField("local", longs), T.StructField("key", array(T.BinaryType()))]
        + [T.StructField(c, longs) for c in ("freq", "docs")]
        + [T.StructField("bags", array(T.BinaryType()))]
    )

    def interned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        pair = pair_of(file_a, file_b)
        first, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal first, ids, texts, held
            out = pa.RecordBatch.from_pylist([_chunk(pair, first, ids, texts)], shape)
            first, ids, texts, held = first + 1, [], [], 0
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), texts.append(text or "")
                held += len(texts[-1].encode())
                if held >= size:
                    yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(interned, schema)


def _number(key: Column | str, at: Column | int, n: int = 4) -> Column:
    """The big-endian number in ``n`` bytes of a key from byte ``at`` (first: 1) on."""
    return F.conv(F.hex(F.substring(key, at, n)), 16, 10).cast("int")


def dictionary(interned: DataFrame, weigh: str = "freq") -> tuple[DataFrame, DataFrame]:
    """(groups, pairs) of the chunks: distinct groups (key, freq, docs, a, b), where a and b are the group's link, and
    id pairs (a, b, count, best): their links' summed ``weigh`` (``freq`` or ``docs``), and whether that is the highest of the B id."""
    entries = interned.select(F.explode(F.arrays_zip("key", "freq", "docs")).alias("g")).select("g.*")
    groups = entries.groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))
    linked = groups.withColumns({"a": _number("key", 1 + 4 * _number("key", 1)), "b": _number("key", F.length("key") - 3)})
    linked = materialize(linked, "groups")
    counted = linked.groupBy("a", "b").agg(F.sum(weigh).alias("count"))
    highest = counted.groupBy("b").agg(F.max("count").alias("highest"))  # a row for each id of B's vocabulary at most
    pairs = counted.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    return linked, pairs


def _scored(texts: pa.Table, values: pa.Table) -> pa.Table:
    """The texts of one chunk, from the counts of its groups."""
    row = {name: texts.column(name)[0] for name in texts.column_names}
    sizes, bags, counts, bounds, group = (_unpacked(x.as_py()) for x in row["bags"])
    local = values.column("local").to_numpy()
    n_keys = int(group.max()) + 1 if len(group) else 0
    per_group = np.zeros((2, n_keys), np.int64)
    for k, name in enumerate(("best", "count")):
        per_group[k, local] = values.column(name).to_numpy().astype(np.int64)
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_group[:, group], axis=1)], axis=1)
    per_piece = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_piece[:, bags] * counts, axis=1)], axis=1)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n_best, count_sum = sums[:, edges[1:]] - sums[:, edges[:-1]]
    columns = {name: row[name].values for name in ("doc_id", "n_a", "n_b", "n_groups")}
    columns |= {"n_links": row["n_groups"].values, "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": row["groups_sha256"].values}
    return pa.table(columns)


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, size: int = CHUNK, weigh: str = "freq", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256."""
    interned = materialize(chunks(docs, file_a, file_b, size, id_col, text_col), "chunks")
    groups, pairs = dictionary(interned, weigh)
    values = groups.join(pairs, ["a", "b"]).select("key", "count", F.col("best").cast("int").alias("best"))
    entries = interned.select(F.col("chunk").alias("of"), F.explode(F.arrays_zip("local", "key")).alias("g")).select("of", "g.local", "g.key")
    back = entries.join(values, "key").select("of", "local", "count", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = interned.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "bags")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_scored, schema)


def lexicon(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, size: int = CHUNK, weigh: str = "freq", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, count, best): how often an id of A and one of B are linked in ``docs``."""
    return dictionary(materialize(chunks(docs, file_a, file_b, size, id_col, text_col), "chunks"), weigh)[1]

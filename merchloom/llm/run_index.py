"""Suffix-array deduplication with a run-length index.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller id is removed. The work is routed so that equal strings meet:

1. Anchors. Each 50-byte window has one anchor, the smallest hash of its ``GRAM``-byte
   grams (the leftmost of equals). Equal windows have equal anchors. Anchor hashes are
   dealt to buckets; those that occur in two documents or more are shared.
2. Segments. Around a shared anchor the document holds a segment: all windows that have
   this anchor, at most 2 * 50 - GRAM bytes. Segments are dealt to buckets by their anchor,
   so all occurrences of a window meet in one bucket.
3. Index. In a bucket the segments, in document order, make one text. Its suffixes are
   sorted, and the Burrows-Wheeler transform is kept as runs, cut where the 50-byte context
   changes: run heads, run starts, the LF offset of each run, and at the run ends the
   sampled earliest document of the context. The segments are then streamed through the
   transform from their ends to their beginnings, LF step by LF step, all segments at once;
   each step gives the matching statistic of a position against earlier documents, as far
   as it is needed: whether a match of 50 bytes or more starts there.
4. Marks are joined back to the texts, merged and cut out.

Copies do not pile up: within a batch one witness stands for all occurrences of an
anchor, and one segment for all equal ones (the others are marked at once, since the
first of them is earlier), in a batch and again in a bucket. The texts are shuffled once; both uses of that shuffle
are the same exchange, which Spark reuses. Numbers of buckets follow the size of the input.

Defined results: null and empty texts lose nothing; a row without id neither loses nor
explains anything; rows with the same id do not explain each other; an empty table gives
an empty one; texts are read whole, as bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bitmap, has_bit, materialize, numbers, planes, renamed

LENGTH, GRAM = 50, 24
#: Contexts of an anchor, counted in each batch, from which on its windows are dealt one by one.
HOT = 4096
#: Bytes of text for each bucket of anchors, and bytes that a task takes at once.
BUCKET_BYTES, BATCH_BYTES, SLICE_BYTES = 16 << 20, 3 << 20, 8 << 20
#: Buckets of segments for each bucket of anchors, and parts of a bucket that are indexed one after the
#: other: an index takes some 120 bytes for each byte of its segments, and small ones stay in the caches.
INDEX_BUCKETS, PARTS = 6, 16
_POSITION_BITS = 22  # of a position in a batch that is hashed at once
_KEY_BITS = 23
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram`` bytes, from those of powers of two."""
    h, width, done, out = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if gram & width:
            out = h if out is None else out[: len(h) - done] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + h[done:]
            done += width
        if 2 * width > gram:
            return _mixed(out)
        h = h[:-width] * np.uint64(pow(_MULTIPLIER, width, 1 << 64)) + h[width:]
        width *= 2


def hashes_at(data: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """``gram_hashes`` of some places only."""
    powers = np.array([pow(_MULTIPLIER, gram - 1 - i, 1 << 64) for i in range(gram)], np.uint64)
    return _mixed(((data[places[:, None] + np.arange(gram)].astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1))


def anchors(data: np.ndarray, lengths: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, document, place of the anchor, first and last window start, hash of the grams beside it) of every
    anchor of some documents laid end to end. Windows that cross documents have none."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = 1, length - gram + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    document = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(document[: n - length + 1] == document[length - 1 :])
    place = (least[starts] & mask).astype(np.int64)
    # A place serves a run of window starts; starts of another document have other places.
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
    last = np.concatenate([first[1:], [len(place)]]) - 1 if len(place) else first
    at, end = place[first], len(hashes) - 1
    beside = hashes[np.maximum(at - gram, 0)] * np.uint64(_MULTIPLIER) + hashes[np.minimum(at + gram, end)]
    return hashes[at], document[starts[first]], at, starts[first], starts[last], beside


def _blocks(ids: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows in blocks of about BATCH_BYTES, in the order of their ids. A longer text is a block of its own."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for row in sorted(zip(ids, texts), key=lambda r: r[0]):
        if block and size + len(row[1]) > BATCH_BYTES:
            yield np.array([r[0] for r in block], np.int64), [r[1] for r in block]
            block, size = [], 0
        block.append(row)
        size += len(row[1])
    if block:
        yield np.array([r[0] for r in block], np.int64), [r[1] for r in block]


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, lengths, index of the text, place in the text): texts too long to be hashed at once come
    in pieces that overlap by one window less one byte, so that each window is in one piece."""
    limit = 1 << _POSITION_BITS
    whole = [i for i, t in enumerate(texts) if len(t) < limit]
    if whole:
        at = 0
        while at < len(whole):
            size, upto = 0, at
            while upto < len(whole) and (upto == at or size + len(texts[whole[upto]]) < limit):
                size += len(texts[whole[upto]])
                upto += 1
            part = whole[at:upto]
            yield np.frombuffer(b"".join(texts[i] for i in part), np.uint8), np.array([len(texts[i]) for i in part]), np.array(part), np.zeros(len(part), np.int64)
            at = upto
    for i, t in enumerate(texts):
        if len(t) >= limit:
            for at in range(0, len(t) - LENGTH + 1, limit // 2):
                piece = np.frombuffer(t, np.uint8, min(limit // 2 + LENGTH - 1, len(t) - at), at)
                yield piece, np.array([len(piece)]), np.array([i]), np.array([at])


def _pack(place: np.ndarray, left: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Start of the first window, bytes to the anchor and further window starts, in one number."""
    return (place << 16) | (left << 8) | span


_ANCHOR_ROWS = "bucket long, hashes binary, ids binary, places binary"


def _row_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a number and blobs as one batch."""
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int64()) for i, x in enumerate(zip(*rows))], names)


def _anchor_rows(buckets: int):
    def row(bucket, h, ids, places):
        # Ids ascend, so their differences are small numbers. In a bucket half a hash tells anchors apart:
        # a chance meeting makes a segment more, and no mark.
        return bucket, planes((h >> np.uint64(32)).astype(np.uint32)), planes(np.diff(ids, prepend=0)), planes(places)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _blocks(batch.column(0).to_pylist(), as_bytes(batch.column(2))):
                found = []
                for data, lengths, index, offset in _pieces(texts):
                    h, doc, place, first, last, beside = anchors(data, lengths)
                    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[doc]
                    found.append((h, index[doc], _pack(first - begin + offset[doc], place - first, last - first), beside))
                if not found:
                    continue
                h, doc, packed, beside = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((doc, h))  # texts are in the order of their ids
                h, own, packed, beside = h[order], ids[doc[order]], packed[order], beside[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                rows = []
                group = np.cumsum(new) - 1
                shared = (np.minimum.reduceat(own, start) < np.maximum.reduceat(own, start))[group]
                contexts = np.ones(len(start), np.int64)
                if shared.any():
                    both = np.lexsort((beside[shared], group[shared]))
                    of, near = group[shared][both], beside[shared][both]
                    contexts = np.bincount(of[np.concatenate([[True], (of[1:] != of[:-1]) | (near[1:] != near[:-1])])], minlength=len(start))
                    # Known to be shared already: they pass the buckets by, with one witness left in their stead.
                    order = np.argsort(own[shared], kind="stable")
                    rows.append(row(-1 - int(xxhash.xxh64_intdigest(packed.tobytes()) >> 2), h[:0], own[shared][order], packed[shared][order]))
                keep = ~shared | new
                # The witness of a shared anchor tells in how many contexts it stands.
                h, own, packed = h[keep], own[keep], np.where(shared[keep], -contexts[group[keep]], packed[keep])
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((own, bucket))
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                rows += [row(int(bucket[part[0]]), h[part], own[part], packed[part]) for part in np.split(order, cuts)]
                yield _row_batch(rows, _ANCHOR_ROWS)

    return dealt


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The blobs of each bucket; rows come sorted by bucket."""
    now, held = None, [[] for _ in range(columns)]
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != now:
                if held[0]:
                    yield now, held
                now, held = row[0], [[] for _ in range(columns)]
            for x, value in zip(held, row[1:]):
                x.append(value)
    if held[0]:
        yield now, held


def _sharing(hot_contexts: int):
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, place) of the anchors that are shared; without doc_id the half hash of each hot anchor."""
        for bucket, blobs in _by_bucket(batches, 3):
            h, places = numbers(blobs[0], np.uint32), numbers(blobs[2], np.int64)
            ids = np.concatenate([np.cumsum(numbers([x], np.int64)) for x in blobs[1]])
            if bucket >= 0:
                order = np.argsort(h, kind="stable")
                h, ids, places = h[order], ids[order], places[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                start = np.flatnonzero(new)
                hot = np.add.reduceat(np.where(places < 0, -places, 1), start) > hot_contexts
                if hot.any():
                    halves = h[start[hot]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(halves), pa.int64()), pa.array(halves)], ["doc_id", "place"])
                keep = (np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start))[np.cumsum(new) - 1] & (places >= 0)
                ids, places = ids[keep], places[keep]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places)], ["doc_id", "place"])

    return shared


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about SLICE_BYTES of their texts."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for at, upto in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        yield batch.slice(at, upto - at)


_SEGMENT_ROWS = "bucket long, ids binary, keys binary, starts binary, lengths binary, bytes binary, parts binary, twin_starts binary, twin_of binary"


def _segment_rows(buckets: int, hot):
    def row(bucket, segments, data, twins=()):
        ids, keys, starts, lengths, parts = (np.array(x, np.int64) for x in zip(*segments))
        twin_starts, twin_of = (np.array(x, np.int64) for x in zip(*twins)) if twins else (np.empty(0, np.int64),) * 2
        described = np.diff(ids, prepend=0), keys, starts, lengths  # ids ascend
        return bucket, *map(planes, described), pa.compress(data, "zstd", asbytes=True), parts.astype(np.uint8).tobytes(), planes(twin_starts), planes(twin_of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                yield from cut_slice(part)

    def cut_slice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        places = batch.column(3)
        values, offsets = places.flatten().to_numpy(zero_copy_only=False), places.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(offsets)
        first: dict[bytes, tuple[int, int, int, int]] = {}  # id, key, bucket and number there
        later: list[tuple[int, int, int, int]] = []
        dealt: dict[int, tuple[list, list, list]] = {}  # rows, segments and twins of each bucket
        ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
        digest = xxhash.xxh64_intdigest
        # In id order, so that the first of equal segments is the earliest.
        for i in sorted(range(len(ids)), key=ids.__getitem__):
            own = values[ends[i] - offsets[i] : ends[i]]
            text, doc, key = texts[i], ids[i], keys[i]
            start, left, span = own >> 16, own >> 8 & 255, own & 255
            inside = start + span + LENGTH <= len(text)  # others are places of another row with this id
            start, left, span = start[inside], left[inside], span[inside]
            alone = np.zeros(len(start), bool)
            if hot is not None and len(start):
                alone = has_bit(hot.value, (hashes_at(np.frombuffer(text, np.uint8), start + left, GRAM) >> np.uint64(32)).astype(np.int64))
            for begin, to_anchor, more, by_window in zip(start.tolist(), left.tolist(), span.tolist(), alone.tolist()):
                for at, size in zip(range(begin, begin + more + 1), [LENGTH] * (more + 1)) if by_window else ((begin, more + LENGTH),):
                    segment = text[at : at + size]
                    seen = first.get(segment)
                    if seen and seen[0] < doc:
                        later.append((doc, key, at, size, 0))
                    elif seen and seen[1] == key:  # again in the same text: it shares the marks of the first
                        dealt[seen[2]][2].append((at, seen[3]))
                    else:
                        part, bucket = divmod(digest(segment if by_window else segment[to_anchor : to_anchor + GRAM], 11), buckets)
                        rows, segments, _ = dealt.setdefault(bucket, ([], [], []))
                        first.setdefault(segment, (doc, key, bucket, len(rows)))
                        rows.append((doc, key, at, size, part % PARTS))
                        segments.append(segment)
        found = [row(bucket, rows, b"".join(segments), twins) for bucket, (rows, segments, twins) in dealt.items()]
        if later:
            found.append(row(-1 - int(digest(str(later[0])) >> 2), later, b""))
        if found:
            yield _row_batch(found, _SEGMENT_ROWS)

    return cut


def _ranked(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by key, equal ones by place, and the dense rank, from 1, of each place's key."""
    n, bits = len(key), max(1, len(key).bit_length())
    if bound << bits < 1 << 63:  # key and place fit one number
        both = np.sort(key << bits | np.arange(n))
        order, held = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable" if bound <= (n + 1) ** 2 else None)
        held = key[order]
    new = np.empty(n, np.int64)
    new[:1], new[1:] = 1, held[1:] != held[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of segments in document order.

    ``data``: the segments, end to end; ``lengths``: of the segments; ``docs``: the document of each,
    ascending. Each segment ends in a terminator, and terminators sort by segment.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int = LENGTH):
        m, n = len(lengths), len(data) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        segment = np.repeat(np.arange(m), lengths + 1)
        seen = np.bincount(data, minlength=256) > 0
        code = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        code[inside] = np.cumsum(seen)[data]  # 1 and up, without gaps; 0 is the terminator
        rest = (np.repeat(ends, lengths + 1) - np.arange(n)).astype(np.int32)  # bytes up to the terminator

        def ahead(x: np.ndarray, by: int) -> np.ndarray:
            """``x`` of the place ``by`` further on; 0 from the terminator on."""
            out = np.empty_like(x)
            out[: n - by], out[n - by :] = x[by:], 0
            out[rest <= by] = 0
            return out

        # Ranks by as many bytes as a number holds, then by doubling until no segment is longer; ranks end at
        # the terminator, and equal suffixes stand in the order of their segments, as their terminators do.
        width, base, key = 1, int(seen.sum()) + 1, code
        while 2 * width <= length and base ** (2 * width) < 1 << 63:
            key = key * base**width + ahead(key, width)
            width *= 2
        order, rank = _ranked(key, base**width)
        half = None
        while width < int(lengths.max(initial=0)) + 1:
            if width <= length < 2 * width:
                half = (rank, width)
            order, rank = _ranked(rank * (n + 1) + ahead(rank, width), (n + 1) ** 2)
            width *= 2
        self.length, self.ends = length, ends
        # Rows with a common context of ``length`` bytes: equal ranks of its first and of its last bytes.
        a, w = half if half else (rank, width)
        b = ahead(a, length - w) if length > w else a
        # Rows that are shorter have no context, and nothing cuts a run of theirs.
        full = rest[order] >= length
        a, b = a[order], b[order]
        cut = (full[1:] | full[:-1]) & ((full[1:] != full[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        context = np.concatenate([[True], cut])
        before = np.where(order == 0, n - 1, order - 1)
        transform = code[before]
        # Runs of one byte in one context. Samples at run ends: where the run starts and the earliest document of its context.
        head = context.copy()
        head[1:] |= transform[1:] != transform[:-1]
        self.run_starts = np.flatnonzero(head)
        self.heads = transform[self.run_starts]
        context_start = np.flatnonzero(context)
        earliest = np.minimum.reduceat(docs[segment[order]], context_start)
        run_context = np.cumsum(context)[self.run_starts] - 1
        self.earliest = np.where(full[self.run_starts], earliest[run_context], np.iinfo(np.int64).max)
        # LF: rows with the byte c in the transform map, in order, to the rows that begin with c.
        sizes = np.diff(np.concatenate([self.run_starts, [n]]))
        by_head = np.argsort(self.heads.astype(np.uint16), kind="stable")
        lf = np.empty(len(sizes), np.int64)
        lf[by_head] = np.cumsum(sizes[by_head]) - sizes[by_head]
        self.shift = lf - self.run_starts
        # Directory: the run of each row.
        self.run_of = (np.cumsum(head) - 1).astype(np.int32)
        # A terminator row is the segment's own number: terminators sort first, by segment.
        self.n_segments = m

    def stream(self, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segments, places, earliest document with the ``length`` bytes from there) of all segments,
        from their ends to their beginnings, one place of every segment at a step."""
        active = np.arange(self.n_segments)
        row, run = active.copy(), self.run_of[active]
        for step in range(1, int(lengths.max(initial=0)) + 1):
            keep = lengths[active] >= step
            active, row, run = active[keep], row[keep], run[keep]
            row = row + self.shift[run]
            run = self.run_of[row]
            if step >= self.length:
                yield active, lengths[active] - step, self.earliest[run]


def earlier_windows(data: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of every window that also starts in a segment of a smaller document."""
    found = [(seg[hit], place[hit]) for seg, place, doc in RunIndex(data, lengths, docs, length).stream(lengths) if (hit := doc < docs[seg]).any()]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _spread(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, mark) for every mark of every segment of ``of``, where mark i belongs to segment at[i]; ``at`` ascends."""
    a, b = (np.searchsorted(at, of, side) for side in ("left", "right"))
    return np.repeat(np.arange(len(of)), b - a), np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())


def _bucket_marks(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: bytes, parts: np.ndarray, twin_starts: np.ndarray, twin_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, key, begin, length) of what the segments of a bucket lose. Of equal segments the earliest stands in
    the index: those of later documents go whole, those of its own document share its marks."""
    upto = np.cumsum(lengths)
    first: dict[bytes, int] = {}
    bounds = list(zip((upto - lengths).tolist(), upto.tolist()))
    order = np.argsort(ids, kind="stable")
    standing = np.array([first.setdefault(text[bounds[i][0] : bounds[i][1]], i) for i in order.tolist()], np.int64)
    later, same = order[ids[order] > ids[standing]], (ids[order] == ids[standing]) & (order != standing)
    of = np.fromiter(first.values(), np.int64, len(first))
    distinct, found = list(first), []
    for part in np.unique(parts[of]):
        own = np.flatnonzero(parts[of] == part)
        segment, place = earlier_windows(np.frombuffer(b"".join([distinct[i] for i in own]), np.uint8), lengths[of[own]], ids[of[own]])
        found.append((own[segment], place))
    segment, place = (np.concatenate(x) for x in zip(*found))
    # Adjacent windows of a segment become one mark.
    sort = np.lexsort((place, of[segment]))
    at, place = of[segment][sort], place[sort]
    begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)])[: len(at)])
    last = np.concatenate([begin[1:], [len(at)]])[: len(begin)] - 1
    at, low, size = at[begin], place[begin], place[last] - place[begin] + LENGTH
    who, mark = _spread(standing[same], at)
    at, low, size = np.concatenate([at, order[same][who], later]), np.concatenate([low, low[mark], np.zeros(len(later), np.int64)]), np.concatenate([size, size[mark], lengths[later]])
    sort = np.argsort(at, kind="stable")
    at, low, size = at[sort], low[sort], size[sort]
    who, mark = _spread(twin_of, at)
    at, begin = np.concatenate([at, at[mark]]), np.concatenate([starts[at] + low, twin_starts[who] + low[mark]])
    return ids[at], keys[at], begin, np.concatenate([size, size[mark]])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, blobs in _by_bucket(batches, 8):
        keys, starts, lengths = (numbers(x, np.int64) for x in blobs[1:4])
        ids = np.concatenate([np.cumsum(numbers([x], np.int64)) for x in blobs[0]])
        if bucket < 0:
            doc_id, key, begin, size = ids, keys, starts, lengths
        else:
            before = np.cumsum([0, *(len(x) // 8 for x in blobs[0])])[:-1]
            twins = np.concatenate([numbers([x], np.int64) + base for x, base in zip(blobs[7], before)])
            parts = np.frombuffer(b"".join(blobs[5]), np.uint8)
            sizes = [int(numbers([x], np.int64).sum()) for x in blobs[3]]
            text = b"".join(pa.decompress(x, n, "zstd", asbytes=True) for x, n in zip(blobs[4], sizes))
            doc_id, key, begin, size = _bucket_marks(ids, keys, starts, lengths, text, parts, numbers(blobs[6], np.int64), twins)
        if len(doc_id):
            # A mark is one number: the text it is for, where it begins, and its length.
            yield pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(key << 40 | begin << 8 | size)], ["doc_id", "mark"])


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that some intervals cover."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return begins[first], reach[np.concatenate([first[1:], [len(begins)]]) - 1]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT) -> DataFrame:
    """(doc_id, key, text, marks) per row of ``docs``: the byte intervals to remove from the rows with this id,
    as numbers that hold a text's key, a begin and a length; not yet merged."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    doc_id = F.col("doc_id") if dict(rows.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    # The key tells rows with the same id apart.
    rows = rows.select(doc_id, F.hash("text").bitwiseAND((1 << _KEY_BITS) - 1).alias("key"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    with_id = rows.where("doc_id IS NOT NULL")

    def by_bucket(blobs: DataFrame, n: int) -> DataFrame:
        """Rows of one bucket in one task; where there are more buckets than partitions, as many partitions as buckets."""
        default = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = blobs.repartition(n, F.col("bucket")) if n > default else blobs.repartition(F.col("bucket"))
        return dealt.sortWithinPartitions("bucket")

    shared = materialize(by_bucket(with_id.mapInArrow(_anchor_rows(buckets), _ANCHOR_ROWS), buckets).mapInArrow(_sharing(hot_contexts), "doc_id long, place long"), "anchors")
    table, n_hot = bitmap(shared.where("doc_id IS NULL"), "place")
    hot = docs.sparkSession.sparkContext.broadcast(table) if n_hot else None
    places = shared.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    # The same in each use, so that both uses are one exchange.
    texts = with_id.repartition("doc_id")
    cut = texts.join(places, "doc_id").select("doc_id", "key", "text", "places").mapInArrow(_segment_rows(INDEX_BUCKETS * buckets, hot), _SEGMENT_ROWS)
    segment_rows = by_bucket(cut, INDEX_BUCKETS * buckets)
    marks = segment_rows.mapInArrow(_matched, "doc_id long, mark long").groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    without_id = rows.where("doc_id IS NULL").select("doc_id", "key", "text", F.lit(None).cast("array<bigint>").alias("marks"))
    return texts.join(marks, "doc_id", "left").select("doc_id", "key", "text", "marks").union(without_id)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, marks in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
            marks = np.array(marks or (), np.int64)
            marks = marks[marks >> 40 == key]
            begins = marks >> 8 & 0xFFFFFFFF
            begins, ends = merged(begins, begins + (marks & 255)) if len(marks) else ((), ())
            kept, at = [], 0
            for a, b in zip(begins, ends):
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((len(text), len(text) - len(rest), len(begins), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_contexts: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left
    (bytes that are no longer whole characters are replaced in it, not in the digest)."""
    spans = removed_spans(docs, id_col, text_col, bucket_bytes, hot_contexts)
    return spans.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")

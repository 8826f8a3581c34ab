"""Substring dedup over bytes: repeated strings found by sorting suffixes, and merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``n`` bytes that covers it also starts earlier, in a row of smaller id or earlier in the same row.

1. The anchor of a string of ``n`` bytes is the smallest hash of its ``m``-byte substrings. Equal strings have equal anchors, and
   neighbouring strings mostly share one, so a document falls into runs of strings of one anchor. Anchors are counted in
   the merged count-min sketch of ``substring``; runs of anchors that occur once are left out, which loses no repeat.
2. A task keeps the runs that it has met. Whole runs that it meets again are settled at once, byte by byte; the others are handed
   on as they are, to buckets by their anchor. So a passage that very many documents share leaves a task about once.
3. A bucket settles whole runs in the same way. What is left to compare are runs of one anchor that differ, as at the edges
   of a passage or next to an edit, and runs that have their anchor twice. Only their suffixes are sorted, by doubling, ``SHARD`` bytes at
   a time with the runs of an anchor together; strings of ``n`` bytes that repeat are neighbours there.
4. Runs of one anchor that are more than a few shards are sorted in several, and the Burrows-Wheeler transforms of these are merged. That starts
   from all suffixes in one block and refines the interleaving ``STEP`` characters at a time: a row goes to the place of the suffix that is
   so much longer (LF mapping), in the order of the characters put in front (numbered once for all rows) and then of the rows before, so each
   shard's own order is kept and no suffix is sorted again. Rows stay in a block while their suffixes have equal prefixes; the
   round in which neighbours part is their common prefix. Blocks with rows of one shard only never find a partner and are dropped. What
   is left at ``n`` are the repeated intervals, byte for byte; all but the first of each are repeated.

Buckets of more than ``most`` bytes, as when one anchor is in a third of all documents next to ever different text, are
taken apart: their strings are dealt out one by one to buckets by a hash of the whole string.

Rows of equal texts are settled before all that by 128 bits of hash. The sketch has at most ``max_bits`` (2^30) bits a row, for
some 250 million anchors or 9 GB of text at full strength; beyond that more runs are handed on, and the result is the same.

Defined cases: null texts are empty; a null id sorts before all others; rows that repeat an id and its text are one document,
judged alike; rows of one id and different texts are ordered by a hash of the text; an id that is no integer is an error at entry; a very
long text is a chunk of its own, with some 60 bytes of tables for each of its bytes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized
from .substring import MAX_BITS, NULL_ID, Hasher, cells, chunks, keyed, merged_runs, sketch, whole_copies

U = np.uint64
#: Bytes of texts looked at together, of strings a shard, of text a bucket, and of strings of a bucket that is taken apart.
CHUNK, SHARD, BUCKET, MOST = 1 << 20, 1 << 18, 1 << 21, 24 << 20
#: Strings of a bucket taken apart that are dealt out together.
DEALT = 1 << 16
#: Bytes and strings that a task remembers.
POOL, SEEN = 32 << 20, 1 << 19
#: Characters by which the interleaving is refined at a time, at most.
STEP = 16
#: Symbols of nine bits in a first sorting key.
FIRST = 7
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
ROW = "bucket long, bytes int, payload binary, key long, text_hash long, first int, words int"


def anchor_bytes(n: int) -> int:
    if n < 16:
        raise ValueError("strings of at least 16 bytes")
    return 8 * max(1, min(4, n // 24))


def hashes(data: np.ndarray, m: int) -> np.ndarray:
    """A hash of the ``m`` bytes from each place on; the last ``m - 1`` are of bytes and zeros."""
    padded = np.zeros(len(data) + m + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + m, "<u8", padded, strides=(1,)).astype(U)
    h = words[: len(data)] * U(FACTORS[0])
    for k in range(1, m // 8):
        h ^= h >> U(31)
        h += words[8 * k : 8 * k + len(data)] * U(FACTORS[k])
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def whole_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """A hash of each string ``start``, ``length`` (``n`` bytes at least, those of a run at most) from the ``hashes`` of pieces that cover it."""
    m = anchor_bytes(n)
    own = length.astype(U)
    for k in range(0, int(length.max(initial=0)), m):
        own = np.where(k < length, Hasher.mix(own, k) + h[start + np.minimum(k, length - m)], own)
    return own


def sliding(x: np.ndarray, w: int, of: Callable) -> np.ndarray:
    """Minima or maxima of each ``w`` values in a row."""
    span = 1
    while 2 * span <= w:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(data: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all places; the anchor of each string of ``n`` bytes, and whether it lies in one text."""
    m = anchor_bytes(n)
    if len(data) < n:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool)
    h = hashes(data, m)[: len(data) - m + 1]
    least = sliding(h, n - m + 1, np.minimum)
    ends = np.zeros(len(data) + 1, np.int32)
    np.add.at(ends, np.maximum(begin[1:] - (n - 1), begin[:-1]), 1)
    np.add.at(ends, begin[1:], -1)
    return h, least, np.cumsum(ends[: len(least)]) == 0


def runs(data: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all places; first place, count of strings of ``n`` bytes and anchor of each run of strings of one anchor in one text,
    none longer than a window of places."""
    h, least, whole = anchors(data, begin, n)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    new[begin[begin < len(least)]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    some = whole[start]
    start, count, anchor = start[some], count[some], least[start[some]]
    w = n - anchor_bytes(n) + 1
    pieces = -(-count // w)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return h, np.repeat(start, pieces) + nth * w, np.minimum(np.repeat(count, pieces) - nth * w, w), np.repeat(anchor, pieces)


def anchor_places(n: int) -> Callable:
    """Two hashes of each place whose hash is the anchor of a string over it, as ``sketch`` counts them."""

    def hashed(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, least, whole = anchors(data, begin, n)
        w = n - anchor_bytes(n) + 1
        held = np.zeros(len(least) + 2 * (w - 1), U)
        held[w - 1 : w - 1 + len(least)] = np.where(whole, least, U(0))
        found = h[sliding(held, w, np.maximum) == h] if len(h) else h
        return found, Hasher.mix(found, 3)

    return hashed


def sorted_suffixes(text: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes of a concatenation of strings in order, each round two or three times as deep.

    ``text`` has byte + 1 for each character and 0 at the end of each string; ``left`` says how many characters stand before that end.
    Ends are ordered by place. Also the ranks at the largest depth up to ``n`` that there is, and that depth.
    """
    size = len(text)
    padded = np.zeros(size + FIRST, np.uint32)
    padded[:size] = text
    two = padded[:-1] << np.uint32(9) | padded[1:]
    key = (two[: size + 2].astype(U) << U(18) | two[2 : size + 4])[:size]
    key = (key << U(18) | two[4 : size + 4]) << U(9) | padded[6 : size + 6]
    ends = np.flatnonzero(text == 0)
    for k in range(FIRST):  # nothing behind an end counts
        at = ends[ends >= k] - k
        at = at[left[at] == k]
        key[at] &= ~U((1 << 9 * (FIRST - 1 - k)) - 1)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(size + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    every = np.arange(size, dtype=np.int32)
    rank = np.empty(size, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], every, np.int32(0)))
    terms, bits = (3, U(21)) if size < 1 << 21 else (2, U(32))  # ranks that fit a key
    depth, half, at_half = FIRST, rank, FIRST
    while True:
        if depth <= n:
            half, at_half = rank.copy(), depth
        open_ = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(open_):
            return order, half, at_half
        own, at = order[open_], open_.astype(np.int32)
        rest = left[own]
        key = rank[own].astype(U)
        for k in range(1, terms):  # behind an end all that counts is its place
            key = key << bits | np.where(rest < k * depth, own, rank[np.minimum(own + k * depth, size - 1)]).astype(U)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        differs = np.ones(len(open_), bool)
        differs[1:] = key[1:] != key[:-1]
        new[open_[differs]] = True
        rank[own] = np.maximum.accumulate(np.where(differs, at, np.int32(0)))
        depth *= terms


def ordered(key: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Number of each document in order of key and hash."""
    by = np.lexsort((hashed, key))
    new = (key[by][1:] != key[by][:-1]) | (hashed[by][1:] != hashed[by][:-1])
    out = np.zeros(len(by), np.int64)
    out[by[1:]] = np.cumsum(new)
    return out


def found_again(key: np.ndarray, hashed: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Rows of ``ROW`` for repeated runs of ``size`` bytes from ``first`` on."""
    k = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, -1)), pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.binary()), pa.array(key), pa.array(hashed), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))],
        ["bucket", "bytes", "payload", "key", "text_hash", "first", "words"],
    )


def spans_of(string: np.ndarray, offset: np.ndarray, key: np.ndarray, hashed: np.ndarray, first: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of repeated places ``(string, offset)``, runs of them as one."""
    by = np.lexsort((offset, string))
    string, offset = string[by], offset[by]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(string)) - 1
    s = string[start]
    return found_again(key[s], hashed[s], first[s] + offset[start], offset[end] - offset[start] + n)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``a[at:at + length]`` and ``b[bt:bt + length]`` are equal, eight bytes at a time."""
    out = np.ones(len(at), bool)
    if not len(at):
        return out
    x, y = eights(a), eights(b)
    for k in range(0, int(length.max()), 8):
        k = np.minimum(k, length - 8)
        out &= x[at + k] == y[bt + k]
    return out


def joined(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> bytes:
    """Strings one after the other."""
    view = memoryview(data)
    return b"".join([view[a:b] for a, b in zip(begin.tolist(), (begin + length).tolist())])


def repeated(data: np.ndarray, hashed: np.ndarray, begin: np.ndarray, length: np.ndarray, key: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings those that are equal to the first with their hash, apart from that one; and whether they stand elsewhere."""
    by = np.argsort(hashed)
    equal = hashed[by][1:] == hashed[by][:-1]
    some = by[np.append(equal, False) | np.append(False, equal)] if len(by) else by
    some = some[np.lexsort((first[some], text[some], key[some], hashed[some]))]
    new = np.ones(len(some), bool)
    new[1:] = hashed[some][1:] != hashed[some][:-1]
    head = some[new][np.cumsum(new) - 1]
    pair = ~new & (length[some] == length[head])
    some, head = some[pair], head[pair]
    equal = same(data, begin[some], data, begin[head], length[some])
    some, head = some[equal], head[equal]
    return some, (key[some] != key[head]) | (text[some] != text[head]) | (first[some] != first[head])


class Strings:
    """Strings that a task has seen, so that whole copies of them are settled at once; compared byte by byte.

    They are held in a pool of bytes, from which they are handed on; a full pool is emptied.
    """

    def __init__(self) -> None:
        self.pool = np.zeros(POOL, np.uint8)
        self.table = np.zeros((6, SEEN), np.int64)  # hash, place in the pool, length, key, text hash, place in the text
        self.used, self.pending = 0, []

    def add(self, data: np.ndarray, hashed: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """``strings`` has rows of place in ``data``, length, anchor, key, text hash and place in the text; which repeat as a whole.

        The others, all those that are earlier than what they equal among them, are kept to be handed on. ``hashed`` has a hash of each.
        """
        at, length, _, key, text, first = strings
        fresh = np.ones(len(at), bool)
        again = np.zeros(len(at), bool)
        some, elsewhere = repeated(data, hashed, at, length, key, text, first)
        fresh[some] = False
        again[some] = elsewhere
        slot = hashed & (SEEN - 1)
        some = np.flatnonzero(fresh & (self.table[0][slot] == hashed))
        _, place, size, k, t, f = self.table[:, slot[some]]
        earlier = (k < key[some]) | (k == key[some]) & ((t < text[some]) | (t == text[some]) & (f < first[some]))
        earlier &= size == length[some]
        some, place = some[earlier], place[earlier]
        some = some[same(data, at[some], self.pool, place, length[some])]
        fresh[some] = False
        again[some] = True
        fresh = np.flatnonzero(fresh)
        own = np.frombuffer(joined(data, at[fresh], length[fresh]), np.uint8)
        if self.used + len(own) + 8 > len(self.pool):
            self.table[:] = 0
            self.used = 0
            if len(own) + 8 > len(self.pool):
                self.pool = np.zeros(len(own) + 8, np.uint8)
        self.pool[self.used : self.used + len(own)] = own
        mine = strings[:, fresh]
        mine[0] = self.used + np.cumsum(length[fresh]) - length[fresh]
        self.table[:, slot[fresh]] = np.stack((hashed[fresh], *mine[[0, 1, 3, 4, 5]]))
        self.pending.append(mine)
        self.used += len(own)
        return again

    def full(self, more: int) -> bool:
        """Whether strings are to be handed on before ``more`` bytes come."""
        return self.used + more + 8 > len(self.pool)

    def handed_on(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The strings kept since the last time, one row a bucket."""
        if self.pending:
            at, length, anchor, key, text, first = np.concatenate(self.pending, axis=1)
            self.pending = []
            anchor = anchor.view(U)
            yield from packed(self.pool, at, length, (Hasher.mix(anchor, 11) % U(buckets)).astype(np.int64), anchor, key, text, first)


def rows_of(bucket: np.ndarray, size: np.ndarray, payload: list[bytes]) -> pa.RecordBatch:
    """Rows of ``ROW`` for what goes to buckets."""
    k = len(payload)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(size.astype(np.int32)), pa.array(payload, pa.binary()), *(pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
        ["bucket", "bytes", "payload", "key", "text_hash", "first", "words"],
    )


def packed(data: np.ndarray, begin: np.ndarray, length: np.ndarray, bucket: np.ndarray, like: np.ndarray, key: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row of strings a bucket; those of equal ``like`` stand together, as they compress."""
    by = np.lexsort((like, bucket))
    begin, length, bucket, key, hashed, first = (x[by] for x in (begin, length, bucket, key, hashed, first))
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    if not len(edge):
        return
    first, size = first.astype(np.int32), length.astype(np.int32)
    z = zstandard.ZstdCompressor(level=1)
    payload = []
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
        numbers = (np.array([b - a]), key[a:b], hashed[a:b], first[a:b], size[a:b])
        payload.append(z.compress(b"".join((*(x.tobytes() for x in numbers), joined(data, begin[a:b], length[a:b])))))
    yield rows_of(bucket[edge], np.add.reduceat(length, edge), payload)


def strings_of(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Bytes of the strings in rows of ``packed``, one after the other; place, length, key, hash and first of each."""
    z = zstandard.ZstdDecompressor()
    data, columns = [], ([], [], [], [])
    for payload in payloads:
        raw = z.decompress(payload)
        count, place = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32)):
            column.append(np.frombuffer(raw, kind, count, place))
            place += count * np.dtype(kind).itemsize
        data.append(np.frombuffer(raw, np.uint8, offset=place))
    key, hashed, first, length = map(np.concatenate, columns)
    length = length.astype(np.int64)
    return np.concatenate(data), np.cumsum(length) - length, length, key, hashed, first


def transforms(data: np.ndarray, begin: np.ndarray, length: np.ndarray, bucket: np.ndarray, key: np.ndarray, hashed: np.ndarray, first: np.ndarray, n: int, alone: bool = False) -> Iterator[pa.RecordBatch]:
    """The shard of strings ``data[begin:begin + length]``, which stand at ``first`` of the text ``(key, hashed)``: what repeats in it,
    and, unless it is ``alone``, a transform for each bucket of the strings that have a first occurrence of ``n`` bytes."""
    if not len(begin):
        return
    by = np.lexsort((begin, bucket))
    begin, length, bucket, key, hashed, first = (x[by] for x in (begin, length, bucket, key, hashed, first))
    full = length + 1
    start = np.cumsum(full) - full
    size = int(full.sum())
    string = np.repeat(np.arange(len(begin), dtype=np.int32), full)
    offset = np.arange(size) - start[string]
    left = (length[string] - offset).astype(np.int32)
    text = np.zeros(size, np.uint16)
    inside = left > 0
    text[inside] = data[(begin[string] + offset)[inside]].astype(np.uint16) + 1
    order, half, depth = sorted_suffixes(text, left, n)
    # Strings of n bytes in order; equal ones are neighbours.
    row = order[left[order] >= n]
    new = np.ones(len(row), bool)
    new[1:] = False
    for at in (*range(0, n - depth, depth), n - depth):
        part = half[row + at]
        new[1:] |= part[1:] != part[:-1]
    again = np.zeros(size, bool)
    if not new.all():
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        row, new = row[several], new[several]
        place = ordered(key, hashed)[string[row]] << 32 | first[string[row]] + offset[row]
        edge = np.flatnonzero(new)
        least = np.minimum.reduceat(place, edge)
        again[row] = place > np.repeat(least, np.diff(np.append(edge, len(row))))
        at = np.flatnonzero(again)
        if len(at):
            yield spans_of(string[at], offset[at], key, hashed, first, n)
    if alone:
        return
    fresh = np.bincount(string[(left >= n) & ~again], minlength=len(begin)) > 0
    rows = order[fresh[string[order]]]
    dense = np.cumsum(np.diff(bucket, prepend=bucket[:1]) > 0)
    dense = dense.astype(np.uint16 if dense[-1] < 1 << 16 else np.int64)  # short integers sort in linear time
    rows = rows[np.argsort(dense[string[rows]], kind="stable")]
    kept = np.flatnonzero(fresh)
    if not len(kept):
        return
    head = offset[rows] == 0
    last = text[rows - 1]  # of a head whatever stands there
    symbols = np.where(head, 0, last - np.uint16(1)).astype(np.uint8)
    row_edge = np.flatnonzero(np.diff(bucket[string[rows]], prepend=-1))
    row_end = np.append(row_edge[1:], len(rows))
    edge = np.flatnonzero(np.diff(bucket[kept], prepend=-1))
    end = np.append(edge[1:], len(kept))
    heads = np.flatnonzero(head)
    head_edge = np.searchsorted(heads, row_edge)
    head_end = np.append(head_edge[1:], len(heads))
    z = zstandard.ZstdCompressor(level=1)
    payload = []
    for a, b, r, t, c, d in zip(edge, end, row_edge, row_end, head_edge, head_end):
        s = kept[a:b]
        numbers = [np.array([t - r, b - a], np.int64), key[s], hashed[s], first[s].astype(np.int32), length[s].astype(np.int32), (heads[c:d] - r).astype(np.int32), symbols[r:t]]
        payload.append(z.compress(b"".join(x.tobytes() for x in numbers)))
    yield rows_of(bucket[kept[edge]], row_end - row_edge, payload)


def unpacked(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the shards' transforms, one after the other: symbols (byte + 1, 0 for the start of a string), the shard and LF mapping of each
    row; key, hash, first, length and last row of each string."""
    z = zstandard.ZstdDecompressor()
    symbols, shard, ends, columns, at = [], [], [], ([], [], [], []), 0
    for k, payload in enumerate(payloads):
        raw = z.decompress(payload)
        rows, strings = np.frombuffer(raw, np.int64, 2)
        place = 16
        for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32)):
            column.append(np.frombuffer(raw, kind, strings, place))
            place += strings * np.dtype(kind).itemsize
        heads = np.frombuffer(raw, np.int32, strings, place)
        own = np.frombuffer(raw, np.uint8, rows, place + 4 * strings).astype(np.uint16) + 1
        own[heads] = 0
        symbols.append(own)
        shard.append(np.full(rows, k, np.int32))
        ends.append(at + np.arange(strings))  # ends of strings sort first, in their order
        at += rows
    symbols, shard = np.concatenate(symbols), np.concatenate(shard)
    row = np.sort(shard.astype(U) << U(41) | symbols.astype(U) << U(32) | np.arange(at, dtype=U)) & U(0xFFFFFFFF)
    before = np.empty(at, np.int64)
    before[row.astype(np.int64)] = np.arange(at)
    return symbols, shard, before, *map(np.concatenate, columns), np.concatenate(ends)


def walked(before: np.ndarray, length: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and strings from each string's end to its start, a character at a time."""
    by = np.argsort(-length, kind="stable")
    row, left = ends[by], length[by]
    for step in range(int(length.max()) + 1):
        some = np.searchsorted(-left, -step, side="right")  # strings of that length or more
        yield row[:some], by[:some]
        row = before[row[:some]]
        left, by = left[:some], by[:some]


def interleaved(symbols: np.ndarray, shard: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose suffixes share ``n`` characters with one of another shard, in order, and the number of their block."""
    front, to, whole = (symbols - np.uint16(1)).astype(np.uint8).astype(U), before, symbols > 0  # without a character before, whatever stands here
    fronts = {1: (front, to, whole)}
    for k, bits in ((2, 8), (4, 16), (8, 32), (STEP, 32)):
        front, to, whole = front[to] << U(bits) | front, to[to], whole & whole[to]
        if k >= 8:  # numbers in order instead of characters
            by = np.argsort(front)
            number = np.zeros(len(front), np.int64)
            number[by[1:]] = np.cumsum(front[by][1:] != front[by][:-1])
            front = number.astype(U)
        fronts[k] = front, to, whole
    row, block = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    depth = 0
    while depth < n and len(row):
        step = max(k for k in fronts if k <= n - depth)
        put, to, whole = fronts[step]
        some = whole[row]
        row, block = row[some], block[some]
        by = np.sort(put[row] << U(32) | np.arange(len(row), dtype=U))
        front, by = by >> U(32), (by & U(0xFFFFFFFF)).astype(np.int64)
        row, block = to[row[by]], block[by]
        new = np.ones(len(row), bool)
        new[1:] = (front[1:] != front[:-1]) | (block[1:] != block[:-1])
        depth += step
        edge = np.flatnonzero(new)
        if not len(edge):
            break
        own = shard[row]
        mixed = np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)
        keep = np.repeat(mixed, np.diff(np.append(edge, len(row))))
        row, block = row[keep], (np.cumsum(new) - 1)[keep]
    return row, block


def merged(payloads: list[bytes], n: int) -> Iterator[pa.RecordBatch]:
    """What repeats between the shards of a bucket."""
    if len(payloads) < 2:
        return
    symbols, shard, before, key, hashed, first, length, ends = unpacked(payloads)
    row, block = interleaved(symbols, shard, before, n)
    if not len(row):
        return
    string, offset = np.empty(len(symbols), np.int32), np.empty(len(symbols), np.int32)
    for step, (at, of) in enumerate(walked(before, length, ends)):
        string[at] = of
        offset[at] = length[of] - step
    string, offset = string[row].astype(np.int64), offset[row].astype(np.int64)
    place = ordered(key, hashed)[string] << 32 | first[string] + offset
    edge = np.flatnonzero(np.diff(block, prepend=-1))
    again = place > np.repeat(np.minimum.reduceat(place, edge), np.diff(np.append(edge, len(block))))
    if again.any():
        yield spans_of(string[again], offset[again], key, hashed, first, n)


def differing(data: np.ndarray, begin: np.ndarray, length: np.ndarray, key: np.ndarray, hashed: np.ndarray, first: np.ndarray, group: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """What repeats among strings in order of ``group``, of which only those of one group can share ``n`` bytes."""
    before = np.cumsum(length) - length
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    shard = np.repeat(before[edge] // SHARD, np.diff(np.append(edge, len(group))))  # a shard ends with a group
    edge = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(shard))):
        size = before[b - 1] + length[b - 1] - before[a]
        parts = [slice(a, b)]
        if size > 4 * SHARD:  # a group that is more than that
            cuts = a + np.flatnonzero(np.diff((before[a:b] - before[a]) // SHARD, prepend=-1))
            parts = [slice(c, d) for c, d in zip(cuts, np.append(cuts[1:], b))]
        payloads = []
        for part in parts:
            own = (x[part] for x in (begin, length, np.zeros_like(key), key, hashed, first))
            for batch in transforms(data, *own, n, alone=len(parts) == 1):
                if batch.column("payload").null_count:
                    yield batch
                else:
                    payloads += batch.column("payload").to_pylist()
        yield from merged(payloads, n)


def settled(payloads: list[bytes], n: int) -> Iterator[pa.RecordBatch]:
    """What repeats among the strings of a bucket."""
    data, begin, length, key, hashed, first = strings_of(payloads)
    m = anchor_bytes(n)
    own, anchor, twice = np.empty(len(begin), U), np.empty(len(begin), U), np.empty(len(begin), bool)
    edge = np.searchsorted(begin, np.arange(0, len(data), CHUNK)).tolist()
    for a, b in zip(edge, [*edge[1:], len(begin)]):
        if a < b:
            h = hashes(data[begin[a] : begin[b - 1] + length[b - 1]], m)
            at = begin[a:b] - begin[a]
            own[a:b] = whole_hashes(h, at, length[a:b], n)
            anchor[a:b] = np.minimum.reduceat(h, np.stack((at, at + n - m + 1), 1).ravel())[::2]
            twice[a:b] = np.add.reduceat(h == np.repeat(anchor[a:b], length[a:b]), at, dtype=np.int64) > 1
    some, elsewhere = repeated(data, own, begin, length, key, hashed, first)
    fresh = np.ones(len(begin), bool)
    fresh[some] = False
    some = some[elsewhere]
    if len(some):
        yield found_again(key[some], hashed[some], first[some], length[some])
    # Only strings of one anchor can share n bytes, and those of n bytes do not, since they differ.
    by = np.flatnonzero(fresh)
    by = by[np.argsort(anchor[by])]
    new = np.ones(len(by), bool)
    new[1:] = anchor[by][1:] != anchor[by][:-1]
    edge, group = np.flatnonzero(new), np.cumsum(new) - 1
    open_ = (np.maximum.reduceat(length[by], edge) > n) & (np.bincount(group) > 1) | np.logical_or.reduceat(twice[by], edge)
    some = open_[group]
    by, group = by[some], group[some]
    if len(by):
        yield from differing(data, *(x[by] for x in (begin, length, key, hashed, first)), group, n)


def single(payload: bytes, buckets: int, base: int, n: int) -> Iterator[pa.RecordBatch]:
    """The strings of a row one by one, ``n`` bytes each, in buckets by a hash of all of them."""
    data, begin, length, key, hashed, first = strings_of([payload])
    total = np.cumsum(length - n + 1)
    edge = np.searchsorted(total, np.arange(0, total[-1], DEALT), side="right").tolist()
    for a, b in zip(edge, [*edge[1:], len(begin)]):
        if a == b:
            continue
        count = length[a:b] - n + 1
        string = np.repeat(np.arange(a, b), count)
        offset = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
        at, size = begin[string] + offset, np.full(len(string), n)
        own = whole_hashes(hashes(data[begin[a] : begin[b - 1] + length[b - 1]], anchor_bytes(n)), at - begin[a], size, n)
        k, t, f = key[string], hashed[string], first[string] + offset
        some, elsewhere = repeated(data, own, at, size, k, t, f)
        fresh = np.ones(len(at), bool)
        fresh[some] = False
        some = some[elsewhere]
        if len(some):
            yield spans_of(string[some], offset[some], key, hashed, first, n)
        yield from packed(data, *(x[fresh] for x in (at, size, base + (Hasher.mix(own, 9) % U(buckets)).astype(np.int64), own, k, t, f)))


def repeats(docs: DataFrame, n: int = 100, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """``(key, text_hash, spans)``: the merged byte runs ``(first, words)`` of repeated strings; ``docs`` as of ``substring.keyed``."""
    copies = whole_copies(docs)
    docs = docs.join(copies, ["key", "text_hash"], "left_anti")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1 << min(max_bits.bit_length() - 1, max(16, (size // 16).bit_length() + 1))
    planes = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits, lambda: anchor_places(n)))
    buckets = max(16, size // BUCKET)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, held = planes.value, Strings()
        for batch in batches:
            keys, hashed = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b, data, begin in chunks(batch.column(2), CHUNK):
                h, start, count, anchor = runs(data, begin, n)
                keep = np.ones(len(start), bool)
                for plane, cell in zip(many, cells(anchor, Hasher.mix(anchor, 3), bits)):
                    keep &= (plane[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                start, count, anchor = start[keep], count[keep], anchor[keep]
                if not len(start):
                    continue
                length = count + n - 1
                own = whole_hashes(h, start, length, n)
                text = np.searchsorted(begin, start, side="right") - 1
                strings = np.stack((start, length, anchor.view(np.int64), keys[a:b][text], hashed[a:b][text], start - begin[text]))
                if held.full(int(length.sum())):
                    yield from held.handed_on(buckets)
                again = held.add(data, own.view(np.int64), strings)
                if again.any():
                    _, length, _, key, text, first = strings[:, again]
                    yield found_again(key, text, first, length)
        yield from held.handed_on(buckets)

    found = cut(docs.select("key", "text_hash", "text").mapInArrow(runs_of, ROW))
    known = found.filter("bucket < 0")
    held = found.filter("bucket >= 0")
    sizes = held.groupBy("bucket").agg(F.sum("bytes").alias("total"))
    large = sized(sizes.filter(F.col("total") > most).withColumn("buckets", F.ceil(F.col("total") * 16 / BUCKET).cast("long")), 100_000)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, bucket, k in zip(*(batch.column(c).to_pylist() for c in ("payload", "bucket", "buckets"))):
                yield from single(payload, k, (bucket + 1) << 31, n)

    def met(table: pa.Table) -> pa.Table:
        batches = list(settled(table.column("payload").to_pylist(), n))
        return pa.Table.from_batches(batches, schema) if batches else schema.empty_table()

    schema = pa.schema([("bucket", pa.int64()), ("bytes", pa.int32()), ("payload", pa.binary()), ("key", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("words", pa.int32())])
    if large.isEmpty():
        between = held.groupBy("bucket").applyInArrow(met, ROW)
    else:
        # One row a string of n bytes is a hundred times the text, but only of what stands next to very common strings.
        dealt = cut(held.join(large, "bucket").repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(apart, ROW))
        known = known.unionByName(dealt.filter("bucket < 0"))
        between = held.join(large, "bucket", "left_anti").unionByName(dealt.filter("bucket >= 0")).groupBy("bucket").applyInArrow(met, ROW)
    return merged_runs(known.unionByName(between).select("key", "text_hash", "first", "words"), copies)


def remove_repeats(docs: DataFrame, n: int = 100, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept``; ``kept`` has the other bytes, which need not be UTF-8."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be of an integer type, since smaller ids come first")
    own = keyed(docs, id_col, text_col)
    marked = own.join(repeats(own, n, max_bits, most), ["key", "text_hash"], "left").select("key", "text", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, removed, counts, rest = [], [], [], [], []
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                spans = (spans or []) if len(data) >= n else []
                pieces, at = [], 0
                for s in spans:
                    pieces.append(data[at : s["first"]])
                    at = min(len(data), s["first"] + s["words"])
                pieces.append(data[at:])
                keys.append(None if key == NULL_ID else key)
                sizes.append(len(data))
                rest.append(b"".join(pieces))
                removed.append(len(data) - len(rest[-1]))
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, sizes, removed, counts)), pa.array(rest, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")

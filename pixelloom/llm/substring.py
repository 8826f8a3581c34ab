"""Substring dedup: repeated word windows, found through a count-min prefilter.

Words are runs of anything but ASCII white space. A word goes if a window of ``n`` consecutive words
that covers it also starts earlier, in a row of smaller id or earlier in the same row.

1. Of rows of equal texts only the first goes on; every word of the others is repeated, if there is a
   window at all. Every task hashes its windows and counts them in a count-min sketch of two rows. A cell
   only needs to know 0, 1 or more, so it is two bits, kept as two bit planes; merging two sketches is
   ``many = a.many | b.many | (a.one & b.one)``, block by block. Merged cells never underestimate.
2. A second pass hands on only windows whose cells say "more", which loses none that repeat. Inside
   one chunk of documents all but the first of equal windows are marked at once, and so are those of later chunks of the
   same task of which an earlier one is still in a table of ``SEEN`` places; so a passage that
   very many documents share reaches the shuffle about once a task. The rest is ranked exactly by hash.

The sketch has two to four bits a row for each word, a power of two in all, and at most
``max_bits`` (2^30: 128 MB a plane, the bound of what is broadcast). Beyond that more unrepeated
windows pass the prefilter and are shuffled; the result stays the same.

Defined cases: null texts have no words; a null id sorts before all others; rows that repeat an id
and its text are one document, judged alike; rows of one id and different texts are ordered by a hash
of the text; a very long text is a chunk of its own, with 40 bytes of tables for each of its bytes; extra columns are
ignored. Windows count as equal if 96 bits of hash are, made from two independent hashes of each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, sized

MAX_BITS = 1 << 30
BLOCK_BITS = 1 << 19
ROWS = 2
MAX_BROADCAST = 2_000_000
WHOLE = (1 << 31) - 1
CHUNK_BYTES = 1 << 20
SEEN = 1 << 18
NULL_ID = -(1 << 63)
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` and its inverse, to the powers 0..n-1, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


class Hasher:
    """Polynomial hashes of words and of word windows; its tables grow with the longest chunk."""

    BYTE, WINDOW = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)

    def __init__(self) -> None:
        self.n = 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 1)
            self.byte = [powers(b, self.n) for b in self.BYTE]
            self.window = [powers(b, self.n // 2 + 2) for b in self.WINDOW]

    @staticmethod
    def mix(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x ^ U(salt)) * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(32)
        return x

    def words(self, data: np.ndarray, begin: np.ndarray, hashes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (or a row of each of two), start byte and text number of each word; text ``i`` is ``data[begin[i]:begin[i + 1]]``."""
        n = len(data)
        self.grow(n + 1)
        space = SPACE[data]
        before = np.empty(n, bool)
        before[1:] = space[:-1]
        after = np.empty(n, bool)
        after[:-1] = space[1:]
        if n:
            edges = begin[begin < n]
            before[edges] = True
            after[edges[edges > 0] - 1] = True
            after[-1] = True
        first = np.flatnonzero(~space & before)
        last = np.flatnonzero(~space & after) + 1
        length = (last - first).astype(U)
        out = []
        for k in range(hashes):
            up, down = self.byte[k]
            total = np.zeros(n + 1, U)
            np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
            out.append(self.mix((total[last] - total[first]) * down[first] + length * U(0x2545F4914F6CDD1D), k))
        for i in np.flatnonzero(length > 64):  # long words can be made to collide in a polynomial
            full = hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=16).digest()
            for k, h in enumerate(out):
                h[i] = int.from_bytes(full[8 * k : 8 * k + 8], "little")
        return out[0] if hashes == 1 else np.stack(out), first, np.searchsorted(begin, first, side="right") - 1

    def windows(self, h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each window of ``n`` words of one text, and the number of its first word."""
        words = (h, h) if h.ndim == 1 else h
        if len(text) < n:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
        out = []
        for k, (up, down) in enumerate(self.window):
            total = np.zeros(len(text) + 1, U)
            np.cumsum(self.mix(words[k], 0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1) * up[: len(text)], out=total[1:])
            out.append(self.mix((total[at + n] - total[at]) * down[at], k + 1))
        return out[0], out[1], at


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, after last, bytes, offsets)`` of runs of texts of at most ``size`` bytes, or of one text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def cells(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each window in each of the ROWS rows."""
    shift = U(64 - bits.bit_length() + 1)
    return [(x >> shift).astype(np.int64) for x in (h1, h2)]


def count_in(one: np.ndarray, many: np.ndarray, cell: np.ndarray) -> None:
    """Count ``cell`` in the two planes."""
    cell = np.sort(cell)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    repeated = np.zeros(len(cell), bool)
    repeated[:-1] = ~new[1:]
    bit = (1 << (cell & 7)).astype(np.uint8)
    byte = cell >> 3
    again = bit * (repeated | ((one[byte] & bit) != 0))
    edge = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    many[byte[edge]] |= np.bitwise_or.reduceat(again, edge)
    one[byte[edge]] |= np.bitwise_or.reduceat(bit, edge)


def word_windows(n: int) -> Callable:
    """Two hashes of each window of ``n`` words of a chunk of texts, as ``sketch`` counts them."""
    hasher = Hasher()

    def hashed(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, _, text = hasher.words(data, begin, 2)
        return hasher.windows(h, text, n)[:2]

    return hashed


def sketch(docs: DataFrame, bits: int, windows: Callable[[], Callable]) -> list[np.ndarray]:
    """The merged "more than one" planes of what ``windows()`` finds in all rows. What reaches the driver is at most ``ROWS * bits`` bits."""
    block = min(BLOCK_BITS, bits) // 8

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = windows()
        planes = [(np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)) for _ in range(ROWS)]
        some = False
        for batch in batches:
            for _, _, data, begin in chunks(batch.column(0)):
                h1, h2 = hashed(data, begin)
                if len(h1):
                    some = True
                    for plane, cell in zip(planes, cells(h1, h2, bits)):
                        count_in(*plane, cell)
        z = zstandard.ZstdCompressor(level=1)
        for r, (one, many) in enumerate(planes if some else []):
            for k in range(0, bits // 8, block):
                yield pa.RecordBatch.from_pydict({"block": pa.array([r * (bits // 8 // block) + k // block], pa.int32()), "one": [z.compress(one[k : k + block].tobytes())], "many": [z.compress(many[k : k + block].tobytes())]})

    def merged(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        one, many = np.zeros(block, np.uint8), np.zeros(block, np.uint8)
        for a, b in zip(table.column("one"), table.column("many")):
            a, b = (np.frombuffer(z.decompress(x.as_py()), np.uint8) for x in (a, b))
            many |= b | (one & a)
            one |= a
        return pa.table({"block": table.column("block")[:1], "many": pa.array([zstandard.ZstdCompressor(level=1).compress(many.tobytes())], pa.binary())})

    # As many sketches as the cluster runs tasks at a time, however many partitions there are.
    slots = max(4, docs.sparkSession.sparkContext.defaultParallelism)
    parts = docs.select("text").coalesce(slots).mapInArrow(counted, "block int, one binary, many binary")
    planes = [np.zeros(bits // 8, np.uint8) for _ in range(ROWS)]
    z = zstandard.ZstdDecompressor()
    for x in parts.groupBy("block").applyInArrow(merged, "block int, many binary").toLocalIterator(prefetchPartitions=True):
        r, k = divmod(x.block, bits // 8 // block)
        planes[r][k * block : (k + 1) * block] = np.frombuffer(z.decompress(bytes(x.many)), np.uint8)
    return planes


def whole_copies(docs: DataFrame) -> DataFrame:
    """``key, text_hash`` of rows whose text is that of a row of smaller key, by 128 bits of hash."""
    own = docs.select("key", "text_hash", F.xxhash64("text", F.lit(1)).alias("other_hash"))
    first = own.groupBy("text_hash", "other_hash").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last").drop("last")
    return sized(salted_join(own, first, ["text_hash", "other_hash"], 16).filter("key > first").select("key", "text_hash").distinct(), MAX_BROADCAST)


def merged_runs(runs: DataFrame, copies: DataFrame) -> DataFrame:
    """``key, text_hash, spans`` of ``runs (key, text_hash, first, words)``, overlapping and touching ones merged; copies have one of ``WHOLE``."""
    spans = runs.groupBy("key", "text_hash").agg(F.expr("array_sort(collect_set(struct(first, words)))").alias("at"))
    fold = F.expr(
        "aggregate(at, named_struct('s', -1, 'e', -1, 'done', cast(array() as array<struct<first:int,words:int>>)),"
        " (acc, x) -> if(x.first <= acc.e, named_struct('s', acc.s, 'e', greatest(acc.e, x.first + x.words), 'done', acc.done),"
        " named_struct('s', x.first, 'e', x.first + x.words, 'done', if(acc.s < 0, acc.done, concat(acc.done, array(named_struct('first', acc.s, 'words', acc.e - acc.s)))))),"
        " acc -> if(acc.s < 0, acc.done, concat(acc.done, array(named_struct('first', acc.s, 'words', acc.e - acc.s)))))"
    )
    whole = F.expr(f"array(named_struct('first', 0, 'words', {WHOLE}))")
    return spans.select("key", "text_hash", fold.alias("spans")).unionByName(copies.select("key", "text_hash", whole.alias("spans")))


def repeats(docs: DataFrame, n: int = 20, max_bits: int = MAX_BITS) -> DataFrame:
    """``(key, text_hash, spans)``: the merged word runs ``(first, words)`` of repeated windows.

    ``docs`` has the columns ``key`` (long), ``text_hash`` and ``text``. A copy of another row's whole
    text has the run ``(0, WHOLE)``, which only counts if the text has a window.
    """
    copies = whole_copies(docs)
    docs = docs.join(copies, ["key", "text_hash"], "left_anti")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = 1 << min(max_bits.bit_length() - 1, max(16, (size // 6).bit_length() + 1))
    planes = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits, lambda: word_windows(n)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        many = planes.value
        seen = [np.zeros(SEEN, d) for d in (U, U, np.int64, np.int64, np.int64)]  # hashes, key, text hash and place of windows handed on
        seen[2][:] = np.iinfo(np.int64).max  # nothing is later than that
        for batch in batches:
            keys, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b, data, begin in chunks(batch.column(2)):
                h, _, text = hasher.words(data, begin, 2)
                h1, h2, at = hasher.windows(h, text, n)
                keep = np.ones(len(h1), bool)
                for plane, cell in zip(many, cells(h1, h2, bits)):
                    keep &= (plane[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                h1, h2, at = h1[keep], h2[keep], at[keep]
                if not len(at):
                    continue
                first_word = np.searchsorted(text, np.arange(b - a))
                key, hashed, pos = keys[a:b][text[at]], hashes[a:b][text[at]], at - first_word[text[at]]
                # Doc by doc, so that neighbouring rows of the shuffle are alike and compress.
                order = np.lexsort((pos, hashed, key))
                h1, h2, key, hashed, pos = (x[order] for x in (h1, h2, key, hashed, pos))
                order = np.lexsort((h2, h1))  # stable: in each group the first of the documents comes first
                new = np.ones(len(order), bool)
                new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                head = np.empty(len(order), np.int64)
                head[order] = order[new][np.cumsum(new) - 1]
                first = head == np.arange(len(head))
                again = ~first & ((key != key[head]) | (hashed != hashed[head]) | (pos != pos[head]))  # not a copy of its row
                slot = (h1 >> U(7)).astype(np.int64) & (SEEN - 1)
                k, t, p = (x[slot] for x in seen[2:])
                earlier = (seen[0][slot] == h1) & (seen[1][slot] == h2) & ((k < key) | ((k == key) & ((t < hashed) | ((t == hashed) & (p < pos)))))
                again |= first & earlier
                first &= ~earlier
                for held, new in zip(seen, (h1, h2, key, hashed, pos)):
                    held[slot[first]] = new[first]
                yield rows(h1[first], h2[first], key[first], hashed[first], pos[first], 0)
                # What has an earlier equal window here is repeated already; runs of them become one row.
                key, hashed, pos = key[again], hashed[again], pos[again]
                if len(pos):
                    new = np.ones(len(pos), bool)
                    new[1:] = (key[1:] != key[:-1]) | (hashed[1:] != hashed[:-1]) | (pos[1:] > pos[:-1] + 1)
                    start = np.flatnonzero(new)
                    end = np.append(start[1:], len(pos)) - 1
                    spread = Hasher.mix(hashed[start].astype(np.int64).view(U) + pos[start].astype(U), 7)
                    yield rows(spread, spread, key[start], hashed[start], pos[start], pos[end] - pos[start] + n)

    def rows(h1, h2, key, hashed, pos, run) -> pa.RecordBatch:
        run = np.broadcast_to(np.asarray(run, np.int32), len(h1))
        cols = (h1.view(np.int64), (h2 >> U(32)).astype(np.uint32).view(np.int32), key, hashed, pos.astype(np.int32), run)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h1", "h2", "key", "text_hash", "first", "run"])

    found = docs.select("key", "text_hash", "text").mapInArrow(candidates, "h1 long, h2 int, key long, text_hash long, first int, run int")
    # run = 0: the first of its chunk, ranked against other chunks; run > 0: known to repeat.
    ranked = found.selectExpr("*", "rank() over (partition by h1, h2, run > 0 order by key, text_hash, first) as nth")
    return merged_runs(ranked.filter("run > 0 or nth > 1").selectExpr("key", "text_hash", "first", f"if(run > 0, run, {n}) as words"), copies)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, n_removed, kept``; ``kept`` has the other words joined by one space."""
    own = keyed(docs, id_col, text_col)
    marked = own.join(repeats(own, n, max_bits), ["key", "text_hash"], "left").select("key", "text", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, removed, texts = [], [], [], []
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                w = (text.as_py() or "").encode().split()
                counts.append(len(w))
                for s in reversed(spans or []) if counts[-1] >= n else ():
                    del w[s["first"] : s["first"] + s["words"]]
                keys.append(None if key == NULL_ID else key)
                removed.append(counts[-1] - len(w))
                texts.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(kept, "id long, n_words long, n_removed long, kept string")

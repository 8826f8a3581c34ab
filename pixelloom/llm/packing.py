"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenized, get an end token, and are cut into pieces only where they are longer than
the capacity. Full pieces are sequences of their own. The others are packed in rounds over the whole
cluster:

1. The longest documents that are left, as many as the tokens left fill sequences, open sequences
   (later rounds: only documents longer than every gap do).
2. Documents and gaps are sorted together by size, largest first, over range partitions; equal sizes
   are spread by a hash, so that a very common length does not land in one task. A gap that holds
   several documents of the largest size left is offered as so many slots.
3. Each partition sweeps its rows: a document takes the smallest free slot that is at least as large,
   its successor in the order. Where several documents want one slot, the one of the higher rank has
   it and the next takes the next larger slot; that is a bracket matching, slots opening and documents
   closing. What is left over in a partition is matched between partitions by rank: the driver sees
   two counts a partition, and gets runs of ranks, of which there are twice as many as partitions at most.
4. Gaps shrink by what was placed in them, and the next round begins.

Rounds end when every document has a place. The driver also sees histograms of sizes, which have at
most ``capacity`` rows.

Defined cases: null and empty texts are the end token alone; rows that repeat an id are packed one by
one; documents of equal length are told apart by a hash of their number; a very long text is encoded
whole and cut into pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, worker_cache

#: Words a Python worker remembers with their ids; a bound on its memory, without effect on results.
CACHED_WORDS = 400_000
ROWS_PER_PARTITION = 200_000
BLANK = bytes.maketrans(b"\t\n\r", b"   ")
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts, from ids of their space-separated parts where that is exact; parts repeat a lot.

    It is exact for tokenizers that ignore the case of ASCII letters, drop white space, never join what
    it separates, and split letters from punctuation: parts are looked up with A-Z lower-cased and
    a tail of punctuation taken off, and each is encoded by the tokenizer itself. Letter-only parts are
    encoded as one text, whose words the tokenizer numbers; if it does not see as many words as there
    are parts, they are encoded one by one. Whether a tokenizer is of that kind is read from its own
    normalizer and pre-tokenizer (``by_parts``); texts of all others, and texts that hold an added
    (special) token, are encoded whole.
    """

    TAIL = ".,;:!?#$%&*|)"
    # The steps of a tokenizer whose texts may be encoded by their parts.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        shape = json.loads(self.tokenizer.to_str())
        split = (shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        added = shape["added_tokens"]
        self.by_parts = (
            shape["normalizer"] == self.NORMALIZER and split[0] == self.SPLIT and [x.get("type") for x in split[1:]] == ["ByteLevel"]
            and not split[1]["use_regex"] and not split[1]["add_prefix_space"] and shape["truncation"] is None and shape["padding"] is None
            and not any(x["normalized"] for x in added)
        )
        self.added = re.compile("|".join(re.escape(x["content"]) for x in added) or "(?!)", re.IGNORECASE)  # parts are looked up lower-cased

    @property
    def known(self) -> dict[str, bytes]:
        return worker_cache(("tokens", self.path))

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def letters(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one word each."""
        found = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        word = np.asarray(found.word_ids, np.int64)
        if not len(word) or word[-1] + 1 != len(parts):
            return self.one_by_one(parts)
        ids = np.asarray(found.ids, "<u4").tobytes()
        edge = np.searchsorted(word, np.arange(len(parts) + 1)) * 4
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def add(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts not known yet."""
        known = self.known
        cores = {w: w.rstrip(self.TAIL) for w in new}
        wanted = {c for c in cores.values() if c not in known} | {t for w, c in cores.items() if c and (t := w[len(c) :]) and t not in known}
        fresh = {"": b""}
        plain, other = [], []
        for w in wanted:
            if w:
                (plain if w.isalpha() else other).append(w)
        for a in range(0, len(plain), 5000):
            fresh.update(zip(plain[a : a + 5000], self.letters(plain[a : a + 5000])))
        # A tail is split off after a letter or digit only; elsewhere the whole part is encoded.
        whole = [w for w, c in cores.items() if len(c) < len(w) and not (c and c[-1].lower()[-1].isalnum()) and w not in fresh]
        other += whole
        for a in range(0, len(other), 5000):
            fresh.update(zip(other[a : a + 5000], self.one_by_one(other[a : a + 5000])))
        both = lambda w: fresh[w] if w in fresh else known[w]
        for w, c in cores.items():
            if w not in fresh:
                fresh[w] = both(c) + both(w[len(c) :])
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = [i for i, t in enumerate(texts) if not self.by_parts or self.added.search(t)]
        if not whole:
            return self.by_words(texts)
        held = set(whole)
        out = dict(zip(whole, self.one_by_one([texts[i] for i in whole])))
        rest = [i for i in range(len(texts)) if i not in held]
        out.update(zip(rest, self.by_words([texts[i] for i in rest]) if rest else ()))
        return [out[i] for i in range(len(texts))]

    def by_words(self, texts: list[str]) -> list[bytes]:
        """The same from the ids of space-separated parts."""
        split = [t.encode().lower().translate(BLANK).decode().split(" ") for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        fresh = self.add(new) if new else {}
        known.update(fresh)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > CACHED_WORDS:
            for w in fresh:
                del known[w]
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, ids`` of every piece; ``ids`` are little-endian 32-bit ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.of(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                keys = batch.column(0)[a : a + 1000].to_pylist()
                texts = [t or "" for t in batch.column(1)[a : a + 1000].to_pylist()]
                rows = []
                for key, ids in zip(keys, encoder.encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), capacity * 4)):
                        part = ids[at : at + capacity * 4]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encoded, "id long, piece int, start long, length long, ids_crc32 long, ids binary")


def matched(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the matched closers and of their openers in a row of brackets."""
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero(opens[order][:-1] & ~opens[order][1:] & (level[order][1:] == level[order][:-1]))
    return order[pair + 1], order[pair]


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """``(part, first rank, n, slot part, rank after the first slot)`` from ``(part, documents left, slots left)`` in order."""
    stack: list[list[int]] = []
    runs = []
    for part, docs, slots in left:
        at = 0
        while at < docs and stack:
            top = stack[-1]
            n = min(docs - at, top[1])
            runs.append((part, at, n, top[0], top[1]))
            at += n
            top[1] -= n
            if not top[1]:
                stack.pop()
        if slots:
            stack.append([part, slots])
    return runs


SWEPT = "doc long, size long, gap long, slot long, part int, rank int"
SWEPT_ARROW = pa.schema([("doc", pa.int64()), ("size", pa.int64()), ("gap", pa.int64()), ("slot", pa.int64()), ("part", pa.int32()), ("rank", pa.int32())])


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match one sorted partition of ``(size, is_slot, id, part)``; a row of the result is a pair or what is left."""
    got = [x for x in batches if x.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    part = table.column(3)[0].as_py()
    size, opens, ids = (table.column(k).to_numpy() for k in range(3))
    docs, slots = matched(opens.astype(bool))
    rest = np.ones(len(size), bool)
    rest[docs] = rest[slots] = False
    for who in (docs, np.flatnonzero(rest & (opens == 0)), np.flatnonzero(rest & (opens == 1))):
        n = len(who)
        none = pa.nulls(n, pa.int64())
        rank = pa.array(np.arange(n, dtype=np.int32))
        where = pa.array(np.full(n, part, np.int32))
        if who is docs:
            cols = [pa.array(ids[docs]), pa.array(size[docs]), pa.array(ids[slots]), pa.array(size[slots]), where, pa.array(np.full(n, -1, np.int32))]
        elif n and not opens[who[0]]:
            cols = [pa.array(ids[who]), pa.array(size[who]), none, none, where, rank]
        else:
            cols = [none, none, pa.array(ids[who]), pa.array(size[who]), where, rank]
        yield pa.RecordBatch.from_arrays(cols, schema=SWEPT_ARROW)


def opening(sizes: list[tuple[int, int]], capacity: int) -> tuple[int, int]:
    """``(size, n)``: documents longer than ``size`` and ``n`` of that size open sequences; ``sizes`` is largest first."""
    wanted = -(-sum(s * n for s, n in sizes) // capacity)
    for s, n in sizes:
        if wanted <= n:
            return s, wanted
        wanted -= n
    return 0, 0


def place(items: DataFrame, capacity: int = 4096, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``(uid, sequence_id)`` for all ``(uid, length)`` with lengths from 1 to ``capacity``."""
    placed = [items.filter(F.col("length") == capacity).select(F.col("uid").alias("doc"), F.col("uid").alias("gap"))]
    state = items.filter(F.col("length") < capacity).select(F.col("uid").alias("doc"), F.col("length").alias("size"), F.lit(None).cast("long").alias("gap"), F.lit(None).cast("long").alias("slot"))
    while True:
        count = {kind: [(r.size, r.n) for r in rows] for kind, rows in _histograms(state).items()}
        docs, gaps = count["docs"], count["gaps"]
        if not docs:
            break
        parts = max(1, -(-sum(n for _, n in docs + gaps) // rows_per_partition))
        large = [x for x in docs if x[0] > (gaps[0][0] if gaps else 0)]
        if large:
            least, n = opening(large, capacity)
            left = state.filter("doc is not null")
            if n < dict(large)[least]:  # some of one size
                left, first = _first(left, F.col("size") == least, n)
                opens = (F.col("size") > least) | first
            else:
                opens = F.col("size") >= least
            left = left.withColumn("gap", F.when(opens, F.col("doc"))).withColumn("slot", F.when(opens, F.lit(capacity).cast("long"))).select("doc", "size", "gap", "slot")
            state = cut(left.unionByName(state.filter("doc is null")).coalesce(parts))
            placed.append(state.filter("doc is not null and gap is not null").select("doc", "gap"))
            opened = state.filter("doc is not null and gap is not null").select(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("size"), "gap", (F.col("slot") - F.col("size")).alias("slot")).filter("slot > 0")
            state = opened.unionByName(state.filter("doc is null or gap is null"))
            rest = _below(docs, least, n)
        else:
            rest = docs
        if not rest:
            break
        state = _round(state, rest, parts)
        placed.append(state.filter("doc is not null and gap is not null").select("doc", "gap"))
        still = state.filter("doc is not null and gap is null")
        free = state.filter("gap is not null").groupBy("gap").agg(F.sum(F.col("slot") - F.coalesce("size", F.lit(0))).alias("slot")).filter("slot > 0")
        state = cut(still.unionByName(free.select(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("size"), "gap", "slot")).coalesce(parts))
    return reduce(DataFrame.unionByName, placed).select(F.col("doc").alias("uid"), F.col("gap").alias("sequence_id"))


def _histograms(state: DataFrame) -> dict:
    """Sizes with their numbers, largest first; at most ``capacity`` rows each."""
    rows = state.groupBy(F.col("doc").isNull().alias("free"), F.coalesce("size", "slot").alias("size")).agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: -r["size"])
    return {"docs": [r for r in rows if not r.free], "gaps": [r for r in rows if r.free]}


def _first(state: DataFrame, wanted: Column, n: int) -> tuple[DataFrame, Column]:
    """``state`` and a condition that holds for exactly ``n`` of the rows for which ``wanted`` does.

    All such rows of the first partitions, and some of one partition: counts a partition reach the driver, rows are
    only ordered inside that one.
    """
    state = cut(state.withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in state.filter(wanted).groupBy("__part").count().collect())
    edge, rest = -1, n
    for edge, c in counts:
        if c >= rest:
            break
        rest -= c
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("doc"))
    some = state.filter(wanted & (F.col("__part") == edge)).select("doc", nth.alias("nth")).filter(F.col("nth") <= rest)
    marked = state.join(some.select(F.col("doc").alias("__doc")), F.col("doc") == F.col("__doc"), "left")
    return marked, wanted & ((F.col("__part") < edge) | F.col("__doc").isNotNull())


def _below(docs: list[tuple[int, int]], least: int, n: int) -> list[tuple[int, int]]:
    return [(s, m - n if s == least else m) for s, m in docs if s < least or s == least and m > n]


def _round(state: DataFrame, docs: list[tuple[int, int]], parts: int) -> DataFrame:
    """One sort, sweep and match over ``state``; pairs have both a document and a gap."""
    most = docs[0][0]
    least = docs[-1][0]
    slots = state.filter("gap is not null").filter(F.col("slot") >= least)
    n = F.greatest(F.lit(1), F.expr(f"slot div {most}"))
    slots = slots.select("gap", "slot", F.explode(F.expr(f"sequence(1, cast(greatest(1, slot div {most}) as int))")).alias("k"), n.alias("n"))
    size = F.when(F.col("n") == 1, F.col("slot")).when(F.col("k") == 1, F.col("slot") - (F.col("n") - 1) * most).otherwise(F.lit(most).cast("long"))
    rows = slots.select(size.alias("size"), F.lit(1).alias("is_slot"), F.col("gap").alias("id")).unionByName(
        state.filter("doc is not null").select("size", F.lit(0).alias("is_slot"), F.col("doc").alias("id"))
    )
    order = [F.col("size").desc(), F.col("is_slot").desc(), F.xxhash64("id"), F.col("id")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    swept = cut(dealt.mapInArrow(sweep, SWEPT).coalesce(parts))
    counts = swept.filter("rank >= 0").groupBy("part").agg(F.count("doc").alias("docs"), F.count("gap").alias("slots")).collect()
    runs = across(sorted((r.part, r.docs, r.slots) for r in counts))
    spark = state.sparkSession
    runs_df = spark.createDataFrame(runs, "part int, a int, n int, slot_part int, top int")
    left = swept.filter("rank >= 0 and doc is not null").alias("d").join(
        F.broadcast(runs_df).alias("r"), (F.col("d.part") == F.col("r.part")) & (F.col("d.rank") >= F.col("r.a")) & (F.col("d.rank") < F.col("r.a") + F.col("r.n")), "left"
    ).select("d.doc", "d.size", F.col("r.slot_part").alias("sp"), (F.col("r.top") - 1 - (F.col("d.rank") - F.col("r.a"))).alias("sr"))
    free = swept.filter("rank >= 0 and gap is not null").select("gap", "slot", "part", "rank")
    # Documents without a slot stay out of the join, where their null keys would meet in one task.
    joined = left.filter("sp is not null").join(free, (F.col("sp") == F.col("part")) & (F.col("sr") == F.col("rank")), "right").select("doc", "size", "gap", "slot")
    none = F.lit(None).cast("long")
    unmatched = left.filter("sp is null").select("doc", "size", none.alias("gap"), none.alias("slot"))
    return cut(swept.filter("rank < 0").select("doc", "size", "gap", "slot").unionByName(joined).unionByName(unmatched).coalesce(parts))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Every piece with its place: ``id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``."""
    found = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    numbered = cut(found.select(*columns).withColumn("uid", F.monotonically_increasing_id()))
    where = place(numbered.select("uid", "length"), capacity, rows_per_partition)
    joined = numbered.join(where, "uid")
    before = F.expr("sum(length) over (partition by sequence_id order by length desc, uid rows between unbounded preceding and current row) - length")
    return joined.withColumn("offset", before.cast("long")).select(*columns, "sequence_id", "offset")

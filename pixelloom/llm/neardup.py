"""Near-duplicate documents by SetSketch registers.

A document's set holds the hashes of its distinct shingles of ``k`` words (A-Z lower-cased, split at
ASCII white space). Its sketch has ``bands * rows`` registers ``floor(1 - log_b(min h))`` of exponentially
distributed hashes, truncated to 16 bits: exponentially spaced, mergeable by maximum, and equal in two
documents with a probability close to their similarity J.

1. Documents of equal sets are one node; only nodes go on.
2. ``rows`` registers make a band. Two nodes of similarity 0.8 agree in a band with probability
   0.8^5 = 0.33, and in none of the 41 bands with probability 8e-8.
3. Every node of a bucket is paired with the bucket's first node, never with all others. Pairs are
   estimated jointly by maximum likelihood from how many registers are larger, smaller and equal, and
   from the known set sizes; those within six standard errors of the threshold are verified on the
   full sets. Verified links give components.
4. What a bucket still holds of different components is tried once more against the best linked node of
   its largest component. Then those outside that component are paired with all others, if sizes and
   parity signatures permit: the bits in which two sets differ bound the elements in which they do, so
   the many texts that share a passage or are rewritten from one, but are not alike enough, are ruled
   out inside the join. Nothing is capped.
5. Components of all links; each is named by its smallest id.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; a text of
fewer words than ``k`` is one shingle; rows that repeat an id are separate nodes unless their sets are
equal; a null id sorts after all others; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, compact, cut, fitted, salted_join, sized
from .components import components
from .substring import Hasher, U, chunks

BANDS, ROWS = 41, 5
#: Base and rate of the registers; 16 bits hold all set sizes up to 2^60 with these.
BASE, RATE = 1.001, 20.0
#: Bits of a set's parity signature.
PARITY = 2048
MAX_BROADCAST = 2_000_000
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    x = Hasher.mix(np.arange(1, 2 * m + 1, dtype=U) * U(0x9E3779B97F4A7C15), 11)
    return (x[:m] >> U(32)).astype(np.uint32) | np.uint32(1), (x[m:] >> U(32)).astype(np.uint32)


def shingles(hasher: Hasher, data: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their text numbers, sorted by text and hash."""
    texts = len(begin) - 1
    h, _, text = hasher.words(LOWERED[data], begin)
    s, _, at = hasher.windows(h, text, k)
    owner = text[at]
    count = np.bincount(text, minlength=texts)
    for t in np.flatnonzero((count > 0) & (count < k)):
        a = np.searchsorted(text, t)
        w = h[a : a + count[t]]
        s = np.append(s, hasher.windows(w, np.zeros(len(w), np.int64), len(w))[0] ^ U(len(w)))
        owner = np.append(owner, t)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], owner[new]


def registers(s: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """``(sets, m)`` 16-bit registers of the sets ``s[first[i]:first[i + 1]]``, none of them empty."""
    x = (s >> U(32)).astype(np.uint32)
    times, flip = seeds(m)
    least = np.empty((m, len(first)), np.uint32)
    for i in range(m):
        least[i] = np.minimum.reduceat((x ^ flip[i]) * times[i], first)
    h = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, 65535).astype(np.uint16)


def parities(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(sets, PARITY // 64)`` longs; bit ``b`` is the parity of the number of elements that hash to ``b``.

    Sets that differ in so many bits differ in at least as many elements.
    """
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    count = np.bincount(owner * PARITY + (Hasher.mix(s, 77) >> U(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=len(first) * PARITY)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(first), PARITY), axis=1).view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, n, s1, s2, registers, parity`` of every row; ``s1, s2`` are hashes of the whole set."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for a, b, data, begin in chunks(batch.column(2), 1 << 18):
                s, owner = shingles(hasher, data, begin, k)
                n = np.bincount(owner, minlength=b - a)
                full = np.flatnonzero(n)
                first = np.searchsorted(owner, full)
                sums = np.zeros((2, b - a), np.int64)
                regs: list[bytes | None] = [None] * (b - a)
                bits: list[np.ndarray | None] = [None] * (b - a)
                if len(full):
                    for j in range(2):
                        sums[j, full] = np.add.reduceat(Hasher.mix(s, 101 + j), first).view(np.int64)
                    for i, r in zip(full, registers(s, first, m)):
                        regs[i] = r.astype("<u2").tobytes()
                    for k0 in range(0, len(full), 100):
                        part = full[k0 : k0 + 100]
                        end = first[k0 + 100] if k0 + 100 < len(full) else len(s)
                        for i, r in zip(part, parities(s[first[k0] : end], first[k0 : k0 + 100] - first[k0])):
                            bits[i] = r
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(regs, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["id", "text_hash", "n", "s1", "s2", "registers", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col)).mapInArrow(
        run, "id long, text_hash long, n long, s1 long, s2 long, registers binary, parity array<long>"
    )


def banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``uid, n, bands``: one hash for each band, the band's number hashed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, bands, rows).astype(U)
            h = np.zeros(r.shape[:2], U) + np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93)
            for j in range(rows):
                h = Hasher.mix(h ^ r[:, :, j], 31 + j)
            flat = pa.array(h.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["uid", "n", "bands"])

    return nodes.select("uid", "n", "registers").mapInArrow(run, "uid long, n long, bands array<long>")


def likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 200) -> np.ndarray:
    """Most likely similarity, on a grid up to the largest that the set sizes allow."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid + 1)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    score = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), score.argmax(1)]


def texts_of(nodes: DataFrame, used: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, text`` of the nodes ``used``; rows that repeat an id and its text may repeat a node."""
    used = sized(used, MAX_BROADCAST)
    where = sized(nodes.join(used, "uid", "left_semi").select("uid", F.col("id").alias("__id"), F.col("text_hash").alias("__hash")), MAX_BROADCAST)
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))
    return text.join(where, text["__id"].eqNullSafe(where["__id"]) & (text["__hash"] == where["__hash"])).select("uid", "text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, m: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * intersection >= percent * union``."""
    margin = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / m)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(-1, m) for c in ("ra", "rb"))
                n_a, n_b = (x.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                j = likelihood((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), n_a, n_b)
                yield x.select(["a", "b"]).filter(pa.array(j >= margin))

    side = lambda c: nodes.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    close = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    close = compact(close.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(likely, "a long, b long"))
    text = texts_of(nodes, close.select(F.col("a").alias("uid")).union(close.select("b")).distinct(), docs, id_col, text_col)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            at = 0
            for i in range(0, batch.num_rows, 200):
                x = batch.slice(i, 200)
                found = []
                for c in ("ta", "tb"):
                    s, owner = [], []
                    for a, _, data, begin in chunks(x.column(c)):
                        own, who = shingles(hasher, data, begin, k)
                        s.append(own)
                        owner.append(who + a)
                    found.append((np.concatenate(s), np.concatenate(owner)))
                (sa, oa), (sb, ob) = found
                s, o = np.concatenate((sa, sb)), np.concatenate((oa, ob))
                order = np.lexsort((s, o))
                s, o = s[order], o[order]
                twice = o[1:][(s[1:] == s[:-1]) & (o[1:] == o[:-1])]
                both = np.bincount(twice, minlength=x.num_rows)
                total = np.bincount(o, minlength=x.num_rows) - both
                keep[at : at + x.num_rows] = 100 * both >= percent * total
                at += x.num_rows
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    texts = close.join(text.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
    return texts.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket and different components that may reach the similarity.

    ``rows`` has ``key, uid, n, component, main, bits``: the largest component of the bucket, and the parity
    signature as longs. Members of that component are only paired with others; so a bucket costs
    the others times its size. Two sets that are alike enough differ in at most a known part of their
    elements, and so in at most as many bits.
    """
    a, b = (rows.select("key", "main", F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("bits").alias(f"p{x}")) for x in "ab")
    apart = "aggregate(zip_with(pa, pb, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    # |A - B| + |B - A| <= (1 - J) * |A or B|, and |A or B| is half of |A| + |B| + that difference.
    can = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * {apart} <= {100 - percent} * (na + nb)"
    pairs = a.filter("ca <> main").join(b.drop("main"), "key").filter(f"ca <> cb and (cb = main or a < b) and {can}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """Buckets with more than one component: ``key, main, members``."""
    each = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    return each.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("members"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("m.component").alias("main"), "members")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, text_hash, n_shingles, component_id``."""
    m = bands * rows
    own = cut(sketches(docs, k, bands, rows, id_col, text_col))
    last = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")
    nodes = own.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(last).alias("of"), F.first("registers").alias("registers"), F.first("parity").alias("parity"))
    nodes = cut(nodes.select("s1", "s2", "n", "registers", "parity", F.col("of.id").alias("id"), F.col("of.text_hash").alias("text_hash")).withColumn("uid", F.monotonically_increasing_id()))

    in_bands = cut(banded(nodes, bands, rows))
    buckets = in_bands.select(F.explode("bands").alias("key"), "uid", "n")
    heads = buckets.groupBy("key").agg(F.min("uid").alias("head"), F.count("*").alias("c")).filter("c > 1").select("key", "head")
    shared = compact(buckets.join(heads, "key").select("key", "uid", "n", "head"))
    stars = compact(shared.filter("head <> uid").select(F.col("head").alias("a"), F.col("uid").alias("b")).distinct())
    links = compact(verified(stars, nodes, docs, k, percent, m, id_col, text_col))

    def with_components(held: DataFrame) -> DataFrame:
        named = compact(shared.join(held, shared["uid"] == held["node"], "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("component")))
        return compact(named.join(mixed(named), "key"))

    # Once more against the node of each bucket's largest component that has the most links.
    held = components(links)
    rest = with_components(held)
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("links"))
    best = rest.filter("component = main").join(degree, "uid").groupBy("key").agg(F.max(F.struct("links", "uid")).alias("m")).select("key", F.col("m.uid").alias("head"))
    second = rest.filter("component <> main").join(best, "key").select(F.least("head", "uid").alias("a"), F.greatest("head", "uid").alias("b")).distinct()
    second = compact(second.join(stars, ["a", "b"], "left_anti"))
    stars = stars.unionByName(second)
    found, n_found = fitted(verified(second, nodes, docs, k, percent, m, id_col, text_col))
    if n_found:
        links = links.unionByName(found)
        held = components(links)
        rest = with_components(held)
    rest = rest.join(nodes.select("uid", F.col("parity").alias("bits")), "uid")
    more, n_more = fitted(across(rest, percent).join(stars, ["a", "b"], "left_anti"))
    if n_more:
        found, n_found = fitted(verified(more, nodes, docs, k, percent, m, id_col, text_col))
        if n_found:
            held = components(links.unionByName(found))

    # Only linked nodes are named by others; a component of very many is joined with its name in parts.
    linked = held.join(nodes.select(F.col("uid").alias("node"), "id"), "node")
    named = salted_join(linked, linked.groupBy("component").agg(F.min("id").alias("component_id")), ["component"], 16).select("node", "component_id")
    label = nodes.join(named, nodes["uid"] == named["node"], "left").select("s1", "s2", F.col("n").alias("size"), F.coalesce("component_id", "id").alias("component_id"))
    joined = own.select("id", "text_hash", "n", "s1", "s2").join(label, (own["s1"] == label["s1"]) & (own["s2"] == label["s2"]) & (own["n"] == label["size"]), "left")
    return joined.select("id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; all columns are kept.

    Rows that repeat the kept id and text are dropped too.
    """
    found = near_duplicates(docs, k, percent, id_col=id_col, text_col=text_col)
    gone = sized(found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), MAX_BROADCAST)
    kept = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left_anti")
    twice = found.groupBy("id", "text_hash").count().filter("count > 1").limit(1)
    return kept if twice.isEmpty() else kept.dropDuplicates([id_col, text_col])

"""Source divergence audit: how far the term frequencies of a language's sources are from each other, and by which terms.

Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased. A language keeps the terms that are in ``least``
of its documents or more; V is their number. A group (a language and source, or a whole language) with N occurrences of kept terms gives
a term that it has ``count`` times ``p = 1 + floor(ONE * (count + 2) / (N + 2 V))``, and the difference of two groups in a
term is ``floor((p - q)^2 / (p + q))``. All of it is integer arithmetic.

1. Every task counts terms a language and source, occurrences and documents at once, and hands on what it has counted whenever
   that is many; languages and sources never meet in one task, terms do.
2. What is kept is dealt out by ranges of (language, term). A task has a sorted array of its kept terms, a chunk at a time; terms are
   numbered by binary search in it and counted into one dense vector a source. Numbers are in the order of the terms'
   UTF-8 bytes, so that ties fall to the smaller number, and chunks are compared without their terms.
3. Chunks meet the totals of their language's groups, and give a sum for each pair of sources and the ``top`` terms of each source.

Defined cases: null text, language and source are empty strings; every row is a document, rows that repeat ids too; groups without kept
terms have ``count = N = 0``; a language without kept terms has pairs of value 0 and no terms; very long texts are counted in
slices; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, salted_join

ONE = 1_000_000_000
#: Bytes of a term as they are or lower-cased, everything else as a space.
TABLE = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SLICE = 1 << 20
#: Terms that a task holds before it hands on its counts, and terms and cells of a dense chunk.
HELD, CHUNK, CELLS = 400_000, 4096, 1 << 20
#: Groups whose totals are broadcast at most; more meet their chunks by a salted shuffle.
MAX_BROADCAST = 1_000_000
SALTS = 16


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes that cut no term."""
    a = 0
    while a < len(text):
        b = text.find(b" ", a + SLICE) if a + SLICE < len(text) else -1
        b = len(text) if b < 0 else b
        yield text[a:b]
        a = b


def counted(docs: DataFrame) -> DataFrame:
    """``lang, term, source, n, docs`` of ``docs (lang, source, text)``: occurrences and documents, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(some), pa.string()), "term": pa.array(some, pa.binary()).cast(pa.string()), "source": pa.array([source] * len(some), pa.string()),
                        "n": pa.array([n[t] for t in some], pa.int64()), "docs": pa.array([in_docs[t] for t in some], pa.int64()),
                    })
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for part in slices(text.encode().translate(TABLE)):
                    terms = part.split()
                    n.update(terms)
                    own.update(terms)
                in_docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "lang string, term string, source string, n long, docs long")


def share(n: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """``1 + floor(ONE * (n + 2) / (total + 2 v))`` by long division in steps of 1000, so that nothing overflows."""
    below = np.asarray(total, np.int64) + 2 * v
    rest = np.asarray(n, np.int64) + 2
    out = np.zeros(np.broadcast(rest, below).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def chunks(kept: DataFrame) -> DataFrame:
    """``lang, terms, sources, counts``: dense vectors of chunks of the kept terms; ``kept`` is sorted in ranges of (lang, term)."""

    def dense(lang: str, terms: list[str], sources: list[str], n: np.ndarray) -> pa.RecordBatch:
        dictionary, names = np.array(sorted(set(terms)), object), np.array(sorted(set(sources)), object)
        cell = np.searchsorted(names, np.array(sources, object)) * len(dictionary) + np.searchsorted(dictionary, np.array(terms, object))
        low, high = (np.bincount(cell, weights=x, minlength=len(names) * len(dictionary)).astype(np.int64) for x in (n & 0xFFFFFFFF, n >> 32))
        return pa.RecordBatch.from_pydict({"lang": [lang], "terms": pa.array([dictionary.tolist()], pa.list_(pa.string())), "sources": pa.array([names.tolist()], pa.list_(pa.string())), "counts": pa.array([(low + (high << 32)).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms, sources, n, some, names = None, [], [], [], 0, set()
        for batch in batches:
            for l, t, s, k in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if terms and (l != lang or t != terms[-1] and (some >= CHUNK or some * len(names) >= CELLS)):
                    yield dense(lang, terms, sources, np.array(n, np.int64))
                    terms, sources, n, some, names = [], [], [], 0, set()
                some += not terms or t != terms[-1]
                lang = l
                terms.append(t)
                sources.append(s)
                n.append(k)
                names.add(s)
        if terms:
            yield dense(lang, terms, sources, np.array(n, np.int64))

    return kept.mapInArrow(run, "lang string, terms array<string>, sources array<string>, counts binary")


def compared(joined: DataFrame, top: int) -> DataFrame:
    """``lang, source, other, term, value`` of ``joined``, chunks with the totals of their language; of pairs one direction, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, names, totals = row["v"], [g["source"] for g in row["groups"]], np.array([g["total"] for g in row["groups"]], np.int64)
                place = {s: i for i, s in enumerate(names)}
                n = np.zeros((len(names), len(row["terms"])), np.int64)
                n[[place[s] for s in row["sources"]]] = np.frombuffer(row["counts"], np.int64).reshape(len(row["sources"]), -1)
                width = max(16, CELLS // len(names))
                for a in range(0, n.shape[1], width):
                    yield from part(row["lang"], names, row["terms"][a : a + width], n[:, a : a + width], totals, v)

    def part(lang: str, names: list[str], terms: list[str], n: np.ndarray, totals: np.ndarray, v: int) -> Iterator[pa.RecordBatch]:
        p, q = share(n, totals[:, None], v), share(n.sum(0), int(totals.sum()), v)
        source, other, term, value = [], [], [], []
        for i, name in enumerate(names):
            sums = difference(p[i], p[i + 1 :]).sum(1)
            more = np.flatnonzero((n[i] > 0) & (p[i] > q))
            f = difference(p[i][more], q[more])
            best = np.lexsort((more, -f))[:top]
            source += [name] * (len(sums) + len(best))
            other += [*names[i + 1 :], *[None] * len(best)]
            term += [*[None] * len(sums), *(terms[k] for k in more[best])]
            value += [*sums.tolist(), *f[best].tolist()]
            if len(value) > 100_000:
                yield result(lang, source, other, term, value)
                source, other, term, value = [], [], [], []
        yield result(lang, source, other, term, value)

    def result(lang: str, source: list, other: list, term: list, value: list) -> pa.RecordBatch:
        strings = [pa.array(x, pa.string()) for x in ([lang] * len(source), source, other, term)]
        return pa.RecordBatch.from_arrays([*strings, pa.array(value, pa.int64())], ["lang", "source", "other", "term", "value"])

    return joined.mapInArrow(run, "lang string, source string, other string, term string, value long")


def audit(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group all other sources of its language (``pair``), and its ``top`` terms
    that are more frequent in it than in its language (``term``); values descending, ties by the item's UTF-8 bytes."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    of_term = Window.partitionBy("lang", "term")
    # Dealt out by (lang, term) once: sums, document counts and the first row of each term need no other shuffle.
    terms = counted(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = terms.withColumns({"docs": F.sum("docs").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    kept = cut(terms.filter(F.col("docs") >= least).select("lang", "term", "source", "n", "nth"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("nth") == 1, 1)).alias("v"))
    groups = cut(own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0))
    by_lang = groups.groupBy("lang").agg(F.sum("v").alias("v"), F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    few = groups.count() <= MAX_BROADCAST

    def with_language(rows: DataFrame, languages: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(languages), "lang") if few else salted_join(rows, languages, ["lang"], SALTS)

    dense = chunks(kept.select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source"))
    found = cut(compared(with_language(dense, by_lang), top))
    sums = found.filter("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    known = sums.select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    others = with_language(groups.select("lang", "source"), by_lang.select("lang", F.col("groups.source").alias("items"))).select("lang", "source", F.explode("items").alias("item")).filter("source <> item")
    pairs = others.join(known, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = found.filter("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, best)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))

"""Vector codes: vectors cut into parts, each part replaced by the number of its nearest codebook entry.

Components become integers, ``floor(scale * x)``, so distances are exact and results do not depend on how rows are dealt.
The codebook of a part starts as that part of the rows of the smallest ids and is moved by Lloyd's rounds: parts go to
their nearest entry (ties to the lower number), entries to the floored mean of their parts.

Hamerly's bounds spare most distances: every part keeps an upper bound of the distance to its entry and a lower bound of that to
any other, in a table that lives from round to round. When entries move, the bounds follow by as much. A part whose upper
bound is strictly below its lower bound, or below half the distance of its entry to the next one, stays; for the others the upper
bound is taken anew, and only where that fails too all entries are looked at. Since only a strict gap skips, ties still go to the
lower number. Bounds are integers in ``1 / UNIT`` of a component, rounded away from the gap by more than a square root errs.

Nothing grows with the rows but their own table: a task sends its sums and counts a part and entry, and the driver holds
``parts * entries`` of them. Every round's table is written to the checkpoint folder.

Defined cases: rows whose vector is null or holds nulls, NaN or infinities are dropped, and so are rows of another length than the
first kept row (of the smallest id) with components, which cannot be cut alike; a null id sorts last; rows that repeat an id count
each, ordered by their components where they compete to be entries; fewer rows than entries make a smaller codebook; no rows
give none; components beyond ``LARGEST`` in absolute value, whose squares would not fit, are an error that says so;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, salted_join

#: Bounds are in this fraction of an integer component.
UNIT = 256
#: Largest component, in absolute value and before scaling by up to 256: 64 squared differences of it fit a long.
LARGEST = 1 << 19
FAR = 1 << 60
#: Totals by label that are broadcast at most; more meet their rows by a salted shuffle.
MAX_BROADCAST = 100_000


def kept_vectors(rows: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """``rows`` with usable vectors only, and these as ``__x``, an array of integers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fits = F.forall(vector_col, lambda x: F.abs(x.cast("double")) <= LARGEST)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("array<bigint>"))
    return rows.filter(F.col(vector_col).isNotNull() & finite & (F.size(vector_col) > 0)).withColumn("__x", checked)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances ``(rows, entries)`` of one part."""
    d = x[:, None, :] - book[None]
    return (d * d).sum(2)


def root_up(squares: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squares.astype(np.float64)) * UNIT).astype(np.int64) + 1


def root_down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.sqrt(squares.astype(np.float64)) * UNIT).astype(np.int64) - 1, 0)


def gaps(book: np.ndarray) -> np.ndarray:
    """Of each entry half the distance to the next one, rounded down."""
    if len(book) == 1:
        return np.full(1, FAR)
    d = distances(book, book)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return root_down(d.min(1)) // 2


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equal ones), upper bound and second-nearest lower bound of each row, by all distances."""
    d = distances(x, book)
    code = d.argmin(1)
    own = np.arange(len(x))
    nearest = d[own, code]
    if len(book) == 1:
        return code, root_up(nearest), np.full(len(x), FAR)
    d[own, code] = np.iinfo(np.int64).max
    return code, root_up(nearest), root_down(d.min(1))


def follow(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, book: np.ndarray) -> int:
    """Assign the rows of one part anew after its entries moved from ``old`` to ``book``, in place; how many were scanned."""
    moved = np.where((old == book).all(1), 0, root_up(((book - old) ** 2).sum(1)))
    most = np.full(len(book), moved.max())  # of all others
    if len(book) > 1:
        most[moved.argmax()] = np.delete(moved, moved.argmax()).max()
    upper += moved[code]
    lower -= most[code]
    gap = np.maximum(lower, gaps(book)[code])
    unsure = np.flatnonzero(upper >= gap)
    if len(unsure):
        upper[unsure] = root_up(((x[unsure] - book[code[unsure]]) ** 2).sum(1))
        unsure = unsure[upper[unsure] >= gap[unsure]]
    if len(unsure):
        code[unsure], upper[unsure], lower[unsure] = scan(x[unsure], book)
    return len(unsure)


def stacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """Equal-sized binaries as one array that can be written to."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def packed(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def assigned(rows: DataFrame, books: np.ndarray, old: np.ndarray | None) -> DataFrame:
    """``rows`` with code and bounds of each part; from nothing if ``old`` is None, else from those that hold for the books ``old``."""
    parts, _, width = books.shape
    first = old is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stacked(batch.column("x"), np.int64, parts, width)
            if first:
                code, upper, lower = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
            else:
                code, upper, lower = stacked(batch.column("code"), np.uint8, parts), stacked(batch.column("upper"), np.int64, parts), stacked(batch.column("lower"), np.int64, parts)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p])
                if first:
                    code[:, p], upper[:, p], lower[:, p] = scan(own, books[p])
                else:
                    c, u, w = code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                    follow(own, c, u, w, old[p], books[p])
                    code[:, p], upper[:, p], lower[:, p] = c, u, w
                error += ((own - books[p][code[:, p]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), packed(code), packed(upper), packed(lower), pa.array(error)], ["id", "label", "x", "code", "upper", "lower", "error"])

    own = [f for f in rows.schema.fields if f.name in ("id", "label", "x")]
    more = [T.StructField(c, T.BinaryType()) for c in ("code", "upper", "lower")]
    return rows.mapInArrow(run, T.StructType([*own, *more, T.StructField("error", T.LongType())]))


def means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with each used entry at the floored mean of its parts."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = stacked(batch.column("code"), np.uint8, parts) + entries * np.arange(parts)
                count += np.bincount(at.ravel(), minlength=len(count))
                np.add.at(total, at.ravel(), stacked(batch.column("x"), np.int64, parts, width).reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int32()), "n": pa.array(count[used]), "sums": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    sums = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    found = state.select("code", "x").mapInArrow(summed, "at int, n long, sums array<long>").groupBy("at").agg(F.sum("n").alias("n"), *sums)
    out = books.copy()
    for r in found.collect():  # at most parts * entries rows
        out[divmod(r["at"], entries)] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def encode(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error)`` of the kept rows, a byte a part in ``code``, and the codebooks ``(parts, entries, width)``."""
    if not (1 <= entries <= 256 and 1 <= scale <= 256):
        raise ValueError("entries and scale are from 1 to 256")
    kept = kept_vectors(rows, vector_col, scale).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), "__x")
    by_id = [F.col("id").asc_nulls_last(), "__x"]
    head = kept.orderBy(*by_id).limit(1).collect()
    if not head:
        return kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    size = len(head[0]["__x"])
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("__x") == size)
    seeds = np.array([r["__x"] for r in kept.orderBy(*by_id).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, size // parts).transpose(1, 0, 2))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("__x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed(values)], ["id", "label", "x"])

    own = [f for f in kept.schema.fields if f.name in ("id", "label")]
    state, old = kept.mapInArrow(flat, T.StructType([*own, T.StructField("x", T.BinaryType())])), None
    for _ in range(rounds):
        state = cut(assigned(state, books, old))
        old, books = books, means(state, books)
    return assigned(state, books, old).select("id", "label", "code", "error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, label_col: str = "label", **how) -> DataFrame:
    """``id, label, code`` (two hex digits a part)``, error, label_error, codebooks_sha256`` of the kept rows."""
    found, books = encode(rows, label_col=label_col, **how)
    # Null labels are a group of their own; a common label's rows are joined in parts.
    found = cut(found.withColumn("__label", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("__none", F.col("label").isNull()))
    totals = cut(found.groupBy("__label", "__none").agg(F.sum("error").alias("label_error")))
    joined = found.join(F.broadcast(totals), ["__label", "__none"]) if totals.count() <= MAX_BROADCAST else salted_join(found, totals, ["__label", "__none"], 16)
    return joined.select("id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

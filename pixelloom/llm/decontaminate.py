"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are lower-cased (A-Z only) runs of letters, digits and non-ASCII characters. A benchmark item
of ``n`` words or more gives its windows of ``n`` consecutive words; a shorter, non-empty one is a
single window. All windows are hashed to 64 bits and broadcast, after their number, that of their items and their
bytes were checked against ``max_broadcast`` and ``MAX_BYTES``. Each document's own windows are
hashed in the same way, looked up, and every hit is verified word by word. Beyond the bounds hashes alone are
looked up first, by a shuffle of (document, place, hash), and only the windows found so are verified; no row
ever carries more of a text than one window.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no
windows; an item whose id is null marks words but is not listed; windows that several items share list them all; very
long texts are looked up window by window; rows are judged one by one, so
repeated rows give repeated results; extra columns are ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, ascii_lower, cut, sized, words

MAX_BROADCAST, MAX_BYTES = 2_000_000, 256 << 20


def benchmark_windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(b_hash, b_words, b_len, b_items)`` of all items."""
    item = benchmark.select(
        F.col(id_col).cast("string").alias("id"), words(ascii_lower(F.col(text_col)), ALNUM_WORDS).alias("w")
    ).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    windows = item.select(
        "id", F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))").alias("ws"), length.alias("b_len")
    )
    return (
        windows.select("id", "b_len", F.explode("ws").alias("b_words"))
        .groupBy("b_words", "b_len")
        .agg(F.collect_set("id").alias("b_items"))
        .select(F.xxhash64("b_words").alias("b_hash"), "b_words", "b_len", "b_items")
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row per document row: ``id, text_hash, n_words, n_hit, spans, items``.

    ``spans`` are merged, sorted ``(first word, words)`` runs of hit words; ``items`` are the sorted
    ids whose windows occur. ``text_hash`` tells rows of one id apart.
    """
    grams = cut(benchmark_windows(benchmark, n, item_col, item_text_col))
    size = grams.agg(F.sum(F.size("b_items")), F.count("*"), F.sum(F.octet_length(F.array_join("b_words", " ")) + 8 * F.size("b_items"))).first()
    lengths = sorted(r.b_len for r in grams.select("b_len").distinct().collect())  # n values at most
    doc = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
        words(ascii_lower(F.col(text_col)), ALNUM_WORDS).alias("w"),
    ).withColumn("n_words", F.size("w"))
    # A window is coded as first word * 16 + length; -1 carries the document itself through the join.
    base = 16 if n < 16 else 1 << n.bit_length()
    codes = [
        F.when(F.col("n_words") >= k, F.expr(f"sequence({k}L, cast(n_words - {k} as bigint) * {base} + {k}, {base}L)")).otherwise(F.array().cast("array<bigint>"))
        for k in lengths
    ]
    start = F.expr(f"cast(greatest(code, 0) div {base} as int)")
    length = F.expr(f"cast(greatest(code, 0) % {base} as int)")
    window = F.slice("w", start + 1, length)
    itself = F.array(F.lit(-1).cast("long"))
    if (size[0] or 0) + size[1] <= max_broadcast and (size[2] or 0) <= MAX_BYTES:
        grams = F.broadcast(grams)
        rows = doc.withColumn("code", F.explode(F.concat(itself, *codes)))
    else:
        every = doc.withColumn("code", F.explode(F.concat(*codes) if codes else F.array().cast("array<bigint>"))).select("id", "text_hash", "code", F.xxhash64(window).alias("b_hash"))
        found = every.join(grams.select("b_hash").distinct(), "b_hash", "left_semi").groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("code").alias("codes"))
        joined = doc.join(found, doc["id"].eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
        rows = joined.withColumn("code", F.explode(F.concat(itself, F.coalesce("codes", F.array().cast("array<bigint>")))))
    rows = rows.select("id", "text_hash", "n_words", "code", F.when(F.col("code") >= 0, window).alias("window")).withColumn("h", F.xxhash64("window"))
    hit = rows.join(grams, (F.col("h") == F.col("b_hash")) & (F.col("window") == F.col("b_words")), "left").filter("code < 0 or b_hash is not null")
    found = hit.groupBy("id", "text_hash").agg(
        F.count(F.when(F.col("code") < 0, 1)).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("code") >= 0, F.struct(start.alias("s"), (start + length).alias("e"))))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("b_items")))).alias("items"),
    )
    fold = F.expr(
        "aggregate(at, named_struct('s', -1, 'e', -1, 'done', cast(array() as array<struct<first:int,words:int>>)),"
        " (acc, x) -> if(x.s <= acc.e, named_struct('s', acc.s, 'e', greatest(acc.e, x.e), 'done', acc.done),"
        " named_struct('s', x.s, 'e', x.e, 'done', if(acc.s < 0, acc.done, concat(acc.done, array(named_struct('first', acc.s, 'words', acc.e - acc.s)))))),"
        " acc -> if(acc.s < 0, acc.done, concat(acc.done, array(named_struct('first', acc.s, 'words', acc.e - acc.s)))))"
    )
    return (
        found.withColumn("spans", fold)
        .select(
            F.explode(F.expr("sequence(1L, copies)")).alias("copy"), "id", "text_hash", "n_words",
            F.expr("aggregate(spans, 0L, (a, x) -> a + x.words)").alias("n_hit"), "spans", "items",
        )
        .drop("copy")
    )


def contaminated(share: int = 20) -> Column:
    """Hit words are at least one in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, remove: str = "documents",
    id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``docs`` without contaminated documents, or without the hit words in them.

    ``remove="documents"`` drops the rows that ``contaminated`` holds for; ``remove="spans"`` keeps
    every row and cuts the hit words out of its text. All columns are kept.
    """
    found = hits(docs, benchmark, n, id_col, text_col, max_broadcast=max_broadcast).filter(F.col("n_hit") > 0)
    if remove == "documents":
        bad = sized(found.filter(contaminated(share)).select(F.col("id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct(), max_broadcast)
        return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs[text_col]) == F.col("__bad_hash")), "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    marks = found.select(F.col("id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"), F.col("spans").alias("__spans")).dropDuplicates(["__hit_id", "__hit_hash"])
    joined = docs.join(marks, docs[id_col].eqNullSafe(F.col("__hit_id")) & (F.xxhash64(docs[text_col]) == F.col("__hit_hash")), "left")
    own = words(F.col(text_col), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    gaps = F.split(F.col(text_col), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    kept = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(
        F.array_join(
            F.transform(F.arrays_zip(gaps.alias("g"), own.alias("o")), lambda x, i: F.concat(
                x["g"], F.when(F.exists(F.col("__spans"), lambda s: (s["first"] <= i) & (i < s["first"] + s["words"])), "").otherwise(F.coalesce(x["o"], F.lit(""))))), "")
    )
    return joined.withColumn(text_col, kept).select(*[F.col(c) for c in docs.columns])

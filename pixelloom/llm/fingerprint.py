"""Document fingerprints by winnowing, in built-in functions only.

Every run of ``k`` code points is hashed to 31 bits by the polynomial of Karp and Rabin, modulo the prime
2^31 - 1, over hashed characters. As in rolling, a gram's hash is never made from its ``k`` characters anew: hashes of runs of twice the length
come from two hashes of the half, ``hash(xy) = hash(x) * BASE^|y| + hash(y)``, for all places at once, so it takes
log2(k) steps a place. (A fold that rolls from place to place would copy the array built so far at each step.)

Of each window of ``w`` consecutive hashes the smallest is kept, of equal ones the rightmost, with its
position. Two texts that share ``w + k - 1`` consecutive characters share a fingerprint, and no match shorter
than ``k`` characters makes one. Windows are shortened in texts of fewer than ``FEW`` times ``w`` grams, down to 1: a
shorter window keeps all that a longer one keeps and more, so the guarantee holds there too. Only texts of fewer
than ``k`` characters are hashed as one run. Minima of windows are found in log2(w) steps a place as well.

A hash and its position are one long, ``hash * 2^31 + (2^31 - 1 - position)``, whose minimum is the
smallest hash at the rightmost place.

Defined cases: null and empty texts have an empty fingerprint, and two empty fingerprints are alike (1), an empty and
another one are not (0); white space counts as any other character; the next document is that of the next larger
(id, text hash), nulls first, and after the last comes the first, so a single document is followed by
itself; rows that repeat an id and its text have the same neighbours; a very long text is fingerprinted
whole, in memory in proportion to it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Characters a gram, grams a window, and how many windows a text has at least before they are shortened.
K, W, FEW = 8, 32, 4
PRIME, BASE = (1 << 31) - 1, 1_566_083_941
NULL_ID = -(1 << 63)
HALF = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: the start of a fold over nothing. Elements that ``F.transform`` makes would be copied, arrays whole."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, use)


def _with_earlier(a: Column, by: Column | int, last: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the element of ``a`` that stands ``by`` earlier, null before the first, and of that of ``last`` at each place.

    Nulls are put in front in one copy of references; slices would go through both arrays element by element. Nothing is cut off either: what
    comes of the first ``by`` places, and of ``by`` more than there were at the end, counts for nothing, and ``_whole`` leaves it out at last.
    """
    return F.zip_with(F.concat(F.array_repeat(F.lit(None).cast("long"), by), a), last, use)


def _whole(a: Column, n: Column | int, size: Column) -> Column:
    """What came of all runs of ``n`` of ``size`` elements; in ``a`` it stands at the last place of each run."""
    return F.slice(a, F.lit(n) if isinstance(n, int) else n, F.greatest(size - n + 1, F.lit(0)))


def _joined(left: Column, right: Column, n: int) -> Column:
    """Hash of a run from those of its two parts, the right one of ``n`` characters."""
    return (left * pow(BASE, n, PRIME) + right) % PRIME


def _runs(codes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` characters at the place of their last one."""
    if k == 1:
        return codes
    if k % 2:
        return _with_earlier(_runs(codes, k - 1), 1, codes, lambda x, y: _joined(x, y, 1))
    return let(_runs(codes, k // 2), lambda h: _with_earlier(h, k // 2, h, lambda x, y: _joined(x, y, k // 2)))


def grams(text: Column, k: int) -> Column:
    """Packed (hash, position) of every run of ``k`` code points; of a shorter text one; none of an empty one."""
    codes = F.transform(F.split(text, ""), lambda c: F.xxhash64(c).bitwiseAND(F.lit(PRIME).cast("long")))  # by code point
    whole = lambda c: F.array(F.aggregate(c, F.lit(0).cast("long"), lambda h, x: _joined(h, x, 1)))
    hashed = let(codes, lambda c: F.when(F.size(c) >= k, _whole(_runs(c, k), k, F.size(c))).otherwise(whole(c)))
    places = lambda h: F.sequence(F.lit(HALF).cast("long"), F.lit(HALF + 1).cast("long") - F.size(h), F.lit(-1).cast("long"))
    packed = let(hashed, lambda h: F.zip_with(h, places(h), lambda x, low: F.shiftleft(x, 31).bitwiseOR(low)))
    return F.when(F.length(text) > 0, packed).otherwise(F.array().cast("array<bigint>"))


def window(of: Column, w: int) -> Column:
    """Grams a window in a text with the grams ``of``."""
    return F.greatest(F.least(F.floor(F.size(of) / FEW).cast("int"), F.lit(w)), F.lit(1))


def minima(packed: Column, n: Column, most: int) -> Column:
    """The distinct minima of all windows of ``n`` elements, ``n`` at most ``most`` and the number of elements."""

    def twice(size: int) -> Callable[[Column], Column]:
        return lambda a: F.when(n >= 2 * size, _with_earlier(a, size, a, lambda x, y: F.when(x < y, x).otherwise(y))).otherwise(a)

    width, least = F.lit(1), packed
    size = 1
    while size * 2 <= most:
        least = let(least, twice(size))
        size *= 2
        width = F.when(n >= size, F.lit(size)).otherwise(width)
    # Two overlapping windows of a power of two make one of any length.
    last = lambda a: F.when(n > width, _with_earlier(a, n - width, a, lambda x, y: F.when(x < y, x).otherwise(y))).otherwise(a)
    return F.array_distinct(_whole(let(least, last), n, F.size(packed)))


def winnowed(packed: Column, n: Column, most: int) -> Column:
    return let(n, lambda m: F.when(F.size(packed) > 0, minima(packed, m, most)).otherwise(packed))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """Packed (hash, position) pairs of a text, in order of position."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(grams(t, k), lambda g: winnowed(g, window(g, w), w)))


def _with_edited_fingerprint(df: DataFrame, kept: Column, k: int, w: int) -> DataFrame:
    """``packed_edited`` of ``edited``, which begins with the same ``kept`` characters as ``text`` with its ``packed``.

    Where both texts have whole windows, only what follows the start of the last window of kept characters is hashed
    again: places of minima never go back, so before the first one from there the two have the same.
    """
    whole = FEW * w + k - 1
    again = F.when((F.length("text") >= whole) & (F.length("edited") >= whole), kept - (k - 1) - w).otherwise(0).cast("int")
    df = df.withColumn("again", F.greatest(again, F.lit(0)))
    late = let(F.expr("substring(edited, again + 1)"), lambda t: let(grams(t, k), lambda g: winnowed(g, F.when(F.col("again") > 0, F.least(F.lit(w), F.size(g))).otherwise(window(g, w)), w)))
    df = df.withColumn("late", F.transform(late, lambda p: p - F.col("again")))
    place = lambda p: F.lit(HALF) - p.bitwiseAND(F.lit(HALF).cast("long"))
    early = F.filter("packed", lambda p: place(p) < place(F.element_at(F.col("late"), 1)))
    return df.withColumn("packed_edited", F.when((F.col("again") > 0) & (F.size("late") > 0), F.concat(early, F.col("late"))).otherwise(F.col("late"))).drop("again", "late")


def hashes(packed: Column) -> Column:
    """The distinct hashes of a fingerprint as integers."""
    return F.array_distinct(F.transform(packed, lambda p: F.shiftright(p, 31).cast("int")))


def printed(packed: Column) -> Column:
    """``hash:position`` of each pair, the hash in hexadecimal, joined by spaces."""
    return F.array_join(F.transform(packed, lambda p: F.concat(F.hex(F.shiftright(p, 31)), F.lit(":"), (F.lit(HALF) - p.bitwiseAND(F.lit(HALF).cast("long"))).cast("string"))), " ")


def _place(p: Column) -> Column:
    return (F.lit(HALF) - p.bitwiseAND(F.lit(HALF).cast("long"))).cast("int")


def shipped(packed: Column) -> Column:
    """A fingerprint as one array of integers, as it is shuffled: how many, their hashes, their positions.

    Positions are two to an integer if all are under 2^16.
    """
    place = lambda p, i: F.coalesce(_place(F.get(p, i)), F.lit(0))
    pairs = lambda p: F.transform(F.sequence(F.lit(0), (F.size(p) - 1).cast("int"), F.lit(2)), lambda i: F.shiftleft(place(p, i), 16).bitwiseOR(place(p, i + 1)))
    places = lambda p: F.when(place(p, F.size(p) - 1) < (1 << 16), pairs(p)).otherwise(F.transform(p, _place))
    hashed = lambda p: F.transform(p, lambda x: F.shiftright(x, 31).cast("int"))
    return let(packed, lambda p: F.when(F.size(p) > 0, F.concat(F.array(F.size(p)), hashed(p), places(p))).otherwise(F.array(F.lit(0))))


def received(print_: Column) -> Column:
    """What ``shipped`` was made of."""

    def one(s: Column, n: Column, i: Column) -> Column:
        pair = F.get(s, F.lit(1) + n + F.shiftright(i, 1))
        half = F.when(F.pmod(i, F.lit(2)) == 0, F.shiftrightunsigned(pair, 16)).otherwise(pair.bitwiseAND(F.lit(0xFFFF)))
        place = F.when((F.size(s) == 1 + n + n) & (n > 1), F.get(s, F.lit(1) + n + i)).otherwise(half)
        return F.get(s, i + 1).cast("long") * (1 << 31) + (F.lit(HALF).cast("long") - place)

    several = lambda s, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(s, n, i))
    return let(print_, lambda s: let(F.get(s, F.lit(0)), lambda n: F.when(n > 0, several(s, n)).otherwise(F.array().cast("array<bigint>"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def followers(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``key, text_hash, quarter, next_key, next_hash`` of each distinct document, and whether rows repeat.

    Keys are sorted by range; inside a range the next key follows, and the last of a range is
    followed by the first of the next non-empty one. Only one row a range is looked at together.
    """
    keys = docs.groupBy("key", "text_hash").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.count("*").alias("copies"))
    keys = cut(keys.repartitionByRange("key", "text_hash").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("key", "text_hash")
    keys = keys.withColumn("next", F.lead(F.struct("key", "text_hash")).over(inside))
    firsts = keys.groupBy("part").agg(F.min(F.struct("key", "text_hash")).alias("first"))  # a row a range
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    linked = keys.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    linked = cut(linked.select("key", "text_hash", F.expr("cast(n div 4 as int)").alias("quarter"), F.col("next.key").alias("next_key"), F.col("next.text_hash").alias("next_hash"), "copies"))
    return linked.drop("copies"), not linked.filter("copies > 1").isEmpty()


def compare_with_edits(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited, packed, packed_edited, near_edited, near_next`` of every row.

    ``edited`` is the text with its last quarter of code points replaced by as many first ones (or
    all) of the next document.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    linked, repeated = followers(own)
    prints = own.select("key", "text_hash", "text", shipped(fingerprint(F.col("text"), k, w)).alias("print"))
    link = linked.select(F.col("key").alias("of_key"), F.col("text_hash").alias("of_hash"), "quarter", F.col("next_key").alias("key"), F.col("next_hash").alias("text_hash"))
    after = prints.join(link, ["key", "text_hash"]).select(
        F.col("of_key").alias("key"), F.col("of_hash").alias("text_hash"), "quarter", F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("start"), F.array_distinct(F.slice("print", F.lit(2), F.get("print", F.lit(0)))).alias("next_hashes")
    )
    if repeated:
        after = after.dropDuplicates(["key", "text_hash"])
    both = prints.join(after, ["key", "text_hash"]).withColumn("packed", received(F.col("print"))).drop("print").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("quarter")).cast("int")), F.col("start")))
    both = _with_edited_fingerprint(both, F.col("n_chars") - F.col("quarter"), k, w)
    return both.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("id"), "n_chars", "edited", "packed", "packed_edited",
        likeness(hashes(F.col("packed")), hashes(F.col("packed_edited"))).alias("near_edited"), likeness(hashes(F.col("packed")), F.col("next_hashes")).alias("near_next"),
    )

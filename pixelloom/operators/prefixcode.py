"""Prefix codes of bounded length, of least cost for the symbols counted in each group.

Symbols are counted before they are shuffled; a group's counts, at most ``SYMBOLS``, are then one row of arrays. The lengths come from
merging packages: level by level, pairs of the cheapest items of the level below become packages that are merged with the leaves in
order of weight. The first ``2n - 2`` items of the last level are paid for, and so on downwards; a symbol is as long as the number of levels
in which it is paid for. Leaves are paid for in order of weight, so one count a level is all that is kept. All of it is built-in expressions.

Defined cases: null symbols and counts below 1 are left out, repeated symbols are added up, of equal counts the smaller symbol is taken
to be rarer; a group of one symbol gives it one bit. With ``reserved`` the code of ones only, of the greatest length used, stays free. Groups that
do not fit, more than ``2 ** limit`` codes or more than ``SYMBOLS`` symbols, keep their rows with null length and code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most symbols of a group: more than any alphabet of the formats at hand has.
SYMBOLS = 4096


def counted(df: DataFrame, by: list[str], symbol: str = "symbol") -> DataFrame:
    """``by, symbol, n``: how often each symbol occurs in each group."""
    return df.filter(F.col(symbol).isNotNull()).groupBy(*by, F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))


def _levels(limit: int) -> str:
    """All levels of ``leaves``, the lowest first; an item is its weight and whether it is a package."""
    pairs = "if(size(acc.last) < 2, array(), transform(sequence(0, size(acc.last) div 2 - 1), i -> named_struct('w', acc.last[2 * i].w + acc.last[2 * i + 1].w, 'package', 1)))"
    kind = "array<struct<w:bigint,package:int>>"
    step = f"transform(array(cast(array_sort(concat(leaves, {pairs})) as {kind})), l -> named_struct('last', l, 'all', concat(acc.all, array(l))))[0]"
    return f"aggregate(sequence(1, {limit}), named_struct('last', cast(array() as {kind}), 'all', cast(array() as array<{kind}>)), (acc, i) -> {step}, acc -> acc.all)"


def prefix_codes(counts: DataFrame, by: list[str], limit: int = 15, reserved: bool = False) -> DataFrame:
    """``by, symbol, n, length, code``: canonical codes of at most ``limit`` bits for the counts ``by, symbol, n``."""
    if not 1 <= limit <= 30:
        raise ValueError("limit must be from 1 to 30")
    own = counts.filter("symbol is not null and n > 0").groupBy(*by, "symbol").agg(F.sum("n").cast("long").alias("n"))
    sizes = own.groupBy(*by).agg(F.count("*").alias("symbols"))
    same = [F.col(f"o.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    most = min(SYMBOLS, (1 << limit) - int(reserved))
    sized = own.alias("o").join(sizes.alias("s"), same, "left").select("o.*", "symbols")
    lists = sized.filter(F.col("symbols") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "symbol"))).alias("s"))
    weights = "transform(s, q -> named_struct('w', q.n, 'package', 0))"
    leaves = f"concat(array(named_struct('w', 0L, 'package', 0)), {weights})" if reserved else weights
    levels = lists.withColumn("leaves", F.expr(leaves)).withColumn("levels", F.expr(_levels(limit)))
    # From the last level downwards: how many items are paid for, and how many of them are leaves.
    step = "transform(array(size(filter(slice(level, 1, acc.paid), q -> q.package = 0))), c -> named_struct('paid', 2 * (acc.paid - c), 'leaves', concat(acc.leaves, array(c))))[0]"
    paid = f"aggregate(reverse(levels), named_struct('paid', 2 * size(leaves) - 2, 'leaves', cast(array() as array<int>)), (acc, level) -> {step}, acc -> acc.leaves)"
    rank = f"pos + {int(reserved)}"
    rows = levels.select(*by, "s", F.expr(paid).alias("paid"), F.size("leaves").alias("codes")).select(*by, "paid", "codes", F.posexplode("s").alias("pos", "q"))
    rows = rows.select(*by, "q.symbol", "q.n", F.expr(f"if(codes = 1, 1, size(filter(paid, c -> c > {rank})))").alias("length"))
    before = Window.partitionBy(*by).orderBy("length", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {limit} - length)")).over(before), F.lit(0))
    coded = rows.withColumn("code", F.call_function("shiftright", whole.cast("long"), F.lit(limit) - F.col("length")))
    none = sized.filter(F.col("symbols") > most).select(*by, "symbol", "n", F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("code"))
    return coded.unionByName(none)

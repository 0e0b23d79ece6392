"""Order-dependent columns (W4-W14, A47). Every window has a partition; a whole-table order isn't gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def angle_fraction(keys: Sequence[str], order: Sequence[str]) -> Column:
    """(j + 1) / (n + 1) of a row in its cell."""
    w = Window.partitionBy(*keys)
    return F.row_number().over(w.orderBy(*order)) / (F.count("*").over(w) + 1)


def jitter(x: str, y: str, order: Sequence[str], radius: float) -> tuple[Column, Column]:
    """Rows at one place on a circle around it; a row alone stays."""
    w = Window.partitionBy(x, y)
    n = F.count("*").over(w)
    angle = 2 * F.pi() * (F.row_number().over(w.orderBy(*order)) - 1) / n
    move = lambda c, f: F.when(n > 1, F.round(F.col(c) + radius * f(angle), 6)).otherwise(F.col(c))
    return move(x, F.cos), move(y, F.sin)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The number of the run of equal values that a row is in, its parity, and its length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turned = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    out = df.withColumn("_turn", turned).withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")
    return out.withColumns({"parity": F.col("run") % 2, "span": F.count("*").over(Window.partitionBy(*keys, "run"))})


def running_span(keys: Sequence[str], order: Sequence[str], size: str) -> tuple[Column, Column]:
    """Where a row begins and ends if the rows of its group are laid end to end."""
    end = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return end - F.col(size), end


def best_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """After how many rows to cut a group so that the larger part is smallest; the later of equal cuts."""
    w = Window.partitionBy(*keys)
    k, head = F.row_number().over(w.orderBy(*order)), F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = df.select(*keys, k.alias("_k"), head.alias("_head"), F.sum(size).over(w).alias("_all"))
    larger = F.greatest(F.col("_head"), F.col("_all") - F.col("_head"))
    return cut.groupBy(*keys).agg(F.min_by("_k", F.struct(larger, -F.col("_k"))).alias("cut"), F.min(larger).alias("larger"))


def clamp(positions: Column, size: float, low: float, high: float) -> Column:
    """Sorted positions pushed apart to `size` forwards, then back from the upper end; two folds over the array."""
    push = lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.coalesce(F.try_element_at(acc, F.lit(-1)) + size, F.lit(low)))))
    back = lambda acc, x: F.concat(acc, F.array(F.least(x, F.coalesce(F.try_element_at(acc, F.lit(-1)) - size, F.lit(high)))))
    empty = F.array().cast("array<double>")
    forward = F.aggregate(F.array_sort(positions), empty, push)
    return F.reverse(F.aggregate(F.reverse(forward), empty, back))


def first_batch(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, n: int) -> DataFrame:
    """The first n rows of a group, and the rest of the block that the last of them is in."""
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(*order))
    reach = F.max(F.when(F.col("_k") == n, F.col(block))).over(w)
    tagged = df.withColumn("_k", k).withColumn("_reach", reach)
    return tagged.where((F.col("_k") <= n) | (F.col(block) == F.col("_reach"))).drop("_k", "_reach")


def carried(keys: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rate(keys: Sequence[str], ts: str, seconds: int, amount: Column) -> Column:
    """T5: the amount of the last `seconds` seconds, the row included."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return F.sum(amount).over(w)

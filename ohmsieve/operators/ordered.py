"""Ordered target statistics of categories: what the rows before a row, in a random order, say of its category.

A statistic is (sum of labels + STRENGTH * PRIOR) / (rows + STRENGTH) over the
rows of the same category that come earlier, so no row sees its own label.  An
order is a hash of the row's key; rows of one key stand at one place and do not
see each other.  The place's first bits are its part: sums are taken inside
parts and the sums of the parts before are added, so a category that holds
most rows is spread over 2 ** PART_BITS tasks.

For models of folds, a training row's statistic leaves out the model's own fold,
and a row of that fold has the statistic of all training rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.io import scratch_table

# The prior and its weight in rows.
PRIOR, STRENGTH = 0.5, 1.0
ORDERS, PART_BITS = 2, 8
#: Hexadecimal digits of a place.
DIGITS = 15


def place(key: Column, order: int) -> Column:
    """Where a key stands in an order: the first bits of an md5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{order}")).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def statistic(total: Column, n: Column) -> Column:
    return (total.cast("double") + E.dbl(STRENGTH * PRIOR)) / (n.cast("double") + E.dbl(STRENGTH))


def _cells(rows: DataFrame, columns: list[str], key: str, more: list[str], orders: int) -> DataFrame:
    """(more, y, nth, col, value, part): a row for each row, order and column."""
    part = lambda k: F.shiftright(place(F.col(key), k), 4 * DIGITS - PART_BITS).cast("int")
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(E.NULL_TOKEN)).alias("value"), part(k).alias("part")) for k in range(orders) for c in columns]))
    return rows.select(*more, F.col("Label").cast("long").alias("y"), each)


def earlier(cells: DataFrame, sums: dict[str, Column], key: str, orders: int = ORDERS) -> DataFrame:
    """``cells`` with, for each of ``sums``, the sum over the earlier rows of the same order, column and value.

    Cells move as narrow as they are: places and what is summed follow from them behind the exchange.
    """
    of = ["nth", "col", "value"]
    summed = [x.alias(f"_{k}") for k, x in sums.items()]
    parts = cells.select(*of, "part", *summed).groupBy(*of, "part").agg(*[F.sum(f"_{k}").alias(k) for k in sums])
    before = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carry = parts.select(*of, "part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in sums])
    here = Window.partitionBy(*of, "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    at = F.lit(None).cast("long")
    for k in range(orders):
        at = F.when(F.col("nth") == k, place(F.col(key), k)).otherwise(at)
    local = cells.repartition(*of, "part").select("*", at.alias("at"), *summed)
    local = local.select("*", *[F.coalesce(F.sum(f"_{k}").over(here), F.lit(0)).alias(f"{k}_here") for k in sums])
    out = local.join(carry, [*of, "part"])
    return out.withColumns({k: F.col(f"{k}_here") + F.col(f"{k}_before") for k in sums}).drop(*[f"{k}_{x}" for k in sums for x in ("here", "before")], *[f"_{k}" for k in sums])


def ordered_statistics(rows: DataFrame, columns: list[str], key: str = "Id", orders: int = ORDERS) -> DataFrame:
    """(key, nth, col, statistic) of every row (key, Label, columns), order and column."""
    found = earlier(_cells(rows, columns, key, [key], orders), {"total": F.col("y"), "n": F.lit(1).cast("long")}, key, orders)
    return found.select(key, "nth", "col", statistic(F.col("total"), F.col("n")).alias("statistic"))


def whole_statistics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, statistic) over all rows: what new rows get; a value not seen has the PRIOR."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(E.NULL_TOKEN)).alias("value")) for c in columns]))
    sums = rows.select(F.col("Label").cast("long").alias("y"), each).groupBy("col", "value").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select("col", "value", statistic(F.col("total"), F.col("n")).alias("statistic"))


def for_models(rows: DataFrame, columns: list[str], splits: list[tuple[str, int]], orders: int = ORDERS, train: Column | None = None) -> tuple[DataFrame, list[list[str]]]:
    """``rows`` (row, Label, columns, fold columns) with a statistic for each model and column, and their names by model.

    Models: one for each fold of each (fold column, folds) of ``splits``, then
    one of all rows.  ``row`` tells all rows apart.  The mean over the orders is
    taken; rows without ``train`` teach nothing.
    """
    taught = F.lit(True) if train is None else train
    folds = [name for name, _ in splits]
    base = rows.select("row", *columns, *folds, F.when(taught, F.col("Label")).alias("Label"), F.when(taught, 1).otherwise(0).alias("taught"))
    cells = _cells(base, columns, "row", ["row", "taught", *folds], orders)
    y, one = F.coalesce("y", F.lit(0)), F.col("taught").cast("long")
    mine = [(f"{name}{k}", F.col(name) == k) for name, n in splits for k in range(n)]
    sums = {"t": y, "n": one} | {f"t_{m}": F.when(is_in, y).otherwise(0) for m, is_in in mine} | {f"n_{m}": F.when(is_in, one).otherwise(0) for m, is_in in mine}
    cells = scratch_table(cells, "cells")
    found = earlier(cells, sums, "row", orders)
    of = ["col", "value"]
    whole = cells.filter("nth = 0").groupBy(*of).agg(*[F.sum(x).alias(f"all_{k}") for k, x in sums.items()])
    found = found.join(whole, of)
    each = [F.when(is_in, statistic(F.col("all_t") - F.col(f"all_t_{m}"), F.col("all_n") - F.col(f"all_n_{m}"))).otherwise(statistic(F.col("t") - F.col(f"t_{m}"), F.col("n") - F.col(f"n_{m}"))) for m, is_in in mine]
    each.append(statistic(F.col("t"), F.col("n")))
    names = [[f"_stat_{m}_{c}" for c in columns] for m in range(len(each))]
    # a cell moves with a number a model, not with the sums of all columns
    narrow = found.select("row", "col", *[x.alias(f"m{m}") for m, x in enumerate(each)]).repartition("row")
    wide = narrow.groupBy("row").agg(*[F.avg(F.when(F.col("col") == c, F.col(f"m{m}"))).alias(names[m][i]) for m in range(len(each)) for i, c in enumerate(columns)])
    return rows.join(wide, "row"), names


def with_statistics(df: DataFrame, learned: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """New rows with the statistic of each column's value from :func:`whole_statistics`."""
    for c, name in zip(columns, names, strict=True):
        own = learned.filter(F.col("col") == c).select(F.col("value").alias("_value"), F.col("statistic").alias(name))
        value = F.coalesce(F.col(c).cast("string"), F.lit(E.NULL_TOKEN))
        df = df.withColumn("_value", value).join(own, "_value", "left").drop("_value").withColumn(name, F.coalesce(name, E.dbl(PRIOR)))
    return df



"""Operators on ordered rows: carrying, sessions, paging, latest and changed rows.

All of them work within a key and need a total order, so that ties can't change a result. None needs all
rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESET = "\x00"


def _within(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def carry_forward(rows: DataFrame, keys: list[str], order: list, mark: Column, name: str, reset: Column | None = None) -> DataFrame:
    """The latest mark at or before each row; rows where reset holds start anew without one."""
    shown = F.when(F.coalesce(reset, F.lit(False)), F.lit(RESET)).otherwise(mark) if reset is not None else mark
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.nullif(F.last(shown, ignorenulls=True).over(upto), F.lit(RESET)))


def sessions(rows: DataFrame, keys: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """Number of the session of each row; rows before the first start are session 0."""
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(upto).cast("int"))


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """1, 2, 3, ... within keys."""
    return rows.withColumn(name, F.row_number().over(_within(keys, order)))


def running_start(rows: DataFrame, keys: list[str], order: list, amount: str, name: str) -> DataFrame:
    """Sum of the amounts before each row, for items that hold several pages."""
    before = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)))


def page(rows: DataFrame, keys: list[str], order: list, since: int = 0, limit: int = 60, most: int = 200) -> DataFrame:
    """Rows since+1 .. since+limit of each key, with their 0-based line_no and the key's total.

    since counts from 0 up and is cut to what there is; limit is at least 1 and at most `most`.
    """
    limit, since = max(1, min(limit, most)), max(0, since)
    w = _within(keys, order)
    out = rows.withColumn("line_no", (F.row_number().over(w) - 1).cast("long")).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return out.where((F.col("line_no") >= since) & (F.col("line_no") < since + limit))


def tail(rows: DataFrame, keys: list[str], order_desc: list, n: int, name: str = "from_end") -> DataFrame:
    """The last n rows of each key, numbered from the end."""
    return rows.withColumn(name, F.row_number().over(_within(keys, order_desc))).where(F.col(name) <= n)


def latest(rows: DataFrame, keys: list[str], newest_first: list) -> DataFrame:
    """One row a key: the first in an order that begins with the newest."""
    return rows.withColumn("__n", F.row_number().over(_within(keys, newest_first))).where("__n = 1").drop("__n")


def transitions(rows: DataFrame, keys: list[str], order: list, status: str, before: str = "before") -> DataFrame:
    """Rows whose status is another than their predecessor's; the first row of a key counts as one."""
    out = rows.withColumn(before, F.lag(status).over(_within(keys, order))).withColumn("__n", F.row_number().over(_within(keys, order)))
    return out.where((F.col("__n") == 1) | ~F.col(status).eqNullSafe(F.col(before))).drop("__n")


def neighbours(rows: DataFrame, keys: list[str], order: list, item: str, radius: int = 2) -> DataFrame:
    """Items around each one, nearest first and the one before ahead of the one after."""
    w = _within(keys, order)
    near = [f(item, k).over(w) for k in range(1, radius + 1) for f in (F.lag, F.lead)]
    return rows.withColumn("near", F.array_compact(F.array(*near)))


def steps(rows: DataFrame, keys: list[str], order: list, item: str) -> DataFrame:
    """The item before and the one after each; at the ends the item itself."""
    w = _within(keys, order)
    return rows.withColumn("prev_item", F.coalesce(F.lag(item).over(w), F.col(item))).withColumn("next_item", F.coalesce(F.lead(item).over(w), F.col(item)))


def attempts(tries: DataFrame, keys: list[str], order: list, success: Column, most: int = 2) -> DataFrame:
    """For each key how many tries were made before success or the limit, and whether it came."""
    first = tries.withColumn("__n", F.row_number().over(_within(keys, order))).where(F.col("__n") <= most)
    out = first.groupBy(*keys).agg(F.min(F.when(success, F.col("__n"))).alias("won"), F.max("__n").alias("made"))
    return out.select(*keys, F.coalesce("won", "made").cast("int").alias("attempts"), F.when(F.col("won").isNotNull(), "success").otherwise("failed").alias("status"))


def joined_text(rows: DataFrame, keys: list[str], position: list[str], text: str, name: str, between: str = "") -> DataFrame:
    """The parts of each key put together in the order of their positions."""
    parts = F.array_sort(F.collect_list(F.struct(*position, F.col(text).alias("__t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), between).alias(name))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """base with changes in place of rows of the same key; among changes the last version wins."""
    both = base.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    return latest(both, keys, [F.desc("__side"), *(F.desc(v) for v in version)]).drop("__side")


def replace_keys(base: DataFrame, fresh: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Pages after a run: a key that ran loses its old rows, also when it failed; its new ones come from success.

    outcomes has the key and a status: success, failed, skipped or no_input. Skipped keys and keys without
    input keep what they had.
    """
    ran = outcomes.where(F.col("status").isin("success", "failed")).select(key)
    won = outcomes.where(F.col("status") == "success").select(key)
    return base.join(ran, key, "left_anti").unionByName(fresh.join(won, key, "left_semi"))


def changed(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """Keys of new whose signature differs from old's or that old has not."""
    before = old.select(key, F.col(signature).alias("__old"))
    return new.join(before, key, "left").where(~F.col(signature).eqNullSafe(F.col("__old"))).drop("__old")


def least_that_fits(tries: DataFrame, keys: list[str], order: list, size: str, limit: int) -> DataFrame:
    """For each key the first try of at most limit, or else the smallest, the first of equals."""
    fits = F.when(F.col(size) <= limit, 0).otherwise(1)
    rank = F.when(F.col(size) <= limit, F.lit(0)).otherwise(F.col(size))
    return latest(tries, keys, [fits, rank, *order])


def queue_order(requests: DataFrame, keys: list[str], item: str, seq: str, urgent: str) -> DataFrame:
    """Places in a queue: each item once; urgent ones ahead, the latest urgent one first, others by first request."""
    one = requests.groupBy(*keys, item).agg(F.min(seq).alias("__first"), F.max(F.when(F.col(urgent), F.col(seq))).alias("__urgent"))
    w = Window.partitionBy(*keys).orderBy(F.col("__urgent").isNull(), F.desc("__urgent"), "__first")
    return one.select(*keys, item, F.row_number().over(w).alias("place"))

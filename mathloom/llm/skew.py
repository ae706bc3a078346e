"""Joins of rows with equal keys when single keys may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of all rows, so there are at most 1000 hot keys.
HOT_SHARE = 0.001


def join_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per key and its number of rows in ``n``.

    ``total`` is at least the sum of ``n``, so at most 1 / HOT_SHARE groups are hot: they are
    broadcast and their rows never shuffled. All others take an ordinary shuffled join.
    Null keys match nothing; ``n`` is not part of the result.
    """
    limit = max(2.0, total * HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(n) >= limit).drop(n))
    cold = groups.where(F.col(n) < limit).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


#: So many rows of a hot key meet so many others in one task.
BLOCK = 1024
#: One row id in so many takes part in the search for hot keys.
SAMPLED = 64
#: Hot keys at most, which bounds their broadcast: a few numbers each.
MOST_HOT = 1 << 20
#: Rows that one task of the join reads, about 10 MB.
ROWS_A_TASK = 250_000


def sampled(row_id: str) -> Column:
    """Does a row take part in the search for hot keys?"""
    return F.pmod(F.xxhash64(row_id), F.lit(SAMPLED)) == 0


def pairs_within(
    rows: DataFrame, keys: list[str], row_id: str, n_rows: int, condition: Column | None, columns: list[str], sides: tuple[Column, Column] | None = None, sample: DataFrame | None = None
) -> DataFrame:
    """Pairs of ``rows`` with the same ``keys`` that meet ``condition``, in which the sides are called x and y.
    The result has x and y versions of ``columns`` as x_... and y_....

    Without ``sides`` each unordered pair comes once, x with the smaller ``row_id``; with them x meets the first
    and y the second of two conditions on a row. Rows of one row_id are never paired. Null keys match nothing.
    Conditions of equality belong into ``keys``: Spark would take them for keys of the join and shuffle once more.

    No task sees all pairs of a large key: keys that seem to hold at least BLOCK rows and a 2^20th of all rows
    (about ``n_rows``) in a sample of row ids are cut into blocks of about BLOCK rows, and every two blocks are
    a join key of their own. There are at most MOST_HOT such keys (each holds its share of the rows, up to the
    error of the sample), so they are broadcast. The others are shuffled once for both sides, into as many
    partitions as their number asks for. The sample only picks the way a key takes; no pair depends on it.
    ``sample``: the sampled rows, where computing them from ``rows`` would cost as much as all of them.
    """
    limit = max(float(BLOCK), n_rows / MOST_HOT) / SAMPLED
    seen = rows.where(sampled(row_id)) if sample is None else sample
    counts = seen.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= limit)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") * SAMPLED / BLOCK).cast("int").alias("_g")))
    left, right = sides or (F.lit(True), F.lit(True))
    kept = condition if condition is not None else F.lit(True)
    x_id, y_id = F.col(f"x.{row_id}"), F.col(f"y.{row_id}")
    parts = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))

    same = lambda *more: reduce(and_, (F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, *more)))
    once = rows.join(hot.select(*keys), keys, "left_anti").repartition(parts, *keys)
    order = x_id != y_id if sides else x_id < y_id
    cold = once.where(left).alias("x").join(once.where(right).alias("y"), same()).where(kept & order)
    cold = cold.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in columns))

    many = rows.join(hot, keys).withColumn("_b", F.pmod(F.xxhash64(row_id, F.lit(1)), F.col("_g").cast("long")).cast("int"))
    first = F.lit(0) if sides else F.col("_b")
    last = F.col("_g") - 1 if sides else F.col("_b")
    x = many.where(left).withColumn("_j", F.explode(F.sequence(first, F.col("_g") - 1))).withColumn("_i", F.col("_b")).alias("x")
    y = many.where(right).withColumn("_i", F.explode(F.sequence(F.lit(0), last))).withColumn("_j", F.col("_b")).alias("y")
    met = x.join(y, same("_i", "_j"))
    apart = x_id != y_id if sides else (x_id < y_id) | ((F.col("x._i") < F.col("x._j")) & (x_id != y_id))
    swap = F.lit(False) if sides else x_id > y_id
    side = lambda a, b, c: F.when(swap, F.col(f"{b}.{c}")).otherwise(F.col(f"{a}.{c}")).alias(f"{a}_{c}")
    split = met.where(kept & apart).select(*(side(a, b, c) for a, b in ("xy", "yx") for c in columns))
    return cold.unionByName(split)

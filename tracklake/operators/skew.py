"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(sizes: DataFrame, key: str, total: int, least: int = 64) -> dict[int, list]:
    """Number of parts -> keys that are to be split so, from the rows of each key (key, n).

    A key with more rows than a quarter of an even task's share (``least`` at least)
    is hot.  There are at most four hot keys for each shuffle partition, so their
    list is small whatever the data.
    """
    limit = max(least, total // (4 * int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = defaultdict(list)
    for value, parts in sizes.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("long")).collect():
        out[1 << (parts - 1).bit_length()].append(value)
    return dict(out)


def parts_of(key: str, hot: dict[int, list]) -> Column:
    """In how many parts the rows of a key are dealt, 1 for all but hot keys."""
    out = F.lit(1).cast("long")
    for parts, values in hot.items():
        out = F.when(F.col(key).isin(values), F.lit(parts).cast("long")).otherwise(out)
    return out


def join_to_one(many: DataFrame, one: DataFrame, key: str, spread: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Join rows of ``many`` to the single row of ``one`` with their key.

    Rows of a hot key are dealt over several tasks by the hash of the columns
    ``spread``, and its row of ``one`` is repeated for each.  ``sizes`` (key, n) may
    give the rows of each key where they are known.  ``many`` (or ``sizes``) is read
    twice, so it should be a stored table.  Null keys join nothing.
    """
    sizes = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    parts = parts_of(key, hot_keys(sizes, key, sizes.agg(F.sum("n")).first()[0] or 0))
    left = many.withColumn("tl_slot", F.pmod(F.xxhash64(*spread), parts))
    right = one.withColumn("tl_slot", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return left.join(right.hint("merge"), [key, "tl_slot"], how).drop("tl_slot")


#: Rows that one task joins in no time; a join of fewer is not searched for hot keys.
SMALL = 1 << 20


def join_lookup(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], rows: int) -> DataFrame:
    """Inner join of ``rows`` rows of the stored table ``many`` to the single row of ``one`` with their keys.

    Where there are more than :data:`SMALL` rows, keys with over a quarter of an even
    task's share are marked in a table of their own (four rows for each shuffle
    partition at most), which both sides meet by a broadcast join: rows of such a key
    are dealt by the hash of ``spread`` and its row of ``one`` is repeated.
    """
    if rows <= SMALL:
        return many.join(one, keys)
    limit = max(SMALL // 4, rows // (4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(many.groupBy(*keys).agg(F.count("*").alias("tl_n")).where(F.col("tl_n") > limit).select(*keys, F.ceil(F.col("tl_n") / limit).cast("long").alias("tl_parts")))
    left, right = (t.join(hot, keys, "left").withColumn("tl_parts", F.coalesce("tl_parts", F.lit(1).cast("long"))) for t in (many, one))
    left = left.withColumn("tl_slot", F.pmod(F.xxhash64(*spread), F.col("tl_parts"))).drop("tl_parts")
    right = right.withColumn("tl_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tl_parts") - 1))).drop("tl_parts")
    return left.join(right, [*keys, "tl_slot"]).drop("tl_slot")

"""Joins that send no hot key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hot_keys(rows: DataFrame, key: str, share: int = 1000) -> list:
    """Keys that hold more than one in ``share`` of all rows: fewer than ``share`` of them, whatever the data.

    One aggregate over the key column, partial before the shuffle.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * share > F.col("_t")).where("_n > 1000")  # one row; small keys need no help
    return [r[0] for r in hot.select(key).collect()]


def join_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", share: int = 1000, hot: list | None = None) -> DataFrame:
    """``rows`` joined to ``unique``, which has at most one row a key, on ``key`` (inner or left).

    Rows of hot keys meet the fewer than ``share`` rows of ``unique`` for them in a
    broadcast join and are not moved; all others go through an ordinary join.
    ``hot`` names the hot keys where they are known already.
    """
    hot = hot_keys(rows, key, share) if hot is None else hot
    if not hot:
        return rows.join(unique, key, how)
    is_hot: Column = F.coalesce(F.col(key).isin(*hot), F.lit(False))
    few = unique.where(F.col(key).isin(*hot))  # fewer rows than ``share``
    return rows.where(is_hot).join(F.broadcast(few), key, how).unionByName(rows.where(~is_hot).join(unique, key, how))

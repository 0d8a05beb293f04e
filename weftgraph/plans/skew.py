"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than this share of the left rows, so there are
#: never more than ``1 / HOT_SHARE`` hot keys and their broadcast is bounded.
HOT_SHARE = 1 / 200
SALTS = 64
#: Below this many rows on one key a task handles them without salting.
HOT_LEAST = 200_000


def hot_keys(left: DataFrame, key: str, rows: int) -> DataFrame:
    """Keys of ``left`` above the hot share: at most ``1 / HOT_SHARE`` rows."""
    bound = max(HOT_LEAST, int(rows * HOT_SHARE))
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(key)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` JOIN ``right`` on ``key``; ``right`` is unique on ``key`` or holds few rows a key.

    ``rows`` is the row count of ``left``.  Hot keys of the left side are salted
    over ``SALTS`` tasks and only their few right rows are repeated.  Null keys
    match nothing.  No row is dropped or sampled.

    The hot keys are found at once, so that the plan holds no more than a join where
    there are none: ``left`` should be cheap to read twice (a written table).
    """
    if rows <= HOT_LEAST:  # no key can be hot
        return left.join(right, key, how)
    keys = hot_keys(left.where(F.col(key).isNotNull()), key, rows)
    listed = keys.collect()  # at most 1 / HOT_SHARE
    if not listed:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(listed, keys.schema).withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    repeat = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.join(hot, key, "left").withColumn("_salt", spread).drop("_hot")
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(repeat)).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")

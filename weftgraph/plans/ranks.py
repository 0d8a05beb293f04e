"""Places in a total order without gathering the rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scratch import Scratch

_BITS = 33  # of the row number within a partition


def numbered(df: DataFrame, *order: Column | str, out: str = "ord", start: int = 0) -> DataFrame:
    """``df`` with ``out``, the row's place from ``start`` in ``order``.

    Rows are range-partitioned by a sort and written; one count a partition comes
    to the driver, and a row's place is its partition's offset and its own number.
    """
    spark = df.sparkSession
    rows = Scratch(spark, "ranks").save(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _BITS).alias("_part")
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = zip([p for p, _ in counts], accumulate([start, *(n for _, n in counts)]))
    off = spark.createDataFrame(list(offsets), "_part bigint, _off bigint")
    placed = rows.withColumn("_part", F.shiftright("_m", _BITS)).join(F.broadcast(off), "_part")  # a row a partition
    return placed.withColumn(out, F.col("_off") + F.col("_m").bitwiseAND((1 << _BITS) - 1)).drop("_m", "_part", "_off")

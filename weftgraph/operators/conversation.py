"""Conversation history: complete turns of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYWORD_ANSWERS = r"""^(\{ "high_level_keywords"|\{'high_level_keywords')"""


def turns(messages: DataFrame, n: int, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``conv, history``: the last ``n`` pairs of a user's and an assistant's message, the user first.

    Messages pair up as (0, 1), (2, 3), ... after keyword answers are left out;
    other pairs are skipped.
    """
    if n <= 0:
        return messages.select(conv).distinct().withColumn("history", F.lit(""))
    kept = messages.where(~((F.col("role") == "assistant") & F.col("text").rlike(KEYWORD_ANSWERS)))
    place = F.row_number().over(Window.partitionBy(conv).orderBy(order)) - 1
    numbered = kept.withColumn("p", F.floor(place / 2)).withColumn("u", F.when(F.col("role") == "user", F.col("text"))).withColumn("a", F.when(F.col("role") == "assistant", F.col("text")))
    pairs = numbered.groupBy(conv, "p").agg(F.max("u").alias("u"), F.max("a").alias("a"), F.count(F.lit(1)).alias("m")).where("m = 2 AND u IS NOT NULL AND a IS NOT NULL")
    last = pairs.withColumn("r", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc("p")))).where(F.col("r") <= n)
    line = F.concat(F.lit("user: "), "u", F.lit("\nassistant: "), "a")
    by = last.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))
    return messages.select(conv).distinct().join(by, conv, "left").select(conv, F.coalesce("history", F.lit("")).alias("history"))

"""Filling fixed-capacity containers with items of varying length (problem 7).

Method: length-histogram planning.  Only the counts of items by length, at most
``capacity`` numbers, come to the driver; a best-fit plan is made over those
counts; then every item takes a planned slot by joining on its rank among the
items of its length.

Results: one row a piece.  An item over the capacity is split into full pieces
and a remainder, nothing else is split; items of null or zero size are left
out; equal lengths, repeated rows and any key type are taken as they are; the
same input gives the same plan, and a container never exceeds its capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans import Scratch

CAPACITY = 2048
#: Ranks within one length are counted in buckets of the key, at least this many and one for so
#: many pieces, so that one length may hold a third of all items.
BUCKETS, BUCKET_PIECES = 1024, 500_000
#: Rows of a plan that are broadcast (some 3 MB); a larger plan is joined by size instead.
BROADCAST_PLAN = 100_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first.

    Rows ``(size, first_rank, last_rank, first_container, items_each)``: the
    items of ``size`` whose rank is in [first_rank, last_rank] fill containers
    from ``first_container`` on, ``items_each`` to a container.  Open containers
    are kept as runs of equal free space, so the work follows the number of
    distinct lengths and never the number of items; a plan has some rows a length.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first container, how many)
    spaces: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def give(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, many))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            i = bisect_left(spaces, size)
            if i < len(spaces):  # the tightest open containers that hold the size
                space = spaces[i]
                first, many = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(i)
            else:
                space, first = capacity, made
                many = -(-left // (capacity // size))
                made += many
            each = space // size
            full = min(many, left // each)
            if full:
                rows.append((size, rank, rank + full * each - 1, first, each))
                give(space - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many and left:  # fewer items than one container takes
                rows.append((size, rank, rank + left - 1, first + full, left))
                give(space - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(space, first + full, many - full)
    return rows


def pieces(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, size``: whole items, and the pieces of oversized ones."""
    n = F.col("n")
    cut = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n")).where("n > 0")
    last = F.floor((n - 1) / capacity).cast("int")
    spread = cut.select("key", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return spread.select("key", "piece", F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("size"))


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key, piece, size, container`` for every item of positive size."""
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    parts = pieces(items, key, size, capacity)
    all_pieces = scratch.save(parts)
    buckets = max(BUCKETS, -(-all_pieces.count() // BUCKET_PIECES))
    salted = all_pieces.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    by_bucket = scratch.save(salted.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("many")))
    # One number a length: at most ``capacity``, whatever the corpus.
    histogram = {r["size"]: r["n"] for r in by_bucket.groupBy("size").agg(F.sum("many").alias("n")).collect()}
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(rows, "size int, lo bigint, hi bigint, first bigint, each bigint")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = by_bucket.select("size", "bucket", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    # The offsets follow the number of buckets, so they are shuffled to the ranks and not broadcast.
    ranked = salted.withColumn("rn", F.row_number().over(within)).join(offsets.hint("merge"), ["size", "bucket"])
    ranked = ranked.select("key", "piece", "size", (F.col("off") + F.col("rn") - 1).alias("rank"))
    slots = F.broadcast(slots) if len(rows) <= BROADCAST_PLAN else slots.hint("merge")
    placed = ranked.join(slots, (ranked["size"] == slots["size"]) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return placed.select(
        F.col("key").alias(key), "piece", ranked["size"].alias("size"), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("bigint").alias("container")
    )


def fill(packed: DataFrame, capacity: int = CAPACITY, size: str = "size", container: str = "container") -> DataFrame:
    """One row: ``containers, tokens, least`` possible containers, ``unused`` share, and ``fullest`` and ``emptiest`` container."""
    each = packed.groupBy(container).agg(F.sum(F.col(size).cast("bigint")).alias("n"))
    total = each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n").alias("fullest"), F.min("n").alias("emptiest"))
    unused = F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), unused.alias("unused"), "fullest", "emptiest")

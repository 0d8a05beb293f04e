"""Most similar vectors for every vector (problem 1).

Method: multi-index hashing.  A rotation learned from a sample gives binary
codes; a code is split into ``m`` substrings, each of which is indexed, and every
substring's index is probed within ``r`` = ``PROBE_BITS`` bits.  By the pigeonhole
principle two codes within Hamming radius ``m (r + 1) - 1`` agree in at least one
substring up to ``r`` bits, so all of those are retrieved.  Pairs at the threshold
lie further apart than that radius as a rule; they are retrieved where any
substring happens to be within ``r`` bits, and there are as many substrings as the
wanted recall at the threshold needs by that count (``index_shape``).  What is
retrieved is cut to the radius that holds pairs at the threshold, and the rest is
reranked by the cosine of the floats.

Plan.  The pigeonhole principle is used once more to spread the index: of the
``r + 1`` chunks of a substring two values within ``r`` bits share one, so a row goes
to the cells (substring, chunk, chunk's value), and cells are spread over all
partitions; a task holds some rows times cells / partitions.  Cells above
``BLOCK_ROWS`` rows are split into a triangle of blocks.  A partition meets a row's
code once, however many of its cells lie there.  Retrieved pairs are gathered by
their smallest neighbour, so that a vector is sent once for many pairs.

A vector is usable when it has the expected length, only finite components and
a positive norm; unusable ones (null, empty, zero, NaN, another length) are in
no result.  Lengths of vectors do not matter.  Rows of equal direction (to one
millionth in every component), which one vector repeated over a third of the
table would make, are one class for the index: every row of a class gets the
``k`` smallest other ids of its class, with cosine 1.  Equal cosines rank by the
smaller id.  An empty table gives an empty result.  Many *different* vectors
within the threshold of each other cost time in proportion to their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.neardup import partition_keys
from weftgraph.plans import Scratch, lookup

DIM = 64
#: Rows on which the rotation is fitted; a bound, every row is indexed.
FIT_ROWS = 8192
FIT_ROUNDS = 20
PROBE_BITS = 2
CHUNKS = PROBE_BITS + 1
#: Rows of a cell above which it is split into blocks of that many.
BLOCK_ROWS = 1 << 17
#: Pairs whose cosines a task computes at once, about.
RERANK_PAIRS = 200_000
#: Standard deviations of a pair's Hamming distance within the radius.
RADIUS_SIGMAS = 3.5
_STEP = 1 << 19


def _usable(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import xxhash

        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
            rows = batch.filter(pc.and_(right, pc.is_valid(batch.column(0))))
            if not rows.num_rows:
                continue
            x = matrix(rows.column(1), rows.num_rows).astype(np.float64)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
                fine = np.isfinite(norm) & (norm > 0)
                x = x[fine] / norm[fine, None]
            near = np.round(x * 1_000_000).astype(np.int32)
            cls = [xxhash.xxh3_64_intdigest(r.tobytes()) - (1 << 63) for r in near]
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(fine)), pa.array(cls, pa.int64()), _lists(x)], names=["id", "cls", "v"])

    return run


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """``id, cls, v array<float>`` of the usable rows, scaled to length one; ``cls`` names the direction."""
    return _vectors(df, key, vector).mapInArrow(_usable(dim), "id bigint, cls bigint, v array<float>")


def _lists(x):
    import numpy as np

    flat = pa.array(np.ascontiguousarray(x, dtype=np.float32).reshape(-1))
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), flat)


def learn_rotations(sample, bits: int, seed: int = 20):
    """Mean and orthogonal directions: iterative quantization, one block of ``dim`` bits at a time."""
    import numpy as np

    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    x = (sample - mean).astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)  # principal axes
    y = x @ axes
    blocks = []
    for _ in range(-(-bits // dim)):
        r, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        for _ in range(FIT_ROUNDS if len(x) >= dim else 0):
            u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ w).T
        blocks.append(axes @ r)
    return mean.astype(np.float32), np.concatenate(blocks, axis=1)[:, :bits].astype(np.float32)


def index_shape(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a substring, and how many substrings reach ``recall`` at ``threshold``."""
    width = min(24, max(12, math.ceil(math.log2(max(rows, 2)))))
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi  # odds that a bit differs
    near = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(PROBE_BITS + 1))
    return width, max(4, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def packed(bits):
    """(rows, words) the bit matrix as 64-bit words."""
    import numpy as np

    raw = np.packbits(bits, axis=1)
    out = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), dtype=np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


def substrings(words, width: int, m: int):
    """(rows, m) integer substrings of packed codes."""
    import numpy as np

    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)[:, : m * width]
    weights = (1 << np.arange(width)).astype(np.uint32)
    return (bits.reshape(len(words), m, width) * weights).sum(axis=2, dtype=np.uint32)


def matrix(column, n: int):
    """A list column of equal lengths as an (n, dim) array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _coded(shared, dim: int):
    """``id, cls, code`` of the usable rows, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        mean, axes = shared.value
        for batch in _usable(dim)(batches):
            n = batch.num_rows
            if n:
                words = packed((matrix(batch.column(2), n) - mean) @ axes >= 0)
                ends = (np.arange(n + 1) * words.shape[1] * 8).astype(np.int32)
                code = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code], names=["id", "cls", "code"])

    return run


def chunk_spans(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of a substring's chunks."""
    cut = [width * c // CHUNKS for c in range(CHUNKS + 1)]
    return list(zip(cut, (b - a for a, b in zip(cut, cut[1:]))))


class Shape:
    """Substrings of ``width`` bits, ``m`` of them, and the blocks of the cells that have several."""

    def __init__(self, width: int, m: int, blocks: dict[int, int] | None = None):
        self.width, self.m = width, m
        self.spans = chunk_spans(width)
        self.bits = max(n for _, n in self.spans)
        self.blocks = blocks or {}

    def cells(self, subs):
        """(rows, m, chunks) numbers of the cells of each row."""
        import numpy as np

        j = np.arange(self.m)
        parts = [(((j * CHUNKS + c) << self.bits) + ((subs >> np.uint32(a)) & np.uint32((1 << n) - 1)).astype(np.int64)) for c, (a, n) in enumerate(self.spans)]
        return np.stack(parts, axis=2)

    def places(self, subs, ids):
        """Row, cell, block pair and own block of every place a row goes to."""
        import numpy as np

        cell = self.cells(subs).reshape(-1)
        row = np.repeat(np.arange(len(subs)), self.m * CHUNKS)
        none = np.zeros(len(row), dtype=np.int64)
        if not self.blocks:
            return row, cell, none, none
        hot = np.fromiter(self.blocks, np.int64, count=len(self.blocks))
        many = np.fromiter(self.blocks.values(), np.int64, count=len(self.blocks))
        order = np.argsort(hot)
        hot, many = hot[order], many[order]
        at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
        b = np.where(hot[at] == cell, many[at], 1)
        again = np.repeat(np.arange(len(row)), b)
        other = np.arange(len(again)) - np.repeat(np.cumsum(b) - b, b)
        own = (_mixed(ids[row[again]].astype(np.uint64)) % b[again].astype(np.uint64)).astype(np.int64)
        pair = np.where(b[again] > 1, (np.minimum(own, other) << 16) + np.maximum(own, other) + 1, 0)
        return row[again], cell[again], pair, own


def _mixed(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _partition(cell, pair, parts: int):
    import numpy as np

    # Cells are numbered: in turn they fill the partitions evenly; the blocks of one are scattered.
    scattered = np.where(pair == 0, 0, _mixed(pair.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    return (cell + scattered) % parts


def _words(column, n: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(n, -1)


def _count_cells(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(shape.m * CHUNKS << shape.bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(shape.cells(substrings(_words(batch.column(0), batch.num_rows), shape.width, shape.m)).reshape(-1), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["cell", "n"])

    return run


def _route(shape: Shape, keys):
    """For every batch and partition one record of ids, classes and codes of the rows with a place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts = len(keys)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, cls = (batch.column(c).to_numpy() for c in (0, 1))
            _, first = np.unique(cls, return_index=True)  # one row of a direction in a batch
            ids, cls, words = ids[first], cls[first], _words(batch.column(2), n)[first]
            row, cell, pair, _ = shape.places(substrings(words, shape.width, shape.m), ids)
            to = np.unique((_partition(cell, pair, parts) << 32) | row)
            part, row = to >> 32, to & 0xFFFFFFFF
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [ids[r].tobytes() + cls[r].tobytes() + words[r].tobytes() for r in np.split(row, start[1:])]
            p = part[start]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(keys, dtype=np.int32)[p]), pa.array(p.astype(np.int32)), pa.array(blobs, pa.binary())], names=["p", "part", "rows"])

    return run


def masks(width: int, radius: int = PROBE_BITS, without: tuple[int, int] = (0, 0)):
    """All bit patterns of at most ``radius`` ones, zero first; none in the span ``without``."""
    import numpy as np

    one = [1 << i for i in range(width) if not without[0] <= i < sum(without)]
    out, layer = [0], [0]
    for _ in range(radius):
        layer = [x | o for x in layer for o in one if o > x]
        out += layer
    return np.asarray(out, dtype=np.uint64)


def probe_join(values, flips) -> Iterator[tuple]:
    """Index pairs (i, j) whose 64-bit values differ by one of the bit patterns ``flips``, each once."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    cells, start, held = np.unique(values[order], return_index=True, return_counts=True)
    for mask in flips.tolist():
        if mask:
            other = cells ^ np.uint64(mask)
            at = np.searchsorted(cells, other)
            at[at == len(cells)] = 0
            x = np.flatnonzero((cells[at] == other) & (cells < other))
            y = at[x]
        else:
            x = y = np.flatnonzero(held > 1)
        many = held[x] * held[y]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(x):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + _STEP, side="right")))
            c = many[lo:hi]
            k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            w = np.repeat(held[y[lo:hi]], c)
            i = np.repeat(start[x[lo:hi]], c) + k // w
            j = np.repeat(start[y[lo:hi]], c) + k % w
            if not mask:
                keep = i < j
                i, j = i[keep], j[keep]
            yield order[i], order[j]
            lo = hi


def within(words, a, b, radius: int):
    """Which of the pairs (a, b) differ in at most ``radius`` bits."""
    import numpy as np

    keep = np.arange(len(a))
    total = np.zeros(len(a), dtype=np.int32)
    for k in range(words.shape[1]):
        total = total + np.bitwise_count(words[a[keep], k] ^ words[b[keep], k])
        ok = total <= radius
        keep, total = keep[ok], total[ok]
    return keep


def _retrieve(shape: Shape, radius: int, parts: int):
    """Pairs within the full radius, each from the first substring, and chunk of it, that retrieves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        size = -(-shape.width * shape.m // 64)
        got: dict[int, list] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                n = len(data) // (16 + 8 * size)
                x = np.frombuffer(data, dtype=np.int64)
                got.setdefault(part, []).append((x[:n], x[n : 2 * n], x[2 * n :].view(np.uint64).reshape(n, size)))
        for part, pieces in got.items():
            ids, cls, words = (np.concatenate(x) for x in zip(*pieces))
            order = np.lexsort((ids, cls))  # one row a direction: the smallest id that came
            lead = order[np.concatenate([[True], cls[order][1:] != cls[order][:-1]])]
            ids, words = ids[lead], words[lead]
            subs = substrings(words, shape.width, shape.m)
            held: list = []
            for at in range(0, len(ids), 8192):  # a row's places are found again, and those of other partitions left out at once
                row, cell, pair, own = shape.places(subs[at : at + 8192], ids[at : at + 8192])
                here = _partition(cell, pair, parts) == part
                held.append((row[here] + at, cell[here], pair[here], own[here]))
            row, cell, pair, own = (np.concatenate(x) for x in zip(*held))
            tag = cell >> shape.bits
            _, place = np.unique((cell << 32) | pair, return_inverse=True)
            value = (place.astype(np.uint64) << np.uint64(32)) | subs[row, tag // CHUNKS].astype(np.uint64)
            for c in range(CHUNKS):
                mine = np.flatnonzero(tag % CHUNKS == c)
                for x, y in probe_join(value[mine], masks(shape.width, PROBE_BITS, shape.spans[c])):
                    x, y = mine[x], mine[y]
                    keep = within(words, row[x], row[y], radius)
                    x, y = x[keep], y[keep]
                    if len(x):
                        keep = _first(shape, subs, row[x], row[y], tag[x] // CHUNKS, c) & ((own[x] != own[y]) | (pair[x] == 0) | ((pair[x] - 1) >> 16 == (pair[x] - 1) & 0xFFFF))
                        x, y = ids[row[x[keep]]], ids[row[y[keep]]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _first(shape: Shape, subs, a, b, j, c: int):
    """Whether no earlier substring, nor an earlier chunk of substring ``j``, retrieves the pairs (a, b)."""
    import numpy as np

    apart = subs[a] ^ subs[b]
    earlier = ((np.bitwise_count(apart) <= PROBE_BITS) & (np.arange(shape.m) < j[:, None])).any(axis=1)
    mine = apart[np.arange(len(a)), j]
    for start, n in shape.spans[:c]:
        earlier |= (mine >> np.uint32(start)) & np.uint32((1 << n) - 1) == 0
    return ~earlier


def _cosines(threshold: float):
    """Cosines of the pairs of a bucket from its vectors, in slices."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        import numpy as np

        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids)
        x = matrix(vectors.column("v").combine_chunks(), len(ids))
        i, j = (order[np.searchsorted(ids, k, sorter=order)] if len(k) else np.zeros(0, np.int64) for k in (a, b))
        cos = np.empty(len(a))
        for at in range(0, len(a), 50_000):
            u, w = (x[k[at : at + 50_000]].astype(np.float64) for k in (i, j))
            cos[at : at + 50_000] = np.einsum("ij,ij->i", u, w) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", w, w))
        out = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cos": pa.array(cos)})
        return out.filter(pa.array(cos >= threshold - 1e-7))

    return run


def rerank(found: DataFrame, floats: DataFrame, threshold: float, pairs: int, tasks: int) -> DataFrame:
    """``a, b, cos`` of the pairs at or above the threshold; ``floats``: ``id, v``.

    Pairs are gathered by the smallest neighbour of ``a``, and of one neighbour's
    pairs above the share of a bucket by ``a`` as well.
    """
    both = found.union(found.select("b", "a")).toDF("id", "o")
    label = both.groupBy("id").agg(F.min("o").alias("o")).select(F.col("id").alias("a"), F.least("id", "o").alias("label"))
    labelled = found.join(label, "a")
    buckets = max(tasks, -(-pairs // RERANK_PAIRS))
    # At most 1,000 labels have a thousandth of the pairs.
    hot = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(RERANK_PAIRS, pairs // 1000)).select("label", F.lit(True).alias("hot"))
    keyed = labelled.join(F.broadcast(hot), "label", "left") if pairs > RERANK_PAIRS else labelled.withColumn("hot", F.lit(False))
    group = F.pmod(F.xxhash64("label", F.when(F.col("hot"), F.col("a")).otherwise(F.lit(0))), F.lit(buckets)).cast("int")
    keyed = keyed.select(group.alias("g"), "a", "b")
    need = keyed.select("g", F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = need.join(floats, "id").select(F.col("g").alias("g2"), "id", "v")
    return keyed.groupBy("g").cogroup(vectors.groupBy("g2")).applyInArrow(_cosines(threshold), "a bigint, b bigint, cos double")


def full_radius(bits: int, threshold: float) -> int:
    """Hamming radius that holds pairs at the threshold but for one in some thousands (independent bits)."""
    p = math.acos(threshold) / math.pi
    return math.ceil(bits * p + RADIUS_SIGMAS * math.sqrt(bits * p * (1 - p)))


def fit_sample(df: DataFrame, key: str, vector: str, n: int, dim: int = DIM):
    """At most ``FIT_ROWS`` of the ``n`` vectors, those of the smallest id hashes, for the rotation."""
    import numpy as np

    # A share that holds somewhat more rows than wanted, of which the first are taken.
    share = min(1.0, 1.3 * FIT_ROWS / max(1, n))
    h = F.xxhash64(F.col(key).cast("bigint")) / F.lit(2.0**63)
    some = usable(df.where(h <= -1 + 2 * share), key, vector, dim)
    sample = some.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toPandas()
    return np.stack(sample["v"].to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, dim), np.float32)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, k: int = 10, dim: int = DIM, recall: float = 0.99, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, other, cos``: of every row, its ``k`` most similar others at or above ``threshold``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    n = df.count()
    width, m = index_shape(n, threshold, recall)
    shared = spark.sparkContext.broadcast(learn_rotations(fit_sample(df, key, vector, n, dim), width * m))
    coded = scratch.save(_vectors(df, key, vector).mapInArrow(_coded(shared, dim), "id bigint, cls bigint, code binary"), "lz4")
    # Equal directions are one class; the k + 1 smallest ids of it are all that can be neighbours.
    byv = coded.select("id", "cls")
    heads = byv.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copied = scratch.save(heads.where("copies > 1"))
    many = scratch.save(lookup(byv, copied, "cls", n))
    # The rank limit is applied by the map tasks already, so a class never meets whole in one task.
    small = many.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    near = small.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("near"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks: dict[int, int] = {}
    if n > block_rows:  # else no cell can be larger
        # There are at most 3 m 2^(width / 3) cells, some 20,000 at the largest width.
        counted = coded.select("code").mapInArrow(_count_cells(Shape(width, m)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        blocks = {r["cell"]: -(-r["n"] // block_rows) for r in counted.where(F.col("n") > block_rows).collect()}
    shape = Shape(width, m, blocks)
    keys = partition_keys(spark, tasks)
    routed = coded.mapInArrow(_route(shape, keys), "p int, part int, rows binary")
    radius = full_radius(width * m, threshold)
    found = scratch.save(routed.repartition(tasks, "p").mapInArrow(_retrieve(shape, radius, tasks), "a bigint, b bigint"))
    close = scratch.save(rerank(found, _vectors(df, key, vector), threshold, found.count(), tasks))
    rep_of = many.select("id", "rep")
    close = close.join(rep_of.toDF("a", "ra"), "a", "left").join(rep_of.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "cos")
    one_way = close.select(F.col("a").alias("id"), F.col("b").alias("other"), "cos").union(close.select("b", "a", "cos"))
    # A class stands for its copies: give each copy its representative's neighbours, and each neighbour's copies.
    copies = many.select("id", "rep")
    wide = one_way.join(near.withColumnRenamed("rep", "other"), "other", "left")
    wide = wide.select("id", F.explode(F.coalesce("near", F.array("other"))).alias("other"), "cos")
    own = near.select(F.col("rep").alias("id"), F.explode("near").alias("other"), F.lit(1.0).alias("cos"))
    ranked = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    # Of a class one neighbour may be the row itself, so k + 1 are kept until the copies are named.
    of_rep = wide.union(own).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    of_all = of_rep.withColumnRenamed("id", "rep").join(copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "other", "cos").where("id <> other")
    return of_all.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).drop("r")


#: Recall of a search without a threshold at the cosine of the k-th neighbour of structureless vectors.
SEARCH_RECALL = 0.97
#: Rows of a block, and queries that meet it at a time.
SEARCH_ROWS, QUERY_BLOCK = 16_384, 4096
#: Candidates of a query in a block that are reranked by floats, of the smallest Hamming distance.
SEARCH_TOP = 120


def search_index(words, width: int, m: int) -> list[tuple]:
    """For each substring the sorted values, where each starts, how many, and the rows in order."""
    import numpy as np

    subs = substrings(words, width, m)
    out = []
    for j in range(m):
        order = np.argsort(subs[:, j], kind="stable")
        values, start, held = np.unique(subs[order, j], return_index=True, return_counts=True)
        out.append((values, start, held, order))
    return out


def probe(index: list[tuple], asked, width: int, m: int) -> Iterator[tuple]:
    """(query, row) pairs within ``PROBE_BITS`` in a substring, by ranges of queries; each pair once a range."""
    import numpy as np

    subs = substrings(asked, width, m)
    flips = masks(width).astype(np.uint32)
    for at in range(0, len(subs), 64):
        some = subs[at : at + 64]
        pairs = []
        for j, (values, start, held, order) in enumerate(index):
            want = (some[:, j, None] ^ flips).reshape(-1)
            i = np.minimum(np.searchsorted(values, want), len(values) - 1)
            hit = np.flatnonzero(values[i] == want)
            i, many = i[hit], held[i[hit]]
            k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pairs.append((np.repeat(hit // len(flips), many) << 32) | order[np.repeat(start[i], many) + k])
        both = np.unique(np.concatenate(pairs))
        yield (both >> 32) + at, both & 0xFFFFFFFF


def _search(shared, width: int, m: int, k: int):
    """Local top k of a block of queries in a block of rows."""

    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        import numpy as np

        out: list = []
        if base.num_rows and queries.num_rows:
            mean, axes = shared.value
            x, q = (matrix(t.column("v").combine_chunks(), t.num_rows) for t in (base, queries))
            ids, qids = (t.column("id").to_numpy() for t in (base, queries))
            wx, wq = (packed((v - mean) @ axes >= 0) for v in (x, q))
            index = search_index(wx, width, m)
            top = max(SEARCH_TOP, 4 * k)
            for i, j in probe(index, wq, width, m):
                apart = np.bitwise_count(wq[i] ^ wx[j]).sum(axis=1, dtype=np.int64)
                order = np.lexsort((apart, i))
                i, j = i[order], j[order]
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                place = np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]])))
                keep = (place < top) & (ids[j] != qids[i])
                i, j = i[keep], j[keep]
                out.append((qids[i], ids[j], np.einsum("ij,ij->i", q[i].astype(np.float64), x[j].astype(np.float64))))
        a, b, c = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((b, -c, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        keep = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]]))) < k if len(a) else np.zeros(0, bool)
        return pa.table({"id": pa.array(a[keep], pa.int64()), "other": pa.array(b[keep], pa.int64()), "cos": pa.array(c[keep])})

    return run


def usual_cosine(rows: int, k: int, dim: int) -> float:
    """Cosine of the k-th of ``rows`` neighbours where vectors have no structure."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - min(0.4, k / max(1, rows))) / math.sqrt(dim)


def nearest(df: DataFrame, key: str, vector: str, is_query, k: int = 10, dim: int = DIM) -> DataFrame:
    """``id, other, cos``: the ``k`` most similar rows of every query, without a threshold.

    ``is_query`` is a condition on ``id``.  Every row is indexed, in blocks of about
    ``SEARCH_ROWS`` rows with a multi-index each; blocks of queries meet blocks of
    rows, candidates rank by Hamming distance, the first by the floats, and the
    blocks' bests are ranked together.
    """
    spark = df.sparkSession
    rows = Scratch(spark, "search").save(usable(df, key, vector, dim).select("id", "v"), "lz4")
    n = rows.count()
    width, m = index_shape(min(n, SEARCH_ROWS), usual_cosine(n, k, dim), SEARCH_RECALL)
    shared = spark.sparkContext.broadcast(learn_rotations(fit_sample(df, key, vector, n, dim), width * m))
    asked = rows.where(is_query)
    row_blocks, query_blocks = max(1, -(-n // SEARCH_ROWS)), max(1, -(-asked.count() // QUERY_BLOCK))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    base = rows.withColumn("bp", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("qb", spread(query_blocks))
    parts = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("bp", spread(row_blocks))
    local = base.groupBy("bp", "qb").cogroup(parts.groupBy("bp", "qb")).applyInArrow(_search(shared, width, m, k), "id bigint, other bigint, cos double")
    ranked = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return local.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).drop("r")

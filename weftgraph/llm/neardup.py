"""Near-duplicate records with small edits (problem 3).

A pair of records counts when the Jaccard similarity of their sets of word
shingles reaches a threshold.  Words are single characters of U+4E00-U+9FFF or
maximal runs of a-z, 0-9 and U+00C0-U+024F in the lower-cased text.

Method: signature trees.  Every record has a token bitmap and a size; a tree's
nodes hold the OR of their records' bitmaps and the range of their sizes; the
dual traversal of two trees drops a pair of nodes when the largest overlap that
any two of their records could have is too small for any two of their sizes.

Plan.  (1) A frequency sketch, sized by the number of records up to a bound,
counts the shingles of all records; its segments are summed in as many tasks.
(2) Shingles are ordered by that count; two similar records share one of the
first ``n - ceil(t n) + 1`` shingles of each, so a record goes, once per
partition, to the partitions of those shingles (shingles that the sketch proves
to be unique are left out: they lose no pair).  Shingles held by very many
records are spread over a triangle of blocks.  The records are written once and
sent in rounds of some partitions each, so that the disk holds one round's copies
however many partitions a record goes to.  (3) In each partition the records
of each shingle form signature trees, which are joined by dual traversal.  (4)
The surviving pairs are verified exactly on the whole texts.

Exact copies (equal shingle sets) form one class: the trees see one record of a
class and task, the result names every copy.

Results: records with fewer words than a shingle, null and empty texts among
them, are in no pair.  Very long texts are used whole.  The outcome does not
depend on the sketch, which only orders.  Shingles are compared as 44-bit
hashes; for texts of a thousand words a chance hit has odds below 1e-7 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans import Scratch, lookup

#: Fixed value: the definition of a word.
WORD = re.compile("[一-鿿]|[a-z0-9À-ɏ]+")
HASH_BITS = 44
#: log2 of the counters of the frequency sketch: some 16 a record, between these bounds (a broadcast of 4 to 64 MB).
LEAST_SKETCH, MOST_SKETCH = 22, 26
#: log2 of the counters, and of the filter's bytes, that one task sums.
SEGMENT_BITS = 17
#: Shingles a partition of the join is planned for, about; its task holds their records.
PARTITION_SHINGLES = 2_000_000
#: Bytes that one round of the join sends, a shingle of all records (about 1.6 times the input), and at least.
ROUND_BYTES, LEAST_ROUND = 6, 64_000_000
#: Set hashes that a task remembers to leave out further copies; beyond it starts afresh.
KNOWN_SETS = 1_000_000
FANOUT = 8
#: Records on one shingle above which it is spread over blocks of that many.
BLOCK_ROWS = 50_000
#: log2 of the bits of the filter that keeps unmatched texts from being read again: some 16 a candidate, between these.
LEAST_FILTER, MOST_FILTER = 23, 30
#: Rows of a class in a block, about: two blocks are paired row by row at once.
BLOCK_COPIES = 64
_STEP = 1 << 20  # pairs expanded at once in a traversal
#: Words of bitmaps compared at once: bounds a task's memory whatever the texts' lengths.
_WORDS = 1 << 22


class _WordHashes(dict):
    """Word -> 64-bit hash, computed once a process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_words = _WordHashes()


def shingles(texts: list[str | None], size: int):
    """(record index << 44 | shingle hash), sorted and distinct, over all texts."""
    import numpy as np

    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    total = int(lengths.sum())
    get = _words.__getitem__
    flat = np.fromiter((h for ws in lists for h in map(get, ws)), dtype=np.uint64, count=total)
    if total < size:
        return np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(lists), dtype=np.uint64), lengths)
    h = np.zeros(total - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = (h ^ flat[i : total - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - HASH_BITS)
    inside = doc[: total - size + 1] == doc[size - 1 :]
    key = (doc[: total - size + 1][inside] << np.uint64(HASH_BITS)) | h[inside]
    key.sort()
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = key[1:] != key[:-1]
    return key[keep]


def _parts(key, rows: int):
    """Hashes, record index and first position of each record."""
    import numpy as np

    doc = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    n = np.bincount(doc, minlength=rows)
    start = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(n, out=start[1:])
    return key & np.uint64((1 << HASH_BITS) - 1), doc, n, start


def _set_hash(h, n, start):
    """A 63-bit hash of each record's whole set."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = h * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(27)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(x, out=total[1:])
    return ((total[start[1:]] - total[start[:-1]]) >> np.uint64(1)).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """Pieces of at most some millions of characters."""
    step, col = 4096, batch.column(1)
    for a in range(0, batch.num_rows, step):
        texts, at, size = col.slice(a, step).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size > 4_000_000 or i == len(texts) - 1:
                yield batch.column(0).slice(a + at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


# --- pass 1: frequency sketch and set hashes -------------------------------------------------


def sketch_bits(records: int) -> int:
    return max(LEAST_SKETCH, min(MOST_SKETCH, (16 * max(1, records)).bit_length()))


def _survey(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["id", "n", "sig", "seg", "counts"]
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for ids, texts in _slices(batch):
                h, _, n, start = _parts(shingles(texts, size), len(texts))
                at, many = np.unique(h >> np.uint64(HASH_BITS - bits), return_counts=True)
                counts[at.astype(np.int64)] += many.astype(np.uint32)
                sig = _set_hash(h, n, start)
                rows = pa.array(np.flatnonzero(n))
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array(n, pa.int32()).take(rows), pa.array(sig, pa.int64()).take(rows), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names
                )
        for seg, part in enumerate(np.split(counts, max(1, len(counts) >> SEGMENT_BITS))):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([seg], pa.int32()), pa.array([_packed(part)], pa.binary())], names=names
                )

    return run


def _packed(counts) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _add_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of each segment; counts become a byte on a log scale, and the segment's sum is kept."""
    import numpy as np
    import zstandard

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint32).astype(np.int64)
            sums[seg] = sums[seg] + x if seg in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_level(x).tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["seg", "counts", "total"]
        )


def _level(counts):
    """0 none, 1 one, and from there up to 255 by the count's logarithm, rounded up."""
    import numpy as np

    return np.where(counts <= 1, counts, np.minimum(255, 1 + np.ceil(6 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def _most(level):
    """The largest count of a level."""
    return 2.0 ** ((level.astype("f8") - 1) / 6)


# --- pass 2: records to partitions -----------------------------------------------------------


def width_class(n):
    """log2 of the bits of a record's bitmap: at least two bits a shingle."""
    import numpy as np

    return np.maximum(7, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)


def bitmaps(h, doc, n):
    """One packed bitmap a record, and where each starts, in bytes."""
    import numpy as np

    bits = np.left_shift(np.int64(1), width_class(n))
    start = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(bits, out=start[1:])
    flags = np.zeros(int(start[-1]), dtype=bool)
    flags[start[doc] + (h.astype(np.int64) & (bits[doc] - 1))] = True
    return np.packbits(flags, bitorder="little"), start // 8


def _target(tok, parts: int):
    """The partition of a token."""
    import numpy as np

    return ((tok >> tok.dtype.type(7)) % tok.dtype.type(parts)).astype(np.int64)


def _first(target, rec):
    """The first token of each record in each partition, of tokens sorted by both."""
    import numpy as np

    new = np.ones(len(rec), dtype=bool)
    new[1:] = (rec[1:] != rec[:-1]) | (target[1:] != target[:-1])
    return new


def _route(size: int, t: float, levels, bits: int, mean: float, parts: int, block_rows: int):
    """One row a slice of the input: its records once, their tokens by partition, and the bytes that all rounds will send.

    ``mean`` is the count that a counter has by chance: it does not make a shingle hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        level_of = np.frombuffer(levels.value, dtype=np.uint8)
        known: set[int] = set()
        for batch in batches:
            for ids, texts in _slices(batch):
                h, doc, n, start = _parts(shingles(texts, size), len(texts))
                sig = _set_hash(h, n, start)
                first = np.zeros(len(texts), dtype=bool)  # of its class in this task, as far as it remembers
                if len(known) > KNOWN_SETS:
                    known.clear()
                for i in np.flatnonzero(n).tolist():
                    s = int(sig[i])
                    if s not in known:
                        known.add(s)
                        first[i] = True
                # Order each record's shingles by level, then hash: one sort of packed keys.
                level = level_of[(h >> np.uint64(HASH_BITS - bits)).astype(np.int64)]
                low = np.uint64(HASH_BITS - 8)
                packed = (doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (level.astype(np.uint64) << low) | (h & ((np.uint64(1) << low) - np.uint64(1)))
                packed.sort()
                pos = np.arange(len(packed)) - start[doc]
                lev = ((packed >> low) & np.uint64(255)).astype(np.int64)
                use = (pos < (n - np.ceil(t * n).astype(np.int64) + 1)[doc]) & (lev > 1) & first[doc]
                d, lev = doc[use], lev[use]
                tok = packed[use] & np.uint64((1 << HASH_BITS) - 1)
                tok = ((tok ^ (tok >> np.uint64(17))) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
                blocks = np.maximum(1, np.ceil((_most(lev) - mean) / block_rows)).astype(np.int64)
                if (hot := blocks > 1).any():  # spread over the cells of a triangle of blocks
                    b, hd, ht = blocks[hot], d[hot], tok[hot]
                    rep = np.repeat(np.arange(len(b)), b)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(b) - b, b)
                    own = (sig[hd[rep]] >> 7) % b[rep]
                    cell = (np.minimum(own, other) << 16) + np.maximum(own, other) + 1
                    spread = (ht[rep] * np.uint64(0x85EBCA6B) + cell.astype(np.uint64) * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
                    d, tok = np.concatenate([d[~hot], hd[rep]]), np.concatenate([tok[~hot], spread])
                if not len(d):
                    continue
                order = np.lexsort((d, _target(tok, parts)))
                d, tok = d[order], tok[order].astype(np.uint32)
                rec, d = np.unique(d, return_inverse=True)
                raw, byte = bitmaps(h, doc, n)
                offsets = byte.astype(np.int32)
                maps = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).take(pa.array(rec))
                new = _first(_target(tok, parts), d)
                sent = 24 * int(new.sum()) + int((np.diff(offsets)[rec])[d[new]].sum()) + 4 * len(tok)
                cols = [ids.take(pa.array(rec)).to_numpy(zero_copy_only=False), n[rec].astype(np.int32), sig[rec], b"".join(maps.to_pylist()), d.astype(np.int32), tok]
                yield pa.RecordBatch.from_arrays([*(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in cols), pa.array([sent], pa.int64())], names=["ids", "n", "sig", "bits", "rec", "toks", "sent"])

    return run


def _widths(n):
    """Bytes of the records' bitmaps."""
    import numpy as np

    return np.left_shift(np.int64(1), width_class(n)) >> 3


def _spread(parts: int, low: int, keys: list[int]):
    """Records of the slices for the partitions from ``low`` on, one for each of ``keys``: a row a slice and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part = np.asarray(keys, dtype=np.int32)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n, sig, bits, rec, tok = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=k) for c, k in (("ids", "i8"), ("n", "i4"), ("sig", "i8"), ("bits", "u1"), ("rec", "i4"), ("toks", "u4")))
                target = _target(tok, parts)
                a, b = np.searchsorted(target, [low, low + len(part)])
                if a == b:
                    continue
                rec, tok, target = rec[a:b], tok[a:b], target[a:b]
                at = np.flatnonzero(_first(target, rec))
                many = np.diff(at, append=b - a).astype(np.int32)  # tokens of each record
                r = rec[at]
                g = np.flatnonzero(np.diff(target[at], prepend=-1))  # first record of each partition
                ends = np.append(g, len(at))
                offsets = np.concatenate([[0], np.cumsum(_widths(n))])
                maps = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bits)]).take(pa.array(r))
                byte = np.concatenate([[0], np.cumsum(_widths(n)[r])])[ends]
                cut = lambda data, places: pa.BinaryArray.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[target[at[g]] - low]), cut(ids[r], ends * 8), cut(n[r], ends * 4), cut(sig[r], ends * 8), cut(maps.buffers()[2], byte), cut(many, ends * 4), cut(tok, np.append(at, b - a)[ends] * 4)],
                    names=["p", "ids", "n", "sig", "bits", "many", "toks"],
                )

    return run


# --- pass 3: signature trees -----------------------------------------------------------------


def _popcount(x):
    import numpy as np

    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class Forest:
    """Signature trees over postings sorted by (token, size): one tree a token."""

    def __init__(self, tok, leaf_bits, n):
        import numpy as np

        self.tok = tok
        new = np.ones(len(tok), dtype=bool)
        new[1:] = tok[1:] != tok[:-1]
        group = np.cumsum(new) - 1
        slack = n - _popcount(leaf_bits)
        #: Per level, leaves first: first child, end of children, bits, smallest and largest size, slack.
        self.levels = [(None, None, leaf_bits, n, n, slack)]
        while True:
            g = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            if len(g) == len(group) and len(self.levels) > 1:
                break
            within = np.arange(len(group)) - np.repeat(g, np.diff(np.concatenate([g, [len(group)]])))
            start = np.flatnonzero(within % FANOUT == 0)
            end = np.concatenate([start[1:], [len(group)]])
            _, _, bits, lo, hi, sl = self.levels[-1]
            self.levels.append((start, end, np.bitwise_or.reduceat(bits, start, axis=0), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.maximum.reduceat(sl, start)))
            group = group[start]
        self.roots = tok[new]

    def top(self) -> int:
        return len(self.levels) - 1

    def lift(self, levels: int) -> None:
        """Chains above the roots until the tree has that many levels."""
        import numpy as np

        while self.top() < levels:
            _, _, bits, lo, hi, sl = self.levels[-1]
            i = np.arange(len(lo))
            self.levels.append((i, i + 1, bits, lo, hi, sl))


def dual_traversal(x: Forest, y: Forest, t: float, same: bool) -> Iterator[tuple]:
    """Leaf pairs of trees of equal tokens that may reach similarity ``t``."""
    import numpy as np

    if same:
        i = j = np.arange(len(x.roots))
    else:
        _, i, j = np.intersect1d(x.roots, y.roots, assume_unique=True, return_indices=True)
        height = max(x.top(), y.top())
        x.lift(height)
        y.lift(height)
    stack = [(x.top(), i, j)]
    step = max(1 << 10, _WORDS // max(1, x.levels[0][2].shape[1]))
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack += [(level, i[a : a + step], j[a : a + step]) for a in range(0, len(i), step)]
            continue
        _, _, xb, xlo, xhi, xs = x.levels[level]
        _, _, yb, ylo, yhi, ys = y.levels[level]
        ok = (xhi[i] >= t * ylo[j]) & (yhi[j] >= t * xlo[i])
        if same and level:
            ok |= i == j
        i, j = i[ok], j[ok]
        # Common bits, and as many more as shingles of one record may share a bit.
        most = np.minimum(_popcount(xb[i] & yb[j]) + np.minimum(xs[i], ys[j]), np.minimum(xhi[i], yhi[j]))
        ok = most * (1 + t) >= t * (xlo[i] + ylo[j]) - 1e-9
        if same and level:
            ok |= i == j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        xa, xe = x.levels[level][0], x.levels[level][1]
        ya, ye = y.levels[level][0], y.levels[level][1]
        a, b = xe[i] - xa[i], ye[j] - ya[j]
        many = a * b
        for lo in _chunks(many):
            ci, cj, ca, cb, cm = xa[i[lo]], ya[j[lo]], a[lo], b[lo], many[lo]
            k = np.arange(int(cm.sum())) - np.repeat(np.cumsum(cm) - cm, cm)
            width = np.repeat(cb, cm)
            ni, nj = np.repeat(ci, cm) + k // width, np.repeat(cj, cm) + k % width
            if same:
                keep = ni < nj if level == 1 else ni <= nj
                ni, nj = ni[keep], nj[keep]
            stack.append((level - 1, ni, nj))


def _chunks(many) -> Iterator[slice]:
    import numpy as np

    ends = np.cumsum(many)
    at = 0
    while at < len(many):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _STEP, side="right")))
        yield slice(at, to)
        at = to


def _fold(bits):
    """The bitmap of half the width that the same shingles would have set."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def join_records(ids, n, sig, maps: list[bytes], toks: list[bytes], t: float):
    """Candidate pairs of record indexes among the records of one partition."""
    import numpy as np

    # One record a class of copies: the one with the smallest id.
    order = np.lexsort((ids, sig))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = sig[order][1:] != sig[order][:-1]
    keep = np.sort(order[lead])
    tok = np.frombuffer(b"".join([toks[i] for i in keep.tolist()]), dtype=np.uint32)
    rec = np.repeat(keep, [len(toks[i]) // 4 for i in keep.tolist()])
    size = n[rec]
    cls = width_class(size)
    order = np.lexsort((size, tok))
    tok, rec, size, cls = tok[order], rec[order], size[order], cls[order]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = tok[1:] != tok[:-1]
    held = np.bincount(np.cumsum(new) - 1)
    shared = np.repeat(held > 1, held)
    tok, rec, size, cls = tok[shared], rec[shared], size[shared], cls[shared]
    found: list = []
    below: tuple | None = None
    for c in sorted(set(cls.tolist())):
        mine = cls == c
        mrec, mtok, msize = rec[mine], tok[mine], size[mine]
        uniq, inv = np.unique(mrec, return_inverse=True)
        bits = np.frombuffer(b"".join([maps[i] for i in uniq.tolist()]), dtype=np.uint64).reshape(len(uniq), -1)
        forest = Forest(mtok, bits[inv], msize)
        for i, j in dual_traversal(forest, forest, t, True):
            found.append(np.unique(_pair(mrec[i], mrec[j])))
        if below is not None and below[0] == c - 1:
            folded = Forest(mtok, _fold(bits)[inv], msize)
            for i, j in dual_traversal(below[1], folded, t, False):
                found.append(np.unique(_pair(below[2][i], mrec[j])))
        below = (c, forest, mrec)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def _pair(a, b):
    import numpy as np

    return (np.minimum(a, b).astype(np.int64) << 32) | np.maximum(a, b).astype(np.int64)


def _pieces(data: bytes, sizes) -> list[memoryview]:
    ends, view = sizes.cumsum().tolist(), memoryview(data)
    return [view[a:b] for a, b in zip([0, *ends], ends)]


def _join(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        data = {c: b"".join(x for b in got for x in b.column(c).to_pylist()) for c in ("ids", "n", "sig", "bits", "many", "toks")}
        del got
        ids, n, sig, many = (np.frombuffer(data[c], dtype=k) for c, k in (("ids", "i8"), ("n", "i4"), ("sig", "i8"), ("many", "i4")))
        a, b = join_records(ids, n, sig, _pieces(data["bits"], _widths(n)), _pieces(data["toks"], 4 * many.astype("i8")), t)
        x, y = ids[a], ids[b]
        for at in range(0, len(x), 100_000):
            lo, hi = np.minimum(x, y)[at : at + 100_000], np.maximum(x, y)[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    return run


# --- pass 4: exact verification --------------------------------------------------------------


def filter_bits(candidates: int) -> int:
    return max(LEAST_FILTER, min(MOST_FILTER, (16 * max(1, candidates)).bit_length()))


def _place(x, bits: int):
    import numpy as np

    with np.errstate(over="ignore"):
        return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _filter_bits(bits: int):
    """The filter of a task's candidates, by segments of 2^SEGMENT_BITS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for b in batches:
            for c in b.columns:
                at = _place(c.to_numpy(zero_copy_only=False), bits)
                np.bitwise_or.at(flags, at >> 3, np.left_shift(1, 7 - (at & 7)).astype(np.uint8))
        for seg, part in enumerate(np.split(flags, max(1, len(flags) >> SEGMENT_BITS))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["seg", "bits"])

    return run


def _or_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import zstandard

    out: dict[int, np.ndarray] = {}
    for b in batches:
        for seg, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
            out[seg] = out[seg] | x if seg in out else x
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([_packed(x) for x in out.values()], pa.binary())], names=["seg", "bits"])


def _sets(size: int, wanted, bits: int):
    """Shingle sets of the records that are in a candidate pair, 6 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        flags = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for seg, data in wanted.value.items():
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
            flags[seg * len(part) : (seg + 1) * len(part)] = part
        for batch in batches:
            at = _place(batch.column(0).to_numpy(zero_copy_only=False), bits)
            hit = (flags[at >> 3] >> (7 - (at & 7))) & 1 == 1
            if not hit.any():
                continue
            for ids, texts in _slices(batch.filter(pa.array(hit))):
                h, _, n, start = _parts(shingles(texts, size), len(texts))
                raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((start * 6).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([ids, data], names=["id", "s"])

    return run


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                m = part.num_rows
                keys, sizes = [], []
                for c in ("sa", "sb"):
                    data = part.column(c).to_pylist()
                    n = np.asarray([len(x) // 6 for x in data], dtype=np.int64)
                    raw = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 6)
                    wide = np.zeros((len(raw), 8), dtype=np.uint8)
                    wide[:, :6] = raw
                    keys.append((np.repeat(np.arange(m, dtype=np.uint64), n) << np.uint64(HASH_BITS)) | wide.reshape(-1).view(np.uint64))
                    sizes.append(n)
                both = np.concatenate(keys)
                both.sort()
                twice = both[1:][both[1:] == both[:-1]]
                common = np.bincount((twice >> np.uint64(HASH_BITS)).astype(np.int64), minlength=m)
                jaccard = common / np.maximum(sizes[0] + sizes[1] - common, 1)
                ok = pa.array(jaccard >= t - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(jaccard)], names=["a", "b", "jaccard"]).filter(ok)

    return run


# --- the operator ----------------------------------------------------------------------------


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` hash partitions one integer that falls into it."""
    keys: dict[int, int] = {}
    at = 0
    while len(keys) < parts:
        span = spark.range(at, at + 8 * parts, 1, 1).select(F.col("id").cast("int").alias("k"))
        for r in span.select("k", F.pmod(F.hash("k"), F.lit(parts)).alias("p")).collect():
            keys.setdefault(r["p"], r["k"])
        at += 8 * parts
    return [keys[i] for i in range(parts)]


def near_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, size: int = 5, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``.

    ``pairs``: ``a, b, jaccard`` between the representatives of classes of equal
    shingle sets, a < b.  ``members``: ``id, rep`` of every record that has a
    shingle.  ``key`` must be a unique integer.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    src = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    rows = src.count()
    bits = sketch_bits(rows)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    survey = scratch.save(src.mapInArrow(_survey(size, bits), "id bigint, n int, sig bigint, seg int, counts binary"))
    width = 1 << min(bits, SEGMENT_BITS)
    summed = survey.where("seg IS NOT NULL").select("seg", "counts").repartition(min(tasks, (1 << bits) // width), "seg").mapInArrow(_add_segments, "seg int, counts binary, total bigint")
    levels, total = bytearray(1 << bits), 0  # bounded by MOST_SKETCH
    for r in summed.collect():
        levels[r["seg"] * width : (r["seg"] + 1) * width] = r["counts"]
        total += r["total"]
    parts = max(tasks, -(-total // PARTITION_SHINGLES))
    shared = spark.sparkContext.broadcast(bytes(levels))
    route = _route(size, threshold, shared, bits, total / (1 << bits), parts, block_rows)
    slices = scratch.save(src.mapInArrow(route, "ids binary, n binary, sig binary, bits binary, rec binary, toks binary, sent bigint"))
    sent = slices.agg(F.sum("sent")).first()[0] or 0
    rounds = min(parts, max(1, -(-sent // max(LEAST_ROUND, ROUND_BYTES * total))))
    each = -(-parts // rounds)
    keys = partition_keys(spark, each)
    met = []
    for low in range(0, parts, each):
        mine = keys[: parts - low]
        routed = slices.mapInArrow(_spread(parts, low, mine), "p int, ids binary, n binary, sig binary, bits binary, many binary, toks binary")
        met.append(scratch.save(routed.repartition(each, "p").mapInArrow(_join(threshold), "a bigint, b bigint")))
    scratch.drop(slices)
    candidates = scratch.save(reduce(DataFrame.union, met).distinct())
    scratch.drop(*met)
    fbits = filter_bits(2 * candidates.count())
    flags = candidates.mapInArrow(_filter_bits(fbits), "seg int, bits binary").repartition(min(tasks, max(1, 1 << (fbits - 3 - SEGMENT_BITS))), "seg").mapInArrow(_or_bits, "seg int, bits binary")
    wanted = spark.sparkContext.broadcast({r["seg"]: bytes(r["bits"]) for r in flags.collect()})  # bounded by MOST_FILTER
    sets = src.mapInArrow(_sets(size, wanted, fbits), "id bigint, s binary")
    left = candidates.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b").select("a", "b", "sa", "sb")
    close = scratch.save(both.mapInArrow(_verify(threshold), "a bigint, b bigint, jaccard double"))
    scratch.drop(candidates)
    records = survey.where("id IS NOT NULL").select("id", "n", "sig")
    # The set hash with the set's size names a class of copies.
    reps = records.groupBy("sig", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = records.withColumn("cls", F.struct("sig", "n"))
    members = scratch.save(lookup(named.select("id", "cls"), reps.select(F.struct("sig", "n").alias("cls"), "rep", "copies"), "cls", records.count()).select("id", "rep", "copies"))
    to_rep = members.select("id", "rep")
    named = close.join(to_rep.toDF("a", "ra"), "a").join(to_rep.toDF("b", "rb"), "b")
    pairs = named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "jaccard").where("a < b").distinct()
    return pairs, members


def all_record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b`` of records, a < b: every pair within and between classes, whatever their size.

    Classes are cut in blocks of about ``BLOCK_COPIES`` rows; a job joins two
    blocks, so that a large class spreads over all tasks.
    """
    of = members.where("copies > 1").withColumn("blocks", F.ceil(F.col("copies") / BLOCK_COPIES).cast("int"))
    blocks = of.where("id = rep").select("rep", "blocks")
    listed = of.groupBy("rep", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")).agg(F.collect_list("id").alias("ids"))
    within = blocks.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    jobs = pairs.select("a", "b").union(within).join(blocks.toDF("a", "na"), "a", "left").join(blocks.toDF("b", "nb"), "b", "left")
    upto = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    jobs = jobs.select("a", "b", "na", "nb", F.explode(upto(F.col("na"))).alias("i")).repartition("a", "b", "i")
    jobs = jobs.select("a", "b", "na", "nb", "i", F.explode(upto(F.col("nb"))).alias("j")).where("a <> b OR i <= j").repartition("a", "b", "i", "j")
    sides = jobs.join(listed.toDF("a", "i", "la"), ["a", "i"], "left").join(listed.toDF("b", "j", "lb"), ["b", "j"], "left")
    once = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    # A class without copies has no block; a block of a class may be empty.
    rows = lambda n, c, k: F.when(F.col(n).isNull(), F.array(k)).otherwise(F.col(c))
    out = sides.select(once.alias("once"), F.explode(rows("na", "la", "a")).alias("x"), rows("nb", "lb", "b").alias("lb")).select("once", "x", F.explode("lb").alias("y"))
    return out.where("NOT once OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

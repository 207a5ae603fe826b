"""Exact n-gram Jaccard join with signature trees.

Words are runs of non-blank characters, A-Z lower-cased; a document's set holds
its distinct shingles (a shorter document's whole sequence is its one
shingle).  Two documents link when their sets' Jaccard similarity reaches
``num / den``.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Shingles have one global order: rarely met hash buckets first (counted over
   all documents), then the hash.  Classes that link share a shingle among
   their first ``n - ceil(t * n) + 1``, so they meet in that shingle's group.
3. Each group is a tree: records sorted by size, leaves of ``LEAF`` records,
   nodes with OR-combined bitmaps and size ranges.  A dual traversal drops a
   pair of nodes when no pair of sizes fits or when the bitmaps' largest
   possible overlap is too small, and a pair of records likewise.  A group of
   one leaf is no tree: sizes, places and then bitmaps bound its pairs.
4. Groups beyond a leaf are traversed twice.  First each record meets, in its
   ``MAIN`` largest groups, the records of its own block of ``BLOCK`` and of the
   next block, and its ``CLOSEST`` likeliest partners are verified on the whole
   sets.  Then, in every group that is not one component by now, all records
   outside of the group's largest component meet all others, and every pair of
   different components that the bounds allow is verified.  Groups of equal
   members are traversed once.
5. Links become components in a distributed way.
6. Every link is inside a component, so each component is dealt over pairs of
   blocks and its links are counted exactly on the whole sets, without a row
   for any pair.

Components are those of all links, and the counts count every link.  Hot
groups are split by blocks, counts are pre-aggregated, nothing is collected but
the 2 ** 20 bucket counts.

Defined results: null and empty texts have an empty set and link with nothing;
rows that share an id count by their own texts, and are one node; rows with a
null id are returned with a null component and link with nothing; ties and
repeated rows are links like others; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import kernel
from .common import discard, lean, stored
from .components import components

LEAF = 32
BLOCK = 1024
BUCKETS = 1 << 20
CHUNKS = 64
#: Records of a block when links are counted.
COUNT_BLOCK = 512
CLOSEST = 3
#: Largest groups of a record that the first traversal looks at; the second one looks at all.
MAIN = 2
#: Buckets of at least 2 ** this times the mean count are hot: their groups are counted with pre-aggregation and may be split by the join.
HOT_LEVEL = 3
#: Ids up to this number are broadcast (8 bytes each) to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 400_000
_U = np.uint64
#: From a 64-bit hash to its bucket.
_SHIFT = _U(64 - (BUCKETS.bit_length() - 1))


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes row by row ascending, row offsets) per slice."""
    for w in kernel.words(column):
        h, counts = kernel.ngrams(w, size)
        rows = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        yield w.first, h, np.searchsorted(rows, np.arange(len(counts) + 1))


def bucket_levels(docs: DataFrame, size: int) -> np.ndarray:
    """Level of each hash bucket: 0 for usual ones, then the logarithm of how far its count exceeds the mean.

    Each task sends its counts as ``CHUNKS`` rows of 16-bit numbers (more
    counts as the largest, which is hot anyway), which are added up by chunk.
    """
    wide = BUCKETS // CHUNKS

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for _, h, _ in _sets(b.column(0), size):
                np.add.at(total, (h >> _SHIFT).astype(np.int64), 1)
        if total.any():
            counts = np.minimum(total, 65535).astype("<u2").reshape(CHUNKS, wide)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([c.tobytes() for c in counts], type=pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), dtype="<u2").astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int32()), pa.array([x.tobytes() for x in sums.values()], type=pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    counts = docs.select("_text").mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    total = np.zeros((CHUNKS, wide), dtype=np.float32)
    for chunk, raw in zip(counts["chunk"].to_pylist(), counts["counts"], strict=True):
        total[chunk] = np.frombuffer(raw.as_buffer(), dtype=np.int64)
    mean = max(1.0, float(total.sum(dtype=np.float64)) / BUCKETS)
    return np.clip(np.floor(np.log2(np.maximum(total.ravel(), 1) / mean)), 0, 60).astype(np.uint8)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bitmap of a set as 64-bit words: four bits a shingle at least, a power of two of words, so that wider ones fold."""
    words = 1
    while words * 16 < len(h):
        words *= 2
    bit = (h & _U(words * 64 - 1)).astype(np.int64)
    marks = np.zeros(words * 64, dtype=np.uint8)
    marks[bit] = 1
    return np.packbits(marks, bitorder="little").view(_U)


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Records of one group whose bitmaps have one width, sorted by size."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, ids: np.ndarray, parts: np.ndarray, comps: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids, sizes))
        self.sizes, self.maps, self.ids, self.parts, self.comps = sizes[order], maps[order], ids[order], parts[order], comps[order]
        self.hidden = self.sizes - np.bitwise_count(self.maps).sum(1)  # shingles that share a bit
        self.leaf = leaf
        self.nodes: list[tuple] = []  # first, end, bitmap, smallest and largest size, most hidden, children, the component of all or None
        self.root = self._build(0, len(ids))

    def _build(self, a: int, b: int) -> int:
        kids = ()
        if b - a > self.leaf:
            mid = (a + b) // 2
            kids = (self._build(a, mid), self._build(mid, b))
            union = self.nodes[kids[0]][2] | self.nodes[kids[1]][2]
        else:
            union = np.bitwise_or.reduce(self.maps[a:b], axis=0)
        own = self.comps[a:b]
        one = int(own[0]) if (own == own[0]).all() else None
        self.nodes.append((a, b, union, int(self.sizes[a]), int(self.sizes[b - 1]), int(self.hidden[a:b].max()), kids, one))
        return len(self.nodes) - 1


def traverse(x: SignatureTree, y: SignatureTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Record positions (in x, in y) that may link and are not yet in one component, and their largest possible similarity; ``x is y`` gives each pair once."""
    same, stack = x is y, [(x.root, y.root)]
    while stack:
        i, j = stack.pop()
        a, b, union_a, low_a, high_a, hidden_a, kids_a, one_a = x.nodes[i]
        c, d, union_c, low_c, high_c, hidden_c, kids_c, one_c = y.nodes[j]
        if one_a is not None and one_a == one_c:
            continue
        if high_a * den < num * low_c or high_c * den < num * low_a:
            continue
        least = -(-num * (low_a + low_c) // (num + den))
        if not (same and i == j) and int(np.bitwise_count(union_a & union_c).sum()) + min(hidden_a, hidden_c) < least:
            continue
        if kids_a and (not kids_c or b - a >= d - c):
            if same and i == j:
                stack += [(kids_a[0], kids_a[0]), (kids_a[0], kids_a[1]), (kids_a[1], kids_a[1])]
            else:
                stack += [(k, j) for k in kids_a]
        elif kids_c:
            stack += [(i, k) for k in kids_c]
        else:
            mx, my = x.maps[a:b], y.maps[c:d]
            nx, ny = x.sizes[a:b, None], y.sizes[None, c:d]
            least = -(-num * (nx + ny) // (num + den))
            # a bit that only x has stands for a shingle that y lacks, and the other way round
            shared = np.bitwise_count(mx[:, None, :] & my[None, :, :]).sum(2, dtype=np.int64)
            most = np.minimum(nx - (np.bitwise_count(mx).sum(1)[:, None] - shared), ny - (np.bitwise_count(my).sum(1)[None, :] - shared))
            ok = (most >= least) & (np.minimum(nx, ny) * den >= num * np.maximum(nx, ny)) & (x.comps[a:b, None] != y.comps[None, c:d])
            if same and i == j:
                ok &= np.arange(b - a)[:, None] < np.arange(d - c)[None, :]
            p, q = np.nonzero(ok)
            if len(p):
                both = most[p, q]
                yield p + a, q + c, both / (nx[p, 0] + ny[0, q] - both)


def group_pairs(sizes: np.ndarray, maps: list[np.ndarray], ids: np.ndarray, parts: np.ndarray, comps: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Id pairs of one group that may link, with their bounds.  ``parts``: only pairs between part 0 and 1, or all where every part is 0."""
    split = bool(parts.any()) and not bool(parts.all())
    by: dict[int, list[int]] = {}
    for k, m in enumerate(maps):
        by.setdefault(len(m), []).append(k)
    trees = {}
    for width, own in by.items():
        for fold_to in (width, width // 2):
            if fold_to and (fold_to == width or fold_to in by):
                trees[width, fold_to] = SignatureTree(sizes[own], _fold(np.stack([maps[k] for k in own]), fold_to), ids[own], parts[own], comps[own])
    for width in by:
        pairs = [(trees[width, width], trees[width, width])]
        if (width * 2, width) in trees:
            pairs.append((trees[width, width], trees[width * 2, width]))
        for x, y in pairs:
            for p, q, bound in traverse(x, y, num, den):
                if split:
                    keep = x.parts[p] != y.parts[q]
                    p, q, bound = p[keep], q[keep], bound[keep]
                if len(p):
                    yield x.ids[p], y.ids[q], bound


def closest(a: np.ndarray, b: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """Positions of the pairs that are among the ``k`` best of either of their records."""
    keep = np.zeros(len(a), dtype=bool)
    for side in (a, b):
        order = np.lexsort((-bound, side))
        own = side[order]
        first = np.searchsorted(own, own)
        keep[order[np.arange(len(own)) - first < k]] = True
    return np.flatnonzero(keep)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, room: int) -> Iterator[pa.Table]:
    """Tables of whole groups (rows equal in the first ``keys`` columns) of sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < room:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.num_rows - 1
        same = np.ones(table.num_rows, dtype=bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            same &= column == column[at]
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if first:
            yield table.slice(0, first)
            held = table.slice(first).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _possible(na: np.ndarray, nb: np.ndarray, maps_a: pa.Array, maps_b: pa.Array, num: int, den: int) -> np.ndarray:
    """Positions of the pairs whose bitmaps allow the similarity."""
    good = []
    for k in range(len(na)):
        x, y = (np.frombuffer(m[k].as_py(), dtype=_U)[None, :] for m in (maps_a, maps_b))
        words = min(x.shape[1], y.shape[1])
        x, y = _fold(x, words), _fold(y, words)
        shared = int(np.bitwise_count(x & y).sum())
        most = min(na[k] - (int(np.bitwise_count(x).sum()) - shared), nb[k] - (int(np.bitwise_count(y).sum()) - shared))
        if most >= -(-num * (na[k] + nb[k]) // (num + den)):
            good.append(k)
    return np.array(good, dtype=np.int64)


def possible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the coarse bitmaps (a bit a shingle at least) do not rule out: a few hundredths of the bytes of whole sets, and most pairs of small groups end here."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(_possible(batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4), batch.column(5), num, den))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])

    first = pairs.join(marks.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("coarse").alias("ba")), "a")
    both = first.join(marks.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("coarse").alias("bb")), "b")
    return both.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def whole_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the texts of ``ids``: the hashes of the whole set, ascending, 8 bytes each."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, at in _sets(b.column(1), size):
                values = [h[x:z].tobytes() for x, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(values)), pa.array(values, type=pa.binary())], names=["doc_id", "shingles"])

    # ids alone, and only where they are few: beyond that the texts are shuffled
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return stored(texts.select("doc_id", "_text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.BinaryType())])), "whole-sets")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, own = [], None, None
            left, right = batch.column(2), batch.column(3)
            for k, b in enumerate(batch.column(1).to_pylist()):
                if b != last:
                    last, own = b, np.frombuffer(right[k].as_buffer(), dtype=_U)
                other = np.frombuffer(left[k].as_buffer(), dtype=_U)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if den * both >= num * (len(own) + len(other) - both):
                    good.append(k)
            good = pa.array(good, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], names=["a", "b"])

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    return first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long")


def _small(num: int, den: int):
    """Pairs of groups of one leaf: rows (key, n, pos, doc_id), sorted."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 1, 200_000):
            key, n, pos, ids = (table.column(k).to_numpy() for k in range(4))
            out_a, out_b = [], []
            for step in range(1, LEAF):
                i = np.flatnonzero(key[step:] == key[:-step])
                if not len(i):
                    break
                j = i + step
                ok = n[i] * den >= num * n[j]
                ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= -(-num * (n[i] + n[j]) // (num + den))
                i, j = i[ok], j[ok]
                out_a.append(np.minimum(ids[i], ids[j]))
                out_b.append(np.maximum(ids[i], ids[j]))
            if out_a:
                pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
                yield _pair_batch(pairs[0], pairs[1])

    return run


def _large(best: int, num: int, den: int):
    """Pairs of larger groups: rows (key, lo, hi, part, n, doc_id, comp, bits), sorted; ``best``: only each record's so many likeliest, or all at 0."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for table in _whole_groups(batches, 3, 4096):
            key, lo, hi, part, n, ids, comps = (table.column(k).to_numpy() for k in range(7))
            maps = table.column(7).to_pylist()
            change = np.ones(len(key), dtype=bool)
            change[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            starts = np.append(np.flatnonzero(change), len(key))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (comps[s:e] == comps[s]).all():
                    continue
                parts = part[s:e].astype(np.int8)
                if not best and lo[s] != hi[s] and (parts.all() or not parts.any()):
                    continue
                found = list(group_pairs(n[s:e], [np.frombuffer(m, dtype=_U) for m in maps[s:e]], ids[s:e], parts if not best else np.zeros_like(parts), comps[s:e], num, den))
                if not found:
                    continue
                a, b, bound = (np.concatenate(x) for x in zip(*found, strict=True))
                a, b = np.minimum(a, b), np.maximum(a, b)
                if best:
                    top = closest(a, b, bound, best)
                    a, b = a[top], b[top]
                new = list({p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in seen})
                if len(seen) > 100_000:
                    seen.clear()
                seen.update(new)
                if new:
                    yield _pair_batch(np.array([p[0] for p in new]), np.array([p[1] for p in new]))

    return run


def _dealt(rows: DataFrame, marks: DataFrame, best: int, num: int, den: int) -> DataFrame:
    """Pairs of rows (key, lo, hi, part, doc_id, comp), dealt by (key, lo, hi); the likeliest are found by coarse bitmaps, all by fine ones."""
    rows = rows.join(marks.select("doc_id", "n", F.col("coarse" if best else "bits").alias("bits")), "doc_id").select("key", "lo", "hi", "part", F.col("n").cast("long").alias("n"), "doc_id", "comp", "bits")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n", "doc_id").mapInArrow(_large(best, num, den), "a long, b long")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id"), blocks).cast("int")


def _first_rows(many: DataFrame) -> DataFrame:
    """Each record in its ``MAIN`` largest groups, in its own block and as a neighbour in the one before."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("c").desc(), "key"))
    rows = many.withColumn("rank", rank).where(F.col("rank") <= MAIN)
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", _block(F.col("blocks")))
    rows = rows.withColumn("part", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    lo = F.pmod(F.col("own") - F.col("part"), F.col("blocks"))
    return rows.select("key", lo.alias("lo"), lo.alias("hi"), "part", "doc_id", F.col("doc_id").alias("comp"))


def _open_rows(many: DataFrame, comps: DataFrame) -> DataFrame:
    """Records of the groups that are no component: blocks of the largest component meet blocks of the others, and these each other."""
    rows = many.join(comps, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    shares = rows.groupBy("key", "comp").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    groups = shares.groupBy("key").agg(F.sum("m").alias("c"), F.max(F.struct("m", "comp")).alias("most"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("most.m < c")
    # of groups of equal members one
    groups = groups.groupBy("c", "x", "y").agg(F.min(F.struct("key", "most")).alias("g")).select("g.key", "c", F.col("g.most.m").alias("m"), F.col("g.most.comp").alias("main"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    # a group of one block meets itself
    one = F.col("c") <= BLOCK
    groups = groups.select("key", F.when(one, F.lit(None)).otherwise(F.col("main")).alias("main"), F.when(one, 0).otherwise(blocks(F.col("m"))).alias("inner"), F.when(one, 1).otherwise(blocks(F.col("c") - F.col("m"))).alias("outer"))
    rows = rows.join(groups, "key")
    inside = F.col("comp").eqNullSafe(F.col("main"))
    rows = rows.withColumn("own", F.when(inside, _block(F.col("inner"))).otherwise(F.col("inner") + _block(F.col("outer"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("key", lo.alias("lo"), hi.alias("hi"), ((F.col("own") == hi) & (lo < hi)).cast("int").alias("part"), "doc_id", "comp")


def links(sets: DataFrame, marks: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between representatives that join all that link, and the whole sets of all that occur in them.

    ``sets`` has the representatives' keys (doc_id, n, usual, keys), ``marks``
    their fine and coarse bitmaps (doc_id, n, bits, coarse).
    """
    keyed = sets.select("doc_id", F.col("n").cast("int").alias("n"), "usual", F.posexplode("keys").alias("pos", "key"))
    # a usual bucket holds a few times the mean at most, so no key of it is hot and one shuffle counts and keeps its rows
    usual = keyed.where("pos < usual").drop("usual").withColumn("c", F.count("*").over(Window.partitionBy("key")))
    hot = keyed.where("pos >= usual").drop("usual")
    hot = hot.join(hot.groupBy("key").agg(F.count("*").alias("c")), "key").select(usual.columns)
    live = stored(usual.unionByName(hot).where("c > 1"), "groups")
    few = live.where(F.col("c") <= LEAF).select("key", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "doc_id")
    near = few.repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_small(num, den), "a long, b long")
    many = live.where(F.col("c") > LEAF).select("key", "doc_id", "c")
    first = stored(possible(near.distinct(), marks, num, den).unionByName(_dealt(_first_rows(many), marks, CLOSEST, num, den)).distinct(), "pairs")
    wanted = stored(_ends(first), "wanted")
    held = whole_sets(wanted, docs, size)
    linked = stored(verified(first, held, num, den), "links")
    rest = stored(_dealt(_open_rows(many, components(linked)), marks, 0, num, den).distinct().join(first, ["a", "b"], "left_anti"), "pairs-left")
    discard(live, first)
    if rest.isEmpty():
        return linked, held
    more = stored(_ends(rest).join(wanted, "doc_id", "left_anti"), "wanted")
    held = held.unionByName(whole_sets(more, docs, size))
    return linked.unionByName(stored(verified(rest, held, num, den), "links")), held


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: rare shingles pair by pair, usual ones by products of dense columns, shingles of all sets as a constant."""
    n = len(sets)
    shingles, cols = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(x) for x in sets])
    often = np.bincount(cols, minlength=len(shingles))
    out = np.full((n, n), float((often == n).sum()), dtype=np.float32)
    rare = (often > 1) & (often < 12) & (often < n)
    own = np.flatnonzero(rare[cols])
    own = own[np.argsort(cols[own], kind="stable")]
    c, r = cols[own], rows[own]
    for step in range(1, 11):
        i = np.flatnonzero(c[step:] == c[:-step])
        if not len(i):
            break
        np.add.at(out, (r[i], r[i + step]), 1)
        np.add.at(out, (r[i + step], r[i]), 1)
    usual = np.flatnonzero((often >= 12) & (often < n))
    place = np.full(len(shingles), -1)
    place[usual] = np.arange(len(usual))
    at = place[cols]
    wide = max(256, (1 << 21) // n)
    for k in range(0, len(usual), wide):
        inside = (at >= k) & (at < k + wide)
        m = np.zeros((n, min(wide, len(usual) - k)), dtype=np.float32)
        m[rows[inside], at[inside] - k] = 1
        out += m @ m.T
    return out


def link_counts(comps: DataFrame, weights: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, linked): how many documents of other texts each representative links with; ``weights`` has (rep, copies)."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("c"))
    blocks = F.ceil(F.col("c") / F.lit(COUNT_BLOCK)).cast("int")
    rows = comps.join(sizes, "component").join(weights, F.col("node") == F.col("rep")).select(F.col("node").alias("doc_id"), "component", "copies", blocks.alias("blocks"))
    rows = rows.withColumn("own", _block(F.col("blocks"))).join(sets, "doc_id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("component", lo.alias("lo"), hi.alias("hi"), F.col("own").alias("own"), "doc_id", "copies", "shingles")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3, 512):
            comp, lo, hi, own, ids, copies = (table.column(k).to_numpy() for k in range(6))
            raw = table.column(6).combine_chunks()
            change = np.ones(len(comp), dtype=bool)
            change[1:] = (comp[1:] != comp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            starts = np.append(np.flatnonzero(change), len(comp))
            linked = np.zeros(len(comp), dtype=np.int64)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s == 1:
                    continue
                sets = [np.frombuffer(raw[k].as_buffer(), dtype=_U) for k in range(s, e)]
                n = np.array([len(x) for x in sets])
                both = _overlaps(sets).astype(np.int64)
                ok = (den + num) * both >= num * (n[:, None] + n[None, :])
                ok &= ids[s:e, None] != ids[None, s:e]
                if lo[s] != hi[s]:
                    ok &= own[s:e, None] != own[None, s:e]
                linked[s:e] = ok @ copies[s:e]
            good = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(linked[good])], names=["doc_id", "linked"])

    counted = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "doc_id").mapInArrow(run, "doc_id long, linked long")
    return counted.groupBy("doc_id").agg(F.sum("linked").alias("linked"))


def join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row; ids are integers.  ``n_links``: how many other documents it links with, equal texts included; without ``counts`` there is no such column."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(bucket_levels(rows, size))  # a byte a bucket

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for b in batches:
            for first, h, at in _sets(b.column(1), size):
                n = len(at) - 1
                mixed = kernel.splitmix(h)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[_U(0)], np.cumsum(h, dtype=_U)])
                    sums2 = np.concatenate([[_U(0)], np.cumsum(mixed, dtype=_U)])
                    h1, h2 = sums[at[1:]] - sums[at[:-1]], sums2[at[1:]] - sums2[at[:-1]]
                level = levels[(h >> _SHIFT).astype(np.int64)]
                keys, bits, coarse, ends, usual = [], [], [], [0], []
                for k in range(n):
                    own = h[at[k] : at[k + 1]]
                    size_k = len(own)
                    take = size_k - -(-num * size_k // den) + 1 if size_k else 0
                    high = level[at[k] : at[k + 1]]
                    order = np.argsort(high, kind="stable")[:take]
                    keys.append(own[order])
                    usual.append(int((high[order] < HOT_LEVEL).sum()))
                    ends.append(ends[-1] + take)
                    own_map = bitmap(own) if size_k else np.zeros((0,), dtype=_U)
                    bits.append(own_map.tobytes())
                    coarse.append(_fold(own_map[None, :], max(1, len(own_map) // 4)).tobytes() if size_k else b"")
                flat = np.concatenate(keys) if keys else np.zeros(0, dtype=_U)
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.diff(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, pa.array(usual, type=pa.int32()), pa.array(bits, type=pa.binary()), pa.array(coarse, type=pa.binary())], names=["doc_id", "n", "h1", "h2", "keys", "usual", "bits", "coarse"])

    schema = "doc_id long, n long, h1 long, h2 long, keys array<long>, usual int, bits binary, coarse binary"
    sets = stored(rows.mapInArrow(run, schema), "sets")
    same = ["n", "h1", "h2"]
    live = "n > 0 and doc_id is not null"
    first = stored(sets.where(live).groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    # the representatives' own rows
    own = sets.where(live).join(first.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same])
    marks = stored(own.select("doc_id", "n", "bits", "coarse"), "marks")
    linked, whole = links(own.select("doc_id", "n", "usual", "keys"), marks, rows, size, num, den)
    found = components(linked)
    member = first.join(found, F.col("rep") == F.col("node"), "left").select("rep", "copies", *same, F.coalesce("component", "rep").alias("component"))
    if counts:
        found = stored(found, "components")
        member = member.join(link_counts(found, first.select("rep", "copies"), whole, num, den).withColumnRenamed("doc_id", "rep"), "rep", "left")
        member = member.withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).drop("linked")
    out = sets.select("doc_id", *same).join(member.drop("rep", "copies"), same, "left")
    found_columns = [F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")]
    if counts:
        found_columns.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    return out.select(*found_columns)

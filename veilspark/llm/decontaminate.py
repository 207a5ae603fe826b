"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Words are runs of letters and digits, A-Z lower-cased.  Around every place
where a document shares a five-word shingle with a benchmark item, the
document's window of that item's size, aligned at the shared shingle, gets a
64-bit SimHash of its words.  (A window that shares no shingle has similarity
0 and can't be verified, so nothing is lost.)  The items' fingerprints lie in
``RADIUS + 1`` block tables; two fingerprints within ``RADIUS`` bits agree on
one block at least, so the tables return every item within the radius.  Near
passages may lie beyond any radius, as SimHash is over words; so an item is a
candidate too when the window's shared shingles weigh ``threshold`` times as
much as the item's, without which the similarity can't reach ``threshold``.  A
candidate is verified exactly: the weighted Jaccard similarity of the window's
and the item's shingles, with the inverse document frequency of a shingle
among the items as its weight, must reach ``threshold``.  Items shorter than
five words count as one shingle, and their window is that shingle.

Overlapping verified windows of one item in one document are one finding, the
most similar window's.  The benchmark is broadcast; its size is checked.

Defined results: null and empty texts and items have no words and no finding;
repeated benchmark texts give a finding each; repeated documents one each;
empty tables give an empty result; other columns are ignored by ``find`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from . import kernel
from .common import lean
from .toxicity import LETTERS

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 12
#: Words of all items together that may be broadcast (about 200 bytes each in the index).
MAX_ITEM_WORDS = 2_000_000
_U = np.uint64
_BITS = np.arange(64, dtype=_U)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash of a multiset of word hashes: the sign of each bit's balance."""
    if not len(hashes):
        return 0
    bits = ((hashes[:, None] >> _BITS) & _U(1)).astype(np.int32)
    up = bits.sum(0) * 2 > len(hashes)
    return int((up.astype(_U) << _BITS).sum())


class HammingIndex:
    """Every fingerprint within ``radius`` bits, by blocks: of radius + 1 blocks one must agree."""

    def __init__(self, prints: list[int], radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in self.blocks]
        for i, p in enumerate(prints):
            for (a, mask), table in zip(self.blocks, self.tables, strict=True):
                table[(p >> a) & mask].append(i)

    def within(self, p: int) -> list[int]:
        found = set()
        for (a, mask), table in zip(self.blocks, self.tables, strict=True):
            found.update(table.get((p >> a) & mask, ()))
        return sorted(i for i in found if (self.prints[i] ^ p).bit_count() <= self.radius)


def _shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=_U)
    size = min(size, n)
    h = np.full(n - size + 1, 0xA0761D6478BD642F, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(size):
            h += hashes[k : n - size + 1 + k] * kernel._MULT[k]
        return kernel.splitmix(h + _U(size))


class Items:
    """Benchmark items by size: fingerprints, shingles, weights and places."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS, most: int = MAX_ITEM_WORDS):
        column = pa.array(texts, type=pa.large_string())
        words = [w.hashes[w.offsets[i] : w.offsets[i + 1]] for w in kernel.words(column, LETTERS) for i in range(len(w.counts))]
        if sum(map(len, words)) > most:
            raise ValueError(f"the benchmark has more than {most} words; run it in parts")
        kept = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.sizes = [ids[k] for k in kept], [len(words[k]) for k in kept]
        self.grams = [_shingles(words[k]) for k in kept]
        df: dict[int, int] = defaultdict(int)
        for g in self.grams:
            for x in set(g.tolist()):
                df[x] += 1
        self.unseen = float(np.log(1 + len(kept)))
        self.weight = {x: float(np.log(1 + len(kept) / n)) for x, n in df.items()}
        self.sets = [set(g.tolist()) for g in self.grams]
        by: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.sizes):
            by[n].append(i)
        self.index = {n: (own, HammingIndex([simhash(words[kept[i]]) for i in own], radius)) for n, own in by.items()}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)  # shingle -> (item's size, place in it)
        for i, g in enumerate(self.grams):
            for j, x in enumerate(g.tolist()):
                if (self.sizes[i], j) not in self.places[x]:
                    self.places[x].append((self.sizes[i], j))
        self.holders: dict[int, list[int]] = defaultdict(list)  # shingle -> items that have it, one of those that are equal
        self.equal: dict[int, list[int]] = {}  # such an item -> all items of its size and shingles
        first: dict[tuple, int] = {}
        for i, own in enumerate(self.sets):
            k = first.setdefault((self.sizes[i], frozenset(own)), i)
            self.equal.setdefault(k, []).append(i)
            if k == i:
                for x in own:
                    self.holders[x].append(i)
        self.weights = [sum(self.weight[x] for x in own) for own in self.sets]
        keys = np.array(sorted(self.places), dtype=_U)
        self.keys = keys
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(keys & _U(0xFFFFF)).astype(np.int64)] = True
        self.lengths = sorted({min(n, SHINGLE) for n in self.sizes})

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles and an item's."""
        own, other = set(_shingles(window).tolist()), self.sets[item]
        weight = lambda s: sum(self.weight.get(x, self.unseen) for x in s)
        both = weight(own & other)
        return both / (weight(own) + weight(other) - both) if both else 0.0

    def sharing(self, window: np.ndarray, size: int, threshold: float) -> set[int]:
        """Items of ``size`` words whose shingles in the window weigh ``threshold`` of the item's at least: a bound of the similarity."""
        shared: dict[int, float] = defaultdict(float)
        for x in set(_shingles(window).tolist()):
            for i in self.holders.get(x, ()):
                if self.sizes[i] == size:
                    shared[i] += self.weight[x]
        return {j for i, both in shared.items() if both >= threshold * self.weights[i] - 1e-6 for j in self.equal[i]}

    def findings(self, hashes: np.ndarray, anchors: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, end word, similarity) of one document; ``anchors`` are the places of shared shingles."""
        n, windows = len(hashes), set()
        for p, x in zip(anchors.tolist(), grams.tolist(), strict=True):
            for size, j in self.places[x]:
                start = min(max(p - j, 0), max(n - size, 0))
                windows.add((start, min(size, n), size))
        best: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for start, length, size in sorted(windows):
            window = hashes[start : start + length]
            own, index = self.index[size]
            near = {own[k] for k in index.within(simhash(window))}
            for k in sorted(near | self.sharing(window, size, threshold)):
                s = self.similarity(window, k)
                if s >= threshold - 1e-9:
                    best[k].append((start, start + length, s))
        out = []
        for item, spans in sorted(best.items()):
            group: list[tuple[int, int, float]] = []
            end = -1
            for span in [*sorted(spans), (1 << 60, 1 << 60, 0.0)]:
                if group and span[0] >= end:
                    a, b, s = max(group, key=lambda x: (x[2], -x[0]))
                    out.append((item, a, b, s))
                    group, end = [], -1
                group.append(span)
                end = max(end, span[1])
        return out


def _document_findings(column: pa.Array, items: Items, threshold: float) -> Iterator[tuple[kernel.Words, int, list]]:
    """(slice, row of it, findings) of the documents that have any."""
    for w in kernel.words(column, LETTERS):
        n = len(w.hashes)
        if not n or not len(items.keys):
            continue
        rows = w.rows()
        hits_at, hits_gram = [], []
        for size in items.lengths:
            if n < size:
                continue
            h = _shingles(w.hashes, size)
            at = np.flatnonzero(items.table[(h & _U(0xFFFFF)).astype(np.int64)])
            at = at[rows[at] == rows[at + size - 1]]
            place = np.minimum(np.searchsorted(items.keys, h[at]), len(items.keys) - 1)
            at = at[items.keys[place] == h[at]]
            hits_at.append(at)
            hits_gram.append(h[at])
        if not hits_at or not sum(map(len, hits_at)):
            continue
        at, gram = np.concatenate(hits_at), np.concatenate(hits_gram)
        order = np.argsort(at, kind="stable")
        at, gram = at[order], gram[order]
        cut = np.flatnonzero(np.diff(rows[at])) + 1
        for a, g in zip(np.split(at, cut), np.split(gram, cut), strict=True):
            row = int(rows[a[0]])
            first, end = int(w.offsets[row]), int(w.offsets[row + 1])
            found = items.findings(w.hashes[first:end], a - first, g, threshold)
            if found:
                yield w, row, found


def load_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", radius: int = RADIUS) -> Items:
    """The benchmark on the driver, behind a check of its size."""
    words = benchmark.agg(F.sum(F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")))).first()[0] or 0
    if words > MAX_ITEM_WORDS:
        raise ValueError(f"the benchmark has {words} words, more than {MAX_ITEM_WORDS}; run it in parts")
    rows = benchmark.select(item_col, text_col).orderBy(item_col).collect()
    return Items([r[0] for r in rows], [r[1] for r in rows], radius)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per finding: the document's id, the item's id, first word, number of words and similarity."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_items(benchmark, item_col))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])

    arrow = to_arrow_schema(schema)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            ids, out = [], []
            for w, row, found in _document_findings(b.column(1), items, threshold):
                for item, start, end, s in found:
                    ids.append(b.column(0)[w.first + row].as_py())
                    out.append((items.ids[item], start, end - start, round(s, 9)))
            columns = [ids, *([x[k] for x in out] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the verified windows cut out of the texts (blanks around a cut become one space); documents of nothing else go.

    ``length_col``, where the table has it, is set to the new text's code points.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_items(benchmark))
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else -1

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            texts: dict[int, str] = {}
            column = b.column(at)
            for w, row, found in _document_findings(column, items, threshold):
                raw = column[w.first + row].as_py().encode("utf-8", "surrogatepass")
                base, first = int(w.begins[row]), int(w.offsets[row])
                end, left = 0, []
                for start, stop in sorted((int(w.starts[first + a]) - base, int(w.ends[first + z - 1]) - base) for _, a, z, _ in found):
                    if start > end:
                        left.append(raw[end:start])
                    end = max(end, stop)
                left.append(raw[end:])
                parts = [p.decode("utf-8", "replace").strip() for p in left]
                texts[w.first + row] = " ".join(p for p in parts if any(c.isalnum() for c in p))
            if texts:
                values = column.to_pylist()
                for i, t in texts.items():
                    values[i] = t
                arrays = [b.column(k) for k in range(len(names))]
                arrays[at] = pa.array(values, type=column.type)
                if length_at >= 0:
                    sizes = b.column(length_at).to_pylist()
                    for i, t in texts.items():
                        sizes[i] = len(t)
                    arrays[length_at] = pa.array(sizes, type=b.column(length_at).type)
                gone = {i for i, t in texts.items() if not t}
                b = pa.RecordBatch.from_arrays(arrays, names=b.schema.names)
                if gone:
                    b = b.take(pa.array([i for i in range(b.num_rows) if i not in gone], type=pa.int64()))
            yield b

    return docs.mapInArrow(run, docs.schema)

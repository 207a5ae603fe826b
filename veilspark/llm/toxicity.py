"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters and digits, A-Z lower-cased).  The vocabulary
holds every term of the labelled examples; document frequencies are counted
over all documents.  A term's weight is its inverse document frequency times
its tie to the label: ``TIE_FLOOR`` plus the squared z-score of its log odds
among the examples.  No term is left out; a text outside of the index is one
that shares no word with any example.

Examples with equal vectors are one entry that keeps its count of each label
and its smallest id, so ties vote together.  The index keeps, per term,
postings cut into blocks of ``BLOCK`` entries with the largest weight of each
block.  A query adds up the block maxima of its terms, visits blocks by falling
bound and stops when no block left can beat its k-th best cosine: the
neighbours are exact.  Votes are weighted by closeness; a logistic curve fitted
on examples outside of the index turns them into scores.  The evidence is the
nearest example's id, its cosine and, for texts over the threshold, the shared
words that weigh most.

Fitting uses at most ``MAX_EXAMPLES`` labelled rows (drawn by a hash of the
id), a fifth of them for the curve; every row is scored over its whole text in
one pass without a shuffle.

Defined results: a text without any term of the vocabulary (null and empty
ones included) has no neighbour and gets the share of toxic examples; repeated
rows get equal scores; ties of the cosine go to the smaller entry; without
examples the score is 0 everywhere; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import kernel
from .common import give_back, held_out, labelled_sample, lean
from .nbsvm import logistic_fit

MAX_EXAMPLES = 6_000
NEIGHBOURS = 15
BLOCK = 64
HEAD = 512
SLACK = 1e-5
#: Queries multiplied at once.
QUERIES = 256
TIE_FLOOR = 0.1
EVIDENCE = 5
_U = np.uint64
#: Letters, digits and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[c for c in range(128) if chr(c).isalnum()]] = True
LETTERS[128:] = True


@dataclass
class Sparse:
    """Rows of (column, value), columns ascending inside a row."""

    at: np.ndarray
    cols: np.ndarray
    values: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def take(self, own: np.ndarray) -> Sparse:
        sizes = np.diff(self.at)[own]
        at = np.concatenate([[0], np.cumsum(sizes)])
        from_ = _ranges(self.at[:-1][own], sizes)
        return Sparse(at, self.cols[from_], self.values[from_])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.cols[self.at[i] : self.at[i + 1]], self.values[self.at[i] : self.at[i + 1]]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + sizes[i] - 1, one range after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def weights(counts: Sparse, labels: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency times tie to the label, per term."""
    terms = len(df)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)
    own = labels[counts.rows()]
    seen = np.stack([np.bincount(counts.cols[own == k], minlength=terms) for k in (0, 1)]).astype(float)
    rate = (seen + 0.5) / (n[:, None] + 1.0)
    odds = np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))
    z = odds / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    return (np.log((n_docs + 1) / (df + 1.0)) + 1) * (TIE_FLOOR + z * z)


def unit(counts: Sparse, weight: np.ndarray) -> Sparse:
    """TF-IDF rows of length 1; TF is 1 plus the logarithm of the count."""
    v = (1 + np.log(counts.values)) * weight[counts.cols]
    rows = counts.rows()
    norm = np.sqrt(np.bincount(rows, v * v, minlength=len(counts.at) - 1))
    return Sparse(counts.at, counts.cols, v / norm[rows])


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit rows.

    The ``HEAD`` terms of most postings, whose postings are nearly full, are
    dense columns, multiplied for many queries at once; all others have
    postings in blocks with their largest weights.
    """

    def __init__(self, vectors: Sparse, terms: int, block: int = BLOCK, head: int = HEAD):
        self.block, self.size, self.vectors = block, len(vectors.at) - 1, vectors
        self.blocks = -(-self.size // block)
        self.starts = np.arange(self.blocks) * block
        self.full = np.zeros(terms)  # a query, laid out over all terms
        often = np.bincount(vectors.cols, minlength=terms)
        dense = np.argsort(-often, kind="stable")[:head]
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[dense] = np.arange(len(dense))
        rows = vectors.rows()
        inside = self.column[vectors.cols] >= 0
        self.matrix = np.zeros((len(dense), self.size), dtype=np.float32)
        self.matrix[self.column[vectors.cols[inside]], rows[inside]] = vectors.values[inside]
        cols, rows, values = vectors.cols[~inside], rows[~inside], vectors.values[~inside]
        order = np.lexsort((rows, cols))
        cols, rows = cols[order], rows[order]
        self.entry, self.value = rows.astype(np.int32), values[order].astype(np.float32)
        new = np.ones(len(cols), dtype=bool)
        new[1:] = (cols[1:] != cols[:-1]) | (rows[1:] // block != rows[:-1] // block)
        first = np.flatnonzero(new)
        self.first = np.append(first, len(cols)).astype(np.int32)  # postings of each (term, block)
        self.of = (rows[first] // block).astype(np.int32)
        self.most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.float32)
        self.at = np.searchsorted(cols[first], np.arange(terms + 1)).astype(np.int32)  # (term, block)s of each term

    def heads(self, queries: Sparse) -> np.ndarray:
        """The dense terms' part of the product of each query with each entry."""
        rows, column = queries.rows(), self.column[queries.cols]
        own = column >= 0
        q = np.zeros((len(queries.at) - 1, len(self.matrix)), dtype=np.float32)
        q[rows[own], column[own]] = queries.values[own]
        return q @ self.matrix

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and entries of the k best, best first, smaller entries first among equals; cosines of 0 are left out."""
        score = self.heads(Sparse(np.array([0, len(terms)]), terms, values))[0] if head is None else head.copy()
        if not self.size:
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        sizes = self.at[terms + 1] - self.at[terms]
        pairs = _ranges(self.at[terms], sizes)
        weight = np.repeat(values.astype(np.float32), sizes)
        of = self.of[pairs]
        # of a block: what its best entry has so far, and the maxima of the terms left
        bound = np.maximum.reduceat(score, self.starts) + np.bincount(of, weight * self.most[pairs], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        kth = lambda: float(np.partition(score, self.size - k)[self.size - k]) if self.size > k else 0.0
        done, step, least = 0, 4, kth()
        while done < self.blocks and bound[order[done]] > 0 and bound[order[done]] >= least - SLACK:
            now = order[done : done + step]
            visited = np.zeros(self.blocks, dtype=bool)
            visited[now] = bound[now] >= least - SLACK
            own = np.flatnonzero(visited[of])
            first = self.first[pairs[own]]
            count = self.first[pairs[own] + 1] - first
            at = _ranges(first, count)
            np.add.at(score, self.entry[at], np.repeat(weight[own], count) * self.value[at])
            least = kth()
            done, step = done + step, step * 4
        found = np.flatnonzero((score >= least - SLACK) & (score > 0))
        # single precision has chosen with some slack; the cosines are computed anew
        self.full[terms] = values
        own = self.vectors.take(found)
        cosines = np.round(np.bincount(own.rows(), own.values.astype(np.float64) * self.full[own.cols], minlength=len(found)), 9)
        self.full[terms] = 0.0
        top = np.lexsort((found, -cosines))[:k]
        top = top[cosines[top] > 0]
        return cosines[top], found[top]


@dataclass
class Judge:
    """Vocabulary, index, votes and the curve."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    votes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    ids: pa.Array | None = None
    plain: float = 0.0
    slope: float = 4.0
    shift: float = -2.0
    k: int = NEIGHBOURS

    def vote(self, cosines: np.ndarray, entries: np.ndarray) -> float | None:
        """Share of toxic votes, each weighted by 1 / (0.05 + distance)."""
        if not len(entries):
            return None
        total = ((1.0 / (0.05 + np.maximum(0.0, 1.0 - cosines)))[:, None] * self.votes[entries]).sum(0)
        return float(total[1] / total.sum())

    def judge(self, terms: np.ndarray, values: np.ndarray, head: np.ndarray | None = None) -> tuple[float, int, float]:
        """(score, nearest entry or -1, its cosine) of a text's unit vector."""
        if not len(terms):
            return self.plain, -1, 0.0
        cosines, entries = self.index.nearest(terms, values, self.k, head)
        vote = self.vote(cosines, entries)
        if vote is None:
            return self.plain, -1, 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30)))), int(entries[0]), float(cosines[0])

    def shared(self, terms: np.ndarray, entry: int) -> np.ndarray:
        """Positions in ``terms`` of those that weigh most in the product with an entry."""
        cols, values = self.index.vectors.row(entry)
        place = np.minimum(np.searchsorted(cols, terms), max(len(cols) - 1, 0))
        hit = np.flatnonzero(cols[place] == terms)
        return hit[np.argsort(-(values[place[hit]] * self.weight[terms[hit]]), kind="stable")[:EVIDENCE]]


def counted(w: kernel.Words, terms: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """Vocabulary counts of the rows of a slice, and the position of a word for each."""
    if not len(terms):
        return Sparse(np.zeros(len(w.counts) + 1, dtype=np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64)
    known, back = np.unique(w.hashes, return_inverse=True)
    place = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
    good = np.flatnonzero((terms[place] == known)[back])
    keys = w.rows()[good] * len(terms) + place[back[good]]
    keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return Sparse(np.searchsorted(keys, np.arange(len(w.counts) + 1) * len(terms)), keys % len(terms), counts), good[first]


def build(counts: Sparse, labels: np.ndarray, ids: pa.Array, terms: np.ndarray, df: np.ndarray, n_docs: int, k: int = NEIGHBOURS) -> Judge:
    """The judge of examples in the order of their ids: every fifth fits the curve, the others are the index."""
    n = len(labels)
    if not n:
        return Judge()
    fitted = np.arange(n) % 5 == 4
    if not fitted.any() or len(set(labels[fitted].tolist())) < 2:
        fitted = np.zeros(n, dtype=bool)
    own = np.flatnonzero(~fitted & (np.diff(counts.at) > 0))
    plain = float(labels.mean())
    if not len(own):
        return Judge(plain=plain)
    examples = counts.take(own)
    weight = weights(examples, labels[own], df, n_docs)
    rows = examples.rows()
    with np.errstate(over="ignore"):
        mark = kernel.splitmix(examples.cols.astype(_U) * _U(0x9E3779B97F4A7C15) + examples.values.astype(_U))
        sums = np.concatenate([[_U(0)], np.cumsum(mark, dtype=_U)])
        signature = sums[examples.at[1:]] - sums[examples.at[:-1]]
    del mark, sums
    vectors = unit(examples, weight)
    # entries of one leading term lie together, so that blocks differ in their bounds
    lead = np.zeros(len(own), dtype=np.int64)
    order = np.lexsort((vectors.values, rows))
    lead[rows[order]] = vectors.cols[order]
    order = np.lexsort((np.arange(len(own)), signature, lead))
    new = np.ones(len(own), dtype=bool)
    new[1:] = signature[order][1:] != signature[order][:-1]
    entry = np.cumsum(new) - 1
    tally = np.zeros((int(entry[-1]) + 1, 2))
    np.add.at(tally, (entry, labels[own][order]), 1.0)
    first = order[new]
    vectors = vectors.take(first)
    vectors = Sparse(vectors.at, vectors.cols.astype(np.int32), vectors.values.astype(np.float32))
    out = Judge(terms, weight, BlockMaxIndex(vectors, len(terms)), np.sqrt(tally), ids.take(pa.array(own[first])), plain, k=k)
    tested = np.flatnonzero(fitted) if fitted.any() else own
    votes, truth = [], []
    for part in np.array_split(tested, -(-len(tested) // QUERIES)):
        queries = unit(counts.take(part), weight)
        heads = out.index.heads(queries)
        for i, label in enumerate(labels[part]):
            vote = out.vote(*out.index.nearest(*queries.row(i), k, heads[i]))
            if vote is not None:
                votes.append(vote)
                truth.append(float(label))
    if len(set(truth)) == 2:
        out.slope, out.shift = logistic_fit(np.array(votes), np.array(truth))
    elif truth:
        out.slope, out.shift = 4.0, 0.0 if truth[0] else -4.0
    return out


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Document frequency of each term, and the number of documents, over all of ``docs``: counted per task, then added up."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, n = np.zeros(len(terms), dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for w in kernel.words(b.column(0), LETTERS):
                total += np.bincount(counted(w, terms)[0].cols, minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["t", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["t"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(terms), dtype=np.int64)
    df[at[at >= 0]] = n[at >= 0]
    shared.destroy()
    return df, int(n[at < 0].sum())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_EXAMPLES) -> Judge:
    """The judge fitted on at most ``bound`` labelled rows of the training folds, with document frequencies of all ``docs``."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, bound).select("doc_id", F.col("text").cast("string").alias("text"), "label")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in kernel.words(b.column("text"), LETTERS):
                n = len(w.counts)
                own = np.unique(w.hashes)
                found, _ = counted(w, own)
                offs = pa.array(found.at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(w.first, n), pa.ListArray.from_arrays(offs, pa.array(own[found.cols].view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(found.values.astype(np.int32))), b.column("label").slice(w.first, n)],
                    names=["doc_id", "terms", "times", "label"],
                )

    schema = T.StructType([sample.schema["doc_id"], T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("label", T.IntegerType())])
    got = sample.mapInArrow(run, schema).toArrow().combine_chunks()
    if not got.num_rows:
        return Judge()
    order = np.argsort(np.array([str(x) for x in got["doc_id"].to_pylist()]), kind="stable")
    y = (got["label"].to_numpy() > 0).astype(np.int64)
    lists, times = got["terms"].combine_chunks(), got["times"].combine_chunks()
    at = np.asarray(lists.offsets).astype(np.int64)
    hashes = np.asarray(lists.flatten()).view(_U)
    terms, cols = np.unique(hashes, return_inverse=True)
    cols = cols.astype(np.int32)
    # a row's hashes ascend, and so do their places
    counts = Sparse(at - at[0], cols, np.asarray(times.flatten())).take(order)
    ids = got["doc_id"].combine_chunks().take(pa.array(order))
    del got, lists, times, hashes, cols
    df, n = document_frequencies(docs, terms)
    judge = build(counts, y[order], ids, terms, df, n)
    del counts
    give_back()
    return judge


def _judged(column: pa.Array, judge: Judge, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """(first row, scores, nearest entries, cosines, matched words) per slice."""
    for w in kernel.words(column, LETTERS):
        counts, place = counted(w, judge.terms)
        n, heads, begin = len(w.counts), None, 0
        scores, near, cosines, words = np.full(n, judge.plain), np.full(n, -1), np.zeros(n), [None] * n
        queries = unit(counts, judge.weight)
        for i in range(n):
            t, v = queries.row(i)
            if not len(t):
                continue
            if heads is None or i - begin >= len(heads):
                heads, begin = judge.index.heads(queries.take(np.arange(i, min(n, i + QUERIES)))), i
            scores[i], near[i], cosines[i] = judge.judge(t, v, heads[i - begin])
            if scores[i] >= threshold and near[i] >= 0:
                own = place[counts.at[i] : counts.at[i + 1]][judge.shared(t, int(near[i]))]
                words[i] = " ".join(w.data[w.starts[p] : w.ends[p]].tobytes().decode("utf-8", "replace") for p in own)
        yield w.first, np.round(scores, 9), near, cosines, words


def score(docs: DataFrame, judge: Judge, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbour, cosine, matched) of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(judge)  # bounded by MAX_EXAMPLES texts

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in batches:
            kind = b.column("doc_id").type
            ids = judge.ids.cast(kind) if judge.ids is not None else pa.nulls(0, kind)
            for first, scores, near, cosines, words in _judged(b.column("text"), judge, threshold):
                n = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, n), b.column("held_out").slice(first, n), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), ids.take(pa.array(near, mask=near < 0)), pa.array(np.round(cosines, 9)), pa.array(words, type=pa.string())],
                    names=schema.fieldNames(),
                )

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("neighbour", kind), T.StructField("cosine", T.DoubleType()), T.StructField("matched", T.StringType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, judge: Judge, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores under the threshold: decided row by row in the scoring pass, so repeated and null ids play no part."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, scores, _, _, _ in _judged(b.column(at), shared.value, 2.0):
                yield b.slice(first, len(scores)).filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Hard negatives of embeddings by blocked dense products.

1. Usable rows (label, vector and every component present and finite) become
   blocks of float64 matrices inside each task; components are
   ``floor(scale * x)``, so products of integers are exact as long as no sum
   reaches 2 ** 53.  A block beyond that bound is multiplied in Python's
   integers instead.
2. Anchors are taken in groups of at most ``ANCHOR_BYTES``.  A group is
   broadcast; each task multiplies it with its blocks and keeps its own best
   positives of every anchor, at most ``n_positives`` of them.
3. The tasks' lists are merged by a window that keeps the first ones of an
   anchor (Spark cuts each task's lists before the shuffle), which gives the
   positives and so the window of scores of each.
4. The group is broadcast again with these windows, and the second pass keeps
   in the same way the first negatives of every anchor and positive.

A pass holds one group on the driver and in a worker, whatever the number of
anchors; more anchors take more passes over the table.  The result of a group
is written to the shared folder.  Nothing is sampled; the anchors are the query
set, and all rows are candidates.

Defined results: rows with a null label, vector, component, id, or with a NaN
or infinite component take no part; vectors of different lengths are compared
over the shorter one's components (missing ones are 0); ties go by the smaller
id, so repeated rows each take a place; a row is never its own id's positive or
negative; anchors that share an id are anchors of their own; an anchor without
a positive, and a positive without a negative in its window, give no row; a
score that no 64-bit integer holds is an error; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, lean, stored

#: Bytes of an anchor group's matrix, which is broadcast and held by a worker.
ANCHOR_BYTES = 32 << 20
#: Anchors and candidates of one product.
ROWS = 1024
EXACT = 1 << 53
#: Columns of an anchor's place in its group, and of the results.
_POSITIVE = "place long, anchor_id long, score long, id long"
_NEGATIVE = "place long, anchor_id long, positive long, positive_id long, positive_score long, score long, id long"


@dataclass
class Anchors:
    """A group: ids, labels and matrix; of the second pass also each anchor's positives."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    positives: list[list[tuple[int, int]]] | None = None  # (score, id) in order


def usable(vectors: DataFrame, vec_id: str, vector: str, label: Column | str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("label is not null")


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros to the longest one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(counts) and (counts == counts[0]).all():
        return flat.reshape(len(counts), counts[0])
    out = np.zeros((len(counts), int(counts.max(initial=0))))
    out[np.arange(out.shape[1]) < counts[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, exact; float64 where no sum can reach 2 ** 53, else integers of any length."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d == 0:
        return np.zeros((len(a), len(b)))
    if np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    made = whole(a) @ whole(b).T
    if max(abs(x) for x in made.flat) >= 1 << 63:
        raise OverflowError("a score that no 64-bit integer holds")
    return made.astype(np.int64)


def _firsts(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the best allowed score of each row, then of the second best ... of equal scores the first column."""
    low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    left = np.where(allowed, scores, low)
    rows = np.flatnonzero(allowed.any(axis=1))
    for _ in range(k):
        if not len(rows):
            return
        columns = left[rows].argmax(axis=1)
        there = allowed[rows, columns]
        rows, columns = rows[there], columns[there]
        yield rows, columns
        left[rows, columns] = low
        allowed[rows, columns] = False


def _merged(kept: dict, key: tuple, score: int, row_id: int, k: int) -> None:
    """Puts a row into the best ``k`` of a key."""
    own = kept.setdefault(key, [])
    if len(own) < k or (-score, row_id) < own[-1]:
        own.append((-score, row_id))
        own.sort()
        del own[k:]


def _pass(group: Anchors, k: int, window: tuple[int, int, int] | None, scale: float):
    """A task of the first pass (no ``window``: rows of the anchor's label), or of the second (other labels, inside each positive's window)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            order = np.argsort(ids, kind="stable")  # so that the first of equal scores has the smallest id
            matrix, ids, labels = _matrix(batch.column("v"), scale)[order], ids[order], labels[order]
            for c in range(0, len(ids), ROWS):
                for a in range(0, len(group.ids), ROWS):
                    own = slice(a, a + ROWS)
                    scores = products(group.matrix[own], matrix[c : c + ROWS])
                    same = group.labels[own][:, None] == labels[c : c + ROWS]
                    other_id = group.ids[own][:, None] != ids[c : c + ROWS]
                    if window is None:
                        _positives(kept, scores, same & other_id, a, ids[c : c + ROWS], k)
                    else:
                        _negatives(kept, group, scores, ~same & other_id, a, ids[c : c + ROWS], k, window)
        yield from _rows(kept, group, window is None)

    return lean(task)


def _positives(kept: dict, scores: np.ndarray, allowed: np.ndarray, a: int, ids: np.ndarray, k: int) -> None:
    # a row that can't enter an anchor's full list is left out before any list is touched
    for r in np.flatnonzero(allowed.any(axis=1)):
        own = kept.get((a + r, 0))
        if own is not None and len(own) == k:
            allowed[r] &= scores[r] >= -own[-1][0]
    for rows, columns in _firsts(scores, allowed, k):
        for r, c in zip(rows.tolist(), columns.tolist()):
            _merged(kept, (a + r, 0), int(scores[r, c]), int(ids[c]), k)


def _negatives(kept: dict, group: Anchors, scores: np.ndarray, allowed: np.ndarray, a: int, ids: np.ndarray, k: int, window: tuple[int, int, int]) -> None:
    low, of, high = window
    found = group.positives[a : a + len(scores)]
    for p in range(max(map(len, found), default=0)):
        rows = np.array([r for r, x in enumerate(found) if len(x) > p], dtype=np.int64)
        mark = [found[r][p][0] for r in rows.tolist()]
        # low * m <= of * s <= high * m in whole numbers: s from ceil(low * m / of) to floor(high * m / of)
        least, most = (np.array(x, dtype=object) for x in ([-(-low * m // of) for m in mark], [high * m // of for m in mark]))
        kind = scores.dtype
        inside = allowed[rows] & (scores[rows] >= least.astype(kind)[:, None]) & (scores[rows] <= most.astype(kind)[:, None])
        for i, r in enumerate(rows.tolist()):
            own = kept.get((a + r, p))
            if own is not None and len(own) == k:
                inside[i] &= scores[r] >= -own[-1][0]
        for got, columns in _firsts(scores[rows], inside, k):
            for i, c in zip(got.tolist(), columns.tolist()):
                _merged(kept, (a + int(rows[i]), p), int(scores[rows[i], c]), int(ids[c]), k)


def _rows(kept: dict, group: Anchors, first: bool) -> Iterator[pa.RecordBatch]:
    flat = [(place, p, -s, i) for (place, p), own in kept.items() for s, i in own]
    for at in range(0, len(flat), 65536):
        place, p, score, row_id = map(list, zip(*flat[at : at + 65536]))
        out = {"place": place, "anchor_id": [int(group.ids[x]) for x in place]}
        if not first:
            out |= {"positive": p, "positive_id": [group.positives[x][y][1] for x, y in zip(place, p)], "positive_score": [group.positives[x][y][0] for x, y in zip(place, p)]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in (out | {"score": score, "id": row_id}).items()})


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", n_positives: int = 5, n_negatives: int = 3, window: tuple[int, int, int] = (50, 100, 95), scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each anchor the first ``n_positives`` other rows of its label, and for
    each of them the first ``n_negatives`` rows of another label whose score s
    fits ``low * positive <= of * s <= high * positive`` for the ``window``
    (low, of, high); higher scores come first, then smaller ids.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, vec_id, vector, label)
    anchors = stored(usable(vectors.where(is_anchor), vec_id, vector, label).withColumn("place", F.monotonically_increasing_id()), "anchors")
    # 8 bytes a component; an id, a label and a list of positives beside them
    widest = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    each = max(1, ANCHOR_BYTES // (8 * (widest[1] or 0) + 128))
    n_groups = -(-widest[0] // each)
    # groups of nearly equal size by a hash of the place; a group larger than planned costs memory in proportion only
    numbered = anchors.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(max(1, n_groups))))
    results = []
    for g in range(n_groups):
        own = numbered.where(F.col("group") == g).select("id", "label", "v").orderBy("id").toArrow()
        group = Anchors(own["id"].to_numpy(), own["label"].to_numpy(), _matrix(own["v"], scale))
        sent = spark.sparkContext.broadcast(group)
        positives = stored(_best(rows.mapInArrow(_sent(sent, n_positives, None, scale), _POSITIVE), ["place"], n_positives), "positives")
        group.positives = [[] for _ in range(len(group.ids))]
        for p in positives.orderBy("place", "rank").toLocalIterator():  # at most n_positives for each anchor of the group
            group.positives[p["place"]].append((p["score"], p["id"]))
        again = spark.sparkContext.broadcast(group)
        found = _best(rows.mapInArrow(_sent(again, n_negatives, window, scale), _NEGATIVE), ["place", "positive"], n_negatives)
        results.append(stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        discard(positives)
        sent.destroy()
        again.destroy()
    discard(anchors)
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(results[0].schema).parquet(*(r._veilspark_path for r in results))


def _sent(group, k: int, window: tuple[int, int, int] | None, scale: float):
    """The task over a broadcast group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pass(group.value, k, window, scale)(batches)

    return task

"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams of two streams: the words (lengths 1
and 2) and the words' shapes (lengths 1 to 3: case, digits, signs, length, and
whether a word repeats the one before).  Each indicator is scaled by the log
ratio of its smoothed class frequencies, and a linear model with hinge loss is
fitted by dual coordinate descent; a logistic curve fitted on rows kept out of
the fit turns margins into scores.

Fitting uses at most ``MAX_EXAMPLES`` labelled rows (drawn by a hash of the
id); every row is scored over its whole text, in one pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of
the bias; ties and repeated rows get equal scores; without examples of both
classes every score is the share of positive examples (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from ..session import ship
from .common import give_back, held_out, labelled_sample, lean

MAX_EXAMPLES = 6000
BITS = 18
EPOCHS = 12
C = 0.1
_U = np.uint64
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[ord("A") : ord("Z") + 1] = 1
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[ord("0") : ord("9") + 1] = 1
_SIGN = np.zeros(256, dtype=np.int32)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1


def _sums(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(table[data], out=out[1:])
    return out


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, feature ids, row offsets) per slice: the distinct features of each row, ascending."""
    off, raw = kernel._buffers(column)
    mask = _U((1 << bits) - 1)
    for w in kernel.words(column):
        data = raw[off[w.first] : off[w.first] + len(w.data)]  # with its case
        upper, digit, sign = (_sums(t, data) for t in (_UPPER, _DIGIT, _SIGN))
        count = lambda s: s[w.ends] - s[w.starts]
        size = (w.ends - w.starts).astype(np.int64)
        n = len(size)
        rows = w.rows()
        again = np.zeros(n, dtype=np.int64)
        if n:
            again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (rows[1:] == rows[:-1])
        caps = np.minimum(count(upper), 2) + 3 * (count(upper) * 2 > size)
        shape = ((caps * 2 + (count(digit) > 0)) * 5 + np.minimum(count(sign), 4)) * 6 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 5)
        shape = kernel.splitmix((shape * 2 + again).astype(_U) + _U(1 << 40))
        parts = []
        for stream, longest in ((w.hashes, 2), (shape, 3)):
            gram = np.zeros(n, dtype=_U)
            for k in range(longest):
                with np.errstate(over="ignore"):
                    moved = np.zeros(n, dtype=_U)
                    moved[: n - k] = stream[k:]
                    gram = kernel.splitmix(gram + moved * kernel._MULT[k])
                ok = np.ones(n, dtype=bool)
                if k:
                    ok[n - k :] = False
                    ok[: n - k] = rows[k:] == rows[: n - k]
                parts.append((rows[ok].astype(_U) << _U(bits)) | (gram[ok] & mask))
        keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=_U)
        at = np.searchsorted(keys, np.arange(len(w.counts) + 1, dtype=_U) << _U(bits))
        yield w.first, (keys & mask).astype(np.int32), at


@dataclass
class Model:
    weights: np.ndarray  # fitted weight times log-count ratio
    ratios: np.ndarray  # the ratios, for a row's length
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss over rows of feature ids whose values are ``scale[id] / norm``."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / max(1e-9, float(np.sqrt((scale[r] ** 2).sum()))) for r in rows]
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            grad = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - grad / 2.0, 0.0), costs[i])  # squared norm of a row: 1, and 1 for the bias
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, 0/1), with smoothed targets and Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> Model:
    """The model of rows of feature ids and their 0/1 labels."""
    y = labels.astype(int)
    size = 1 << bits
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    kept_out = np.arange(len(y)) % 5 == 4
    if len(set(y[kept_out].tolist())) < 2 or len(set(y[~kept_out].tolist())) < 2:
        kept_out = np.zeros(len(y), dtype=bool)
    train = [i for i in range(len(y)) if not kept_out[i]]
    p, q = np.ones(size), np.ones(size)
    for i in train:
        (p if y[i] else q)[rows[i]] += 1
    n_pos = sum(int(y[i]) for i in train)
    ratio = np.log(p / (n_pos + 2)) - np.log(q / (len(train) - n_pos + 2))
    ratio[(p + q) < 4] = 0.0  # seen once: no evidence
    sign = np.where(y[train] > 0, 1.0, -1.0)
    costs = C * 10 * np.where(sign > 0, len(train) / (2 * n_pos), len(train) / (2 * (len(train) - n_pos)))
    w, bias = dual_descent([rows[i] for i in train], ratio, sign, costs)
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), float(bias))
    own = [i for i in range(len(y)) if kept_out[i]] or train
    margins = np.array([_margin(model, rows[i]) for i in own])
    model.slope, model.shift = logistic_fit(margins, y[own])
    return model


def _margin(model: Model, row: np.ndarray) -> float:
    norm = float(np.sqrt((model.ratios[row].astype(float) ** 2).sum())) if len(row) else 0.0
    return float(model.weights[row].sum()) / max(norm, 1e-9) + model.bias


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = MAX_EXAMPLES) -> Model:
    """Fit on at most ``bound`` labelled rows of the training folds."""
    ship(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, ids, at in features(b.column("text")):
                n = len(at) - 1
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), lists, b.column("label").slice(first, n)], names=["doc_id", "ids", "label"])

    sample = labelled_sample(docs, labels, label, bound)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("label", T.IntegerType())])
    got = sample.select("doc_id", F.col("text").cast("string").alias("text"), "label").mapInArrow(run, schema).toArrow().combine_chunks()
    order = np.argsort(np.array(got["doc_id"].to_pylist()), kind="stable") if got.num_rows else np.zeros(0, int)
    lists = got["ids"].combine_chunks() if got.num_rows else None
    rows = [np.asarray(lists[int(i)].values) for i in order]
    model = fit(rows, np.array([got["label"][int(i)].as_py() for i in order], dtype=int))
    del got, lists, rows
    give_back()
    return model


def _scored(column: pa.Array, model: Model) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) per slice."""
    squares = model.ratios.astype(np.float64) ** 2
    weights = model.weights.astype(np.float64)
    for first, ids, at in features(column):
        total = np.concatenate([[0.0], np.cumsum(weights[ids])])
        norm = np.concatenate([[0.0], np.cumsum(squares[ids])])
        norms = np.sqrt(np.maximum(norm[at[1:]] - norm[at[:-1]], 0.0))
        margins = np.where(norms > 1e-6, (total[at[1:]] - total[at[:-1]]) / np.maximum(norms, 1e-6), 0.0) + model.bias
        yield first, np.round(model.scores(margins), 9)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the input

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in _scored(b.column("text"), shared.value):
                n = len(s)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), b.column("held_out").slice(first, n), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, whole, whose text reaches the threshold: decided row by row in the scoring pass, so repeated and null ids play no part."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, s in _scored(b.column(at), shared.value):
                yield b.slice(first, len(s)).filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Bounded-space online packing of token sequences.

Each partition keeps ``OPEN`` open windows.  A document's whole windows are
closed at once; what is left goes to the open window that it fits best.  When
it fits none, the fullest window is emitted: first topped up with the head of
the piece if its gap is at least ``MIN_CUT`` tokens, else padded.  The windows
still open at the end of the partitions are merged, whole, in groups of
partitions, by best fit in order of falling size, so no group grows with the
table.

Defined results: a null or empty text is the end token alone; documents longer
than a window are cut; repeated ids are packed as the separate rows that they
are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PieceEncoder
from ..session import ship
from .common import lean, stored

OPEN = 16
MIN_CUT = 8
#: Partitions whose open windows are merged together.
MERGE = 64
_PART_BITS = 36


class Packer:
    """Open windows of one partition; ``put`` and ``finish`` return closed pieces (document, start, length, window, offset)."""

    def __init__(self, window: int, first_id: int, open_windows: int = OPEN):
        self.window, self.next_id, self.most = window, first_id, open_windows
        self.open: dict[int, int] = {}  # window id -> filled

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, length: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start, length, window, offset) of a document of ``length`` tokens."""
        pieces, start = [], 0
        while length - start >= self.window:
            pieces.append((start, self.window, self._new(), 0))
            start += self.window
        rest = length - start
        while rest:
            fits = [(filled, w) for w, filled in self.open.items() if filled + rest <= self.window]
            if fits:
                filled, w = max(fits)
            elif len(self.open) < self.most:
                filled, w = 0, self._new()
            else:
                filled, w = max((filled, w) for w, filled in self.open.items())
                gap = self.window - filled
                del self.open[w]
                if gap >= MIN_CUT:
                    pieces.append((start, gap, w, filled))
                    start, rest = start + gap, rest - gap
                continue
            pieces.append((start, rest, w, filled))
            self.open[w] = filled + rest
            if self.open[w] == self.window:
                del self.open[w]
            rest = 0
        return pieces


def merge_windows(fills: list[tuple[int, int]], window: int) -> dict[int, tuple[int, int]]:
    """Best fit of whole windows (id, filled) in order of falling size: id -> (new window, offset); the new one is its first member."""
    free: dict[int, int] = {}
    out = {}
    for w, filled in sorted(fills, key=lambda x: (-x[1], x[0])):
        into = min(((room, v) for v, room in free.items() if room >= filled), default=None)
        if into is None:
            out[w] = (w, 0)
            free[w] = window - filled
        else:
            room, v = into
            out[w] = (v, window - room)
            free[v] = room - filled
        if not free[out[w][0]]:
            del free[out[w][0]]
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("_open", T.BooleanType()), T.StructField("_group", T.IntegerType())]
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = PieceEncoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(window, part << _PART_BITS)
        waiting: list[tuple] = []  # pieces of windows that are still open
        arrow_id = None

        def batch(ids: list, rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(ids, type=arrow_id), *(pa.array(c, type=pa.int64()) for c in columns)]
            arrays += [pa.array([is_open] * len(rows), type=pa.bool_()), pa.array([part // MERGE] * len(rows), type=pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        for b in batches:
            arrow_id = b.column(0).type
            ids, rows = [], []
            for row, tokens in enumerate(encoder.encode(b.column(1))):
                tokens = np.append(tokens, np.uint32(end_id))
                doc = b.column(0)[row].as_py()
                for start, length, w, offset in packer.put(len(tokens)):
                    crc = zlib.crc32(tokens[start : start + length].astype("<u4").tobytes())
                    waiting.append((doc, (start, length, crc, len(tokens), w, offset)))
                if len(waiting) > 4096:
                    still = [x for x in waiting if x[1][4] in packer.open]
                    done = [x for x in waiting if x[1][4] not in packer.open]
                    ids += [x[0] for x in done]
                    rows += [x[1] for x in done]
                    waiting = still
            if rows:
                yield batch(ids, rows, False)
        for is_open in (False, True):
            last = [x for x in waiting if (x[1][4] in packer.open) == is_open]
            if last:
                yield batch([x[0] for x in last], [x[1] for x in last], is_open)

    made = stored(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema), "packed")
    closed, left = made.where(~F.col("_open")), made.where("_open")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        fills = part.groupby("sequence_id")["length"].sum()
        to = merge_windows([(int(w), int(n)) for w, n in fills.items()], window)
        moved = [to[int(w)] for w in part["sequence_id"]]
        part["sequence_id"] = [w for w, _ in moved]
        part["offset"] = part["offset"] + pd.Series([o for _, o in moved], index=part.index, dtype="int64")
        return part

    merged = left.groupBy("_group").applyInPandas(merge, schema)
    return closed.unionByName(merged).drop("_open", "_group")

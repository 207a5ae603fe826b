"""Removal of passages that stand somewhere else too, by FM-indexes of shards.

A window is ``window`` consecutive words; every word that a window covers whose
words also start at another place (of the same text or of any other) is
removed.

1. Equal texts are one row with their number of copies, in a table bucketed by
   the text's 128-bit identity; later steps join it without moving the texts.
2. Every window belongs to the smallest hash of its ``GRAM``-word runs.  Equal
   windows have equal ones, so windows can be dealt over shards by it, and a
   key that stands once needs no shard.  A segment is a stretch of
   windows of one key, of at most ``window - GRAM + 1`` of them.
3. Segments of a key that is met twice are cut out of one text each, equal ones
   once with their number of copies, and dealt by key.  Each shard of about
   ``SHARD_WORDS`` words gets an FM-index over the words themselves; its
   segments are streamed through it by backward search, which gives the first
   and last repeated window of each.  The windows of a segment all overlap, so
   these two bound what it removes.
4. Keys with more than ``HOT`` different segments (the edges of a passage that
   very many texts share) are dealt anew by the whole window: windows met once
   go, one copy of every other is looked up in the index in the same way.
5. What a segment removes is joined to every place where the segment stands and
   the intervals of a text are cut from it.

Nothing is collected.  A shard holds whole keys, at most ``HOT`` segments of
one key.  Window keys and segment identities are 64-bit and 128-bit hashes;
the indexes compare words.

Defined results: a null text is an empty one; a text of fewer words than a
window keeps all; copies of a text (of rows that share an id, too) are places of
their own, so a text with a copy and a whole window loses every word that a
window covers; rows with a null id are returned like others; very long texts
are cut into bounded segments; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernel
from .common import lean, shared_dir, stored
from .filter_audit import identity
from .fm_index import FMIndex, repeated

WINDOW = 35
#: Words of the runs whose smallest hash is a window's key.
GRAM = 10
#: Different segments of a key up to which they are indexed together.
HOT = 2048
SHARD_WORDS = 1 << 18
_U = np.uint64
_MULT = kernel.splitmix(np.arange(256, dtype=_U) + _U(0xF111)) | _U(1)
_BYTE = kernel.splitmix(np.arange(256, dtype=_U) + _U(0x7777))
_WIDE = "h1 long, h2 long"


def texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, text, copies) of every different text, as a table bucketed by its identity; copies are 2 at most."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = identity(text)
    distinct = docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"))
    name = f"veilspark_texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/veilspark/{name}"
    distinct.write.bucketBy(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "h1", "h2").option("path", path).saveAsTable(name)
    return spark.table(name)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` words from every word on; those at the end are cut short."""
    out = np.zeros(len(hashes), dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(hashes))):
            out[: len(hashes) - k] += hashes[k:] * _MULT[k]
    return kernel.splitmix(out)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the first minimum of ``span`` values from every one on, by doubling."""
    at, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at[: len(left)] = np.where(values[right] < values[left], right, left)
        width += step
    return at


def _next_equal(values: np.ndarray) -> np.ndarray:
    """Place of the next equal value of each one; beyond the end where there is none."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.full(len(values), len(values) + (1 << 40))
    out[order[:-1][same]] = order[1:][same]
    return out


def _segments(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, identity, first word, windows, whether its key stands twice in it) of the segments of the texts, slice by slice."""
    offsets, raw = kernel._buffers(column)
    span = window - GRAM + 1
    for w in kernel.words(column):
        n = len(w.hashes)
        ends = np.repeat(w.offsets[1:], w.counts)
        at = np.flatnonzero(np.arange(n) + window <= ends)
        if not len(at):
            continue
        grams = _grams(w.hashes, GRAM)
        least = _least(grams, span)[at]
        key = grams[least]
        row = np.repeat(np.arange(len(w.counts)), w.counts)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        cut = np.flatnonzero(place % span == 0)
        count = np.diff(np.append(cut, len(at)))
        # the bytes as they came (the slice's own are lower-cased) tell segments apart
        data = raw[offsets[w.first] : offsets[w.first] + len(w.data)]
        first, last = w.starts[at[cut]], w.ends[at[cut] + count + window - 2]
        sums = np.zeros(len(data) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[data] * kernel._POW[: len(data)], out=sums[1:])
            own = kernel.splitmix((sums[last] - sums[first]) * kernel._INV[first] + (last - first).astype(_U))
        again = _next_equal(grams)[least[cut]] < at[cut] + count + span - 1
        yield w.first + row[cut], key[cut], own, at[cut] - w.offsets[row[cut]], count, again


_RUNS = f"m long, s long, {_WIDE}, at long, copies int, met int"
#: A segment's first word and number of windows in one number.
_PACK = 1 << 16


def _runs(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, copies = (batch.column(c).to_numpy() for c in ("h1", "h2", "copies"))
            for row, key, own, first, count, again in _segments(batch.column("text"), window):
                met = np.maximum(copies[row], np.where(again, 2, 1)).astype(np.int32)
                columns = (key.view(np.int64), own.view(np.int64), h1[row], h2[row], first.astype(np.int64) * _PACK + count, copies[row], met)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["m", "s", "h1", "h2", "at", "copies", "met"])

    return lean(task)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at the six blank bytes and at nothing else


def _cut(window: int):
    """Segments (m, s, copies, words) out of texts, by each text's list of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                words, found = _words(text.as_py()), asked.as_py()
                made = [b" ".join(words[x["at"] // _PACK : x["at"] // _PACK + x["at"] % _PACK + window - 1]).decode() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x["m"] for x in found], pa.int64()), pa.array([x["s"] for x in found], pa.int64()), pa.array([x["copies"] for x in found], pa.int32()), pa.array(made, pa.string())], names=["m", "s", "copies", "words"])

    return lean(task)


def _single(window: int):
    """Every window (m, s, place in the segment, key of the window, h1, h2, at, copies) of a text's asked segments."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h1, h2, text, asked in zip(*(batch.column(c) for c in ("h1", "h2", "text", "asked"))):
                words = _words(text.as_py())
                for x in asked.as_py():
                    first, count = divmod(x["at"], _PACK)
                    part = pa.array([b" ".join(words[first + k : first + k + window]).decode() for k in range(count)])
                    keys = np.concatenate([own for _, _, own, _, _, _ in _segments(part, window)]).view(np.int64).tolist()
                    out += [(x["m"], x["s"], k, key, h1.as_py(), h2.as_py(), (first + k) * _PACK + 1, x["copies"]) for k, key in enumerate(keys)]
            names = ("m", "s", "k", "w", "h1", "h2", "at", "copies")
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("k", "copies") else pa.int64()) for n, c in zip(names, columns)], names=list(names))

    return lean(task)


def _indexed(window: int):
    """(m, s, first, last) of the segments with a repeated window: one FM-index for each stretch of whole keys of about ``SHARD_WORDS`` words."""

    def search(shard: list[tuple]) -> pa.RecordBatch:
        codes: dict[bytes, int] = {}
        segments = [np.array([codes.setdefault(x, len(codes) + 1) for x in words], dtype=np.int64) for _, _, _, words in shard]
        gap = np.zeros(1, dtype=np.int64)
        index = FMIndex(np.concatenate([x for s, row in zip(segments, shard) for _ in range(min(2, row[2])) for x in (s, gap)]), len(codes) + 1)
        lengths = np.array([len(s) for s in segments])
        first, last = repeated(index, np.concatenate(segments), np.cumsum(lengths) - lengths, lengths, window)
        hit = np.flatnonzero(first >= 0)
        m, s = (pa.array([shard[x][k] for x in hit], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([m, s, pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], names=["m", "s", "first", "last"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        held = 0
        for batch in batches:
            for m, s, copies, words in zip(*(batch.column(c).to_pylist() for c in ("m", "s", "copies", "words"))):
                if held >= SHARD_WORDS and m != shard[-1][0]:
                    yield search(shard)
                    shard, held = [], 0
                shard.append((m, s, copies, words.encode().split(b" ")))
                held += len(shard[-1][3]) * min(2, copies)
        if shard:
            yield search(shard)

    return lean(task)


def _asked(segments: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Texts with the list of their asked segments (m, s, at, copies); the bucketed texts stay where they are."""
    lists = segments.groupBy("h1", "h2").agg(F.collect_list(F.struct("m", "s", "at", "copies")).alias("asked"))
    return table.select("h1", "h2", "text").join(lists, ["h1", "h2"])


def found_segments(table: DataFrame, window: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(places where segments of a key that is met twice stand, the segments with a repeated window: m, s, first, last), both written."""
    runs = table.mapInArrow(_runs(window), _RUNS)
    # written first, so that Spark may split the large side of the joins with them where one key holds many rows
    twice = stored(runs.groupBy("m").agg(F.sum("met").alias("n")).where("n > 1").select("m"), "keys")
    places = stored(runs.drop("met").join(twice, "m"), "places")
    own = F.struct("h1", "h2", "at")
    segments = places.groupBy("m", "s").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.min(own).alias("c"))
    segments = stored(segments.select("m", "s", "copies", "c.*"), "segments")
    crowded = stored(segments.groupBy("m").count().where(F.col("count") > hot).select("m"), "crowded")
    usual = _asked(segments.join(crowded, "m", "left_anti"), table).mapInArrow(_cut(window), "m long, s long, copies int, words string")
    single = stored(_asked(segments.join(crowded, "m", "left_semi"), table).mapInArrow(_single(window), f"m long, s long, k int, w long, {_WIDE}, at long, copies int"), "windows")
    again = single.groupBy("w").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.min(own).alias("c")).where("copies > 1")
    again = again.select(F.col("w").alias("m"), F.lit(None).cast("long").alias("s"), "copies", "c.*")  # no segment: a window by itself
    rest = _asked(again, table).mapInArrow(_cut(window), "m long, s long, copies int, words string")
    dealt = usual.unionByName(rest).repartition("m").sortWithinPartitions("m", "s")
    hits = stored(dealt.mapInArrow(_indexed(window), "m long, s long, first int, last int"), "repeated")
    whole = single.join(hits.where("s is null").select(F.col("m").alias("w")), "w").groupBy("m", "s").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return places, hits.where("s is not null").unionByName(whole)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their intervals."""
    for batch in batches:
        rows = []
        for text, cuts in zip(batch.column("text"), batch.column("cuts")):
            words = _words(text.as_py())
            removed: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in cuts.as_py() or ()):
                if removed and a <= removed[-1][1]:
                    removed[-1][1] = max(removed[-1][1], b)
                else:
                    removed.append([a, b])
            kept, at = [], 0
            for a, b in removed:
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": b} for a, b in removed]))
        n, gone, kept, removed = zip(*rows) if rows else ((), (), (), ())
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, interval)], names=["h1", "h2", "n_words", "n_removed", "kept", "removed"])


def by_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h1, h2, n_words, n_removed, kept, removed) of every different text: ``removed`` are intervals of words, ``kept`` the other words joined by a space."""
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    ship(docs.sparkSession)
    table = texts(docs)
    places, found = found_segments(table, window)
    first = F.floor(F.col("at") / _PACK)
    cuts = places.join(found, ["m", "s"]).select("h1", "h2", F.struct((first + F.col("first")).alias("a"), (first + F.col("last") + window).alias("b")).alias("x"))
    cuts = cuts.groupBy("h1", "h2").agg(F.collect_list("x").alias("cuts"))
    joined = table.select("h1", "h2", "text").join(cuts, ["h1", "h2"], "left")
    return joined.mapInArrow(lean(_kept), f"{_WIDE}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def attach(docs: DataFrame, result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A text's result at each of its documents."""
    h1, h2 = identity(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(doc_id, h1.alias("h1"), h2.alias("h2")).join(result, ["h1", "h2"]).drop("h1", "h2")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) of every document."""
    return attach(docs, by_text(docs, window))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): the kept texts stay behind, their digests are joined."""
    short = by_text(docs, window).select("h1", "h2", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
    return attach(docs, short)

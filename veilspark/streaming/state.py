"""Structured Streaming: re-identification of torn placeholders, and session state of quasi-identifiers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Window:
    """Restores placeholders in a stream of texts.

    What is held back is the longest tail that is a proper beginning of some
    placeholder: all before it can't be part of one that is still to come, so
    it is restored and said at once.
    """

    def __init__(self, reid: dict[str, str], held: str = ""):
        self.reid, self.held = reid, held
        self.beginnings = {p[:k] for p in reid for k in range(1, len(p))}
        self.longest = max(map(len, reid), default=1) - 1
        self.any = re.compile("|".join(re.escape(p) for p in sorted(reid, key=len, reverse=True))) if reid else None

    def feed(self, text: str) -> str:
        whole = self.held + text
        tail = next((k for k in range(min(self.longest, len(whole)), 0, -1) if whole[-k:] in self.beginnings), 0)
        said, self.held = whole[: len(whole) - tail], whole[len(whole) - tail :]
        return self._restored(said)

    def flush(self) -> str:
        said, self.held = self.held, ""
        return self._restored(said)

    def _restored(self, text: str) -> str:
        return self.any.sub(lambda m: self.reid[m.group()], text) if self.any else text


_DELTA = ["stream_id", "channel", "call_index", "seq", "text", "finish_reason"]


class Reidentifier(StatefulProcessor):
    """Per (stream, channel, call): the held text is the only state; ``finish_reason`` ends it, or else silence of ``idle_ms``, after which the held text is said with the reason ``idle``."""

    def __init__(self, reid: dict[str, str], escaped: dict[str, str], idle_ms: int | None = None):
        self.reid, self.escaped, self.idle_ms = reid, escaped, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("seq", kind="stable")
        window = Window(self.escaped if key[1] == "arguments" else self.reid, self.held.get()[0] if self.held.exists() else "")
        out = []
        for seq, text, reason in zip(part["seq"], part["text"], part["finish_reason"], strict=True):
            said = window.feed(text or "")
            if reason:
                said += window.flush()
            out.append((*key, seq, said, reason))
        if window.held:
            self.held.update((window.held,))
        else:
            self.held.clear()
        self._renew(timerValues, bool(window.held))
        yield pd.DataFrame(out, columns=_DELTA)

    def _renew(self, timerValues, waiting: bool) -> None:
        if self.idle_ms is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest = self.held.get()[0] if self.held.exists() else ""
        self.held.clear()
        said = Window(self.escaped if key[1] == "arguments" else self.reid, rest).flush()
        yield pd.DataFrame([(*key, None, said, "idle")] if said else [], columns=_DELTA)

    def close(self) -> None:
        pass


def reidentify_stream(deltas: DataFrame, reid: dict[str, str], escaped: dict[str, str] | None = None, idle_ms: int | None = None) -> DataFrame:
    """Deltas (stream_id, channel, call_index, seq, text, finish_reason) with placeholders restored; argument channels take the escaped map.

    Rows are put in order inside a micro-batch, so a source has to give a
    stream's rows in order of their batches.  With ``idle_ms`` a stream that
    falls silent without an end is flushed by a timer.
    """
    return deltas.groupBy("stream_id", "channel", "call_index").transformWithStateInPandas(
        Reidentifier(reid, escaped if escaped is not None else reid, idle_ms), "stream_id string, channel string, call_index int, seq long, text string, finish_reason string", "Append", "none" if idle_ms is None else "processingTime"
    )


_UNION = ["stream_id", "seq", "channel", "call_index", "text", "finish_reason", "placeholder", "value"]
_SAID = "stream_id string, channel string, call_index int, seq long, text string, finish_reason string"
#: A stream's rows go to Python and come back as JSON, as each column of pandas costs time for every stream.
_PACKED = "said string"


def _said(key: str, rows: list[tuple], plain: dict[str, str], held: dict[tuple, str]) -> tuple[list[tuple], dict[tuple, str]]:
    """What is said for a stream's rows (seq, channel, call_index, text, finish_reason) in order, and what is held back in each channel after them.

    A row without a channel is an end without text: it flushes every channel.
    A channel that has nothing to say keeps its row, so that chunks of other
    kinds pass through.
    """
    escaped = {k: json.dumps(v, ensure_ascii=False)[1:-1] for k, v in plain.items()}
    windows: dict[tuple, Window] = {}
    out: list[tuple] = []

    def window(channel: str, call: int) -> Window:
        if (channel, call) not in windows:
            windows[channel, call] = Window(escaped if channel == "arguments" else plain, held.get((channel, call), ""))
        return windows[channel, call]

    for seq, channel, call, text, reason in rows:
        if channel is None:
            if reason:  # the stream's end: whatever is held is said before it
                out += [(key, c, n if n >= 0 else None, seq, window(c, n).flush(), None) for c, n in sorted({*held, *windows}) if window(c, n).held]
            out.append((key, None, None, seq, text, reason))
            continue
        own = window(channel, -1 if call is None else call)
        said = None if text is None else own.feed(text)
        if reason:
            said = (said or "") + own.flush()
        out.append((key, channel, call, seq, said, reason))
    return out, {k: w for k, w in held.items() if k not in windows} | {k: w.held for k, w in windows.items() if w.held}


def _idle(key: str, plain: dict[str, str], held: dict[tuple, str]) -> list[tuple]:
    """What a stream that fell silent still held back."""
    escaped = {k: json.dumps(v, ensure_ascii=False)[1:-1] for k, v in plain.items()}
    return [(key, c, n if n >= 0 else None, None, Window(escaped if c == "arguments" else plain, rest).flush(), "idle") for (c, n), rest in sorted(held.items())]


def _parted(parts: Iterable[pd.DataFrame]) -> tuple[dict[str, str], list[tuple]]:
    """A stream's packed rows apart: its map, and its deltas by seq (those without one last)."""
    told, rows = {}, []
    for part in parts:
        for seq, channel, call, text, reason, placeholder, value in json.loads(f"[{','.join(part['packed'])}]"):
            if placeholder is None:
                rows.append((None if seq is None else int(seq), channel, None if call is None else int(call), text, reason))
            elif value is not None:
                told[placeholder] = value
    return told, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"said": [json.dumps(rows)] if rows else []}, dtype=object)


class KeyedReidentifier(StatefulProcessor):
    """Per stream: its own map, and what is held back in each of its channels.

    The map comes as rows of the stream, in the batch of its first delta or
    before, or as initial state, and may leave the state after some time.
    """

    def __init__(self, idle_ms: int | None, keep_ms: int | None):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reid = handle.getMapState("reid", "placeholder string", "value string", self.keep_ms)
        self.held = handle.getMapState("held", "channel string, call_index int", "text string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for placeholder, value in zip(initialState["placeholder"], initialState["value"], strict=True):
            if placeholder is not None and value is not None:
                self.reid.updateValue((placeholder,), (value,))

    def _map(self) -> dict[str, str]:
        return {k[0]: v[0] for k, v in self.reid.iterator()}

    def _windows(self) -> dict[tuple, str]:
        return {(k[0], k[1]): v[0] for k, v in self.held.iterator()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, deltas = _parted(rows)
        for placeholder, value in told.items():
            self.reid.updateValue((placeholder,), (value,))
        before = self._windows()
        out, held = _said(key[0], deltas, self._map(), before)
        for name, text in held.items():
            if text != before.get(name):
                self.held.updateValue(name, (text,))
        for name in before.keys() - held.keys():
            self.held.removeKey(name)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = _idle(key[0], self._map(), self._windows())
        self.held.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


#: A stream's state in one value: its map with the time of each entry, what is held back, and when silence ends it (JSON).
_KEPT = "kept string"


def _keyed(idle_ms: int | None, keep_ms: int | None):
    """``KeyedReidentifier`` as a function of a stream's rows and its state, which come and go in Arrow batches of many streams."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reid, old, idle_at = json.loads(state.get[0]) if state.exists else ({}, [], None)
        held = {(c, n): text for c, n, text in old}
        clock = idle_ms is not None or keep_ms is not None
        now = state.getCurrentProcessingTimeMs() if clock else 0
        out: list[tuple] = []
        if keep_ms is not None:
            reid = {p: x for p, x in reid.items() if x[1] + keep_ms > now}
        if state.hasTimedOut:
            if idle_at is not None and idle_at <= now:
                out, held, idle_at = _idle(key[0], {p: x[0] for p, x in reid.items()}, held), {}, None
        else:
            told, deltas = _parted(parts)
            reid |= {p: [value, now] for p, value in told.items()}
            out, held = _said(key[0], deltas, {p: x[0] for p, x in reid.items()}, held)
            idle_at = now + idle_ms if idle_ms is not None and held else None
        if reid or held:
            state.update((json.dumps((reid, [(*k, text) for k, text in held.items()], idle_at)),))
            ends = [x[1] + keep_ms for x in reid.values()] if keep_ms is not None else []
            if ends or idle_at is not None:
                state.setTimeoutDuration(max(1, min([*ends, *([] if idle_at is None else [idle_at])]) - now))
        elif state.exists:
            state.remove()
        yield _frame(out)

    return run


def reidentify_streams(deltas: DataFrame, maps: DataFrame, idle_ms: int | None = None, keep_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Deltas (stream_id, channel, call_index, seq, text, finish_reason) restored with the map of their own stream.

    ``maps`` has rows (stream_id, placeholder, value) and may be a stream like
    the deltas; ``initial`` are such rows of streams that are open when the
    query starts.  A delta whose stream has no map passes as it is: a
    placeholder that stays is no leak.  Maps leave the state ``keep_ms`` after
    they were written; without it and ``idle_ms`` the query needs no clock, and
    can end by itself.  Otherwise like ``reidentify_stream``.

    Streams travel in Arrow batches of many, each with its state as one value;
    only initial state needs the processor, which asks the state store for
    every stream by itself.
    """
    packed = lambda df, own: df.select(F.col("stream_id").cast("string").alias("stream_id"), F.to_json(F.array(*((F.col(c) if c in own and c in df.columns else F.lit(None)).cast("string") for c in _UNION[1:]))).alias("packed"))
    every = packed(deltas, _DELTA).unionByName(packed(maps, _UNION[-2:])).groupBy("stream_id")
    clock = idle_ms is not None or keep_ms is not None
    if initial is not None:
        said = every.transformWithStateInPandas(KeyedReidentifier(idle_ms, keep_ms), _PACKED, "Append", "processingTime" if clock else "none", initialState=initial.groupBy("stream_id"))
    else:
        said = every.applyInPandasWithState(_keyed(idle_ms, keep_ms), _PACKED, _KEPT, "append", GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.NoTimeout)
    rows = F.from_json("said", "array<array<string>>", {"mode": "FAILFAST"})
    return said.select(F.explode(rows).alias("_r")).select(*(F.get("_r", F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(x.split(" ") for x in _SAID.split(", "))))


def reassemble(deltas: DataFrame, keys: list[str], seq: str = "seq", text: str = "text") -> DataFrame:
    """Batch form: the whole text of each stream."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda s: s[text]), "")
    return deltas.groupBy(*keys).agg(joined.alias("text"))


def shred(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """Texts torn into single characters; the last one has the finish reason."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return df.select(*keys, F.posexplode(chars).alias("seq", "text"), F.size(chars).alias("_n")).select(*keys, F.col("seq").cast("long").alias("seq"), "text", F.when(F.col("seq") == F.col("_n") - 1, "stop").alias("finish_reason"))


class SessionTypes(StatefulProcessor):
    """Types seen per session with their last time; types older than the time-to-live at a turn's own time don't count."""

    def __init__(self, ttl: float, threshold: int, expires: bool = True):
        self.ttl, self.threshold, self.expires = ttl, threshold, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        # entries leave the state some time after they stopped to count
        self.seen = handle.getMapState("seen", "qi_type string", "at double", int(2 * self.ttl * 1000) if self.expires else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("at", kind="stable")
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        out = []
        for at, kind in zip(part["at"], part["qi_type"], strict=True):
            seen = {k: t for k, t in seen.items() if t >= at - self.ttl} | {kind: at}
            out.append((key[0], at, len(seen), len(seen) >= max(1, self.threshold)))
        self.seen.clear()
        for k, t in seen.items():
            self.seen.updateValue((k,), (t,))
        yield pd.DataFrame(out, columns=["session", "at", "n_types", "generalise"])

    def close(self) -> None:
        pass


def session_types_stream(turns: DataFrame, ttl: float, threshold: int = 3) -> DataFrame:
    """Turns (session, at, qi_type) with the number of live types."""
    return turns.groupBy("session").transformWithStateInPandas(SessionTypes(ttl, threshold), "session string, at double, n_types int, generalise boolean", "Append", "processingTime")

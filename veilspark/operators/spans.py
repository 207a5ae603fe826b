"""Span algebra: validity, overlap resolution, masking, numbering, re-identification, probes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def valid(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)) & (F.coalesce(s["entity_type"], F.lit("")) != ""))


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per island of overlapping spans: keys, start, end, entity_type, score.

    Coverage is the union; touching spans stay apart.  The type is that of the
    best score, then the longest, then the first span, and of equal ones the
    first in the alphabet.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col("start") - F.col("end"), "start", "entity_type")
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("entity_type", best).alias("entity_type"), F.max("score").alias("score")).drop("_island")


def sweep(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Union of overlapping intervals from their sorted ends; of each union's spans the best score, then the longest, then the first, then the first type in the alphabet names it."""
    ends = sorted([(a, 1) for _, a, b, _ in found if a < b] + [(b, -1) for _, a, b, _ in found if a < b])
    unions, depth = [], 0
    for at, step in ends:  # at one place an end comes before a start, so touching spans stay apart
        if depth == 0:
            begin = at
        depth += step
        if depth == 0:
            unions.append((begin, at))
    begins = [begin for begin, _ in unions]
    own: list[list] = [[] for _ in unions]
    for s in found:
        if s[1] < s[2]:
            own[bisect_right(begins, s[1]) - 1].append(s)
    out = []
    for (begin, end), group in zip(unions, own, strict=True):
        kind, _, _, score = min(group, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0]))
        out.append((kind, begin, end, score))
    return out


def resolve_exact(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Spans resolved by ``sweep`` in one Arrow pass."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<entity_type:string,start:int,end:int,score:double>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: [{"entity_type": k, "start": a, "end": b, "score": s} for k, a, b, s in sweep([(x["entity_type"], x["start"], x["end"], x["score"]) for x in r])] if r is not None else [])

    return df.withColumn(spans_col, run(F.col(spans_col)))


def resolve(spans: Column) -> Column:
    """Overlap resolution inside a row, native: spans by start are folded into islands."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["entity_type"].alias("entity_type"))))
    kind = "array<struct<start:int,end:int,score:double,entity_type:string,best_len:int,best_start:int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        size = s["end"] - s["start"]
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["entity_type"].alias("entity_type"), size.alias("best_len"), s["start"].alias("best_start"))
        better = (s["score"] > last["score"]) | ((s["score"] == last["score"]) & (size > last["best_len"]))
        wide = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.greatest(last["score"], s["score"]).alias("score"),
            F.when(better, s["entity_type"]).otherwise(last["entity_type"]).alias("entity_type"), F.when(better, size).otherwise(last["best_len"]).alias("best_len"), F.when(better, s["start"]).otherwise(last["best_start"]).alias("best_start"),
        )
        return F.when((F.size(out) > 0) & (s["start"] < F.try_element_at(out, F.lit(-1))["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wide))).otherwise(F.concat(out, F.array(own)))

    step_safe = lambda out, s: F.when(F.size(out) == 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["entity_type"].alias("entity_type"), (s["end"] - s["start"]).alias("best_len"), s["start"].alias("best_start")))).otherwise(step(out, s))
    merged = F.aggregate(ordered, F.array().cast(kind), step_safe)
    return F.transform(merged, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))


def number(spans: DataFrame, request: list[str], order: list[str]) -> DataFrame:
    """Placeholders: per request and type, values numbered from 0 by first occurrence; adds ``placeholder``.

    ``spans`` has entity_type, value and the columns of ``order``, which fix the
    order of fields inside a request.
    """
    firsts = spans.groupBy(*request, "entity_type", "value").agg(F.min(F.struct(*order)).alias("_first"))
    ranked = firsts.withColumn("_n", F.dense_rank().over(Window.partitionBy(*request, "entity_type").orderBy("_first")) - 1)
    named = ranked.select(*request, "entity_type", "value", F.concat(F.lit("<"), "entity_type", F.lit("_"), F.col("_n").cast("string"), F.lit(">")).alias("placeholder"))
    return spans.join(named, [*request, "entity_type", "value"])


def mask(text: Column, spans: Column) -> Column:
    """Text with disjoint spans (start, end, placeholder) replaced, from right to left."""
    ordered = F.sort_array(spans, asc=False)
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["placeholder"], F.substring(t, s["end"] + 1, F.length(t))))


_NUMBERED = "struct<masked:array<string>,reid_map:array<struct<placeholder:string,value:string>>>"


def masked_tokens(tokens: list[dict]) -> tuple[list[str | None], dict[str, str]]:
    """Masked texts of a request's tokens (text, spans) and its map: one numbering by first occurrence.

    Spans with a ``general`` form get that form and no number; where one of them
    overlaps a span without, it is left to that one.
    """
    known: dict[tuple[str, str], str] = {}
    counts: dict[str, int] = {}
    out: list[str | None] = []
    for token in tokens:
        text = token["text"]
        if text is None:
            out.append(None)
            continue
        fit = [s for s in token["spans"] or () if s["entity_type"] and 0 <= s["start"] < s["end"] <= len(text)]
        direct = sweep([(s["entity_type"], s["start"], s["end"], s["score"]) for s in fit if s.get("general") is None])
        general = {(s["start"], s["end"], s["entity_type"]): s["general"] for s in fit if s.get("general") is not None}
        puts = [(a, b, kind, None) for kind, a, b, _ in direct]
        if general:
            quasi = sweep([(s["entity_type"], s["start"], s["end"], s["score"]) for s in fit if s.get("general") is not None])
            at = 0
            for kind, a, b, _ in quasi:
                while at < len(direct) and direct[at][2] <= a:
                    at += 1
                if at == len(direct) or direct[at][1] >= b:
                    puts.append((a, b, kind, general.get((a, b, kind))))  # a union wider than its best span gets a placeholder
            puts.sort()
        parts, end = [], 0
        for a, b, kind, made in puts:
            if made is None:
                value = (kind, text[a:b])
                if value not in known:
                    known[value] = f"<{kind}_{counts.get(kind, 0)}>"
                    counts[kind] = counts.get(kind, 0) + 1
                made = known[value]
            parts += [text[end:a], made]
            end = b
        out.append("".join([*parts, text[end:]]) if parts else text)
    return out, {placeholder: value for (_, value), placeholder in known.items()}


def _unpacked(rows: pa.Array) -> Iterator[list[dict]]:
    """The tokens of each row, read column by column, as nested values are slow to convert one by one."""
    tokens = rows.values
    texts, spans = tokens.field("text").to_pylist(), tokens.field("spans")
    fields = [f.name for f in spans.type.value_type]
    flat = [dict(zip(fields, x, strict=True)) for x in zip(*(spans.values.field(f).to_pylist() for f in fields), strict=True)]
    ends, given = spans.offsets.to_pylist(), spans.is_valid().to_pylist()
    at = rows.offsets.to_pylist()
    for i, valid in enumerate(rows.is_valid().to_pylist()):
        yield [{"text": texts[k], "spans": flat[ends[k] : ends[k + 1]] if given[k] else None} for k in range(at[i], at[i + 1])] if valid else []


def numbered(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Adds ``out`` (masked, reid_map) of an array of tokens, each a struct of a text and its spans; a null array has none.  Linear in texts and spans."""
    ship(df.sparkSession)

    @F.arrow_udf(_NUMBERED)
    def run(rows: pa.Array) -> pa.Array:
        masked: list[str | None] = []
        names: list[str] = []
        values: list[str] = []
        m_ends, r_ends = [0], [0]
        for row in _unpacked(rows):
            texts, known = masked_tokens(row)
            masked += texts
            names += known.keys()
            values += known.values()
            m_ends.append(len(masked))
            r_ends.append(len(names))
        entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["placeholder", "value"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(m_ends, pa.int32()), pa.array(masked, pa.string())), pa.ListArray.from_arrays(pa.array(r_ends, pa.int32()), entries)], ["masked", "reid_map"])

    # neither the tokens nor the result may be copied into other columns, where Python can't run: what isn't deterministic stays where it is
    held = df.withColumn(tokens, F.when(F.monotonically_increasing_id() >= 0, F.col(tokens)))
    return held.withColumn(out, run.asNondeterministic()(F.col(tokens)))


def mask_rows(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Each row is a request of its own: adds ``masked`` and ``reid_map`` (placeholder, value).

    Overlaps, numbers and the text are made by ``numbered``, in time linear in
    text and spans.  A null text has a null ``masked`` and an empty map.
    """
    spans = F.transform(F.coalesce(F.col(spans_col), F.array().cast("array<struct<entity_type:string,start:int,end:int,score:double>>")), lambda s: F.struct(*(s[c].alias(c) for c in ("entity_type", "start", "end", "score")), F.lit(None).cast("string").alias("general")))
    made = numbered(df.withColumn("_t", F.array(F.struct(F.col(text_col).alias("text"), spans.alias("spans")))), "_t", "_d")
    return made.select(*(c for c in df.columns if c not in ("masked", "reid_map")), F.get("_d.masked", F.lit(0)).alias("masked"), F.col("_d.reid_map").alias("reid_map"))


def reidentify(text: Column, reid_map: Column) -> Column:
    """Placeholders replaced by their values one after the other, longest placeholder first; unknown ones stay."""
    ordered = F.sort_array(F.transform(reid_map, lambda m: F.struct((-F.length(m["placeholder"])).alias("n"), m["placeholder"].alias("p"), m["value"].alias("v"))))
    return F.when(reid_map.isNull(), text).otherwise(F.aggregate(ordered, text, lambda t, m: F.replace(t, m["p"], m["v"])))


def json_escaped(value: Column) -> Column:
    """A value as it stands between the quotes of a JSON string."""
    made = F.to_json(F.struct(value.alias("v")))
    return F.substring(made, F.lit(7), F.length(made) - 8)


def placeholders_kept(masked: Column, answer: Column) -> Column:
    """Whether a rewriting step kept the multiset of placeholders."""
    found = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("<[A-Z_]+_[0-9]+>"), F.lit(0)))
    return found(masked) == found(answer)


def probe(text: Column, placeholders: Column) -> Column:
    """struct<text, fillers>: the placeholders of the map (an array of them) as one blank each, and the blanks' offsets.

    Only placeholders that were given out are blanked; other text of their
    shape stays and is verified like any text.
    """
    longest = F.sort_array(F.transform(placeholders, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    # U+0000 never stands in a text that went through JSON or a table; one that has it is left as it is and so is verified whole
    cut = lambda t: F.split(F.when(~F.contains(t, F.lit("\x00")), F.aggregate(longest, t, lambda u, p: F.replace(u, p["p"], F.lit("\x00")))), "\x00", -1)

    def made(t: Column, parts: Column) -> Column:
        lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p))
        fillers = F.aggregate(lengths, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)) + 1, F.lit(0)) + n)))
        return F.struct(F.coalesce(F.array_join(parts, " "), t).alias("text"), F.when(parts.isNotNull(), fillers).otherwise(F.array().cast("array<int>")).alias("fillers"))

    return bound(text, lambda t: bound(cut(t), lambda parts: made(t, parts)))


def is_artifact(start: Column, end: Column, text: Column, fillers: Column) -> Column:
    """A hit on the probe that is only blanks and touches a filler."""
    a, b = F.greatest(F.lit(0), start), F.least(end, F.length(text))
    inside = F.substring(text, a + 1, b - a)
    return (a < b) & ~inside.rlike("(?U)\\S") & F.exists(fillers, lambda f: (f >= a) & (f < b))


#: The notice that goes with masked texts, unless the caller gives another.
NOTICE = (
    "Zum Datenschutz wurden personenbezogene Angaben in diesem Gespräch durch nummerierte Platzhalter der Form <TYP_0> ersetzt. "
    "Übernimm Platzhalter Zeichen für Zeichen, wenn du dich auf eine solche Angabe beziehst; ändere weder Namen noch Nummer und frage nicht nach dem Wert dahinter."
)


def inject_notice(messages: DataFrame, masked_requests: DataFrame, request: str = "request_id", notice: str = NOTICE) -> DataFrame:
    """Appends the notice to the first system message of masked requests, or adds one before the first message."""
    first = Window.partitionBy(request, "role").orderBy("msg_idx")
    flagged = messages.join(masked_requests.select(request).distinct().withColumn("_m", F.lit(True)), request, "left")
    told = flagged.withColumn("content", F.when(F.col("_m") & (F.col("role") == "system") & (F.row_number().over(first) == 1), F.concat(F.coalesce("content", F.lit("")), F.lit("\n\n" + notice))).otherwise(F.col("content"))).drop("_m")
    without = masked_requests.select(request).distinct().join(messages.where("role = 'system'").select(request), request, "left_anti")
    added = without.join(messages.groupBy(request).agg((F.min("msg_idx") - 1).alias("msg_idx")), request).withColumn("role", F.lit("system")).withColumn("content", F.lit(notice))
    return told.unionByName(added, allowMissingColumns=True)

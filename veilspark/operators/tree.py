"""A request's JSON tree: every maskable text in order, one numbering for all of them, and the tree rebuilt.

A request stays one row.  Its texts become an array in the order content,
name, refusal, reasoning_content, tool calls (name, then arguments), function
call; a text of arguments that is JSON is read as its tokens, whose order in
the text is depth first with keys before values.  Detection runs once for each
token, natively; overlaps, numbers and masked texts of a whole request come
from one small function in Arrow batches (``spans.numbered``), and the tree is
built again with the masked texts in their old places.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from . import classify as C
from . import detect as D
from . import qi as Q
from . import spans as P
from . import validate as V

#: A string or a number of a JSON text; nothing else in one matches.
TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'
#: A text of a request: whether it is arguments or content, and its tokens.
PIECE = "struct<lead:string,raw:string,text:string,quoted:boolean>"
TEXT = f"struct<args:boolean,content:boolean,bad:string,text:string,pieces:array<{PIECE}>,tail:string>"
_STRING = "string"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _given(v: Column) -> Column:
    """Whether a variant is there and no JSON null; its schema would read all that is in it."""
    return v.isNotNull() & ~F.is_variant_null(v)


def _listed(v: Column, path: str) -> Column:
    """A field that is a list, as array<variant>; null for anything else."""
    return _get(v, path, "array<variant>")


def _text(v: Column, path: str) -> Column:
    """A field that is a text; null for anything else."""
    return F.when(F.schema_of_variant(_get(v, path)) == "STRING", _get(v, path, _STRING))


def strictness(text: Column) -> Column:
    """json: strict JSON; text: no JSON at all; else the code of what is wrong.  Repeated keys and NaN can be read by a lax parser only."""
    lax = F.coalesce(F.from_json(text, "map<string,string>").isNotNull(), F.lit(False)) | F.coalesce(F.from_json(text, "array<string>").isNotNull(), F.lit(False))
    return F.when(F.try_parse_json(text).isNotNull(), "json").when(lax & text.rlike(r"\A\s*[{\[]"), "not_strict").otherwise("text")


def _plain(text: Column, content: bool) -> Column:
    piece = F.struct(F.lit("").alias("lead"), text.alias("raw"), text.alias("text"), F.lit(False).alias("quoted"))
    return F.struct(F.lit(False).alias("args"), F.lit(content).alias("content"), F.lit(None).cast(_STRING).alias("bad"), text.alias("text"), F.array(piece).alias("pieces"), F.lit("").alias("tail"))


def _arguments(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def piece(raw: Column, lead: Column) -> Column:
        quoted = raw.startswith('"')
        return F.struct(lead.alias("lead"), raw.alias("raw"), F.when(quoted, _get(F.try_parse_json(raw), "$", _STRING)).otherwise(raw).alias("text"), quoted.alias("quoted"))

    def made(kind: Column, gaps: Column) -> Column:
        whole = F.array(F.struct(F.lit("").alias("lead"), text.alias("raw"), text.alias("text"), F.lit(False).alias("quoted")))
        pieces = F.when(kind == "json", F.transform(tokens, lambda raw, i: piece(raw, F.get(gaps, i)))).otherwise(whole)
        tail = F.when(kind == "json", F.element_at(gaps, -1)).otherwise(F.lit(""))
        return F.struct((kind == "json").alias("args"), F.lit(False).alias("content"), F.when(kind == "not_strict", "arguments").alias("bad"), text.alias("text"), pieces.alias("pieces"), tail.alias("tail"))

    # parsed and split once, not anew for every token
    return P.bound(strictness(text), lambda kind: P.bound(F.split(text, TOKEN, -1), lambda gaps: made(kind, gaps)))


def _function(v: Column) -> Column:
    """Texts of a function payload: its name, then its arguments."""
    return F.array(F.struct(F.lit("name").alias("k"), _text(v, "$.name").alias("t")), F.struct(F.lit("arguments").alias("k"), _text(v, "$.arguments").alias("t")))


def message_texts(v: Column) -> Column:
    """Texts of a message (a variant) in their order, as array<TEXT>."""
    content = F.when(F.schema_of_variant(_get(v, "$.content")) == "STRING", F.array(_get(v, "$.content", _STRING))).otherwise(
        F.transform(_get(v, "$.content", "array<variant>"), lambda p: F.when(_get(p, "$.type", _STRING) == "text", _text(p, "$.text")))
    )
    own = F.transform(F.coalesce(F.filter(content, lambda t: t.isNotNull()), F.array().cast("array<string>")), lambda t: _plain(t, True))
    named = F.transform(F.filter(F.array(*(_text(v, f"$.{n}") for n in ("name", "refusal", "reasoning_content"))), lambda t: t.isNotNull()), lambda t: _plain(t, False))
    calls = F.coalesce(F.flatten(F.transform(_get(v, "$.tool_calls", "array<variant>"), lambda c: _function(_get(c, "$.function")))), F.array().cast("array<struct<k:string,t:string>>"))
    every = F.filter(F.concat(calls, _function(_get(v, "$.function_call"))), lambda x: x["t"].isNotNull())
    whole = F.concat(own, named, F.transform(every, lambda x: F.when(x["k"] == "name", _plain(x["t"], False)).otherwise(_arguments(x["t"])))).cast(f"array<{TEXT}>")
    return F.when(V.is_plain(v), F.array(_plain(_get(v, "$.content", _STRING), True)).cast(f"array<{TEXT}>")).otherwise(whole)


def detected(requests: DataFrame, raw: str = "raw", entities: Iterable[str] = D.ENTITIES, patterns: Iterable[D.Pattern] = (), images: str | None = None, service: bool = False) -> DataFrame:
    """``requests`` with what masking needs: ``_v`` (the parsed request), ``_messages``, ``_texts`` (per message), ``_spans`` (per message, text and token) and ``_reason`` (the first rule a message breaks).

    A request without ``messages`` has none; messages that are no list, or JSON that can't be read, are a reason.
    """
    wanted = set(entities)
    chosen = [p for p in D.PATTERNS if p.entity in wanted] + list(patterns)
    v = F.col("_v")
    listed = _listed(v, "$.messages")
    out = requests.withColumn("_v", F.try_parse_json(raw))
    out = out.withColumn("_messages", F.coalesce(listed, F.array().cast("array<variant>")))
    reasons = F.transform("_messages", lambda m: V.message_reason(F.to_json(m), images, service, m))
    whole = F.when(_get(v, "$", "map<string,variant>").isNull(), "request").when(listed.isNull() & _given(_get(v, "$.messages")), "messages")
    out = out.withColumn("_texts", F.transform("_messages", message_texts))
    broken = F.get(F.filter(F.transform(F.flatten("_texts"), lambda t: t["bad"]), lambda b: b.isNotNull()), F.lit(0))
    out = out.withColumn("_reason", F.coalesce(whole, F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0)), broken))
    empty = F.array().cast(f"array<{D.SPAN}>")
    spans = lambda t: F.when(D.not_blank(t), D.spans_of(t, chosen)).otherwise(empty)
    return out.withColumn("_spans", F.transform("_texts", lambda ts: F.transform(ts, lambda t: F.transform(t["pieces"], lambda p: spans(p["text"])))))


# Where a request's metadata carry the level and the approval.
LEVEL_KEY, APPROVAL_KEY = "sensitivity_level", "sensitivity_approval"


def requested(v: Column) -> tuple[Column, Column]:
    """(approved, level) of a parsed request's metadata, by the type of the JSON: true or one of the texts approves, a number never does; a level is 1 to 3 as a number or text, none is null, and anything else counts as 3."""
    meta = lambda key: _get(v, f"$.metadata.{key}")
    approval, level = meta(APPROVAL_KEY), meta(LEVEL_KEY)
    kind = F.schema_of_variant(approval)
    approved = F.when(kind == "BOOLEAN", F.try_variant_get(approval, "$", "boolean")).when(kind == "STRING", S.approved(F.try_variant_get(approval, "$", _STRING)))
    given = F.schema_of_variant(level)
    plain = F.when(given.isin("BIGINT", "STRING"), F.try_variant_get(level, "$", _STRING)).otherwise(F.lit("?"))
    return F.coalesce(approved, F.lit(False)), F.when(level.isNotNull() & (given != "VOID"), S.requested_level(plain))


def quasi_types(found: DataFrame) -> Column:
    """Quasi-identifier types in the content of a request's messages, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_content_spans(), lambda s: s["entity_type"]), lambda k: k.isin(*Q.QI_TYPES))))


def _content_spans() -> Column:
    own = F.transform(F.arrays_zip("_texts", "_spans"), lambda m: F.flatten(F.transform(F.filter(F.arrays_zip(m["_texts"].alias("t"), m["_spans"].alias("s")), lambda x: x["t"]["content"]), lambda x: F.flatten(x["s"]))))
    return F.flatten(own)


def mask_request_json(found: DataFrame, keep: Iterable[str], approved: Column | None = None, level: Column | None = None, generalise: Column | None = None, entities: Iterable[str] = D.ENTITIES) -> DataFrame:
    """(``keep``, masked, reid_map, n_values, status, reason_code) of requests that ``detected`` has prepared.

    One numbering runs through all texts of a request, so a value has one
    placeholder in content, names and arguments.  With ``generalise`` (a
    boolean) quasi-identifiers in content get no placeholder: where it is true
    they are put into their general form, else they stay.  Without it, or where
    it is null, and beside the content always, they are masked like all others.  Every
    text is classified before masking, arguments as their whole text; tier 3
    blocks, tier 2 without ``approved`` too, and ``level`` can only raise a tier
    (both are read from the request's metadata unless given).  The texts of
    arguments are searched again after masking without the placeholders that
    were given out; what is found blocks.  A blocked request has a null
    ``masked`` and an empty map.  Tokens that hold no hit keep their bytes.
    """
    own_approved, own_level = requested(F.col("_v"))
    approved, level = own_approved if approved is None else approved, own_level if level is None else level
    found, texts = found.withColumn("_flat", F.flatten("_texts")), F.col("_flat")
    # types found in a text link it to a person
    types = F.transform(F.flatten("_spans"), lambda s: F.transform(F.flatten(s), lambda x: x["entity_type"]))
    tiers = F.zip_with(texts, types, lambda t, k: C.tier(t["text"], k))
    tier = F.greatest(F.coalesce(F.array_max(tiers), F.lit(1)), F.coalesce(level, F.lit(1)))
    gated = C.gate(found.withColumn("tier", tier).withColumn("_ok", F.coalesce(approved, F.lit(False))), "_ok")
    made = gated.withColumn("_reason", F.coalesce("_reason", "reason_code")).drop("status", "reason_code")
    made = made.withColumn("_general", generalise if generalise is not None else F.lit(None).cast("boolean"))
    # one entry for each token: its text, its spans, and whether quasi-identifiers are generalised in it
    pieces = F.flatten(F.transform(texts, lambda t: F.transform(t["pieces"], lambda p: F.struct(p["text"].alias("text"), t["content"].alias("content")))))
    spans = F.flatten(F.flatten("_spans"))
    span = lambda p, x: F.struct(*(x[c].alias(c) for c in ("entity_type", "start", "end", "score")), _general(p, x).alias("general"))
    tokens = F.zip_with(pieces, spans, lambda p, s: F.struct(p["text"].alias("text"), F.transform(s, lambda x: span(p, x)).alias("spans")))
    made = P.numbered(made.withColumn("_tokens", F.when(F.col("_reason").isNull(), tokens)), "_tokens", "_done")
    # back into texts: how many tokens came before each text
    sizes = F.transform(texts, lambda t: F.size(t["pieces"]))
    made = made.withColumn("_at", _offsets(sizes))
    # generated columns: a filter on the status doesn't make the texts and their search again
    made = made.withColumn("_new", F.explode(F.array(F.transform("_flat", lambda t, i: _rebuilt(t, F.slice(F.col("_done.masked"), F.get("_at", i) + 1, F.size(t["pieces"])))))))
    made = made.withColumn("_reason", F.explode(F.array(F.coalesce("_reason", _left(F.col("_new"), F.col("_flat"), F.col("_done.reid_map"), set(entities)), _twice(F.col("_new"), F.col("_flat"))))))
    made = made.withColumn("_ends", _offsets(F.transform("_texts", lambda t: F.size(t))))
    messages = F.transform("_messages", lambda m, i: P.bound(F.slice("_new", F.get("_ends", i) + 1, F.size(F.get("_texts", i))), lambda ts: _message(m, ts)))
    tree = F.map_concat(F.map_filter(_get(F.col("_v"), "$", "map<string,variant>"), lambda k, x: k != "messages"), F.map_from_arrays(F.array(F.lit("messages")), F.array(F.try_parse_json(_array(messages)))))
    masked = F.when(_listed(F.col("_v"), "$.messages").isNotNull(), F.to_json(tree)).otherwise(F.to_json("_v"))
    good = F.col("_reason").isNull()
    none = F.array().cast("array<struct<placeholder:string,value:string>>")
    return made.select(*keep, F.when(good, masked).alias("masked"), F.when(good, F.col("_done.reid_map")).otherwise(none).alias("reid_map"), F.when(good, F.size("_done.reid_map")).otherwise(0).alias("n_values"), F.when(good, "ok").otherwise("blocked").alias("status"), F.col("_reason").alias("reason_code"))


def _general(piece: Column, span: Column) -> Column:
    """What stands for a quasi-identifier in content: its general form or itself; null for all that gets a placeholder."""
    value = F.substring(piece["text"], span["start"] + 1, span["end"] - span["start"])
    form = F.when(F.col("_general"), F.coalesce(S.generalize(span["entity_type"], value), value)).otherwise(value)
    return F.when(piece["content"] & F.col("_general").isNotNull() & span["entity_type"].isin(*Q.QI_TYPES), form)


def _offsets(sizes: Column) -> Column:
    """Sums of the sizes before each entry, in one pass: the sizes are made once, not anew for each of them."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, none, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def _rebuilt(text: Column, masked: Column) -> Column:
    """A text from its masked tokens; a token in which nothing changed stays byte for byte."""

    def token(p: Column, m: Column) -> Column:
        return F.concat(p["lead"], F.when(~text["args"], m).when(m == p["text"], p["raw"]).otherwise(F.concat(F.lit('"'), P.json_escaped(m), F.lit('"'))))

    return F.concat(F.array_join(F.zip_with(text["pieces"], masked, token), ""), text["tail"])


def _left(new: Column, old: Column, reid: Column, wanted: set[str]) -> Column:
    """The reason ``left_after_masking`` where the arguments of a call still hold a hit outside of the placeholders."""
    chosen = [p for p in D.PATTERNS if p.entity in wanted]
    names = F.transform(reid, lambda m: m["placeholder"])

    def left(t: Column) -> Column:
        probe = P.probe(t, names)
        return F.exists(F.array(probe), lambda p: F.exists(D.spans_of(p["text"], chosen), lambda s: ~P.is_artifact(s["start"], s["end"], p["text"], p["fillers"])))

    checked = F.exists(F.arrays_zip(new.alias("n"), old.alias("o")), lambda x: x["o"]["args"] & (x["n"] != x["o"]["text"]) & left(x["n"]))
    return F.when(checked, "left_after_masking")


def _twice(new: Column, old: Column) -> Column:
    """The reason ``duplicate_key`` where masking made arguments that are no strict JSON any more."""
    return F.when(F.exists(F.arrays_zip(new.alias("n"), old.alias("o")), lambda x: x["o"]["args"] & F.try_parse_json(x["n"]).isNull()), "duplicate_key")


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _quoted(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('"'), P.json_escaped(text), F.lit('"')))


def _fields(v: Column) -> Column:
    return _get(v, "$", "map<string,variant>")


def _set(v: Column, new: dict[str, Column]) -> Column:
    """An object (a variant) with new values of the fields that it has and that hold something."""

    def value(k: Column, old: Column) -> Column:
        out = old
        for name, x in new.items():
            out = F.when((k == name) & _given(old), x).otherwise(out)
        return out

    return F.to_json(F.transform_values(_fields(v), value))


def _function_with(v: Column, texts: Column) -> Column:
    has = F.when(_text(v, "$.name").isNotNull(), 1).otherwise(0)
    return F.try_parse_json(_set(v, {"name": _quoted(F.get(texts, F.lit(0))), "arguments": _quoted(F.get(texts, has))}))


def _n_function(v: Column) -> Column:
    return F.when(_text(v, "$.name").isNotNull(), 1).otherwise(0) + F.when(_text(v, "$.arguments").isNotNull(), 1).otherwise(0)


def _message(v: Column, texts: Column) -> Column:
    """A message (JSON) with its masked texts in the order in which ``message_texts`` gave them."""
    listed = F.coalesce(_get(v, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    is_text = lambda p: F.when(F.coalesce(_get(p, "$.type", _STRING) == "text", F.lit(False)) & _text(p, "$.text").isNotNull(), 1).otherwise(0)
    parts = F.transform(listed, is_text)
    plain = F.schema_of_variant(_get(v, "$.content")) == "STRING"
    n_content = F.when(plain, 1).otherwise(F.aggregate(parts, F.lit(0), lambda a, b: a + b))
    at_part = _offsets(parts)
    content = F.when(plain, _quoted(F.get(texts, F.lit(0)))).otherwise(F.try_parse_json(_array(F.transform(listed, lambda p, i: F.when(is_text(p) == 1, _set(p, {"text": _quoted(F.get(texts, F.get(at_part, i)))})).otherwise(F.to_json(p))))))
    new, at = {"content": content}, n_content
    for name in ("name", "refusal", "reasoning_content"):
        new[name] = _quoted(F.get(texts, at))
        at = at + F.when(_text(v, f"$.{name}").isNotNull(), 1).otherwise(0)
    calls = F.coalesce(_get(v, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    sizes = F.transform(calls, lambda c: _n_function(_get(c, "$.function")))
    at_call = _offsets(sizes)
    new["tool_calls"] = F.try_parse_json(_array(F.transform(calls, lambda c, i: _set(c, {"function": _function_with(_get(c, "$.function"), F.slice(texts, at + F.get(at_call, i) + 1, F.lit(2)))}))))
    after = at + F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    new["function_call"] = _function_with(_get(v, "$.function_call"), F.slice(texts, after + 1, F.lit(2)))
    return F.when(V.is_plain(v), F.to_json(F.struct(F.get(texts, F.lit(0)).alias("content"), _get(v, "$.role", _STRING).alias("role")))).otherwise(_set(v, new))


def restore_replies(replies: DataFrame, maps: DataFrame, request: str = "request_id", raw: str = "raw", reid: str = "reid") -> DataFrame:
    """Replies (``request``, ``raw``) with the placeholders of their own request's map (``request``, ``reid`` as JSON text) restored.

    Adds ``restored`` and ``status``.  content, refusal, reasoning_content,
    names and arguments of every choice's message (or delta) are restored;
    arguments inside their JSON strings, so that a value with a quote breaks
    nothing.  A reply never fails for its map: without a map (``no_map``), with
    one that isn't an object of texts (``broken_map``), or where the reply isn't
    JSON (``broken_reply``), it stays as it came, placeholders and all.  A reply
    in which nothing is restored keeps its bytes; a second map row of a request
    counts as broken, as it can't be told whose values it holds.
    """
    one = maps.groupBy(request).agg(F.count("*").alias("_n"), F.min(reid).alias("_m"))
    joined = replies.join(one, request, "left")
    parsed = F.try_variant_get(F.try_parse_json("_m"), "$", "map<string,variant>")
    texts = F.transform_values(parsed, lambda _, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", _STRING)))
    sound = (F.col("_n") == 1) & texts.isNotNull() & ~F.exists(F.map_values(texts), lambda x: x.isNull())
    entries = F.transform(F.map_entries(texts), lambda e: F.struct(e["key"].alias("placeholder"), e["value"].alias("value")))
    out = joined.withColumn("_v", F.try_parse_json(raw)).withColumn("_r", F.when(F.coalesce(sound, F.lit(False)), entries))
    out = out.withColumn("_e", F.transform("_r", lambda m: F.struct(m["placeholder"].alias("placeholder"), P.json_escaped(m["value"]).alias("value"))))
    choices = F.transform(_get(F.col("_v"), "$.choices", "array<variant>"), lambda c: _set(c, {k: F.try_parse_json(_restored_message(_get(c, f"$.{k}"), F.col("_r"), F.col("_e"))) for k in ("message", "delta")}))
    made = _set(F.col("_v"), {"choices": F.try_parse_json(_array(choices))})
    listed = _listed(F.col("_v"), "$.choices").isNotNull()
    status = F.when(F.col("_n").isNull(), "no_map").when(F.col("_r").isNull(), "broken_map").when(F.col("_v").isNull(), "broken_reply").otherwise("ok")
    mentioned = P.bound(F.to_json("_v"), lambda v: F.exists("_r", lambda m: F.contains(v, P.json_escaped(m["placeholder"]))))
    restored = F.when((status == "ok") & listed & F.coalesce(mentioned, F.lit(False)), F.coalesce(made, F.col(raw))).otherwise(F.col(raw))
    return out.select(*replies.columns, restored.alias("restored"), status.alias("status"))


def _restored_arguments(text: Column, reid: Column, escaped: Column) -> Column:
    """Arguments: JSON token by token, so that what stays keeps its bytes; what is no JSON takes the values as they stand in JSON."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def changed(raw: Column, value: Column, new: Column) -> Column:
        return F.when(new != value, F.concat(F.lit('"'), P.json_escaped(new), F.lit('"'))).otherwise(raw)

    def token(raw: Column) -> Column:
        read = P.bound(_get(F.try_parse_json(raw), "$", _STRING), lambda value: P.bound(P.reidentify(value, reid), lambda new: changed(raw, value, new)))
        return F.when(raw.startswith('"'), read).otherwise(raw)

    whole = P.bound(F.split(text, TOKEN, -1), lambda gaps: F.concat(F.array_join(F.transform(tokens, lambda raw, i: F.concat(F.get(gaps, i), token(raw))), ""), F.element_at(gaps, -1)))
    return F.when(F.try_parse_json(text).isNotNull(), whole).otherwise(P.reidentify(text, escaped))


def _restored_function(v: Column, reid: Column, escaped: Column) -> Column:
    return F.try_parse_json(_set(v, {"name": _quoted(P.reidentify(_text(v, "$.name"), reid)), "arguments": _quoted(_restored_arguments(_text(v, "$.arguments"), reid, escaped))}))


def _restored_message(v: Column, reid: Column, escaped: Column) -> Column:
    own = {n: F.when(F.schema_of_variant(_get(v, f"$.{n}")) == "STRING", _quoted(P.reidentify(_text(v, f"$.{n}"), reid))).otherwise(_get(v, f"$.{n}")) for n in ("content", "refusal", "reasoning_content")}
    calls = F.transform(_get(v, "$.tool_calls", "array<variant>"), lambda c: _set(c, {"function": _restored_function(_get(c, "$.function"), reid, escaped)}))
    return _set(v, own | {"tool_calls": F.try_parse_json(_array(calls)), "function_call": _restored_function(_get(v, "$.function_call"), reid, escaped)})


def session_levels(found: DataFrame, request: str, session: str, time: str, ttl: int, threshold: int = 3) -> DataFrame:
    """(``request``, seen, generalise): whether a request's quasi-identifiers are generalised, by all types of its session that are alive at its time.

    ``found`` comes from ``detected``; ``time`` is in seconds.  Only the types
    go through the window, not the texts, and each type's last time is a
    running maximum, so a session may be as long as it likes.  Requests of one
    second see one another; a request without a session sees itself only.
    """
    types = found.select(request, session, time, quasi_types(found).alias("_types"))
    made = Q.accumulate(types, session, "_types", time=time, ttl=ttl, threshold=threshold, kinds=Q.QI_TYPES)
    # a request without a quasi-identifier of its own has nothing to generalise
    return made.select(request, "seen", (F.col("generalise") & (F.size("_types") > 0)).alias("generalise"))


def mask_sessions(requests: DataFrame, request: str = "request_id", session: str = "session", time: str = "at", raw: str = "raw", ttl: int = 3600, threshold: int = 3, entities: Iterable[str] = D.ENTITIES) -> DataFrame:
    """Requests masked with the memory of their sessions: (request, masked, reid_map, n_values, status, reason_code, seen, generalised).

    From ``threshold`` distinct quasi-identifier types in a session on, those
    of the present request are generalised in its content; before that they
    stay as they are, and direct identifiers are masked either way.  Detection
    runs once and is written to the shared folder; ``request`` has to be unique.
    """
    entities = tuple(entities)
    found = written(detected(requests.select(request, session, time, raw), raw, entities).withColumn("_texts", F.col("_texts")).drop("_v", "_messages"), "detected")
    levels = session_levels(found, request, session, time, ttl, threshold)
    back = found.join(levels, request).withColumn("_v", F.try_parse_json(raw)).withColumn("_messages", F.coalesce(_get(F.col("_v"), "$.messages", "array<variant>"), F.array().cast("array<variant>")))
    return mask_request_json(back, (request, "seen", F.col("generalise").alias("generalised")), generalise=F.col("generalise"), entities=entities)

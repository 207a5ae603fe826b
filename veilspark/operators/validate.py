"""Fail-closed validation of chat messages held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# The register of fields and of the values allowed in them.
MASKED_FIELDS = ("content", "name", "refusal", "tool_calls", "function_call", "reasoning_content")
CHECKED_FIELDS = ("role", "tool_call_id", "cache_control")
ROLES = ("system", "user", "assistant", "tool", "function", "developer")
CALL_FIELDS = ("id", "type", "index", "function")
FUNCTION_FIELDS = ("name", "arguments")
CACHE_TYPES, CACHE_TTLS = ("ephemeral",), ("5m", "1h")
PART_TYPES = ("text", "image_url")


def _lit(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def unknown_fields(raw: Column, allowed: tuple[str, ...] = MASKED_FIELDS + CHECKED_FIELDS) -> Column:
    return F.array_except(F.json_object_keys(raw), _lit(allowed))


CACHE_FIELDS = ("type", "ttl")


def _field(v: Column, path: str) -> Column:
    """A field of a variant as a variant; null where absent."""
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, *kinds: str, absent: bool = True) -> Column:
    """Whether a variant has one of the kinds; JSON null and absence count as ``absent``."""
    kind = F.schema_of_variant(v)
    ok = F.lit(False)
    for k in kinds:
        ok = ok | (kind.startswith(k + "<") if k in ("OBJECT", "ARRAY") else kind == k)
    return F.coalesce(ok | (kind == "VOID") if absent else ok, F.lit(absent))


def _only(v: Column, allowed: tuple[str, ...]) -> Column:
    """Whether an object has no key beyond ``allowed``."""
    return F.coalesce(F.size(F.array_except(F.json_object_keys(F.to_json(v)), _lit(allowed))) == 0, F.lit(False))


#: How a message of a text and a role alone prints as a type: most are, and need none of the other rules.
_PLAIN = "OBJECT<content: STRING, role: STRING>"


def is_plain(v: Column) -> Column:
    """Whether a message (a variant) has a text as its content, a text as its role, and no other field."""
    return F.coalesce(F.schema_of_variant(v) == _PLAIN, F.lit(False))


def _text_in(v: Column, path: str, allowed: tuple[str, ...], absent: bool = True) -> Column:
    """Whether a field is one of the texts; a number or flag that prints alike is none."""
    own = _field(v, path)
    given = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
    return F.when(given == "VOID", F.lit(absent)).otherwise((given == "STRING") & F.coalesce(F.try_variant_get(v, path, "string").isin(*allowed), F.lit(False)))


def _id_ok(v: Column, path: str) -> Column:
    own = F.coalesce(F.schema_of_variant(_field(v, path)), F.lit("VOID"))
    return F.when(own == "VOID", F.lit(True)).otherwise((own == "STRING") & F.coalesce(S.opaque_id_ok(F.try_variant_get(v, path, "string")), F.lit(False)))


def _function_ok(v: Column, absent: bool = True) -> Column:
    """A function payload: an object of a name and arguments, both texts."""
    inner = _is(v, "OBJECT", absent=False) & _only(v, FUNCTION_FIELDS) & _is(_field(v, "$.name"), "STRING") & _is(_field(v, "$.arguments"), "STRING")
    return F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "VOID", F.lit(absent)).otherwise(inner)


def _cache_ok(v: Column) -> Column:
    """A caching marker: null, or an object of a known type and time-to-live."""
    inner = _is(v, "OBJECT", absent=False) & _only(v, CACHE_FIELDS) & _text_in(v, "$.type", CACHE_TYPES, absent=False) & _text_in(v, "$.ttl", CACHE_TTLS)
    return F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")) == "VOID", F.lit(True)).otherwise(inner)


def _call_ok(c: Column) -> Column:
    return (
        _is(c, "OBJECT", absent=False) & _only(c, CALL_FIELDS) & _id_ok(c, "$.id") & _text_in(c, "$.type", ("function",))
        & _is(_field(c, "$.index"), "BIGINT", "BOOLEAN") & _function_ok(_field(c, "$.function"))
    )


def _part_ok(p: Column, policy: str | None, service: bool) -> Column:
    """A content part: a text with its text, or an image that the policy lets through; a caching marker in it is checked like a message's."""
    linked = _field(p, "$.image_url")
    url = F.when(F.schema_of_variant(linked) == "STRING", F.try_variant_get(p, "$.image_url", "string")).when(F.schema_of_variant(_field(p, "$.image_url.url")) == "STRING", F.try_variant_get(p, "$.image_url.url", "string"))
    text = _text_in(p, "$.type", ("text",), absent=False) & _is(_field(p, "$.text"), "STRING", absent=False)
    image = _text_in(p, "$.type", ("image_url",), absent=False) & (image_policy(url, policy, service) != "block")
    return _is(p, "OBJECT", absent=False) & _cache_ok(_field(p, "$.cache_control")) & (text | image)


def message_reason(raw: Column, images: str | None = None, service: bool = False, parsed: Column | None = None) -> Column:
    """Reason code of the first rule that a message breaks, or null.  Codes never carry the message's values.

    Types are those of the parsed JSON, so a number, flag or object never
    passes for a text.  JSON with repeated keys is no object.  ``images`` and
    ``service`` are those of ``image_policy``: by default images block.
    ``parsed`` is the message as a variant where there is a column of it, so
    that it isn't parsed for every rule.
    """
    v = F.try_parse_json(raw) if parsed is None else parsed
    array = lambda path: F.try_variant_get(v, path, "array<variant>")
    calls, content = _field(v, "$.tool_calls"), _field(v, "$.content")
    listed = _is(content, "ARRAY", absent=False)
    return (
        F.when(is_plain(v) & F.coalesce(F.try_variant_get(v, "$.role", "string").isin(*ROLES), F.lit(False)), F.lit(None).cast("string"))
        .when(v.isNull() | ~_is(v, "OBJECT", absent=False), "not_an_object")
        .when(F.size(unknown_fields(raw)) > 0, "unknown_field")
        .when(~_text_in(v, "$.role", ROLES), "role")
        .when(~(_is(_field(v, "$.name"), "STRING") & _is(_field(v, "$.refusal"), "STRING") & _is(_field(v, "$.reasoning_content"), "STRING")), "text_field")
        .when(~_cache_ok(_field(v, "$.cache_control")), "cache_control")
        .when(~_id_ok(v, "$.tool_call_id"), "opaque_id")
        .when(~_is(calls, "ARRAY") | ~F.coalesce(F.forall(array("$.tool_calls"), _call_ok), F.lit(True)), "tool_calls")
        .when(~_function_ok(_field(v, "$.function_call")), "function_call")
        .when(~_is(content, "STRING", "ARRAY"), "content")
        .when(listed & ~F.coalesce(F.forall(array("$.content"), lambda p: _part_ok(p, images, service)), F.lit(False)), "content_part")
    )


def validate(messages: DataFrame, raw_col: str = "raw", request: str = "request_id") -> DataFrame:
    """Adds ``reason_code`` per message and ``status`` per request: one bad message blocks its whole request."""
    told = messages.withColumn("_v", F.try_parse_json(raw_col)).withColumn("reason_code", message_reason(F.col(raw_col), parsed=F.col("_v"))).drop("_v")
    blocked = F.bool_or(F.col("reason_code").isNotNull()).over(Window.partitionBy(request))
    return told.withColumn("status", F.when(blocked, "blocked").otherwise("ok"))


def require_ok(df: DataFrame) -> DataFrame:
    """Strict mode: the query fails on the first blocked row, with its code only."""
    return df.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(F.concat(F.lit("blocked: "), F.coalesce("reason_code", F.lit("request"))))))


def image_policy(url: Column, policy: str | None, service: bool = False) -> Column:
    """Status of an image part: pass, redact or block.  Default: redact with a service, else block; external urls are blocked."""
    chosen = policy or ("redact" if service else "block")
    if chosen not in ("redact", "block", "pass"):
        raise ValueError(f"unknown image policy {chosen!r}")
    ok = S.data_url_outcome(url) == "ok"
    return F.when(F.lit(chosen == "pass"), "pass").when(F.lit(chosen == "redact") & ok, "redact").otherwise("block")

"""Replies of models and of external detectors, from raw JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detect import SPAN

# Text fields of a message or delta, and the names that detectors give their fields.
TEXT_CHANNELS = ("content", "reasoning_content", "refusal")
TYPE_NAMES, START_NAMES, END_NAMES, SCORE_NAMES = ("entity_type", "type", "entityType"), ("start", "start_index", "startIndex"), ("end", "end_index", "endIndex"), ("score", "confidence")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def deltas(raw: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """Texts of whole replies or of chunks of a stream: keys, choice, channel, call_index, text, finish_reason.

    A choice's ``message`` or else ``delta`` gives a row per text field and,
    of each tool call, one for its name and one for its arguments; calls are
    told apart by their ``index``, or their place without one.  A choice
    without any text gives one row without a channel, so that its end isn't
    lost.  Fields that hold no text are passed over; what is no JSON object or
    has no choices gives no row.
    """
    part = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    choices = raw.select(*keys, F.posexplode(part(F.try_parse_json(raw_col), "$.choices", "array<variant>")).alias("_at", "_c"))
    own = choices.withColumn("_m", F.when(_kind(part(F.col("_c"), "$.message")) != "VOID", part(F.col("_c"), "$.message")).otherwise(part(F.col("_c"), "$.delta")))
    row = lambda channel, call, v, path: F.struct(F.lit(channel).alias("channel"), call.cast("int").alias("call_index"), F.when(_kind(part(v, path)) == "STRING", part(v, path, "string")).alias("text"))
    texts = [row(c, F.lit(None), F.col("_m"), f"$.{c}") for c in TEXT_CHANNELS]

    def call(c: Column, k: Column) -> Column:
        number = F.coalesce(part(c, "$.index", "int"), k)
        return F.array(row("name", number, c, "$.function.name"), row("arguments", number, c, "$.function.arguments"))

    calls = F.coalesce(F.flatten(F.transform(part(F.col("_m"), "$.tool_calls", "array<variant>"), call)), F.array().cast("array<struct<channel:string,call_index:int,text:string>>"))
    found = F.filter(F.concat(F.array(*texts), calls), lambda x: x["text"].isNotNull())
    out = own.select(*keys, F.coalesce(part(F.col("_c"), "$.index", "int"), F.col("_at")).alias("choice"), part(F.col("_c"), "$.finish_reason", "string").alias("finish_reason"), F.explode_outer(found).alias("_t"))
    return out.select(*keys, "choice", "_t.channel", "_t.call_index", "_t.text", "finish_reason")


def reported_spans(df: DataFrame, raw_col: str = "raw", out: str = "spans") -> DataFrame:
    """``df`` with the spans that an external detector reported as JSON, and ``report_error``: null, or the code of what is wrong with the report.

    A report is a list of objects.  Of the names that a field is known by, the
    first one that an object has counts.  Types are texts that are not empty,
    offsets whole numbers, an end isn't before its start; a score that is no
    number is null.  One bad object makes the whole report void (null spans),
    as a part of it would pass for all.  A null report is none: not a list.
    """
    v = F.try_parse_json(raw_col)
    items = F.try_variant_get(v, "$", "array<variant>")

    def first(x: Column, names: tuple[str, ...]) -> Column:
        # an absent field is a null, JSON's null is a value
        return F.coalesce(*(F.try_variant_get(x, f"$.{n}", "variant") for n in names))

    whole = lambda x: F.coalesce(F.schema_of_variant(x) == "BIGINT", F.lit(False))
    number = lambda x: F.schema_of_variant(x).rlike("\\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\\z")
    as_kind = lambda x, kind: F.try_variant_get(x, "$", kind)

    def told(x: Column) -> Column:
        kind, a, b, s = (first(x, n) for n in (TYPE_NAMES, START_NAMES, END_NAMES, SCORE_NAMES))
        error = (
            F.when(~F.coalesce(F.schema_of_variant(x).startswith("OBJECT<"), F.lit(False)), "not_an_object")
            .when(~F.coalesce((F.schema_of_variant(kind) == "STRING") & (as_kind(kind, "string") != ""), F.lit(False)), "no_type")
            .when(~(whole(a) & whole(b)), "no_offsets")
            .when(as_kind(b, "long") < as_kind(a, "long"), "end_before_start")
        )
        return F.struct(error.alias("error"), F.struct(as_kind(kind, "string").alias("entity_type"), as_kind(a, "int").alias("start"), as_kind(b, "int").alias("end"), F.when(number(s), as_kind(s, "double")).alias("score")).alias("span"))

    listed = F.coalesce(F.schema_of_variant(v).startswith("ARRAY<"), F.lit(False))
    made = df.withColumn("_i", F.when(listed, F.transform(items, told)))
    bad = F.get(F.filter("_i", lambda x: x["error"].isNotNull()), F.lit(0))["error"]
    made = made.withColumn("report_error", F.when(F.col("_i").isNull(), "not_a_list").otherwise(bad))
    return made.withColumn(out, F.when(F.col("report_error").isNull(), F.transform("_i", lambda x: x["span"])).cast(f"array<{SPAN}>")).drop("_i")


def require_reports(df: DataFrame) -> DataFrame:
    """The query fails on the first void report, with its code only."""
    return df.withColumn("report_error", F.when(F.col("report_error").isNull(), F.col("report_error")).otherwise(F.raise_error(F.concat(F.lit("report: "), F.col("report_error")))))

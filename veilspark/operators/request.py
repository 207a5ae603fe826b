"""A request's way through all steps: classify, gate, detect, generalise, number, mask, verify, tell.

Fields of a request come as rows (request, message and field number, text).
Everything that belongs to a request as a whole (numbering, quasi-identifiers,
status) is a join or aggregation on the request, so no request has to fit into
one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import classify as C
from . import detect as D
from . import qi as Q
from . import spans as P

ORDER = ("msg_idx", "field_idx")


def mask_fields(fields: DataFrame, entities: Iterable[str] = D.ENTITIES, request: str = "request_id", text: str = "text", approved: str | None = None, threshold: int | None = 3, content: str | None = None) -> DataFrame:
    """(request, msg_idx, field_idx, masked, n_spans, status, reason_code) of every field.

    1. Every text is classified as it came; one field that the tiers block
       blocks its whole request, whose texts are then null.
    2. Spans are detected and their overlaps resolved.  Quasi-identifiers are
       pooled over the request: from ``threshold`` distinct types on they are
       generalised; below it, or at None, they are masked like all others.
       ``content`` names a boolean column, false for fields beside the content
       (names, arguments): theirs don't count and are always masked.
    3. Values are numbered over the whole request in the order of its fields.
    4. The masked text, without the placeholders that were given out, is
       searched again: what is found blocks the request.

    Null texts stay null and harm nothing; fields are told apart by
    (request, msg_idx, field_idx), which has to be unique.
    """
    entities = tuple(entities)
    key = [request, *ORDER]
    # a request with a null key is told from no other and stands for none
    read = fields.where(F.col(request).isNotNull()).select(*key, F.col(text).alias("_t"), *([approved] if approved else []), (F.coalesce(F.col(content), F.lit(True)) if content else F.lit(True)).alias("_c"))
    told = C.gate(read.withColumn("tier", C.tier(F.coalesce("_t", F.lit("")))), approved)
    # made once and written: numbering, pooling and masking read the spans again
    found = written(D.detect(told.select(*key, "_t", "_c", "reason_code"), "_t", entities).withColumn("_s", P.resolve(P.valid(F.col("spans"), F.col("_t")))).drop("spans"), "fields")
    spans = found.select(*key, F.posexplode("_s").alias("_k", "_s"), "_t", "_c")
    spans = spans.select(*key, "_k", "_c", F.col("_s.entity_type").alias("entity_type"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.substring("_t", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("value"))
    named = P.number(spans, [request], [*ORDER, "start"])
    if threshold is not None:
        # a flag for each type instead of a set of them: of fixed size, so hashed rows stay in place
        kinds = (F.coalesce(F.max(F.when(F.col("_c") & (F.col("entity_type") == k), 1)), F.lit(0)) for k in Q.QI_TYPES)
        pooled = spans.groupBy(request).agg((sum(kinds, F.lit(0)) >= max(1, threshold)).alias("_general"))
        general = Q.S.generalize(F.col("entity_type"), F.col("value"))
        made = F.col("_general") & F.col("_c") & F.col("entity_type").isin(*Q.QI_TYPES)
        named = named.join(pooled, request).withColumn("placeholder", F.when(made, F.coalesce(general, F.col("value"))).otherwise(F.col("placeholder"))).withColumn("_given", ~made)
    else:
        named = named.withColumn("_given", F.lit(True))
    made = named.groupBy(*key).agg(F.collect_list(F.struct("start", "end", "placeholder", "_given")).alias("_p"))
    out = found.join(made, key, "left").withColumn("masked", F.when(F.col("_p").isNull(), F.col("_t")).otherwise(P.mask(F.col("_t"), F.col("_p"))))
    told = lambda given: F.array_distinct(F.transform(F.filter("_p", lambda s: s["_given"] == F.lit(given)), lambda s: s["placeholder"]))
    out = out.withColumn("_probe", P.probe(F.col("masked"), F.coalesce(F.array_union(told(True), told(False)), F.array().cast("array<string>"))))
    # a text without a hit is as it was, so nothing can be found in it now
    again = D.detect(out.select(*key, "reason_code", "masked", F.size("_s").alias("n_spans"), F.when(F.size("_s") > 0, F.col("_probe.text")).alias("_q"), F.col("_probe.fillers").alias("_f")), "_q", entities, out="_left")
    left = F.filter("_left", lambda s: ~P.is_artifact(s["start"], s["end"], F.col("_q"), F.col("_f")))
    # written, as a request's reason needs all of its fields before any of them is given out: else all would be searched twice
    checked = written(again.select(*key, "masked", "n_spans", F.coalesce("reason_code", F.when(F.size(left) > 0, "left_after_masking")).alias("reason_code")), "checked")
    bad = checked.where("reason_code IS NOT NULL").groupBy(request).agg(F.min("reason_code").alias("_why"))
    return checked.drop("reason_code").join(bad, request, "left").select(*key, F.when(F.col("_why").isNull(), F.col("masked")).alias("masked"), "n_spans", F.when(F.col("_why").isNull(), "ok").otherwise("blocked").alias("status"), F.col("_why").alias("reason_code"))

"""Queries of layers that may fail: images sent to a service, detectors and generalisations that break on single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import isolate as L
from .catalog import query, table


def blackening() -> I.Client:
    """A stand-in for the service: every image as long a run of ``#``; it fails on calls with an image of 7k bytes and answers nothing to one of 5k."""

    def send(images):
        if any(len(b) % 7 == 0 for _, b in images):
            raise RuntimeError("the service fails")
        return [b"" if len(b) % 5 == 0 else b"#" * len(b) for _, b in images]

    return send





@query(
    """SELECT p_partkey AS request_id, CASE WHEN code IS NULL THEN CASE WHEN p_partkey % 3 = 0 THEN '{"messages": [ {"role": "user", "content": "' || p_brand || '"} ]}' ELSE '{"messages":[{"content":[{"text":"' || p_brand || '","type":"text"},{"image_url":' || CASE WHEN p_partkey % 3 = 1 THEN '"' || u || '"' ELSE '{"detail":"low","url":"' || u || '"}' END || ',"type":"image_url"}],"role":"user"}]}' END END AS raw,
        CASE WHEN code IS NULL THEN 'ok' ELSE 'blocked' END AS status, code AS reason_code
    FROM (SELECT *, 'data:image/png;base64,' || base64(encode(repeat('#', length(p_name)))) AS u,
        CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'external' WHEN strlen(p_name) % 7 = 0 THEN 'service' WHEN strlen(p_name) % 5 = 0 THEN 'no_answer' END AS code FROM part)"""
)
def image_redaction(spark, sf_dir):
    """Images of the parts' names, embedded as a text or an object; a third of the requests has none, some are external."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    url = F.when(k % 11 == 0, F.lit("https://host/x.png")).otherwise(F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.encode("p_name", "UTF-8")), "\\s", "")))
    quoted = F.when(k % 3 == 1, F.concat(F.lit('"'), url, F.lit('"'))).otherwise(F.concat(F.lit('{"url": "'), url, F.lit('", "detail": "low"}')))
    plain = F.concat(F.lit('{"messages": [ {"role": "user", "content": "'), "p_brand", F.lit('"} ]}'))
    shown = F.concat(F.lit('{"messages": [{"role": "user", "content": [{"type": "text", "text": "'), "p_brand", F.lit('"}, {"type": "image_url", "image_url": '), quoted, F.lit("}]}]}"))
    return I.redact_requests(p.select(k.alias("request_id"), F.when(k % 3 == 0, plain).otherwise(shown).alias("raw")), blackening)


def _detector(rows):
    """A detector that breaks on some texts."""
    if any(len(t) % 11 == 0 for (t,) in rows):
        raise ValueError("a text that the detector can't read")
    return [len(t) for (t,) in rows]


def _general(rows):
    """A generalisation that breaks on some texts."""
    if any(len(t) % 13 == 0 for (t,) in rows):
        raise KeyError("no such category")
    return ["[allgemein]" if len(t) % 2 else None for (t,) in rows]


@query(
    """SELECT conv_id, turn, CAST(CASE WHEN n % 11 = 0 THEN -1 ELSE n END AS BIGINT) AS found, CASE WHEN n % 11 = 0 THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN n % 11 = 0 THEN 'detector' END AS reason_code,
        CASE WHEN n % 13 <> 0 AND n % 2 = 1 THEN '[allgemein]' ELSE '<MASKE_0>' END AS masked, CASE WHEN n % 13 = 0 THEN 'KeyError' END AS qi_error
    FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations)"""
)
def failure_isolation(spark, sf_dir):
    """A detector and a generalisation that break on some turns: the one blocks its row, the other leaves the mask; all other rows go on."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.lit("<MASKE_0>").alias("masked"))
    seen = L.block_failed(L.isolated(turns, ["text"], _detector, "bigint", "_d"), "_d", "detector")
    done = L.keep_failed(L.isolated(seen, ["text"], _general, "string", "_g"), "_g", "masked")
    return done.select("conv_id", "turn", F.coalesce("_d.value", F.lit(-1)).alias("found"), "status", "reason_code", "masked", F.col("_g.error").alias("qi_error"))

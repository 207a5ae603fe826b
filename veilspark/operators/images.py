"""Images in requests: sent to a redaction service in bounded batches, and put back as data URLs.

The service is a client that the caller gives; each task makes one of its own.
Whatever goes wrong blocks the image: no image passes unchecked.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship
from .tree import _array, _get, _set, _text

#: Images and bytes of one call.
BATCH_IMAGES, BATCH_BYTES = 16, 8 << 20
#: A client takes (type, bytes) of images and gives the bytes of each, or None.
Client = Callable[[list[tuple[str, bytes]]], list[bytes | None]]


def _split(url: str | None) -> tuple[str, bytes] | None:
    head, _, body = (url or "").partition(",")
    if not head.startswith("data:") or not head.endswith(";base64") or not body:
        return None
    try:
        return head[5:-7] or "image/png", base64.b64decode(body, validate=True)
    except binascii.Error:
        return None


def redact_images(images: DataFrame, client: Callable[[], Client], url: str = "url", attempts: int = 3) -> DataFrame:
    """Adds ``redacted`` (a data URL), ``status`` (redacted or blocked) and ``reason_code``.

    A batch of at most ``BATCH_IMAGES`` images or ``BATCH_BYTES`` bytes is one
    call; a call that fails is made again, and after ``attempts`` of them each
    image goes alone, so that one bad image blocks itself only.  No URL
    (``no_url``), one that isn't embedded (``external``), without content
    (``empty``), with broken content (``invalid``), a service that fails
    (``service``) or answers nothing (``no_answer``) block.
    """
    ship(images.sparkSession)
    told = images.withColumn("_code", F.when(F.coalesce(F.col(url), F.lit("")) == "", "no_url").otherwise(F.nullif(S.data_url_outcome(F.col(url)), F.lit("ok"))))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in images.schema.fields if f.name not in ('redacted', 'status', 'reason_code'))}, redacted string, status string, reason_code string"

    def call(send: Client, batch: list[tuple[str, bytes]]) -> list[bytes | None] | None:
        for _ in range(attempts):
            try:
                answers = send(batch)
            except Exception:  # any failure of a service is the same here: no answer that can be trusted
                continue
            if len(answers) == len(batch):
                return list(answers)
        return None

    def redact(urls: list[str | None], codes: list[str | None], send: Client) -> list[tuple[str | None, str | None]]:
        out: list[tuple[str | None, str | None]] = [(None, c) for c in codes]
        batch: list[tuple[int, str, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal batch, size
            answers = call(send, [(m, b) for _, m, b in batch]) if batch else []
            if answers is None:
                answers = [call(send, [(m, b)]) for _, m, b in batch]
                answers = [a[0] if a else False for a in answers]
            for (i, mime, _), answer in zip(batch, answers, strict=True):
                out[i] = (None, "service") if answer is False else (None, "no_answer") if not answer else (f"data:{mime};base64,{base64.b64encode(answer).decode()}", None)
            batch, size = [], 0

        for i, (value, code) in enumerate(zip(urls, codes, strict=True)):
            if code is not None:
                continue
            parts = _split(value)
            if parts is None:
                out[i] = (None, "invalid")
                continue
            if batch and (len(batch) == BATCH_IMAGES or size + len(parts[1]) > BATCH_BYTES):
                flush()
            batch.append((i, *parts))
            size += len(parts[1])
        flush()
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = client()
        for batch in batches:
            made = redact(batch.column(url).to_pylist(), batch.column("_code").to_pylist(), send)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("_code", "redacted", "status", "reason_code")}
            columns |= {"redacted": pa.array([u for u, _ in made], pa.string()), "status": pa.array(["redacted" if c is None else "blocked" for _, c in made], pa.string()), "reason_code": pa.array([c for _, c in made], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return told.mapInArrow(task, schema)


def _url(part: Column) -> Column:
    return F.coalesce(_text(part, "$.image_url"), _text(part, "$.image_url.url"), F.lit(""))


def redact_requests(requests: DataFrame, client: Callable[[], Client], request: str = "request_id", raw: str = "raw", attempts: int = 3) -> DataFrame:
    """(``request``, raw, status, reason_code): requests (JSON) with their images redacted; one image that blocks blocks its request, whose ``raw`` is then null.

    Every distinct image of a request is sent once; requests without images keep their bytes.  ``request`` has to be unique.
    """
    v = F.try_parse_json(raw)
    parts = F.flatten(F.transform(_get(v, "$.messages", "array<variant>"), lambda m: F.coalesce(_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    urls = F.array_distinct(F.transform(F.filter(parts, lambda p: F.coalesce(_get(p, "$.type", "string") == "image_url", F.lit(False))), _url))
    done = redact_images(requests.select(request, F.explode(urls).alias("url")), client, attempts=attempts)
    by = done.groupBy(request).agg(F.map_from_entries(F.collect_list(F.struct("url", F.coalesce("redacted", F.lit(""))))).alias("_new"), F.min("reason_code").alias("_bad"))
    joined = requests.select(request, raw).join(by, request, "left").withColumn("_v", v)

    def image(p: Column) -> Column:
        new = F.try_parse_json(F.concat(F.lit('"'), F.element_at("_new", _url(p)), F.lit('"')))
        inner = F.when(_text(p, "$.image_url").isNotNull(), new).otherwise(F.try_parse_json(_set(_get(p, "$.image_url"), {"url": new})))
        return F.when(F.coalesce(_get(p, "$.type", "string") == "image_url", F.lit(False)), _set(p, {"image_url": inner})).otherwise(F.to_json(p))

    def message(m: Column) -> Column:
        listed = F.coalesce(F.schema_of_variant(_get(m, "$.content")).startswith("ARRAY<"), F.lit(False))
        return F.when(listed, _set(m, {"content": F.try_parse_json(_array(F.transform(_get(m, "$.content", "array<variant>"), image)))})).otherwise(F.to_json(m))

    made = _set(F.col("_v"), {"messages": F.try_parse_json(_array(F.transform(_get(F.col("_v"), "$.messages", "array<variant>"), message)))})
    new = F.when(F.col("_new").isNull(), F.col(raw)).when(F.col("_bad").isNull(), made)
    return joined.select(request, new.alias(raw), F.when(F.col("_bad").isNull(), "ok").otherwise("blocked").alias("status"), F.col("_bad").alias("reason_code"))

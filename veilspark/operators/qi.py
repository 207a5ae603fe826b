"""Quasi-identifiers per session: accumulation with a time-to-live, decision, generalisation, encrypted audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed value: the types that count.
QI_TYPES = ("DE_PLZ", "DE_GEBURTSJAHR", "DE_TVOED_STUFE", "DE_GENDER", "DE_BERUF")


def split_spans(spans: Column, enabled: bool = True) -> tuple[Column, Column]:
    """(direct identifiers, quasi-identifiers); with the layer off all are direct."""
    if not enabled:
        return spans, F.filter(spans, lambda s: F.lit(False))
    is_qi = lambda s: s["entity_type"].isin(*QI_TYPES)
    return F.filter(spans, lambda s: ~is_qi(s)), F.filter(spans, is_qi)


def accumulate(turns: DataFrame, session: str, types: str, time: str | None = None, ttl: int | None = None, order: str | None = None, threshold: int = 3, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``seen`` (distinct types alive up to and with this turn), ``n_types`` and ``generalise``.

    With ``time`` (epoch seconds) and ``ttl`` a type recorded at or after now - ttl
    is alive (closed bound); otherwise turns follow ``order``.  A null session
    sees its own turn only.  ``kinds`` names all types there are: then each
    type's last time is a running maximum, of constant size however long the
    session; without it a turn's window of the time-to-live is read.
    """
    by = F.coalesce(F.col(session).cast("string"), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    keyed = turns.withColumn("_s", by)
    if time is not None and ttl is not None and kinds is not None:
        so_far = Window.partitionBy("_s").orderBy(F.col(time)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = {k: F.max(F.when(F.array_contains(types, k), F.col(time))).over(so_far) for k in sorted(kinds)}
        seen = F.array_compact(F.array(*(F.when(at >= F.col(time) - ttl, F.lit(k)) for k, at in last.items())))
        return keyed.withColumn("seen", seen).withColumn("n_types", F.size("seen")).withColumn("generalise", F.col("n_types") >= max(1, threshold)).drop("_s")
    if time is not None and ttl is not None:
        frame = Window.partitionBy("_s").orderBy(F.col(time)).rangeBetween(-ttl, Window.currentRow)
    else:
        frame = Window.partitionBy("_s").orderBy(order or time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_set(types).over(frame))))
    return keyed.withColumn("seen", seen).withColumn("n_types", F.size("seen")).withColumn("generalise", F.col("n_types") >= max(1, threshold)).drop("_s")


def apply(text: Column, instances: Column) -> Column:
    """Raw values replaced by their generalised forms, longest first; professions stay."""
    made = F.transform(instances, lambda q: F.struct((-F.length(q["value"])).alias("n"), q["value"].alias("v"), S.generalize(q["entity_type"], q["value"]).alias("g")))
    ordered = F.array_sort(F.array_distinct(F.filter(made, lambda q: q["g"].isNotNull() & (q["v"] != ""))))
    return F.aggregate(ordered, text, lambda t, q: F.replace(t, q["v"], q["g"]))


def encrypt_category(category: Column, key: bytes) -> Column:
    """AES-GCM under a key of 16, 24 or 32 bytes; without one nothing is kept."""
    if not key or len(key) not in (16, 24, 32):
        raise ValueError("a key of 16, 24 or 32 bytes is needed; categories are never stored in clear text")
    return F.aes_encrypt(category.cast("binary"), F.lit(key), F.lit("GCM"))


def audit(sessions: DataFrame, key: bytes, column: str = "category_enc", unreadable: str = "[nicht lesbar]") -> DataFrame:
    """Decrypted categories; one that can't be read becomes a marker."""
    return sessions.withColumn("category", F.coalesce(F.try_aes_decrypt(F.col(column), F.lit(key), F.lit("GCM")).cast("string"), F.lit(unreadable))).drop(column)


def expire(sessions: DataFrame, now: Column, ttl: int) -> DataFrame:
    return sessions.where(F.col("created_at") >= now - F.lit(ttl))


def upsert(sessions: DataFrame, turn: DataFrame) -> DataFrame:
    """(session_hash, qi_type) rows with the later record of each."""
    both = sessions.unionByName(turn)
    return both.groupBy("session_hash", "qi_type").agg(F.max_by("category_enc", "created_at").alias("category_enc"), F.max("created_at").alias("created_at"))


def session_hash(key: Column) -> Column:
    return F.sha2(key, 256)

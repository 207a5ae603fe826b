"""Queries of whole requests: one numbering through a request's tree, replies and streams restored with their own request's map, sessions with a memory, and the session store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import qi as Q
from ..operators import tree as T
from ..session import shared_dir, ship, spread, written
from ..sources.sessions import SessionStore
from ..streaming import state as ST
from .catalog import _REGIONS, query, table

# Every conversation is a request: the user gives an address in each turn, the system has one as its name, and the
# assistant calls a function with the user's address and one of its own turn.
_CONTENT = "CASE role WHEN 'user' THEN coalesce(text, '') || ' Kontakt: ' || {user} ELSE coalesce(text, '') END"
_ARGUMENTS = """'{{"an": "' || {user} || '", "kopie": ["' || {own} || '", ' || CAST(turn AS VARCHAR) || ', "ok"]}}'"""
_USER, _OWN = "'u' || CAST(conv_id % 50 AS VARCHAR) || '@firma.de'", "'t' || CAST(turn AS VARCHAR) || '@firma.de'"


def _turns(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, role, content, name, arguments) of every turn."""
    spec = f"SELECT conv_id, turn, role, {_CONTENT} AS content, CASE WHEN role = 'system' THEN {{own}} END AS name, CASE WHEN role = 'assistant' THEN {_ARGUMENTS} END AS arguments FROM {{c}}"
    sql = spec.replace("{user}", _USER).replace("{own}", _OWN).replace("VARCHAR", "STRING")
    return spark.sql(sql, c=table(spark, sf_dir, "conversations"))


def _requests(spark, sf_dir) -> DataFrame:
    """(conv_id, raw): the JSON of every conversation."""
    call = F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(F.lit("senden").alias("name"), F.col("arguments")).alias("function"))
    message = F.to_json(F.struct("role", "content", "name", F.when(F.col("arguments").isNotNull(), F.array(call)).alias("tool_calls")))
    made = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    return made.select("conv_id", F.concat(F.lit('{"model": "m", "messages": ['), F.array_join(F.transform("ms", lambda x: x["m"]), ", "), F.lit("]}")).alias("raw"))


# the values of a request in their order: content, name, then the call's arguments
_NUMBERS = f"""o AS (
        SELECT conv_id, turn * 10 AS pos, {_USER} AS v FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn * 10 + 1, {_OWN} FROM conversations WHERE role = 'system'
        UNION ALL SELECT conv_id, turn * 10 + 2, {_USER} FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn * 10 + 3, {_OWN} FROM conversations WHERE role = 'assistant'
    ), f AS (SELECT conv_id, v, min(pos) AS pos FROM o GROUP BY conv_id, v), r AS (SELECT conv_id, v, '<EMAIL_ADDRESS_' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS VARCHAR) || '>' AS p FROM f)"""
_U, _O = "u.p", "t.p"


def _has(words) -> str:
    """SQL: whether the content has one of the words."""
    return r"regexp_matches({x}, '(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])')"


# tier 3, or tier 2 without approval: its word, and a person (the user's address is one)
_BLOCKED = f"(role = 'user' OR {_has(C.PERSON_WORDS)}) AND ({_has([w for ws in C.TIER3.values() for w in ws])} OR {_has(C.TIER2_WORDS)})".replace("{x}", "coalesce(text, '')")


@query(
    f"""WITH {_NUMBERS}, m AS (
        SELECT c.conv_id, turn, '{{"content":' || CAST(to_json({_CONTENT.replace("{user}", _U)}) AS VARCHAR) || CASE role WHEN 'system' THEN ',"name":"' || {_O} || '"' ELSE '' END || ',"role":"' || role || '"'
            || CASE role WHEN 'assistant' THEN ',"tool_calls":[{{"function":{{"arguments":' || CAST(to_json({_ARGUMENTS.replace("{{", "{").replace("}}", "}").replace("{user}", _U).replace("{own}", _O)}) AS VARCHAR) || ',"name":"senden"}},"id":"c' || CAST(turn AS VARCHAR) || '","type":"function"}}]' ELSE '' END || '}}' AS m
        FROM conversations c LEFT JOIN r u ON u.conv_id = c.conv_id AND u.v = 'u' || CAST(c.conv_id % 50 AS VARCHAR) || '@firma.de' LEFT JOIN r t ON t.conv_id = c.conv_id AND t.v = 't' || CAST(c.turn AS VARCHAR) || '@firma.de'
    ), j AS (SELECT conv_id, '{{"model":"m","messages":[' || string_agg(m, ',' ORDER BY turn) || ']}}' AS masked FROM m GROUP BY conv_id
    ), b AS (SELECT DISTINCT conv_id FROM conversations WHERE {_BLOCKED}
    ), e AS (SELECT conv_id, count(*) AS n, string_agg(p || '=' || v, ' ' ORDER BY CAST(regexp_extract(p, '[0-9]+') AS INTEGER)) AS reid FROM r GROUP BY conv_id)
    SELECT j.conv_id, CASE WHEN b.conv_id IS NULL THEN masked END AS masked, CASE WHEN b.conv_id IS NULL THEN coalesce(reid, '') ELSE '' END AS reid,
        CAST(CASE WHEN b.conv_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_values, CASE WHEN b.conv_id IS NULL THEN 'ok' ELSE 'blocked' END AS status
    FROM j LEFT JOIN e ON j.conv_id = e.conv_id LEFT JOIN b ON j.conv_id = b.conv_id"""
)
def mask_request_json(spark, sf_dir):
    """One numbering for content, names and calls of every conversation, with the map."""
    made = T.mask_request_json(T.detected(spread(_requests(spark, sf_dir))), ("conv_id",))
    reid = F.array_join(F.transform("reid_map", lambda m: F.concat(m["placeholder"], F.lit("="), m["value"])), " ")
    return made.select("conv_id", "masked", reid.alias("reid"), "n_values", "status")


def _map_json(reid_map):
    return F.to_json(F.map_from_entries(F.transform(reid_map, lambda m: F.struct(m["placeholder"], m["value"]))))


@query(
    f"""SELECT conv_id, string_agg({_CONTENT.replace("{user}", _USER)} || CASE WHEN role = 'assistant' THEN {_ARGUMENTS.replace("{{", "{").replace("}}", "}").replace("{user}", _USER).replace("{own}", _OWN)} ELSE '' END, '' ORDER BY turn) AS text, 'ok' AS status
    FROM conversations GROUP BY conv_id HAVING NOT bool_or({_BLOCKED})"""
)
def request_roundtrip(spark, sf_dir):
    """Masked requests, their messages as a model's replies, restored by each request's own map: contents and arguments are those that came.  Blocked requests have no reply."""
    made = written(T.mask_request_json(T.detected(spread(_requests(spark, sf_dir))), ("conv_id",)).where("status = 'ok'"), "masked")
    choices = F.transform(F.try_variant_get(F.try_parse_json("masked"), "$.messages", "array<variant>"), lambda m: F.concat(F.lit('{"message":'), F.to_json(m), F.lit("}")))
    replies = made.select("conv_id", F.concat(F.lit('{"choices":['), F.array_join(choices, ","), F.lit("]}")).alias("raw"))
    back = T.restore_replies(replies, made.select("conv_id", _map_json(F.col("reid_map")).alias("reid")), "conv_id")
    texts = F.transform(F.try_variant_get(F.try_parse_json("restored"), "$.choices", "array<variant>"), lambda c: F.concat(F.try_variant_get(c, "$.message.content", "string"), F.coalesce(F.try_variant_get(c, "$.message.tool_calls[0].function.arguments", "string"), F.lit(""))))
    return back.select("conv_id", F.array_join(texts, "").alias("text"), "status")


_REPLY = """'{"choices":[{"index":0,"message":{"content":"Für ' || {a} || ' und ' || {b} || ' <PERSON_2>","refusal":"' || {a} || '","role":"assistant","tool_calls":[{"function":{"arguments":"{\\"an\\": \\"' || {c} || '\\", \\"n\\": 1}","name":"f"},"id":"c1"}]}}]}'"""


@query(
    f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '<PERSON_0> {{' WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN {_REPLY.replace("{a}", "'<PERSON_0>'").replace("{b}", "'<PERSON_10>'").replace("{c}", "'<PERSON_0>'")}
        ELSE {_REPLY.replace("{a}", "c_name || ' \\\"A\\\"'").replace("{b}", "c_mktsegment").replace("{c}", "c_name || ' \\\\\\\"A\\\\\\\"'")} END AS restored,
        CASE WHEN c_custkey % 11 = 0 THEN 'no_map' WHEN c_custkey % 7 = 0 THEN 'broken_map' WHEN c_custkey % 13 = 0 THEN 'broken_reply' ELSE 'ok' END AS status FROM customer"""
)
def reply_restore(spark, sf_dir):
    """Replies with sound, broken and absent maps, and replies that are no JSON; a map's value has quotes."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    raw = F.when(F.col("c_custkey") % 13 == 0, F.lit("<PERSON_0> {")).otherwise(F.expr(_REPLY.replace("{a}", "'<PERSON_0>'").replace("{b}", "'<PERSON_10>'").replace("{c}", "'<PERSON_0>'").replace("\\", "\\\\")))
    own = F.to_json(F.map_from_arrays(F.array(F.lit("<PERSON_0>"), F.lit("<PERSON_10>")), F.array(F.concat("c_name", F.lit(' "A"')), F.col("c_mktsegment"))))
    broken = F.get(F.array(F.lit("["), F.lit('{"<PERSON_0>": 5}'), F.lit('{"<PERSON_0>": null}')), (F.col("c_custkey") % 3).cast("int"))
    maps = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, broken).otherwise(own).alias("reid"))
    return T.restore_replies(c.select(F.col("c_custkey").alias("id"), raw.alias("raw")), maps, "id").select("id", "restored", "status")


_STREAM_TEXT = "coalesce(text, '') || ' <PERSON_0> <PERSON_1> <PERSON_10> <X'"


@query("SELECT conv_id, turn, coalesce(text, '') || ' Kunde ' || CAST(conv_id AS VARCHAR) || ' ' || role || ' <PERSON_1' || '0> <X' AS text FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn, coalesce(text, '') || ' <PERSON_0> <PERSON_1> <PERSON_10> <X' FROM conversations WHERE conv_id % 4 = 0")
def stream_restore(spark, sf_dir):
    """Texts torn into pieces of 7, streamed and restored, each turn with a map of its own; every fourth conversation has none."""
    ship(spark)
    folder = f"{shared_dir(spark)}/veilspark/stream-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_STREAM_TEXT).alias("text"))
    stream = F.concat_ws("-", "conv_id", "turn")
    torn = turns.select(stream.alias("stream_id"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "text"), F.ceil(F.length("text") / 7).alias("n"))
    torn = torn.select("stream_id", F.col("seq").cast("long").alias("seq"), F.lit("content").alias("channel"), "text", F.when(F.col("seq") == F.col("n") - 1, "stop").alias("finish_reason"))
    own = F.array(F.struct(F.lit("<PERSON_0>").alias("placeholder"), F.concat(F.lit("Kunde "), F.col("conv_id").cast("string")).alias("value")), F.struct(F.lit("<PERSON_1>").alias("placeholder"), F.col("role").alias("value")))
    maps = turns.where("conv_id % 4 <> 0").select(stream.alias("stream_id"), F.inline(own))
    torn.write.parquet(f"{folder}/deltas")
    maps.write.parquet(f"{folder}/maps")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)  # state of this kind needs it
    try:
        read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
        done = ST.reidentify_streams(read("deltas"), read("maps"))
        done.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    whole = ST.reassemble(spark.read.parquet(f"{folder}/said"), ["stream_id"])
    part = F.split("stream_id", "-")
    return whole.select(F.get(part, F.lit(0)).cast("long").alias("conv_id"), F.get(part, F.lit(1)).cast("long").alias("turn"), "text")


# every order is a turn of its customer's session with one quasi-identifier, or none, and an address
_PLZ, _YEAR = "lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')", "1940 + o_orderkey % 60"
_TURN = "'Mail a' || CAST(o_orderkey % 3 AS VARCHAR) || '@x.de, ' || CASE o_orderkey % 4 WHEN 0 THEN 'PLZ ' || {plz} WHEN 1 THEN 'Jahrgang ' || {year} WHEN 2 THEN {gender} ELSE 'nichts' END"
_DAY = 86400


@query(
    f"""WITH t AS (SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS sec, CASE o_orderkey % 4 WHEN 0 THEN 'DE_PLZ' WHEN 1 THEN 'DE_GEBURTSJAHR' WHEN 2 THEN 'DE_GENDER' END AS k, {_PLZ} AS plz, {_YEAR} AS y FROM orders
    ), n AS (SELECT *, count(DISTINCT k) OVER (PARTITION BY o_custkey ORDER BY sec RANGE BETWEEN {400 * _DAY} PRECEDING AND CURRENT ROW) AS n FROM t
    ), g AS (SELECT *, n >= 3 AND k IS NOT NULL AS general FROM n)
    SELECT o_orderkey AS request_id, '{{"messages":[{{"content":"Mail <EMAIL_ADDRESS_0>, ' || CASE k WHEN 'DE_PLZ' THEN 'PLZ ' || CASE WHEN general THEN CASE substr(plz, 1, 1) {_REGIONS} END ELSE plz END
        WHEN 'DE_GEBURTSJAHR' THEN 'Jahrgang ' || CASE WHEN general THEN CASE WHEN y % 10 <= 2 THEN 'Anfang' WHEN y % 10 <= 6 THEN 'Mitte' ELSE 'Ende' END || ' der ' || CAST(y - y % 10 AS VARCHAR) || 'er' ELSE CAST(y AS VARCHAR) END
        WHEN 'DE_GENDER' THEN CASE WHEN general THEN '[Geschlecht anonymisiert]' ELSE 'weiblich' END ELSE 'nichts' END || '","role":"user"}}]}}' AS masked, CAST(n AS INTEGER) AS n_types, general AS generalised, 'ok' AS status FROM g"""
)
def session_requests(spark, sf_dir):
    """The third type in a session of 400 days generalises that turn; older types don't count."""
    turn = _TURN.replace("{plz}", _PLZ).replace("{year}", f"CAST({_YEAR} AS VARCHAR)").replace("{gender}", "'weiblich'").replace("VARCHAR", "STRING")
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 1 << 20).select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("session"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"), F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.expr(turn).alias("content"))).alias("messages"))).alias("raw"))
    made = T.mask_sessions(o, ttl=400 * _DAY, entities=("EMAIL_ADDRESS", "DE_PLZ", "DE_GEBURTSJAHR", "DE_GENDER"))
    return made.select("request_id", "masked", F.size("seen").alias("n_types"), "generalised", "status")


_KEY = b"0123456789abcdef"


def _store(spark, sf_dir) -> SessionStore:
    """A store that has taken the events in three turns, one after the other."""
    store = SessionStore(spark, f"{shared_dir(spark)}/veilspark/sessions-{uuid.uuid4().hex}", 16)
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id"), Q.session_hash(F.col("user_id").cast("string")).alias("session_hash"), F.col("event_type").alias("qi_type"), Q.encrypt_category(F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string")), _KEY).alias("category_enc"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("created_at"))
    for turn in range(3):
        # one record of a session, type and moment in a turn: the later event of a moment stands for it
        own = rows.where(F.col("event_id") % 3 == turn)
        store.upsert(own.groupBy("session_hash", "qi_type", "created_at").agg(F.max_by("category_enc", "event_id").alias("category_enc")))
    return store


_LATEST = "SELECT sha256(CAST(user_id AS VARCHAR)) AS session_hash, event_type AS qi_type, CAST(max(epoch_us(ts)) AS DOUBLE) AS created_at, {more} FROM events GROUP BY user_id, event_type"


@query(_LATEST.format(more="'k' || CAST(arg_max(event_id, ts) % 10 AS VARCHAR) AS category"))
def session_store_upsert(spark, sf_dir):
    """Latest record of every session and type after three upserts, read with its category in clear text."""
    return _store(spark, sf_dir).audit(_KEY).select("session_hash", "qi_type", "created_at", "category")


@query(f"SELECT session_hash, string_agg(qi_type, ',' ORDER BY qi_type) AS seen FROM ({_LATEST.format(more='1 AS one')}) WHERE created_at >= (SELECT CAST(max(epoch_us(ts)) AS DOUBLE) FROM events) - {5 * _DAY}000000 GROUP BY session_hash")
def session_store_expire(spark, sf_dir):
    """Types alive in every session when the records of more than five days before the last one have expired."""
    store = _store(spark, sf_dir)
    now = store.read().agg(F.max("created_at")).first()[0]
    store.expire(now, 5 * _DAY * 1e6)
    return store.read().groupBy("session_hash").agg(F.array_join(F.array_sort(F.collect_set("qi_type")), ",").alias("seen"))

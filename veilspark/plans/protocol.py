"""Queries of the request protocol and of detectors that the catalogue's texts don't reach, with SQL that computes from the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import jsonargs as J
from ..operators import request as RQ
from ..operators import spans as P
from ..operators import validate as V
from ..session import spread
from ..sources import io
from .catalog import _CASES, _EMAIL, _OWN_PATTERNS, _PERSON_SQL, _TALLY, _cases, _spans_of, _spans_sql, persons, query, table

#: Message shapes; every one stands for a rule or for a way to break it.
SHAPES = (
    '{"role":"user","content":"x"}', '{"role":"user","content":"x","extra":1}', '{"role":"boss","content":"x"}', '{"role":7,"content":"x"}', '{"role":"user","content":5}', '{"role":"user","content":{"type":"text","text":"x"}}',
    '{"role":"user","content":"x","name":5}', '{"role":"user","content":"x","refusal":["x"]}', '{"role":"tool","content":"x","tool_call_id":"a b"}', '{"role":"tool","content":"x","tool_call_id":7}', '{"role":"tool","content":"x","tool_call_id":"call_1"}',
    '{"role":"user","content":"x","cache_control":{"type":"ephemeral"}}', '{"role":"user","content":"x","cache_control":{"type":"ephemeral","ttl":"5m"}}', '{"role":"user","content":"x","cache_control":{"type":"ephemeral","note":"x"}}', '{"role":"user","content":"x","cache_control":"ephemeral"}', '{"role":"user","content":"x","cache_control":{"ttl":"1h"}}',
    '{"role":"assistant","content":null,"tool_calls":[{"id":"a","type":"function","index":0,"function":{"name":"f","arguments":"{}"}}]}', '{"role":"assistant","tool_calls":[{"id":5,"type":"function"}]}', '{"role":"assistant","tool_calls":[{"id":"a","index":"1"}]}', '{"role":"assistant","tool_calls":[{"id":"a","function":"f"}]}',
    '{"role":"assistant","tool_calls":[{"id":"a","function":{"name":5}}]}', '{"role":"assistant","tool_calls":[{"id":"a","function":{"name":"f","arguments":{"iban":"DE89"}}}]}', '{"role":"assistant","tool_calls":["{}"]}', '{"role":"assistant","tool_calls":{"id":"a"}}', '{"role":"assistant","tool_calls":[{"id":"a","type":"custom"}]}',
    '{"role":"assistant","function_call":{"name":"f","arguments":"{}"}}', '{"role":"assistant","function_call":"f"}', '{"role":"assistant","function_call":{"name":"f","more":1}}', '{"role":"user","content":[{"type":"text","text":"x"}]}', '{"role":"user","content":[{"type":"text"}]}', '{"role":"user","content":[{"type":"text","text":{"a":"x"}}]}',
    '{"role":"user","content":[{"type":"video"}]}', '{"role":"user","content":[]}', '{"role":"user","content":[{"type":"image_url","image_url":{"url":"https://host/x.png"}}]}', '[1]', '{"role":"user"',
)
_SHAPES_SQL = "(SELECT o_orderkey AS msg, o_custkey AS request_id, [" + ", ".join(f"'{x}'" for x in SHAPES) + f"][1 + o_orderkey % {len(SHAPES)}] AS raw FROM orders)"
_FUNCTION_BAD = "(json_type(X) <> 'OBJECT' OR len(list_filter(json_keys(X), lambda k: k NOT IN ('name', 'arguments'))) > 0 OR coalesce(json_type(X, '$.name'), 'NULL') NOT IN ('VARCHAR', 'NULL') OR coalesce(json_type(X, '$.arguments'), 'NULL') NOT IN ('VARCHAR', 'NULL'))"
_ID = "'^[A-Za-z0-9_.:-]{1,128}$'"


def _one_of(x: str, path: str, values: tuple[str, ...], absent: bool) -> str:
    kind, given = f"coalesce(json_type({x}, '{path}'), 'NULL')", f"json_extract_string({x}, '{path}')"
    return f"(CASE {kind} WHEN 'NULL' THEN {absent} WHEN 'VARCHAR' THEN {given} IN ({', '.join(repr(v) for v in values)}) ELSE FALSE END)"


def _id_sql(x: str, path: str) -> str:
    return f"(CASE coalesce(json_type({x}, '{path}'), 'NULL') WHEN 'NULL' THEN TRUE WHEN 'VARCHAR' THEN regexp_matches(json_extract_string({x}, '{path}'), {_ID}) ELSE FALSE END)"


def _text_sql(x: str, path: str, absent: bool = True) -> str:
    return f"(CASE coalesce(json_type({x}, '{path}'), 'NULL') WHEN 'NULL' THEN {absent} WHEN 'VARCHAR' THEN TRUE ELSE FALSE END)"


_CALL_BAD = f"(json_type(c) <> 'OBJECT' OR len(list_filter(json_keys(c), lambda k: k NOT IN ({', '.join(repr(v) for v in V.CALL_FIELDS)}))) > 0 OR NOT {_id_sql('c', '$.id')} OR NOT {_one_of('c', '$.type', ('function',), True)} OR coalesce(json_type(c, '$.index'), 'NULL') NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN', 'NULL') OR (coalesce(json_type(c, '$.function'), 'NULL') <> 'NULL' AND {_FUNCTION_BAD.replace('X', 'json_extract(c, ' + chr(39) + '$.function' + chr(39) + ')')}))"
_REASON_SQL = f"""CASE WHEN NOT json_valid(raw) OR json_type(raw) <> 'OBJECT' THEN 'not_an_object'
 WHEN len(list_filter(json_keys(raw), lambda k: k NOT IN ({', '.join(repr(v) for v in V.MASKED_FIELDS + V.CHECKED_FIELDS)}))) > 0 THEN 'unknown_field'
 WHEN NOT {_one_of('raw', '$.role', V.ROLES, True)} THEN 'role'
 WHEN NOT ({_text_sql('raw', '$.name')} AND {_text_sql('raw', '$.refusal')} AND {_text_sql('raw', '$.reasoning_content')}) THEN 'text_field'
 WHEN coalesce(json_type(raw, '$.cache_control'), 'NULL') <> 'NULL' AND (json_type(raw, '$.cache_control') <> 'OBJECT' OR len(list_filter(json_keys(raw, '$.cache_control'), lambda k: k NOT IN ('type', 'ttl'))) > 0 OR NOT {_one_of('raw', '$.cache_control.type', V.CACHE_TYPES, False)} OR NOT {_one_of('raw', '$.cache_control.ttl', V.CACHE_TTLS, True)}) THEN 'cache_control'
 WHEN NOT {_id_sql('raw', '$.tool_call_id')} THEN 'opaque_id'
 WHEN coalesce(json_type(raw, '$.tool_calls'), 'NULL') NOT IN ('NULL', 'ARRAY') OR len(list_filter(json_extract(raw, '$.tool_calls[*]'), lambda c: {_CALL_BAD})) > 0 THEN 'tool_calls'
 WHEN coalesce(json_type(raw, '$.function_call'), 'NULL') <> 'NULL' AND {_FUNCTION_BAD.replace('X', "json_extract(raw, '$.function_call')")} THEN 'function_call'
 WHEN coalesce(json_type(raw, '$.content'), 'NULL') NOT IN ('NULL', 'VARCHAR', 'ARRAY') THEN 'content'
 WHEN json_type(raw, '$.content') = 'ARRAY' AND len(list_filter(json_extract(raw, '$.content[*]'), lambda p: NOT ({_one_of('p', '$.type', ('text',), False)} AND {_text_sql('p', '$.text', False)}))) > 0 THEN 'content_part' END"""


def _from_sql(spark, sf_dir, sql: str, name: str):
    """The rows of a derived table of the SQL above, in Spark."""
    made = sql.strip()[1:-1].replace("VARCHAR", "STRING").replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {t}")
    return spark.sql(made, t=spread(table(spark, sf_dir, name)))


@query(f"SELECT request_id, msg, {_REASON_SQL} AS reason_code FROM (SELECT msg, request_id, CASE WHEN json_valid(raw) THEN raw ELSE '[]' END AS raw FROM {_SHAPES_SQL})")
def message_shapes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.get(F.array(*(F.lit(x) for x in SHAPES)), (F.col("o_orderkey") % len(SHAPES)).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("msg"), F.col("o_custkey").alias("request_id"), raw.alias("raw"))
    return V.validate(rows).select("request_id", "msg", "reason_code")


_REQUESTS = ('{"messages":[{"role":"user"},{"role":"tool"}]}', '{"messages":"DE89 3704"}', '{"messages":{"role":"user"}}', '{"model":"m"}', '{"messages":[]}', '{"messages":[7]}', '{"call_type":"embedding","messages":"x"}', '[1]')
_REQUESTS_SQL = "(SELECT s_suppkey AS request_id, [" + ", ".join(f"'{x}'" for x in _REQUESTS) + f"][1 + s_suppkey % {len(_REQUESTS)}] AS raw FROM supplier)"


@query(
    f"""WITH r AS (SELECT *, json_type(raw) <> 'OBJECT' OR coalesce(json_type(raw, '$.messages'), 'NULL') NOT IN ('NULL', 'ARRAY') AS bad FROM {_REQUESTS_SQL} WHERE coalesce(json_extract_string(raw, '$.call_type'), 'completion') IN ('completion', 'text_completion', 'acompletion'))
    SELECT request_id, 0 AS msg_idx, 'blocked' AS status FROM r WHERE bad
    UNION ALL SELECT request_id, CAST(unnest(range(len(json_extract(raw, '$.messages[*]')))) AS INTEGER), 'ok' FROM r WHERE NOT bad"""
)
def request_messages(spark, sf_dir):
    raw = F.get(F.array(*(F.lit(x) for x in _REQUESTS)), (F.col("s_suppkey") % len(_REQUESTS)).cast("int"))
    return io.messages(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), raw.alias("raw"))).select("request_id", "msg_idx", "status")


_FORMS_SQL = """(SELECT c_custkey AS id, 'Wohnt Lange Allee ' || CAST(1 + c_custkey % 99 AS VARCHAR) || ', EG ' || CAST(1 + c_custkey % 15 AS VARCHAR) || ', Zeichen ' || CAST(1 + c_custkey % 999 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) || '.7-3/' || CAST(2000 + c_custkey % 25 AS VARCHAR)
 || ', Konto DE' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') || ' 3704 0044 0532 0130 00, Ende' AS text FROM customer)"""
_FORMS = {
    "strasse_zwei": ("DE_STRASSE", ("street_two_words",), r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]*[ ](?i:allee|gasse|platz)[ ]+\d{1,4}[ ]?[a-zA-Z]?\b"),
    "tvoed_kurz": ("DE_TVOED_STUFE", ("pay_grade_short",), r"(?i)\b(?:EG|E|A|B|R|W)[ ]?\d{1,2}\b"),
    "aktenzeichen_amt": ("DE_AKTENZEICHEN", ("office_reference",), r"\b\d{1,4}-\d{1,6}\.\d{1,3}-\d{1,3}/\d{1,4}\b"),
}
for _name, (_entity, _names, _rx) in _FORMS.items():
    query(_spans_sql(_FORMS_SQL, _rx), f"detect_de_{_name}")(lambda spark, sf_dir, e=_entity, n=_names: _spans_of(_from_sql(spark, sf_dir, _FORMS_SQL, "customer"), e, n))


@query(_spans_sql(_FORMS_SQL, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", keep="CAST(replace(replace(replace(substr(value, 5) || substr(value, 1, 4), ' ', ''), 'D', '13'), 'E', '14') AS HUGEINT) % 97 = 1"))
def detect_iban(spark, sf_dir):
    """Two in a hundred check digits are right."""
    return _spans_of(_from_sql(spark, sf_dir, _FORMS_SQL, "customer"), "IBAN_CODE")


@query(f"SELECT id, value, start, \"end\", 'DE_GEBURTSJAHR' AS entity_type FROM ({_spans_sql(_PERSON_SQL, _OWN_PATTERNS['geburtsjahr'][2], 1)})")
def detect_score_threshold(spark, sf_dir):
    """Of two detectors the one that reaches the score."""
    found = D.detect(persons(spark, sf_dir), entities=("DE_PLZ", "DE_GEBURTSJAHR"), score_threshold=0.5)
    return found.select("id", "text", F.explode("spans").alias("s")).select("id", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"))


_UNION = " UNION ALL ".join(f"SELECT id, '{_OWN_PATTERNS[n][0]}' AS entity_type, value, start FROM ({_spans_sql(_PERSON_SQL, _OWN_PATTERNS[n][2], _OWN_PATTERNS[n][3])})" for n in ("plz", "geburtsjahr", "kfz"))


@query(_UNION)
def detect_union(spark, sf_dir):
    """Spans of several detectors in one pass."""
    found = D.detect(persons(spark, sf_dir), entities=("DE_PLZ", "DE_GEBURTSJAHR", "DE_KFZ_KENNZEICHEN"))
    return found.select("id", "text", F.explode("spans").alias("s")).select("id", F.col("s.entity_type").alias("entity_type"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.col("s.start").alias("start"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_linenumber - 3 >= 0 AND l_linenumber - 3 < l_suppkey % 7 AND l_suppkey % 7 <= length(l_returnflag || l_linestatus || 'abc') AND l_partkey % 5 > 0 AS ok FROM lineitem")
def span_validity(spark, sf_dir):
    span = F.struct(F.when(F.col("l_partkey") % 5 > 0, "T").otherwise("").alias("entity_type"), (F.col("l_linenumber") - 3).cast("int").alias("start"), (F.col("l_suppkey") % 7).cast("int").alias("end"), F.lit(0.5).alias("score"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.size(P.valid(F.array(span), F.concat("l_returnflag", "l_linestatus", F.lit("abc")))) == 1).alias("ok"))


_ARGUMENTS_SQL = """(SELECT c_custkey AS id, '{"iban": "DE89 3704 0044 0532 0130 00", "karte": "4111 1111 1111 1111", "host": "10.' || CAST(c_custkey % 300 AS VARCHAR) || '.7.1", "n": ' || CAST(c_custkey % 90 AS VARCHAR) || '}' AS arguments FROM customer)"""


@query(f"SELECT id, replace(replace(CASE WHEN CAST(regexp_extract(arguments, '10\\.([0-9]+)\\.7\\.1', 1) AS INTEGER) <= 255 THEN regexp_replace(arguments, '10\\.[0-9]+\\.7\\.1', '<IP_ADDRESS_0>') ELSE arguments END, 'DE89 3704 0044 0532 0130 00', '<IBAN_CODE_0>'), '4111 1111 1111 1111', '<CREDIT_CARD_0>') AS masked, 'ok' AS json_status FROM {_ARGUMENTS_SQL}")
def json_argument_checked_types(spark, sf_dir):
    """Types with a checksum inside arguments."""
    return J.mask_arguments(_from_sql(spark, sf_dir, _ARGUMENTS_SQL, "customer"), ("IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS")).select("id", "masked", "json_status")


_MAILS_SQL = "(SELECT o_custkey AS request_id, o_orderkey AS msg_idx, 0 AS field_idx, 'Von k' || CAST(o_orderkey % 3 AS VARCHAR) || '@firma.de an k' || CAST(o_orderkey % 5 AS VARCHAR) || '@firma.de' AS text FROM orders)"


@query(
    f"""WITH t AS (SELECT *, regexp_extract_all(text, '{_EMAIL}') AS h FROM {_MAILS_SQL}), u AS (SELECT request_id, msg_idx, h[i] AS v, i FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM t)),
    f AS (SELECT request_id, v, min((msg_idx, i)) AS first FROM u GROUP BY ALL), r AS (SELECT request_id, v, dense_rank() OVER (PARTITION BY request_id ORDER BY first) - 1 AS k FROM f)
    SELECT t.request_id, t.msg_idx, 'Von <EMAIL_ADDRESS_' || CAST(a.k AS VARCHAR) || '> an <EMAIL_ADDRESS_' || CAST(b.k AS VARCHAR) || '>' AS masked, 2 AS n_spans, 'ok' AS status
    FROM t JOIN r a ON a.request_id = t.request_id AND a.v = t.h[1] JOIN r b ON b.request_id = t.request_id AND b.v = t.h[2]"""
)
def mask_requests(spark, sf_dir):
    """All fields of a request with one numbering, every detector on."""
    return RQ.mask_fields(_from_sql(spark, sf_dir, _MAILS_SQL, "orders"), threshold=None).select("request_id", "msg_idx", "masked", "n_spans", "status")


@query()
def mask_conversations(spark, sf_dir):
    """Every turn of every conversation as a field of its request."""
    fields = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("msg_idx"), F.lit(0).alias("field_idx"), "text")
    return RQ.mask_fields(fields).select("request_id", "msg_idx", "masked", "n_spans", "status", "reason_code")


@query(
    f"SELECT 'recall' AS target, e AS entity_type, CAST(tp AS DOUBLE) / (tp + fn) AS value FROM ({_TALLY}), (VALUES ('all'), ('PERSON')) AS t(e) WHERE CAST(tp AS DOUBLE) / (tp + fn) < 0.9 UNION ALL SELECT 'precision', 'all', CAST(tp AS DOUBLE) / (tp + fp) FROM ({_TALLY}) WHERE CAST(tp AS DOUBLE) / (tp + fp) < 0.9 UNION ALL SELECT 'disturbance', 'all', CAST(count(*) AS DOUBLE) / count(*) FROM {_CASES} WHERE kind = 0"
)
def gate_violations_all(spark, sf_dir):
    """With the disturbance target."""
    cases, truth, found = _cases(spark, sf_dir)
    return E.violations(E.tallies(truth, found, E.match(E.candidates(truth, found)), cases), E.disturbance(cases, found))

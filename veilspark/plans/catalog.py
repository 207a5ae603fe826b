"""Registered queries of the personal-data operators and the SQL that checks them.

The tables hold little German personal data, so most queries derive texts from
columns, in the same way here and in SQL.  Every query runs over its whole
table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import jsonargs as J
from ..operators import qi as Q
from ..operators import rules as R
from ..operators import spans as P
from ..operators import validate as V
from ..session import spread
from ..streaming import state as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# one derived text per customer, with every German identifier once
_PERSON_SQL = """(SELECT c_custkey AS id, 'Kunde ' || c_name || ', PLZ ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || ', Jahrgang ' || CAST(1940 + c_custkey % 70 AS VARCHAR)
 || ', geboren am ' || CAST(1 + c_custkey % 28 AS VARCHAR) || '.' || CAST(1 + c_custkey % 12 AS VARCHAR) || '.' || CAST(1940 + c_custkey % 70 AS VARCHAR)
 || ', Kennzeichen: K-AB ' || CAST(1 + c_custkey % 999 AS VARCHAR) || ', Bahnhofstrasse ' || CAST(1 + c_custkey % 99 AS VARCHAR)
 || ', IdNr. ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' 123 456'
 || ', SV 12 ' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || ' M 123, Entgeltgruppe ' || CAST(1 + c_custkey % 15 AS VARCHAR)
 || ', HRB ' || CAST(1 + c_custkey % 5000 AS VARCHAR) || ', weiblich, Beruf Notarin, Az. ' || CAST(1 + c_custkey % 30 AS VARCHAR) || ' O ' || CAST(1 + c_custkey % 500 AS VARCHAR) || '/99'
 || ', Firma Nord Handel GmbH, Konto DE89 3704 0044 0532 0130 00.' AS text FROM customer)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _PERSON_SQL.strip()[1:-1].replace("VARCHAR", "STRING").replace("FROM customer", "FROM {c}")
    return spark.sql(made, c=spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")))


def _spans_sql(source: str, rx: str, group: int = 0, key: str = "id", keep: str = "TRUE") -> str:
    """SQL for values and offsets of a pattern; ``group`` is the value inside a consumed context."""
    rx = rx.replace("'", "''")
    return f"""WITH t AS (SELECT {key} AS id, text, regexp_extract_all(text, '{rx}', 0) AS h, regexp_extract_all(text, '{rx}', {group}) AS v, string_split_regex(text, '{rx}') AS p FROM {source}),
    u AS (SELECT id, text, h, v, p, unnest(range(1, len(h) + 1)) AS i FROM t WHERE len(h) > 0),
    s AS (SELECT id, v[i] AS value, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) + strpos(h[i], v[i]) - 1 AS INTEGER) AS start FROM u)
    SELECT id, value, start, CAST(start + length(value) AS INTEGER) AS "end" FROM s WHERE {keep}"""


def _spans_of(df: DataFrame, entity: str, names: tuple[str, ...] = ()) -> DataFrame:
    found = [D.pattern_spans(F.col("text"), p) for p in D.PATTERNS if p.entity == entity and (not names or p.name in names)]
    spans = F.concat(*found) if len(found) > 1 else found[0]
    return df.select("id", "text", F.explode(spans).alias("s")).select("id", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


_WORD = r"(?i)(?:^|[^\p{L}\p{N}_])"
_OWN_PATTERNS = {
    "steuer_id": ("DE_STEUER_ID", (), r"(?i)\b\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0),
    "sv": ("DE_SOZIALVERSICHERUNG", (), r"(?i)\b\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}\b", 0),
    "handelsregister": ("DE_HANDELSREGISTER", (), r"(?i)\bHR[AB][ ]?\d{1,6}\b", 0),
    "kfz": ("DE_KFZ_KENNZEICHEN", (), r"(?i)\b[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}[ ]?\d{1,4}\b", 0),
    "strasse": ("DE_STRASSE", ("street_one_word",), r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]*(?i:strasse)[ ]+\d{1,4}[ ]?[a-zA-Z]?\b", 0),
    "plz": ("DE_PLZ", (), r"\b\d{5}\b", 0),
    "geburtsjahr": ("DE_GEBURTSJAHR", (), r"(?i)(?:geboren|jahrgang|geburtsjahr|geb\.)[ ]{0,4}((?:19\d{2}|20[0-2]\d))\b", 1),
    "geburtsdatum": ("DE_GEBURTSDATUM", (), r"(?i)(?:geboren(?:[ ]+am)?|geburtsdatum|geb\.)[ :]{0,4}(\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2}))\b", 1),
    "tvoed": ("DE_TVOED_STUFE", ("pay_grade",), r"(?i)\b(?:TV-L|Besoldungsgruppe|Entgeltgruppe|BesGr)[ ]*[A-W]?[ ]?\d{1,2}\b", 0),
    "gender": ("DE_GENDER", (), _WORD + r"(männlich|weiblich|divers|nichtbinär|non-binär)(?:$|[^\p{L}\p{N}_])", 1),
    "beruf": ("DE_BERUF", (), _WORD + r"(Notarin|Notar|Richterin|Richter)(?:$|[^\p{L}\p{N}_])", 1),
    "aktenzeichen": ("DE_AKTENZEICHEN", ("court_reference",), r"(?i)\b(?:\d{1,4}|[IVX]{1,4})[ ][A-ZÄÖÜ][A-Za-zÄÖÜ]{0,4}[ ]\d{1,5}/\d{2,4}\b", 0),
    "firma": ("DE_FIRMA", (), r"([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\-]+(?:[ ]+(?:&[ ]+)?[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\-]+){0,4}[ ]+(?:GmbH|mbH|AG|KG))", 1),
}


def _german(entity: str, names: tuple[str, ...]):
    return lambda spark, sf_dir: _spans_of(persons(spark, sf_dir), entity, names)


for _name, (_entity, _names, _rx, _group) in _OWN_PATTERNS.items():
    query(_spans_sql(_PERSON_SQL, _rx, _group), f"detect_de_{_name}")(_german(_entity, _names))

_DOCS = "(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
# the edge before is one consumed character; the one behind is a word edge, or a letter that can't stand before a number, as a consumed separator would be missing before the next number
_PHONE = r"(^|[^0-9A-Za-z_+])((?:\+|0)[0-9](?:[ /()-]{0,2}[0-9]){6,13})(?:\b|[A-Za-z_])"
_PLAIN = "regexp_replace(regexp_replace(value, '[^0-9]', '', 'g'), '^00', '')"
_CODE = f"CASE WHEN {_PLAIN}[1] IN ('1', '7') THEN 1 WHEN {_PLAIN}[1:2] IN ({', '.join(repr(c) for c in S.TWO_DIGIT_CODES)}) THEN 2 ELSE 3 END"
_PLAN = f"""CASE WHEN value LIKE '+%' OR regexp_replace(value, '[^0-9]', '', 'g') LIKE '00%' THEN {_PLAIN} NOT LIKE '0%' AND length({_PLAIN}) - {_CODE} BETWEEN
    CASE {_PLAIN}[1:{_CODE}] {" ".join(f"WHEN '{c}' THEN {a}" for c, (a, _) in S.NATIONAL_LENGTHS.items())} ELSE 5 END AND CASE {_PLAIN}[1:{_CODE}] {" ".join(f"WHEN '{c}' THEN {b}" for c, (_, b) in S.NATIONAL_LENGTHS.items())} ELSE 15 - {_CODE} END
    ELSE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN {S.TRUNK_LENGTHS[0]} AND {S.TRUNK_LENGTHS[1]} END"""
_LUHN = "(SELECT sum(CASE WHEN (i - 1) % 2 = 0 THEN CAST(d[i] AS INT) ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END) % 10 = 0 FROM (SELECT d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT string_split(reverse(regexp_replace(value, '[^0-9]', '', 'g')), '') AS d)))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL"))


@query(_spans_sql(_DOCS, _EMAIL))
def detect_email(spark, sf_dir):
    return _spans_of(_documents(spark, sf_dir), "EMAIL_ADDRESS")


@query(_spans_sql(_DOCS, _IP, keep="len(list_filter(string_split(value, '.'), lambda x: CAST(x AS INT) > 255)) = 0"))
def detect_ipv4_valid(spark, sf_dir):
    return _spans_of(_documents(spark, sf_dir), "IP_ADDRESS")


@query(_spans_sql(_DOCS, _CARD, keep=_LUHN))
def detect_card_luhn(spark, sf_dir):
    return _spans_of(_documents(spark, sf_dir), "CREDIT_CARD")


@query(_spans_sql(_DOCS, _PHONE, 2, keep=_PLAN))
def detect_phone(spark, sf_dir):
    return _spans_of(_documents(spark, sf_dir), "PHONE_NUMBER")


@query(
    """SELECT c_custkey AS id, iban, (SELECT list_reduce(list_prepend(0, list_transform(string_split(substr(iban, 5) || substr(iban, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)) = 1 AS ok
    FROM (SELECT c_custkey, 'DE' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS iban FROM customer)"""
)
def detect_iban_mod97(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    iban = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97 + 2).cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 18, "0"))
    return c.select(F.col("c_custkey").alias("id"), iban.alias("iban")).select("id", "iban", S.iban_ok(F.col("iban")).alias("ok"))


_SPANS = "(SELECT l_orderkey AS doc, CAST((l_linenumber * 7 + l_partkey) % 40 AS INTEGER) AS start, CAST((l_linenumber * 7 + l_partkey) % 40 + 3 + l_suppkey % 9 AS INTEGER) AS \"end\", 'T' || CAST(l_linenumber AS VARCHAR) AS entity_type, 1.0 / (1 + l_linenumber) AS score FROM lineitem)"


def _line_spans(spark, sf_dir):
    at = (F.col("l_linenumber") * 7 + F.col("l_partkey")) % 40
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), at.cast("int").alias("start"), (at + 3 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("entity_type"), (1.0 / (1 + F.col("l_linenumber"))).alias("score"))


# spans of one start and end are peers (RANGE), so that they fall into one island in whatever order two windows read them
_ISLANDS_SQL = f"""WITH s AS (SELECT * FROM {_SPANS}), m AS (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
    n AS (SELECT *, sum(CASE WHEN b IS NULL OR start >= b THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY start, "end" RANGE UNBOUNDED PRECEDING) AS g FROM m)
    SELECT doc, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end", first(entity_type ORDER BY score DESC, "end" - start DESC, start, entity_type) AS entity_type FROM n GROUP BY doc, g"""


@query(_ISLANDS_SQL)
def overlap_islands(spark, sf_dir):
    return P.islands(_line_spans(spark, sf_dir), ["doc"]).select("doc", "start", "end", "entity_type")


@query(_ISLANDS_SQL)
def overlap_exact(spark, sf_dir):
    grouped = _line_spans(spark, sf_dir).groupBy("doc").agg(F.collect_list(F.struct("entity_type", "start", "end", "score")).alias("spans"))
    return P.resolve_exact(grouped).select("doc", F.explode("spans").alias("s")).select("doc", "s.start", "s.end", "s.entity_type")


@query()
def mask_documents(spark, sf_dir):
    """Every document, masked for all types; one without a hit is as it was."""
    done = P.mask_rows(D.detect(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))))
    return done.select("id", "masked", F.size("reid_map").alias("n_values"))


_MASK_SQL = f"""WITH t AS (SELECT id, text, regexp_extract_all(text, '{_EMAIL}', 0) AS h, string_split_regex(text, '{_EMAIL}') AS p FROM {_DOCS}),
    u AS (SELECT id, p, len(h) AS n, h[i] AS v, i FROM (SELECT id, h, p, unnest(range(1, len(h) + 1)) AS i FROM t WHERE len(h) > 0)),
    f AS (SELECT id, v, min(i) AS first FROM u GROUP BY id, v), r AS (SELECT id, v, dense_rank() OVER (PARTITION BY id ORDER BY first) - 1 AS k FROM f)
    SELECT u.id, string_agg(p[i] || '<EMAIL_ADDRESS_' || CAST(k AS VARCHAR) || '>' || CASE WHEN i = n THEN p[i + 1] ELSE '' END, '' ORDER BY i) AS masked, CAST(max(k) + 1 AS INTEGER) AS n_values FROM u JOIN r ON u.id = r.id AND u.v = r.v GROUP BY u.id"""


@query(_MASK_SQL)
def mask_email(spark, sf_dir):
    found = D.detect(_documents(spark, sf_dir), entities=("EMAIL_ADDRESS",))
    return P.mask_rows(found.where(F.size("spans") > 0)).select("id", "masked", F.size("reid_map").alias("n_values"))


@query(f"SELECT count(*) AS documents, count(*) AS restored FROM {_DOCS} WHERE regexp_matches(text, '{_EMAIL}')")
def reidentify_roundtrip(spark, sf_dir):
    done = P.mask_rows(D.detect(_documents(spark, sf_dir), entities=("EMAIL_ADDRESS",)).where(F.size("spans") > 0))
    back = P.reidentify(F.col("masked"), F.col("reid_map"))
    return done.agg(F.count("*").alias("documents"), F.count(F.when(back == F.col("text"), 1)).alias("restored"))


@query(
    """WITH v AS (SELECT o_custkey AS request, o_orderkey AS pos, 'STATUS' AS entity_type, o_orderstatus || CAST(o_orderkey % 3 AS VARCHAR) AS value FROM orders),
    f AS (SELECT request, value, min(pos) AS first FROM v GROUP BY request, value), r AS (SELECT request, value, dense_rank() OVER (PARTITION BY request ORDER BY first) - 1 AS k FROM f)
    SELECT v.request, v.pos, '<STATUS_' || CAST(r.k AS VARCHAR) || '>' AS placeholder FROM v JOIN r ON v.request = r.request AND v.value = r.value"""
)
def placeholder_numbering(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("pos"), F.lit("STATUS").alias("entity_type"), F.concat("o_orderstatus", (F.col("o_orderkey") % 3).cast("string")).alias("value"))
    return P.number(o, ["request"], ["pos"]).select("request", "pos", "placeholder")


_WORDS = ", ".join(f"'{w}'" for w in D.STOP_WORDS)


@query(f"SELECT p_partkey AS id, w AS value FROM (SELECT p_partkey, [{_WORDS}, p_name][CAST(1 + p_partkey % 15 AS INTEGER)] AS w FROM part) WHERE lower(w) NOT IN ({_WORDS})")
def allow_list_filter(spark, sf_dir):
    words = F.array(*(F.lit(w) for w in D.STOP_WORDS), F.col("p_name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(words, (F.col("p_partkey") % 15).cast("int")).alias("value"))
    stop = spark.createDataFrame([(w,) for w in D.STOP_WORDS], "w string")
    return parts.join(F.broadcast(stop), F.lower("value") == F.col("w"), "left_anti")


@query("SELECT CAST(0 AS BIGINT) AS violations")
def stop_word_guard(spark, sf_dir):
    """No stop word may match a term of a deny list."""
    stop = spark.createDataFrame([(w,) for w in D.STOP_WORDS], "w string")
    deny = spark.createDataFrame([(w,) for w in D.GENDERS + D.PROFESSIONS], "d string")
    return stop.join(deny, F.lower("w") == F.lower("d")).agg(F.count("*").alias("violations"))


@query(
    r"""WITH m AS (SELECT c_custkey AS id, '<PERSON_' || CAST(c_custkey % 12 AS VARCHAR) || '>' AS own, 'Rueckfrage zu <PERSON_' || CAST(c_custkey % 12 AS VARCHAR) || '> und <DE_PLZ_0>, danke.' AS text FROM customer)
    SELECT id, replace(text, own, ' ') AS probe, CAST(strpos(text, own) - 1 AS VARCHAR) AS fillers FROM m"""
)
def probe_builder(spark, sf_dir):
    """Only the placeholder that was given out is blanked; the other one is text."""
    own = F.concat(F.lit("<PERSON_"), (F.col("c_custkey") % 12).cast("string"), F.lit(">"))
    text = F.concat(F.lit("Rueckfrage zu "), own, F.lit(" und <DE_PLZ_0>, danke."))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), P.probe(text, F.array(own)).alias("p"))
    return made.select("id", F.col("p.text").alias("probe"), F.array_join(F.transform("p.fillers", lambda x: x.cast("string")), ",").alias("fillers"))


_TIER_TEXT = """(SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Frau Nord hat die Diagnose erhalten' WHEN 1 THEN 'Der Kunde verdient 4500 euro' WHEN 2 THEN 'Das Wort Diagnose steht hier allein' WHEN 3 THEN 'Streng vertraulich, sagt der Mitarbeiter'
 WHEN 4 THEN 'Religionsunterricht bei Herr Sued' ELSE 'Die Bestellung ist unterwegs' END AS text, CASE WHEN o_orderkey % 10 = 0 THEN 2 END AS level FROM orders)"""


def _tier_texts(spark, sf_dir):
    sql = _TIER_TEXT.strip()[1:-1].replace("FROM orders", "FROM {o}")
    return spark.sql(sql, o=table(spark, sf_dir, "orders"))


_TIER_SQL = f"""SELECT id, h AS heuristic_tier, CAST(greatest(h, coalesce(level, 1)) AS INTEGER) AS tier FROM (SELECT id, level, CAST(CASE id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS h FROM {_TIER_TEXT})"""


@query(_TIER_SQL)
def tier_classify(spark, sf_dir):
    return C.classify(_tier_texts(spark, sf_dir), level_col="level").select("id", "heuristic_tier", "tier")


@query(f"SELECT tier, CASE WHEN tier = 3 OR (tier = 2 AND id % 4 <> 0) THEN 'blocked' ELSE 'ok' END AS status, count(*) AS n FROM ({_TIER_SQL}) GROUP BY ALL")
def tier_gate_counts(spark, sf_dir):
    made = C.classify(_tier_texts(spark, sf_dir), level_col="level").withColumn("approved", F.col("id") % 4 == 0)
    return C.gate(made, "approved").groupBy("tier", "status").agg(F.count("*").alias("n"))


@query()
def tier_conversations(spark, sf_dir):
    return C.classify(spread(table(spark, sf_dir, "conversations")), signals=True).groupBy("role", "tier").agg(F.count("*").alias("n"), F.sum(F.size("matched_signals")).cast("long").alias("n_signals"))


_REGIONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PLZ_REGIONS.items())


@query(f"SELECT c_custkey AS id, CASE substr(lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0'), 1, 1) {_REGIONS} END AS region FROM customer")
def qi_generalize_plz(spark, sf_dir):
    plz = F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.generalize_plz(plz).alias("region"))


@query("SELECT c_custkey AS id, CASE WHEN y % 10 <= 2 THEN 'Anfang' WHEN y % 10 <= 6 THEN 'Mitte' ELSE 'Ende' END || ' der ' || CAST(y - y % 10 AS VARCHAR) || 'er' AS decade FROM (SELECT c_custkey, 1930 + c_custkey % 90 AS y FROM customer)")
def qi_generalize_birth_year(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.generalize_birth_year((1930 + F.col("c_custkey") % 90).cast("string")).alias("decade"))


@query(f"SELECT c_custkey AS id, CASE WHEN g <= 6 THEN 'unteres' WHEN g <= 11 THEN 'mittleres' ELSE 'gehobenes' END || ' {S.PAY_UNKNOWN}' AS band FROM (SELECT c_custkey, 1 + c_custkey % 16 AS g FROM customer)")
def qi_generalize_pay(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.generalize_pay_grade(F.concat(F.lit("TV-L E "), (1 + F.col("c_custkey") % 16).cast("string"))).alias("band"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 3 END AS threshold FROM customer")
def qi_threshold_presets(spark, sf_dir):
    preset = F.get(F.array(F.lit("utility"), F.lit("balanced"), F.lit("paranoid"), F.lit("other")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.threshold(preset).alias("threshold"))


def _event_types(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.array("event_type").alias("types"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT event_id, CAST(count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS INTEGER) AS n_types FROM events")
def qi_session_ttl(spark, sf_dir):
    return Q.accumulate(_event_types(spark, sf_dir), "user_id", "types", time="at", ttl=86400, kinds=("click", "error", "purchase", "signup", "view")).select("event_id", "n_types")


@query("SELECT event_id, CAST(count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS n_types, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) >= 3 AS generalise FROM events")
def qi_session_turns(spark, sf_dir):
    return Q.accumulate(_event_types(spark, sf_dir), "user_id", "types", order="event_id").select("event_id", "n_types", "generalise")


@query("SELECT c_custkey AS id, replace(replace('PLZ ' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || ', weiblich', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), CASE substr(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 1, 1) " + _REGIONS + " END), 'weiblich', '[Geschlecht anonymisiert]') AS text FROM customer")
def qi_apply(spark, sf_dir):
    plz = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("PLZ "), plz, F.lit(", weiblich")).alias("t"), F.array(F.struct(F.lit("DE_PLZ").alias("entity_type"), plz.alias("value")), F.struct(F.lit("DE_GENDER").alias("entity_type"), F.lit("weiblich").alias("value"))).alias("q"))
    return made.select("id", Q.apply(F.col("t"), F.col("q")).alias("text"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'sid:' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'sid:t' || CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 2 = 0 THEN 'apikey:' || o_orderstatus END AS key FROM orders")
def session_key_coalesce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), S.session_key(("sid", F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("")), ("sid", F.when(k % 3 == 1, F.concat(F.lit("t"), F.col("o_custkey").cast("string")))), ("apikey", F.when(k % 2 == 0, F.col("o_orderstatus")))).alias("key"))


@query("SELECT c_custkey AS id, sha256('sid:' || c_name) AS session_hash FROM customer")
def session_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), Q.session_hash(F.concat(F.lit("sid:"), "c_name")).alias("session_hash"))


@query("SELECT p_partkey AS id, len(list_intersect(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) >= 3), list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: length(x) >= 3))) > 0 AS leaks FROM part")
def leak_token_check(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.arrays_overlap(S.leak_tokens(F.col("p_name")), S.leak_tokens(F.col("p_type"))), F.lit(False)).alias("leaks"))


@query("SELECT p_partkey AS id, 'CUSTOM_' || trim(regexp_replace(upper(p_brand || '-' || p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS entity_type FROM part")
def entity_type_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.custom_entity_type(F.concat("p_brand", F.lit("-"), "p_type")).alias("entity_type"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS level, c_custkey % 7 = 0 AS approved FROM customer")
def level_and_approval(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.get(F.array(F.lit(None), F.lit("1"), F.lit(" 2 "), F.lit("3"), F.lit("hoch")), (k % 5).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.coalesce(S.requested_level(raw), F.lit(0)).alias("level"), S.approved(F.when(k % 7 == 0, F.lit(" Ja ")).otherwise(F.lit("nein"))).alias("approved"))


@query("SELECT o_orderkey AS id, regexp_full_match(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'call_' || CAST(o_orderkey AS VARCHAR) END, '[A-Za-z0-9_.:-]{1,128}') AS ok FROM orders")
def opaque_id_check(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("call_"), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.opaque_id_ok(value).alias("ok"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'external' WHEN 2 THEN 'empty' ELSE 'invalid' END AS outcome, CASE WHEN p_partkey % 4 = 0 THEN 'redact' ELSE 'block' END AS policy FROM part")
def image_data_url_outcome(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.base64(F.encode(F.col("p_name"), "UTF-8"))
    url = F.when(k % 4 == 0, F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(body, "\\s", ""))).when(k % 4 == 1, F.lit("https://host/x.png")).when(k % 4 == 2, F.lit("data:image/png;base64,")).otherwise(F.lit("data:image/png;base64,%%%%"))
    return table(spark, sf_dir, "part").select(k.alias("id"), S.data_url_outcome(url).alias("outcome"), V.image_policy(url, None, service=True).alias("policy"))


_MESSAGES = """(SELECT o_custkey AS request_id, o_orderkey AS msg, CASE o_orderkey % 9 WHEN 0 THEN '{"role":"user","content":"x","extra":1}' WHEN 1 THEN '{"role":"boss","content":"x"}' WHEN 2 THEN '{"role":"tool","content":"x","tool_call_id":"a b"}'
 WHEN 3 THEN '{"role":"user","content":[{"type":"video"}]}' WHEN 4 THEN '{"role":"user","content":5}' ELSE '{"role":"user","content":"ok","name":"n"}' END AS raw FROM orders)"""


@query(f"SELECT request_id, msg, CASE msg % 9 WHEN 0 THEN 'unknown_field' WHEN 1 THEN 'role' WHEN 2 THEN 'opaque_id' WHEN 3 THEN 'content_part' WHEN 4 THEN 'content' END AS reason_code, CASE WHEN bool_or(msg % 9 < 5) OVER (PARTITION BY request_id) THEN 'blocked' ELSE 'ok' END AS status FROM {_MESSAGES}")
def message_validate(spark, sf_dir):
    sql = _MESSAGES.strip()[1:-1].replace("FROM orders", "FROM o_rders").replace("{", "{{").replace("}", "}}").replace("FROM o_rders", "FROM {o}")
    return V.validate(spark.sql(sql, o=table(spark, sf_dir, "orders"))).select("request_id", "msg", "reason_code", "status")


@query("SELECT c_custkey AS id, substr(sha256('''' || c_mktsegment || ''''), 1, 8) AS fingerprint FROM customer")
def field_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.field_fingerprint(F.col("c_mktsegment")).alias("fingerprint"))


_CASES = "(SELECT c_custkey AS id, c_custkey % 3 AS kind, 5 + c_custkey % 4 AS shift FROM customer)"


def _cases(spark, sf_dir):
    """Cases of one PERSON at 10..20 (none in every third), with one finding that is shifted by 5 to 8."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), (F.col("c_custkey") % 3).alias("kind"), (5 + F.col("c_custkey") % 4).cast("int").alias("shift"))
    e = F.array(F.struct(F.lit("PERSON").alias("type"), F.lit("x").alias("value"), F.lit("must_detect").alias("expected_recall")))
    cases = c.withColumn("entities", F.when(F.col("kind") == 0, F.slice(e, 1, 0)).otherwise(e))
    truth = cases.where("kind > 0").select("case_id", F.lit(0).alias("gt"), F.lit("PERSON").alias("entity_type"), F.lit("must_detect").alias("expected"), F.lit(10).alias("start"), F.lit(20).alias("end"))
    found = cases.where("kind < 2 or shift < 7").select("case_id", F.lit(0).alias("pred"), F.lit("PERSON").alias("entity_type"), (10 + F.col("shift")).alias("start"), (20 + F.col("shift")).alias("end"))
    return cases, truth, found


_TALLY = f"""SELECT sum(CASE WHEN kind > 0 AND shift <= 5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN kind > 0 AND shift > 5 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS fp FROM {_CASES}"""


@query(f"SELECT t.entity_type, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, CAST(tp + fn AS BIGINT) AS support, CAST(tp AS DOUBLE) / (tp + fn) AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision FROM ({_TALLY}), (VALUES ('PERSON'), (NULL)) AS t(entity_type)")
def corpus_tallies_rollup(spark, sf_dir):
    cases, truth, found = _cases(spark, sf_dir)
    return E.tallies(truth, found, E.match(E.candidates(truth, found)), cases)


@query(f"SELECT count(*) AS negatives, CAST(count(*) AS BIGINT) AS disturbed, CAST(1.0 AS DOUBLE) AS disturbance FROM {_CASES} WHERE kind = 0")
def disturbance_rate(spark, sf_dir):
    cases, _, found = _cases(spark, sf_dir)
    return E.disturbance(cases, found)


@query(
    f"SELECT 'recall' AS target, e AS entity_type, CAST(tp AS DOUBLE) / (tp + fn) AS value FROM ({_TALLY}), (VALUES ('all'), ('PERSON')) AS t(e) WHERE CAST(tp AS DOUBLE) / (tp + fn) < 0.9 UNION ALL SELECT 'precision', 'all', CAST(tp AS DOUBLE) / (tp + fp) FROM ({_TALLY}) WHERE CAST(tp AS DOUBLE) / (tp + fp) < 0.9"
)
def gate_violations(spark, sf_dir):
    cases, truth, found = _cases(spark, sf_dir)
    return E.violations(E.tallies(truth, found, E.match(E.candidates(truth, found)), cases))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def stream_reassembly(spark, sf_dir):
    return ST.reassemble(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), ["conv_id"], seq="turn").select("conv_id", "text")


@query("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS pieces, text FROM conversations WHERE text <> ''")
def stream_shred(spark, sf_dir):
    torn = ST.shred(table(spark, sf_dir, "conversations"), F.col("text"), "conv_id", "turn")
    return torn.groupBy("conv_id", "turn").agg(F.count("*").alias("pieces"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("text"))


@query("SELECT s_suppkey AS id, 'CUSTOM_LIEFERANT' AS entity_type, s_name AS value, 4 AS start FROM supplier")
def custom_rule_native(spark, sf_dir):
    rule = R.build({"name": "lieferant", "entity": "Lieferant", "type": "regex", "value": r"Supplier#\d{9}", "examples": ["Supplier#000000001"]})
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("von "), "s_name", F.lit(".")).alias("text"))
    found = D.detect(s, entities=(), rules=R.native_patterns([rule]))
    return found.select("id", "text", F.explode("spans").alias("s")).select("id", F.col("s.entity_type").alias("entity_type"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.col("s.start").alias("start"))


@query("SELECT s_suppkey AS id, 'ok' AS rule_status, 1 AS n FROM supplier")
def custom_rule_scan(spark, sf_dir):
    rule = R.build({"name": "lieferant", "entity": "Lieferant", "type": "regex", "value": r"Supplier#\d{9}", "examples": ["Supplier#000000001"]})
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("von "), "s_name", F.lit(".")).alias("text"))
    return R.scan(s, [rule]).select("id", "rule_status", F.size("rule_spans").alias("n"))


@query("""SELECT c_custkey AS id, '{"plz": "<DE_PLZ_0>", "n": ' || CAST(c_custkey % 90 AS VARCHAR) || ', "list": [true, null, "<DE_PLZ_0> Ort"]}' AS masked, 'ok' AS json_status FROM customer""")
def json_argument_mask(spark, sf_dir):
    plz = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    raw = F.concat(F.lit('{"plz": "'), plz, F.lit('", "n": '), (F.col("c_custkey") % 90).cast("string"), F.lit(', "list": [true, null, "'), plz, F.lit(' Ort"]}'))
    return J.mask_arguments(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), raw.alias("arguments")), ("DE_PLZ",)).select("id", "masked", "json_status")


@query(f"SELECT id, CAST(round(sum(score) * 100) AS INTEGER) AS score, CAST(count(*) AS INTEGER) AS n FROM (SELECT id, 0.7 AS score FROM {_PERSON_SQL}) GROUP BY id")
def context_boost(spark, sf_dir):
    boosted = D.context_boost(D.detect(persons(spark, sf_dir), entities=("DE_PLZ",)))
    return boosted.select("id", F.explode(F.filter("spans", lambda s: s["score"] > 0.5)).alias("s")).groupBy("id").agg(F.round(F.sum("s.score") * 100).cast("int").alias("score"), F.count("*").cast("int").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS value, CAST(strpos(t, n_name) - 1 AS INTEGER) AS start FROM (SELECT n_nationkey, n_name, 'Ort: ' || n_name || ', Region ' || r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)")
def gazetteer_location(spark, sf_dir):
    """Place names from a table: an equality join on the name inside the text's fields, offsets by instr."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Ort: "), "n_name", F.lit(", Region "), "r_name").alias("t"))
    names = n.select(F.col("n_name").alias("value"))
    word = t.select("id", "t", F.regexp_extract("t", "Ort: ([^,]+),", 1).alias("value"))
    return word.join(F.broadcast(names), "value").select("id", "value", (F.instr(F.col("t"), F.col("value")) - 1).cast("int").alias("start"))


@query("SELECT o_custkey AS request_id, CASE WHEN count(*) > 0 THEN 1 END AS notices FROM orders GROUP BY o_custkey")
def notice_injection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    msgs = o.select(F.col("o_custkey").alias("request_id"), n.alias("msg_idx"), F.when(F.col("o_orderkey") % 5 == 0, "system").otherwise("user").alias("role"), F.lit("hi").alias("content"))
    told = P.inject_notice(msgs, msgs.select("request_id"))
    return told.groupBy("request_id").agg(F.count(F.when(F.col("content").contains(P.NOTICE), 1)).cast("int").alias("notices"))


@query("SELECT s_suppkey AS id, 'kategorie' AS category FROM supplier")
def qi_audit_roundtrip(spark, sf_dir):
    key = b"0123456789abcdef"
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), Q.encrypt_category(F.lit("kategorie"), key).alias("category_enc"))
    return Q.audit(s, key)


@query("SELECT c_custkey AS id, '<A_1>x<A_10>' AS masked, c_name || 'x' || c_mktsegment AS text FROM customer")
def reidentify_longest_first(spark, sf_dir):
    m = F.array(F.struct(F.lit("<A_1>").alias("placeholder"), F.col("c_name").alias("value")), F.struct(F.lit("<A_10>").alias("placeholder"), F.col("c_mktsegment").alias("value")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("<A_1>x<A_10>").alias("masked"), P.reidentify(F.lit("<A_1>x<A_10>"), m).alias("text"))

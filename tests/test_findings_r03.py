"""One test for each finding of round 3 that was right."""

import json
import random
import time

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.operators import detect as D
from veilspark.operators import gazetteer as G
from veilspark.operators import request as RQ
from veilspark.operators import spans as P
from veilspark.operators import tree as T
from veilspark.operators import validate as V
from veilspark.plans import catalog, protocol, replies, requests  # noqa: F401  (the last two add their queries)
from veilspark.session import spread
from veilspark.streaming import state as ST


def put(folder, **tables):
    """Tables (name: columns) as Parquet files in ``folder``, and a DuckDB connection that sees them."""
    con = duckdb.connect()
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def agree(spark, folder, con, name):
    """The query's rows, which are those of its SQL."""
    made = catalog.QUERIES[name](spark, str(folder))
    told = sorted(map(tuple, con.execute(f"SELECT {', '.join(f'q.{chr(34)}{c}{chr(34)}' for c in made.columns)} FROM ({catalog.ORACLES[name]}) AS q").fetchall()), key=repr)
    rows = sorted(map(tuple, made.collect()), key=repr)
    assert rows == told
    return rows


def test_f3_numbers_with_one_separator_between_them(spark, tmp_path):
    texts = ["030 1234567,+49 30 1234567\n0301234567", "0301234567\n0301234568x0301234569", "x0301234567_,0301234567_0301234567", None, ""]
    con = put(tmp_path, documents={"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    rows = agree(spark, tmp_path, con, "detect_phone")
    assert [sum(r[0] == i for r in rows) for i in range(len(texts))] == [3, 2, 1, 0, 0]


def test_f4_f5_equal_spans_fall_into_one_island_and_one_type(spark, tmp_path):
    spans = [("B", 0, 5, 0.5), ("A", 0, 5, 0.5), ("C", 4, 8, 0.4), ("C", 8, 9, 0.4)]
    assert P.sweep(spans) == P.sweep(spans[::-1]) == [("A", 0, 8, 0.5), ("C", 8, 9, 0.4)]
    flat = spark.createDataFrame([(i, *s) for i in range(20) for s in (spans if i % 2 else spans[::-1])], "id int, entity_type string, start int, end int, score double")
    assert {tuple(r) for r in P.islands(flat, ["id"]).select("start", "end", "entity_type").collect()} == {(0, 8, "A"), (8, 9, "C")}
    lines = [(doc, n, doc % 3 + k % 2 * 5, doc % 2) for doc in range(2000) for k, n in enumerate((1, 1, 2, 2, 3, 3, 4, 4))]
    con = put(tmp_path, lineitem={"l_orderkey": [x[0] for x in lines], "l_linenumber": pa.array([x[1] for x in lines], pa.int32()), "l_partkey": [x[2] for x in lines], "l_suppkey": [x[3] for x in lines]})
    assert agree(spark, tmp_path, con, "overlap_exact") == agree(spark, tmp_path, con, "overlap_islands")


def test_f1_names_with_one_first_word_and_texts_of_it(spark):
    names = spark.range(5000).select(F.concat(F.lit("Kunde#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.lit("PERSON").alias("entity_type"))
    texts = spark.createDataFrame([(i, " ".join(f"KUNDE  {i * 1000 + k:06d};" for k in range(1000))) for i in range(10)], "id int, text string")
    begun = time.monotonic()
    rows = G.find_names(texts, names, "id").select("id", "start", "end", "value").collect()
    # each of these words begins every name: rows of both that met by it took minutes
    assert time.monotonic() - begun < 60
    assert sorted(tuple(r) for r in rows) == [(i, k * 15, k * 15 + 13, f"KUNDE  {i * 1000 + k:06d}") for i in range(5) for k in range(1000)]


def test_f6_f7_a_table_in_one_piece_is_dealt_over_the_cores_and_look_behinds_find_the_same(spark, tmp_path):
    put(tmp_path, customer={"c_custkey": list(range(100)), "c_name": [f"Customer#{i:09d}" for i in range(100)]})
    assert catalog.persons(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert protocol._from_sql(spark, str(tmp_path), protocol._ARGUMENTS_SQL, "customer").rdd.getNumPartitions() > 1
    rng = random.Random(6)
    parts = ["geboren", " am", "Geb.", "GEBURTSDATUM", "jahrgang", "Geburtsjahr", " ", ":", "1", "19", "20", "1980", "2019", "1.2.80", "01.12.1999", ".", "x", "١", "\n", "ſ"]
    texts = ["".join(rng.choices(parts, k=8)) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, whole in (("birth_year", r"(?<=(?:geboren|jahrgang|geburtsjahr|geb\.)[ ]{0,4})(?:19\d{2}|20[0-2]\d)\b"), ("birth_date", r"(?<=(?:geboren(?:[ ]{1,8}am)?|geburtsdatum|geb\.)[ :]{0,4})\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})\b")):
        (own,) = (p for p in D.PATTERNS if p.name == name)
        assert own.regex.startswith("(?=")
        rows = df.select(F.regexp_extract_all("text", F.lit(own.flags + own.regex), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(own.flags + whole), F.lit(0)).alias("b")).collect()
        assert any(r["a"] for r in rows) and all(r["a"] == r["b"] for r in rows)


def test_f2_f9_a_pattern_is_searched_once(spark):
    found = D.detect(spark.createDataFrame([("PLZ 12345, Jahrgang 1980", 1), (None, 2), ("", 3)], "text string, id int"), entities=("DE_PLZ", "DE_GEBURTSJAHR"), score_threshold=0.3)
    spans = found.where(F.size("spans") > 0).select("id", F.explode("spans").alias("s"))
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    # one search for each pattern, whatever asks for the spans afterwards
    assert plan.count("regexp_extract_all(") == 2
    assert sorted((r["s"]["start"], r["s"]["end"]) for r in spans.collect()) == [(4, 9), (20, 24)]
    assert [len(r["spans"]) for r in found.orderBy("id").collect()] == [2, 0, 0]


def test_f10_replies_in_one_piece_are_dealt_over_the_cores(spark, tmp_path):
    n = 100
    con = put(tmp_path, customer={"c_custkey": list(range(n)), "c_name": [f"Customer#{i:09d}" for i in range(n)], "c_mktsegment": ["BUILDING"] * n})
    assert catalog.QUERIES["reply_restore"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Repartition") >= 1
    agree(spark, tmp_path, con, "reply_restore")


class Kept:
    """A stream's state as the function sees it."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.wait = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.wait = value, None

    def remove(self):
        self.value = self.wait = None

    def setTimeoutDuration(self, ms):
        self.wait = ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_f8_streams_travel_together_and_their_numbers_stay_whole(spark, tmp_path):
    big = 2**53
    deltas = spark.createDataFrame([(f"s{s}", big + k, "content", x, "stop" if k == 2 else None) for s in range(50) for k, x in enumerate((f"{s} <P", "_0> ", '"ä\n'))], "stream_id string, seq long, channel string, text string, finish_reason string")
    maps = spark.createDataFrame([(f"s{s}", "<P_0>", f'A"{s}') for s in range(0, 50, 2)], "stream_id string, placeholder string, value string")
    deltas.write.parquet(str(tmp_path / "deltas"))
    maps.write.parquet(str(tmp_path / "maps"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    done = ST.reidentify_streams(read("deltas", deltas), read("maps", maps))
    # a processor asks the state store for every stream by itself, over a socket
    assert "TransformWithState" not in done._jdf.queryExecution().logical().toString()
    done.writeStream.format("parquet").option("path", str(tmp_path / "said")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(120)
    said = spark.read.parquet(str(tmp_path / "said"))
    assert sorted({r["seq"] for r in said.collect()}) == [big, big + 1, big + 2]  # doubles of pandas lost the second one
    assert {r["stream_id"]: r["text"] for r in ST.reassemble(said, ["stream_id"]).collect()} == {f"s{s}": f'{s} ' + (f'A"{s}' if s % 2 == 0 else "<P_0>") + ' "ä\n' for s in range(50)}


def test_f8_silence_and_old_maps_in_the_state_of_a_stream():
    run, state = ST._keyed(100, 1000), Kept()
    row = lambda *x: json.dumps([None if v is None else str(v) for v in x])

    def feed(*rows):
        (frame,) = run(("s",), [pd.DataFrame({"packed": list(rows)})], state)
        return json.loads(frame["said"][0]) if len(frame) else []

    assert feed(row(None, None, None, None, None, "<P_0>", "Ada")) == [] and state.wait == 1000
    state.now = 10
    assert feed(row(2, "content", None, "d <P", None, None, None), row(1, "content", None, "<P_0> un", None, None, None)) == [["s", "content", None, 1, "Ada un", None], ["s", "content", None, 2, "d ", None]] and state.wait == 100
    state.now, state.hasTimedOut = 110, True
    assert feed() == [["s", "content", None, None, "<P", "idle"]] and state.wait == 890
    state.now, state.hasTimedOut = 900, False
    assert feed(row(3, "arguments", 4, "<P_0> <", None, None, None)) == [["s", "arguments", 4, 3, "Ada ", None]] and state.wait == 100
    state.now = 1000  # the map is too old now
    assert feed(row(4, "arguments", 4, "P_0>", "stop", None, None)) == [["s", "arguments", 4, 4, "<P_0>", "stop"]] and not state.exists


def test_f12_orders_in_one_piece_are_dealt_and_plain_messages_take_the_short_way(spark, tmp_path):
    n = 300
    con = put(tmp_path, orders={"o_orderkey": list(range(n)), "o_custkey": [i % 20 for i in range(n)], "o_orderdate": pa.array([i * 86400 * 10**6 * 7 for i in range(n)], pa.timestamp("us"))})
    agree(spark, tmp_path, con, "session_requests")
    assert spread(spark.read.parquet(str(tmp_path / "orders.parquet")), 1 << 20).rdd.getNumPartitions() >= 8
    assert spread(spark.range(10000), 1000).rdd.getNumPartitions() == 80
    # plain ones, and those that look like them: what the rules say about each has not changed
    messages = ['{"role": "user", "content": "a"}', '{"role": "x", "content": "a"}', '{"role": null, "content": "a"}', '{"role": "user", "content": 1}', '{"role": "user", "content": "a", "content": "b"}', '{"role": "user", "content": "a", "more": 1}', '{"content": "a"}', '{"role": "user"}', '"text"']
    told = spark.createDataFrame([(m,) for m in messages], "raw string").withColumn("v", F.try_parse_json("raw"))
    rows = told.select(V.is_plain(F.col("v")).alias("plain"), V.message_reason(F.col("raw"), parsed=F.col("v")).alias("reason")).collect()
    assert [r["plain"] for r in rows] == [True, True] + [False] * 7
    assert [r["reason"] for r in rows] == [None, "role", None, "content", "not_an_object", "unknown_field", None, None, "not_an_object"]


def test_f12_tokens_read_by_columns_are_those_of_the_rows():
    span = lambda k, a, b: {"entity_type": k, "start": a, "end": b, "score": 0.5, "general": None}
    rows = [[{"text": "abc", "spans": [span("A", 0, 1), span("B", 1, 2)]}, {"text": None, "spans": None}], None, [], [{"text": "x", "spans": []}], [{"text": "y", "spans": [span("C", 0, 1)]}]]
    kind = pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("general", pa.string())])
    made = pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(kind))])))
    for part in [made.slice(k) for k in range(6)] + [made.slice(k, 2) for k in range(5)]:
        assert list(P._unpacked(part)) == [r or [] for r in part.to_pylist()]


def test_f13_masked_fields_are_searched_once_and_one_field_blocks_its_request(spark, tmp_path, monkeypatch):
    # a content of three types is generalised, a field beside it masked, a hit that is left blocks
    n = 60
    con = put(tmp_path, customer={"c_custkey": list(range(n)), "c_name": [f"Customer#{i:09d}" for i in range(n)]})
    agree(spark, tmp_path, con, "mask_fields_beside_content")
    rows = [("a", 0, 0, "PLZ 12345, weiblich, Beruf Notarin", True), ("a", 0, 1, "12345", False), ("b", 0, 0, "Herr Nord, Diagnose 12345", True), ("b", 0, 1, "12345", False), ("c", 0, 0, "12345 und \x00 54321", True), ("c", 0, 1, None, None), ("d", 0, 0, "WEIBLICH 1234 12345", True), (None, 0, 0, "12345", True)]
    fields = spark.createDataFrame(rows, "request_id string, msg_idx int, field_idx int, text string, content boolean")
    plans = []
    kept = RQ.written
    monkeypatch.setattr(RQ, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    made = RQ.mask_fields(fields, ("DE_PLZ", "DE_GENDER", "DE_BERUF"), content="content")
    last = made._jdf.queryExecution().optimizedPlan().toString()
    # what was found is read by two plans, so neither may search for it again
    assert len(plans) == 2 and all("regexp_extract_all(" in p for p in plans) and "regexp_extract_all(" not in last
    told = {(r["request_id"], r["field_idx"]): (r["masked"], r["status"], r["reason_code"]) for r in made.collect()}
    assert told == {
        ("a", 0): (f"PLZ {S.PLZ_REGIONS['1']}, [Geschlecht anonymisiert], Beruf Notarin", "ok", None), ("a", 1): ("<DE_PLZ_0>", "ok", None), ("b", 0): (None, "blocked", "tier_3"), ("b", 1): (None, "blocked", "tier_3"),
        ("c", 0): ("<DE_PLZ_0> und \x00 <DE_PLZ_1>", "ok", None), ("c", 1): (None, "ok", None), ("d", 0): ("<DE_GENDER_0> 1234 <DE_PLZ_0>", "ok", None),
    }


def test_f13_words_are_looked_for_only_where_one_may_begin(spark):
    rng = random.Random(13)
    terms = ("Kunde", "stra", "männlich", "e.V", "ß", "intern")
    parts = ["Kunde", "KUNDE", "Kunde", "ſtra", "STRA", "Männlich", "MÄNNLICH", "e.v", "İntern", "ıntern", "intern", "ß", "ẞ", " ", "-", "_", "x", "١"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=4)),) for _ in range(4000)], "text string")
    plain = r"(?<!\w)(?:" + "|".join(D.quoted(t) for t in terms) + r")(?!\w)"
    assert D.whole_words(terms) == "(?=[Keimsß])" + plain and D.whole_words([""]) == r"(?<!\w)(?:)(?!\w)"
    rows = df.select(*(F.regexp_extract_all("text", F.lit("(?iU)" + rx), F.lit(0)).alias(n) for n, rx in (("a", D.whole_words(terms)), ("b", plain)))).collect()
    assert any(r["a"] for r in rows) and all(r["a"] == r["b"] for r in rows)


def test_f14_a_filter_on_the_status_makes_no_text_again_and_sizes_are_summed_once(spark):
    rows = ["x", None, "[1]", '"t"', '{"messages": {}}', '{"messages": 5}', '{"messages": null}', "{}", '{"messages": []}']
    long = [{"role": "user", "content": f"m{i} a{i % 3}@x.de"} for i in range(150)]
    call = {"role": "assistant", "content": "", "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"an": [' + ", ".join(f'"a{i % 4}@x.de", {i}' for i in range(100)) + ', "\\"ü"] }'}}]}
    rows.append(json.dumps({"messages": [*long, call]}))
    df = spark.createDataFrame(list(enumerate(rows)), "id int, raw string")
    made = T.mask_request_json(T.detected(df, entities=("EMAIL_ADDRESS",)), ("id",), entities=("EMAIL_ADDRESS",))
    plan = made.where("status = 'ok'")._jdf.queryExecution().optimizedPlan().toString()
    # the filter stands on what was made: neither the texts nor their search stand in it
    assert all("regexp_extract_all(" not in line and "zip_with(" not in line for line in plan.splitlines() if "Filter " in line)
    told = {r["id"]: r for r in made.collect()}
    assert [told[i]["reason_code"] for i in range(10)] == ["request"] * 4 + ["messages"] * 2 + [None] * 4
    assert [told[i]["masked"] for i in (6, 7, 8)] == ['{"messages":null}', "{}", '{"messages":[]}']
    masked = json.loads(told[9]["masked"])["messages"]
    assert [m["content"] for m in masked[:150]] == [f"m{i} <EMAIL_ADDRESS_{i % 3}>" for i in range(150)]
    assert masked[150]["tool_calls"][0]["function"]["arguments"] == '{"an": [' + ", ".join(f'"<EMAIL_ADDRESS_{i % 4}>", {i}' for i in range(100)) + ', "\\"ü"] }'
    reply = made.where("id = 9").select("id", F.regexp_replace(F.regexp_replace("masked", r'^\{"messages":\[', '{"choices":[{"message":'), r"\]\}$", "}]}").alias("raw"))
    reply = reply.select("id", F.replace(F.col("raw"), F.lit('},{"content"'), F.lit('}},{"message":{"content"')).alias("raw"))
    back = T.restore_replies(reply, made.select("id", requests._map_json(F.col("reid_map")).alias("reid")), "id").first()
    assert back["status"] == "ok" and [c["message"] for c in json.loads(back["restored"])["choices"]] == [*long, call]
    sums = spark.createDataFrame([([2, 3, 1],), ([],), (None,)], "n array<int>").select(T._offsets(F.transform("n", lambda x: x + 0)).alias("o"))
    assert [r["o"] for r in sums.collect()] == [[0, 2, 5], [], None]
    # every sum would else name the sizes, and so make them, again
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("transform(") <= 1

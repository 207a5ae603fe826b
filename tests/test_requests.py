import json

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect as D
from veilspark.operators import qi as Q
from veilspark.operators import spans as P
from veilspark.operators import tree as T
from veilspark.sources.sessions import SCHEMA, SessionStore, StoreConflict
from veilspark.streaming import state as ST

ENTITIES = ("EMAIL_ADDRESS", "DE_PLZ", "DE_GEBURTSJAHR", "DE_GENDER")


def request(*messages, **more):
    return json.dumps({"model": "m", **more, "messages": list(messages)}, ensure_ascii=False)


def masked(spark, raws, **options):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "request_id string, raw string")
    return {int(r["request_id"]): r for r in T.mask_request_json(T.detected(df, entities=ENTITIES), ("request_id",), entities=ENTITIES, **options).collect()}


def test_one_numbering_through_content_names_and_calls(spark):
    arguments = '{"b@y.de": ["a@x.de", 12345, true, null, 1.50], "q": "sagt \\"c@z.de\\"\\n"}'
    messages = [
        {"role": "system", "content": None, "name": "d@y.de", "refusal": "nein b@y.de", "reasoning_content": "zu a@x.de"},
        {"role": "user", "content": [{"type": "text", "text": "an a@x.de"}, {"type": "text", "text": "ohne"}]},
        {"role": "assistant", "content": "", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": arguments}}, {"function": {"name": "g"}}], "function_call": {"arguments": "x e@y.de {"}},
    ]
    same = [{"role": "user", "content": "a@x.de"}, {"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": '{"x":"b@y.de"}'}}]}]
    got = masked(spark, [request(*messages), request(*same)])
    tree = json.loads(got[0]["masked"])
    out = tree["messages"]
    assert tree["model"] == "m" and got[0]["status"] == "ok"
    assert (out[0]["name"], out[0]["refusal"], out[0]["reasoning_content"], out[0]["content"]) == ("<EMAIL_ADDRESS_0>", "nein <EMAIL_ADDRESS_1>", "zu <EMAIL_ADDRESS_2>", None)
    assert [p["text"] for p in out[1]["content"]] == ["an <EMAIL_ADDRESS_2>", "ohne"]
    assert out[2]["tool_calls"][0]["function"]["arguments"] == '{"<EMAIL_ADDRESS_1>": ["<EMAIL_ADDRESS_2>", "<DE_PLZ_0>", true, null, 1.50], "q": "sagt \\"<EMAIL_ADDRESS_3>\\"\\n"}'
    assert out[2]["tool_calls"][1] == {"function": {"name": "g"}} and out[2]["function_call"] == {"arguments": "x <EMAIL_ADDRESS_4> {"}
    reid = {m["placeholder"]: m["value"] for m in got[0]["reid_map"]}
    assert reid == {"<EMAIL_ADDRESS_0>": "d@y.de", "<EMAIL_ADDRESS_1>": "b@y.de", "<EMAIL_ADDRESS_2>": "a@x.de", "<DE_PLZ_0>": "12345", "<EMAIL_ADDRESS_3>": "c@z.de", "<EMAIL_ADDRESS_4>": "e@y.de"}
    # two values never share a placeholder, though one stands in content and one in arguments
    assert {m["value"] for m in got[1]["reid_map"]} == {"a@x.de", "b@y.de"} and '<EMAIL_ADDRESS_1>' in got[1]["masked"]


def test_requests_that_block(spark):
    user = {"role": "user", "content": "x"}
    call = lambda a: request({"role": "assistant", "content": "x", "tool_calls": [{"function": {"name": "f", "arguments": a}}]})
    raws = [None, "{", "[]", '{"messages": "x"}', request({"role": "boss", "content": "x"}), call('{"a": 1, "a": "p@q.de"}'), call('{"a": NaN}'), request({"role": "user", "content": "Frau Nord hat die Diagnose"}), call('{"grund": "Diagnose", "wer": "Patient"}'), request(user, "x"), '{"prompt": "x"}', request(), call('{"<EMAIL_ADDRESS_0>": 1, "p@q.de": 2}')]
    got = masked(spark, raws)
    assert [got[k]["reason_code"] for k in range(len(raws))] == ["request", "request", "request", "messages", "role", "arguments", "arguments", "tier_3", "tier_3", "not_an_object", None, None, "duplicate_key"]
    assert all((r["masked"] is None) == (r["status"] == "blocked") and (r["status"] == "ok" or r["reid_map"] == []) for r in got.values())


def test_approval_and_level(spark):
    raw = request({"role": "user", "content": "Streng vertraulich, sagt der Mitarbeiter"})
    assert masked(spark, [raw])[0]["reason_code"] == "tier_2_not_approved"
    assert masked(spark, [raw], approved=F.lit(True))[0]["status"] == "ok"
    assert masked(spark, [raw], approved=F.lit(True), level=F.lit(3))[0]["reason_code"] == "tier_3"


def test_replies_take_the_map_of_their_own_request(spark):
    reply = lambda t, a="{}": json.dumps({"choices": [{"message": {"role": "assistant", "content": t, "tool_calls": [{"function": {"name": "f", "arguments": a}}]}}]})
    rows = [("a", reply("<P_0> <P_10> <P_2>", '{"k": "<P_0>", "n":  1}')), ("b", reply("<P_0>")), ("c", reply("<P_0>")), ("d", reply("<P_0>")), ("e", "kein JSON <P_0>"), ("f", '{"choices": [ {"message": {"content": "nichts"}} ]}'), ("g", reply("<P_0>")), ("h", None), ("a", reply("noch <P_0>", "{ kaputt <P_0>"))]
    maps = [("a", json.dumps({"<P_0>": 'A"ä', "<P_10>": "zehn"})), ("b", json.dumps({"<P_0>": "B"})), ("d", '{"<P_0>": 1}'), ("e", "{}"), ("f", '{"<P_0>": "x"}'), ("g", '{"<P_0>": "1"}'), ("g", '{"<P_0>": "2"}'), ("h", "{}")]
    got = T.restore_replies(spark.createDataFrame(rows, "request_id string, raw string"), spark.createDataFrame(maps, "request_id string, reid string")).collect()
    told = {(r["request_id"], r["raw"]): r for r in got}
    message = lambda i, raw: json.loads(told[i, raw]["restored"])["choices"][0]["message"]
    assert message(*rows[0])["content"] == 'A"ä zehn <P_2>' and message(*rows[0])["tool_calls"][0]["function"]["arguments"] == '{"k": "A\\"ä", "n":  1}'
    assert message(*rows[8])["content"] == 'noch A"ä' and message(*rows[8])["tool_calls"][0]["function"]["arguments"] == '{ kaputt A\\"ä'
    assert message(*rows[1])["content"] == "B"
    assert {k[0]: told[k]["status"] for k in told} == {"a": "ok", "b": "ok", "c": "no_map", "d": "broken_map", "e": "broken_reply", "f": "ok", "g": "broken_map", "h": "broken_reply"}
    assert all(told[r]["restored"] == r[1] for r in rows if r[0] in "cdefgh")


def test_streams_take_their_own_map(spark, tmp_path):
    deltas = "stream_id string, seq long, channel string, call_index int, text string, finish_reason string"
    pieces = ["Hallo <PER", "SON_0> und <PERSON_1", "0>!", " <PER"]
    rows = [(s, k, "content", None, x, None) for s in "ab" for k, x in enumerate(pieces)]
    rows += [(s, 10 + k, "arguments", 0, x, None) for s in "ab" for k, x in enumerate(['{"a": "<PERS', 'ON_0>"}'])]
    rows += [(s, 20, None, None, None, "stop") for s in "ab"] + [("c", 0, "content", None, "x <PERSON_0> y", None)]
    spark.createDataFrame(rows, deltas).write.parquet(str(tmp_path / "deltas"))
    maps = "stream_id string, placeholder string, value string"
    spark.createDataFrame([("a", "<PERSON_0>", 'Anna "A"'), ("a", "<PERSON_10>", "Zehn")], maps).write.parquet(str(tmp_path / "maps"))
    opened = spark.createDataFrame([("b", "<PERSON_0>", "Bert")], maps)  # b was open before, and comes as initial state
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    done = ST.reidentify_streams(read("deltas", deltas), read("maps", maps), initial=opened)
    done.writeStream.format("parquet").option("path", str(tmp_path / "said")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination(120)
    said = spark.read.parquet(str(tmp_path / "said"))
    got = {(r["stream_id"], r["channel"]): r["text"] for r in ST.reassemble(said.where("text is not null"), ["stream_id", "channel"]).collect()}
    assert got == {
        ("a", "content"): 'Hallo Anna "A" und Zehn! <PER', ("a", "arguments"): '{"a": "Anna \\"A\\""}',
        ("b", "content"): "Hallo Bert und <PERSON_10>! <PER", ("b", "arguments"): '{"a": "Bert"}', ("c", "content"): "x <PERSON_0> y",
    }
    assert said.where("finish_reason = 'stop' and channel is null").count() == 2


def test_sessions_remember_types_until_they_expire(spark):
    at = lambda t: request({"role": "user", "content": t})
    rows = [("1", "s", 1000, at("PLZ 12345, a@x.de")), ("2", "s", 1050, at("weiblich")), ("3", "s", 1099, at("Jahrgang 1985 und PLZ 12345")), ("4", "s", 1140, at("nur Jahrgang 1985")), ("5", "s", 1145, at("nichts")), ("6", "t", 1099, at("Jahrgang 1985")), ("7", None, 1099, at("weiblich, PLZ 12345, Jahrgang 1985")), ("8", None, 1099, at("weiblich"))]
    made = {r["request_id"]: r for r in T.mask_sessions(spark.createDataFrame(rows, "request_id string, session string, at long, raw string"), ttl=100, entities=ENTITIES).collect()}
    text = {k: json.loads(r["masked"])["messages"][0]["content"] for k, r in made.items()}
    assert text["1"] == "PLZ 12345, <EMAIL_ADDRESS_0>" and text["2"] == "weiblich"
    assert text["3"].startswith("Mitte der 1980er und PLZ ".replace("Mitte", "Jahrgang Mitte")) and "12345" not in text["3"]
    assert made["4"]["generalised"] and "1985" not in text["4"]  # 12345 was renewed at 1099
    assert not made["5"]["generalised"] and not made["6"]["generalised"] and text["6"] == "Jahrgang 1985"
    assert made["7"]["generalised"] and text["8"] == "weiblich"


def records(spark, rows):
    return spark.createDataFrame([(s, k, bytes([v]), float(t)) for s, k, v, t in rows], SCHEMA)


def test_session_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "store"), 8)
    assert store.read().count() == 0 and store.expire(0, 0) == [] and store.upsert(records(spark, [])) == []
    store.upsert(records(spark, [(f"s{k}", "A", k, 10) for k in range(40)]))
    before = store.manifest()[1]
    touched = store.upsert(records(spark, [("s1", "A", 99, 20), ("s1", "B", 7, 20), ("s1", "A", 50, 5)]))
    after = store.manifest()[1]
    assert len(touched) == 1 and {k for k in after if after[k] != before.get(k)} == set(touched)
    assert {(r["qi_type"], bytes(r["category_enc"])[0], r["created_at"]) for r in store.read().where("session_hash = 's1'").collect()} == {("A", 99, 20.0), ("B", 7, 20.0)}
    assert store.read().count() == 41
    seen = store.seen(spark.createDataFrame([("s1",), ("s2",), ("zz",)], "session_hash string"), F.lit(25.0), 10)
    assert {r["session_hash"]: r["seen"] for r in seen.collect()} == {"s1": ["A", "B"]}
    assert store.expire(25, 10) and store.read().count() == 2
    assert store.vacuum() >= 1 and store.read().count() == 2


def test_session_store_survives_a_crash_and_refuses_a_second_writer(spark, tmp_path, monkeypatch):
    store = SessionStore(spark, str(tmp_path / "store"), 4)
    store.upsert(records(spark, [("a", "A", 1, 1), ("b", "A", 1, 1)]))
    monkeypatch.setattr(SessionStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.upsert(records(spark, [("a", "A", 2, 2)]))
    monkeypatch.undo()
    assert {bytes(r["category_enc"])[0] for r in store.read().collect()} == {1}  # data was written, but no manifest names it
    start = store.manifest()
    store.upsert(records(spark, [("a", "A", 3, 3)]))
    with pytest.raises(StoreConflict):
        store._rewrite(start, [0, 1, 2, 3], records(spark, [("a", "A", 4, 4)]))
    assert {r["session_hash"]: bytes(r["category_enc"])[0] for r in store.read().collect()} == {"a": 3, "b": 1}
    with pytest.raises(ValueError):
        SessionStore(spark, str(tmp_path / "store"), 5).read()
    assert store.audit(b"0123456789abcdef").select("category").distinct().collect()[0][0] == "[nicht lesbar]"
    assert Q.expire(store.read(), F.lit(3.0), 0).count() == 1


def test_very_many_hits_in_one_text(spark):
    n = 50_000
    df = spark.createDataFrame([(" ".join(f"a{k % 7}@x.de" for k in range(n)),), (None,), ("",)], "text string")
    got = P.mask_rows(D.detect(df, entities=("EMAIL_ADDRESS",)))
    rows = got.collect()
    assert rows[0]["masked"].split() == [f"<EMAIL_ADDRESS_{k % 7}>" for k in range(n)] and len(rows[0]["reid_map"]) == 7
    assert [(r["masked"], r["reid_map"]) for r in rows[1:]] == [(None, []), ("", [])]
    starts = [s["start"] for s in rows[0]["spans"]]
    assert len(starts) == n and starts == [k * 8 for k in range(n)]

import json

import pytest
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.operators import classify as C
from veilspark.operators import evaluate as E
from veilspark.operators import jsonargs as J
from veilspark.operators import qi as Q
from veilspark.operators import rules as R
from veilspark.operators import validate as V
from veilspark.sources import io
from veilspark.streaming import state as ST


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_generalisers(spark):
    assert one(spark, S.generalize_plz(F.lit("50667"))).startswith("Region Nordrhein-Westfalen (Süd)")
    assert [one(spark, S.generalize_birth_year(F.lit(y))) for y in ("1972", "1973", "1977", "19")] == ["Anfang der 1970er", "Mitte der 1970er", "Ende der 1970er", "unbekanntes Jahrzehnt"]
    assert one(spark, S.generalize_pay_grade(F.lit("E 12"))).startswith("gehobenes")
    assert one(spark, S.state_category(F.lit("DE_BERUF"), F.lit("Notar"))) == "Berufsangabe (Kategorie)"
    assert one(spark, S.opaque_id_ok(F.lit("a\n"))) is False
    assert one(spark, S.custom_entity_type(F.lit(" Straße 1 "))) == "CUSTOM_STRASSE_1"
    assert one(spark, S.data_url_outcome(F.lit(None).cast("string"))) == "external"


def test_tiers(spark):
    rows = [("Frau Nord hat Krebs", 3), ("Religionsunterricht bei Herr Sued", 1), ("Mein Gehalt: der Kunde verdient 4500 euro", 2), ("Diagnose", 1), (None, 1)]
    got = C.classify(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()
    assert [r["tier"] for r in got] == [t for _, t in rows]
    raised = C.gate(C.classify(spark.createDataFrame([("x", 3)], "text string, level int"), level_col="level")).first()
    assert (raised["tier"], raised["status"]) == (3, "blocked")


def test_session_ttl_bound_is_closed(spark):
    turns = spark.createDataFrame([("s", ["A"], 1000), ("s", ["B"], 1100), ("s", ["C"], 1201), (None, ["D"], 1201)], "session string, types array<string>, at long")
    got = {(r["session"], r["at"]): r["n_types"] for r in Q.accumulate(turns, "session", "types", time="at", ttl=100).collect()}
    assert got == {("s", 1000): 1, ("s", 1100): 2, ("s", 1201): 1, (None, 1201): 1}
    with pytest.raises(ValueError):
        Q.encrypt_category(F.lit("x"), b"")


def test_json_arguments():
    m = lambda: J.Masker(J.compiled((("PLZ", r"\b\d{5}\b", 0.5, "", None),)))
    assert m().arguments('{"a": "50667", "n": 50667, "t": true}') == ('{"a": "<PLZ_0>", "n": "<PLZ_0>", "t": true}', "ok")
    assert m().arguments('{"a":  "x"}') == ('{"a":  "x"}', "ok")
    assert m().arguments('{"a": 1, "a": 2}')[1] == "blocked:duplicate_key"
    assert m().arguments('{"a": NaN}')[1] == "blocked:not_a_number"
    assert m().arguments("{broken 50667")[0] == "{broken <PLZ_0>"
    deep = "[" * 80 + "]" * 80
    assert m().arguments(deep)[1].startswith("blocked")
    assert json.loads(J.reidentify_json('{"k": "<PLZ_0>"}', {"<PLZ_0>": 'a"b'})) == {"k": 'a"b'}


def test_messages(spark):
    rows = [(1, '{"role":"user","content":"x"}'), (1, '{"role":"user","content":null,"tool_calls":[{"id":"a","type":"function","function":{"name":"f","arguments":"{}"}}]}'), (2, '{"role":"user","content":"x"}'), (2, '{"role":"user","content":[{"type":"video"}]}'), (3, "[]"), (4, '{"role":"user","content":[]}'), (5, '{"role":"user","content":"x","tool_calls":[{"id":"a","evil":1}]}')]
    got = V.validate(spark.createDataFrame(rows, "request_id int, raw string")).select("request_id", "reason_code", "status").collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, None, "ok"), (2, None, "blocked"), (2, "content_part", "blocked"), (3, "not_an_object", "blocked"), (4, None, "ok"), (5, "tool_calls", "blocked")}


def test_rules(tmp_path, spark):
    good = {"name": "projekt", "entity": "Projektname", "type": "term", "value": "Nordwind", "examples": ["der Nordwind weht"], "counter_examples": ["Nordwinde"]}
    made = R.load({"rules": [good, good, {"name": "x"}, good | {"name": "leak", "entity": "Nordwind Kunde"}, good | {"name": "off", "enabled": False}]})
    assert [r.name for r in made.active] == ["projekt"] and len(made.quarantined) == 3
    assert not any("ordwind" in why for _, why in made.quarantined)
    assert R.scan_text([("T", R.Rule("a", "b", "regex", r"(a+)+$", 0.5).compiled(), 0.5)], "a" * 40 + "b", budget=0.2) in (None, [])
    store = io.RuleFile(tmp_path / "rules.json")
    store.add(good)
    with pytest.raises(R.RuleError):
        store.add(good)
    assert store.describe()["active"][0]["entity"] == "CUSTOM_PROJEKTNAME" and store.permission_warning() is None
    (tmp_path / "rules.json").write_text("{")
    assert [r.name for r in store.get().active] == ["projekt"] and store.error
    got = R.scan(spark.createDataFrame([("Nordwind",), (None,), ("",)], "text string"), made.active).collect()
    assert [len(r["rule_spans"]) for r in got] == [1, 0, 0]


def test_evaluation(spark):
    cases = io.corpus(spark, [{"id": "a", "text": "Max Muster kam", "entities": [{"type": "PERSON", "value": "Max Muster"}]}, {"id": "b", "text": "leer", "entities": []}])
    truth = E.ground_truth(cases)
    found = spark.createDataFrame([("a", 0, "PERSON", 0, 6), ("a", 1, "PERSON", 4, 10), ("b", 0, "PERSON", 0, 4)], "case_id string, pred int, entity_type string, start int, end int")
    matched = E.match(E.candidates(truth, found))
    assert matched.count() == 1
    total = [r for r in E.tallies(truth, found, matched, cases).collect() if r["entity_type"] is None][0]
    assert (total["tp"], total["fn"], total["fp"], total["recall"], total["precision"]) == (1, 0, 1, 1.0, 0.5)
    assert E.disturbance(cases, found).first()["disturbance"] == 1.0
    assert E.disturbance(cases.where("case_id = 'a'"), found).first()["disturbance"] is None


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50])
def test_any_chunking_gives_the_whole_text(step):
    reid = {"<PERSON_1>": "Ada", "<PERSON_10>": "Bob"}
    text = "x <PERSON_1> y <PERSON_10> z <PERSON_2> <PER"
    w = ST.Window(reid)
    out = "".join(w.feed(text[i : i + step]) for i in range(0, len(text), step)) + w.flush()
    assert out == "x Ada y Bob z <PERSON_2> <PER"


def test_stream(spark, tmp_path):
    rows = [("s", "content", 0, k, c, "stop" if k == 8 else None) for k, c in enumerate("a<P_0>b c")]
    schema = "stream_id string, channel string, call_index int, seq long, text string, finish_reason string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ST.reidentify_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"<P_0>": "Ada"}).writeStream.format("memory").queryName("reid_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "".join(r["text"] for r in spark.table("reid_out").orderBy("seq").collect()) == "aAdab c"


def test_reports_are_whole_or_refused(spark, tmp_path):
    path = tmp_path / "report.json"
    io.write_report(spark.range(10_000), str(path))
    assert len(json.loads(path.read_text())) == 10_000
    path.unlink()
    with pytest.raises(ValueError):
        io.write_report(spark.range(10_001), str(path))
    assert not path.exists()


def test_session_state_and_idle_flush(spark, tmp_path):
    spark.createDataFrame([("a", 0.0, "x"), ("a", 5.0, "y"), ("a", 50.0, "x"), ("b", 1.0, "x")], "session string, at double, qi_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema("session string, at double, qi_type string").parquet(str(tmp_path / "in"))
    q = ST.session_types_stream(turns, ttl=20.0, threshold=2).writeStream.format("memory").queryName("session_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("session_out").collect()} == {("a", 0.0, 1, False), ("a", 5.0, 2, True), ("a", 50.0, 1, False), ("b", 1.0, 1, False)}
    schema = "stream_id string, channel string, call_index int, seq long, text string, finish_reason string"
    spark.createDataFrame([("s", "content", 0, 0, "a <P_", None)], schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    deltas = ST.reidentify_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "d")), {"<P_0>": "Ada"}, idle_ms=1)
    q = deltas.writeStream.format("memory").queryName("idle_out").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            rows = spark.table("idle_out").collect()
            if len(rows) > 1:
                break
    finally:
        q.stop()
    assert [(r["text"], r["finish_reason"]) for r in rows] == [("a ", None), ("<P_", "idle")]

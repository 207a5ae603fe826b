import random

from pyspark.sql import functions as F

from veilspark.operators import detect as D
from veilspark.operators import spans as P


def found(spark, text, entity):
    df = D.detect(spark.createDataFrame([(text,)], "text string"), entities=(entity,))
    return [text[s["start"] : s["end"]] for s in df.first()["spans"]]


def test_detectors(spark):
    assert found(spark, "Az. 3 O 12/99 und HRB 4711", "DE_HANDELSREGISTER") == ["HRB 4711"]
    assert found(spark, "Az. 3 O 12/99", "DE_AKTENZEICHEN") == ["3 O 12/99"]
    assert found(spark, "Jahrgang 1980, Raum 1990", "DE_GEBURTSJAHR") == ["1980"]
    assert found(spark, "geboren am 01.02.1980", "DE_GEBURTSDATUM") == ["01.02.1980"]
    assert found(spark, "Karte 4111 1111 1111 1111 und 4111 1111 1111 1112", "CREDIT_CARD") == ["4111 1111 1111 1111"]
    assert found(spark, "IBAN DE89 3704 0044 0532 0130 00", "IBAN_CODE") == ["DE89 3704 0044 0532 0130 00"]
    assert found(spark, "die Bürgermeisterin kam", "DE_BERUF") == ["Bürgermeisterin"]
    assert found(spark, "für 30 Euro", "DE_TVOED_STUFE") == []
    assert found(spark, "Müller & Söhne Handels GmbH", "DE_FIRMA") == ["Müller & Söhne Handels GmbH"]
    assert found(spark, "😀 a@b.de", "EMAIL_ADDRESS") == ["a@b.de"]
    assert found(spark, "   ", "DE_PLZ") == []


def test_ner_hook_and_allow_list(spark):
    df = spark.createDataFrame([("Herr Dr. Max Muster, Bestellnummer",)], "text string")
    spans = D.detect(df, entities=(), ner=D.honorific_person_spans()).first()["spans"]
    assert [s["entity_type"] for s in spans] == ["PERSON"]
    assert len(D.detect(df, entities=(), ner=D.honorific_person_spans(), allow_list=("Dr. Max Muster",)).first()["spans"]) == 0


def test_resolution_covers_and_matches_the_sweep(spark):
    rng = random.Random(3)
    cases = []
    for k in range(300):
        scores = rng.sample(range(1, 100), 6)
        cases.append((k, [(f"T{i}", a := rng.randrange(30), a + rng.randrange(1, 9), scores[i] / 100) for i in range(rng.randrange(1, 6))]))
    df = spark.createDataFrame(cases, f"id int, spans array<{D.SPAN}>")
    native = {r["id"]: [(s["entity_type"], s["start"], s["end"]) for s in r["r"]] for r in df.select("id", P.resolve(F.col("spans")).alias("r")).collect()}
    exact = {r["id"]: [(s["entity_type"], s["start"], s["end"]) for s in r["spans"]] for r in P.resolve_exact(df).collect()}
    flat = df.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    windows = {}
    for r in P.islands(flat, ["id"]).collect():
        windows.setdefault(r["id"], []).append((r["entity_type"], r["start"], r["end"]))
    for k, own in cases:
        assert [x[1:] for x in native[k]] == [x[1:] for x in exact[k]] == [x[1:] for x in sorted(windows[k], key=lambda x: x[1])]
        covered = {i for _, a, b in native[k] for i in range(a, b)}
        assert covered == {i for _, a, b, _ in own for i in range(a, b)}
    same = sum(native[k] == exact[k] == sorted(windows[k], key=lambda x: x[1]) for k, _ in cases)
    assert same == len(cases)


def test_mask_and_back(spark):
    texts = ["an a@b.de und c@d.de und a@b.de", "nichts", "1.2.3.4 a@b.de", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    done = P.mask_rows(D.detect(df, entities=("EMAIL_ADDRESS", "IP_ADDRESS"))).withColumn("back", P.reidentify(F.col("masked"), F.col("reid_map"))).collect()
    assert done[0]["masked"] == "an <EMAIL_ADDRESS_0> und <EMAIL_ADDRESS_1> und <EMAIL_ADDRESS_0>"
    assert all(r["back"] == r["text"] for r in done)


def test_probe_and_artifacts(spark):
    p = spark.range(1).select(P.probe(F.lit("<A_0>x<B_12> y"), F.array(F.lit("<A_0>"), F.lit("<B_12>"))).alias("p")).first()["p"]
    assert (p["text"], p["fillers"]) == (" x  y", [0, 2])
    art = lambda a, b: spark.range(1).select(P.is_artifact(F.lit(a), F.lit(b), F.lit(p["text"]), F.array(*map(F.lit, p["fillers"])))).first()[0]
    assert art(0, 1) and art(2, 4) and not art(0, 2) and not art(1, 1) and not art(3, 4)


def test_json_escape_and_integrity(spark):
    r = spark.range(1).select(P.json_escaped(F.lit('a"b\nc')), P.placeholders_kept(F.lit("<A_0> <A_0>"), F.lit("<A_0>"))).first()
    assert r[0] == 'a\\"b\\nc' and r[1] is False

import base64
import json

from veilspark.operators import images as I
from veilspark.operators import isolate as L

PNG = lambda b: "data:image/png;base64," + base64.b64encode(b).decode()


def service():
    """A client made in place, as workers don't import this module: it fails the first time it is asked, and always on a bad image."""
    bad, none = b"bad", b"none"

    def make():
        calls = []

        def send(images):
            calls.append(len(images))
            if len(calls) == 1 or any(b == bad for _, b in images):
                raise OSError("down")
            return [None if b == none else b"#" + b for _, b in images]

        return send

    return make


def test_images_are_sent_in_batches_and_block_alone(spark, monkeypatch):
    monkeypatch.setattr(I, "BATCH_IMAGES", 3)
    urls = [PNG(b"one"), "https://x/y.png", "", None, "data:image/png;base64,", "data:image/png;base64,%%%", PNG(b"bad"), PNG(b"none"), PNG(b"two"), "data:;base64," + base64.b64encode(b"three").decode(), "data:image/gif;base64,QQ==="]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "id int, url string, status string").coalesce(1)
    got = {r["id"]: (r["redacted"], r["status"], r["reason_code"]) for r in I.redact_images(df, service()).collect()}
    assert [got[i][2] for i in range(len(urls))] == [None, "external", "no_url", "no_url", "empty", "invalid", "service", "no_answer", None, None, "invalid"]
    assert got[0][0] == PNG(b"#one") and got[9][0] == PNG(b"#three") and all((r is None) == (s == "blocked") for r, s, _ in got.values())
    assert I.redact_images(df.limit(0), service()).count() == 0


def test_requests_get_their_images_back(spark):
    ask = lambda *parts: json.dumps({"messages": [{"role": "user", "content": list(parts)}, {"role": "user", "content": "x"}]})
    rows = [("a", ask({"type": "text", "text": "t"}, {"type": "image_url", "image_url": PNG(b"one")}, {"type": "image_url", "image_url": {"url": PNG(b"one"), "detail": "low"}})), ("b", ask({"type": "image_url", "image_url": PNG(b"bad")}, {"type": "image_url", "image_url": PNG(b"two")})), ("c", '{"messages": [ ]}'), ("d", None), ("e", ask({"type": "image_url"}))]
    got = {r["request_id"]: r for r in I.redact_requests(spark.createDataFrame(rows, "request_id string, raw string"), service()).collect()}
    parts = json.loads(got["a"]["raw"])["messages"][0]["content"]
    assert parts == [{"text": "t", "type": "text"}, {"image_url": PNG(b"#one"), "type": "image_url"}, {"image_url": {"detail": "low", "url": PNG(b"#one")}, "type": "image_url"}]
    assert {k: (r["status"], r["reason_code"]) for k, r in got.items()} == {"a": ("ok", None), "b": ("blocked", "service"), "c": ("ok", None), "d": ("ok", None), "e": ("blocked", "no_url")}
    assert got["c"]["raw"] == '{"messages": [ ]}' and got["b"]["raw"] is None and got["d"]["raw"] is None


def test_a_failing_row_stays_alone(spark):
    def layer(rows):
        for x, _ in rows:
            if x is None or x < 0:
                raise ValueError(f"secret {x}")
        return [[str(x), y] if x != 3 else 3 for x, y in rows]

    df = spark.createDataFrame([(1, "a"), (-1, "b"), (2, None), (None, "c"), (3, "d")], "x int, y string").coalesce(1)
    made = L.isolated(df, ["x", "y"], layer, "array<string>", "o")
    got = [(r["o"]["value"], r["o"]["error"]) for r in made.collect()]
    assert got[:4] == [(["1", "a"], None), (None, "ValueError"), (["2", None], None), (None, "ValueError")] and got[4][0] is None and got[4][1].startswith("Arrow")
    blocked = L.block_failed(made, "o", "detector").select("status", "reason_code").collect()
    assert [tuple(r) for r in blocked] == [("ok", None), ("blocked", "detector"), ("ok", None), ("blocked", "detector"), ("blocked", "detector")]
    short = L.isolated(df, ["x"], lambda rows: rows[1:], "int", "o").select("o.error").distinct().collect()
    assert [r[0] for r in short] == ["LengthError"]
    kept = L.keep_failed(L.isolated(df, ["y"], lambda rows: [None if y == "a" else y.upper() for (y,) in rows], "string", "o"), "o", "y").select("y").collect()
    assert [r[0] for r in kept] == ["a", "B", None, "C", "D"]

"""Sources and sinks: requests, rule files, labelled corpora, session tables, reports."""

from __future__ import annotations

import json
import os
import stat
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators.classify import Keywords
from ..operators.jsonargs import Masker

# Call types that are processed.
CALL_TYPES = ("completion", "text_completion", "acompletion")
MAX_REPORT_ROWS = 10_000


def requests(spark: SparkSession, path: str, fmt: str = "json", stream: bool = False) -> DataFrame:
    """Requests as raw lines of JSON (batch or stream), so that unknown fields stay visible."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "raw") if fmt == "json" else reader.format(fmt).load(path)


def messages(raw: DataFrame, request_col: str = "request_id") -> DataFrame:
    """(request, msg_idx, raw, status) of requests that are processed, one row per message.

    Requests without messages give none.  Where ``messages`` is no array, or
    the request no JSON object, nothing could be checked: the request gives one
    row without a message and with status ``blocked``.
    """
    v = F.try_parse_json("raw")
    known = F.try_variant_get(v, "$.call_type", "string")
    open_ = raw.where(v.isNull() | known.isNull() | known.isin(*CALL_TYPES)).withColumn("_v", F.try_parse_json("raw"))
    given = F.schema_of_variant(F.try_variant_get("_v", "$.messages", "variant"))
    object_ = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False))
    bad = ~object_ | ~F.coalesce((given == "VOID") | given.startswith("ARRAY<"), F.lit(True))
    parts = F.transform(F.try_variant_get("_v", "$.messages", "array<variant>"), lambda m: F.to_json(m))
    rows = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(parts)
    out = open_.select(request_col, bad.alias("_bad"), F.posexplode(rows).alias("msg_idx", "raw"))
    return out.select(request_col, "msg_idx", "raw", F.when(F.col("_bad"), "blocked").otherwise("ok").alias("status"))


def write_session_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def corpus(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Labelled cases, checked: ids unique, values in their texts, known expectations."""
    seen = set()
    for c in cases:
        if c["id"] in seen:
            raise ValueError(f"case {c['id']} occurs twice")
        seen.add(c["id"])
        for e in c.get("entities") or []:
            if e["value"] not in c["text"] or not e["value"]:
                raise ValueError(f"case {c['id']}: a value is not in the text")
            if e.get("expected_recall", "must_detect") not in ("must_detect", "known_gap"):
                raise ValueError(f"case {c['id']}: unknown expectation")
    rows = [(c["id"], c["text"], [(e["type"], e["value"], e.get("expected_recall", "must_detect")) for e in c.get("entities") or []]) for c in cases]
    return spark.createDataFrame(rows, "case_id string, text string, entities array<struct<type:string,value:string,expected_recall:string>>")


def write_report(df: DataFrame, path: str) -> None:
    """Bounded metric rows as UTF-8 JSON; more than ``MAX_REPORT_ROWS`` are an error and nothing is written."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"the report has more than {MAX_REPORT_ROWS} rows; write the table with Spark")
    Path(path).write_text(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2), encoding="utf-8")


class RuleFile:
    """A rule file that is read again only when its time or size changes; a bad or missing file keeps the last good rules and says so in ``error``."""

    def __init__(self, path: str | os.PathLike):
        self.path, self.rules, self.key, self.error, self.loaded = Path(path), R.RuleSet(), None, None, False

    def get(self) -> R.RuleSet:
        try:
            s = self.path.stat()
            key = (s.st_mtime_ns, s.st_size)
            if key != self.key:
                self.rules, self.error = R.load(_parse(self.path.read_text(encoding="utf-8"))), None
                self.key, self.loaded = key, True
        except FileNotFoundError as e:
            # a file that was never there has no rules; one that goes away takes none with it
            self.key, self.error = None, type(e).__name__ if self.loaded else None
        except (OSError, ValueError) as e:
            self.error = type(e).__name__
        return self.rules

    def permission_warning(self) -> str | None:
        try:
            return "the rule file is readable by others" if stat.S_IMODE(self.path.stat().st_mode) & 0o077 else None
        except OSError:
            return None

    def document(self) -> list[dict]:
        raw = _parse(self.path.read_text(encoding="utf-8")) if self.path.exists() else None
        return list((raw.get("rules") if isinstance(raw, dict) else raw) or [])

    def save(self, rules: list[dict]) -> None:
        """Whole file at once, for its owner only."""
        fd, name = tempfile.mkstemp(dir=self.path.parent, prefix=".rules-")
        with os.fdopen(fd, "w", encoding="utf-8") as file:
            json.dump({"rules": rules}, file, ensure_ascii=False, indent=2)
        os.chmod(name, 0o600)
        os.replace(name, self.path)

    def add(self, rule: dict) -> None:
        R.build(rule)
        own = self.document()
        if any(r.get("name") == rule["name"] for r in own):
            raise R.RuleError("name exists")
        self.save([*own, rule])

    def remove(self, name: str) -> None:
        own = self.document()
        left = [r for r in own if r.get("name") != name]
        if len(left) == len(own):
            raise R.RuleError("no such rule")
        self.save(left)

    def preview(self, text: str) -> tuple[list[dict], str]:
        """(findings of the active rules by place, the text as it would leave); a text whose scan takes too long is refused."""
        named = {(R.entity_type(r.entity), r.compiled().pattern): r.name for r in self.get().active}
        patterns = [(R.entity_type(r.entity), r.compiled(), r.score) for r in self.rules.active]
        found = R.scan_text(patterns, text)
        if found is None:
            raise R.RuleError("the scan takes too long")
        hits = [{"name": named[k, rx.pattern], "entity_type": k, "start": a, "end": b} for kind, rx, score in patterns for k, a, b, _ in R.scan_text([(kind, rx, score)], text) or ()]
        return sorted(hits, key=lambda h: (h["start"], h["end"], h["name"])), Masker((k, rx, s, None) for k, rx, s in patterns).mask(text)

    def describe(self) -> dict:
        rules = self.get()
        return {"active": [{"name": r.name, "entity": R.entity_type(r.entity), "type": r.kind, "score": r.score} for r in rules.active], "quarantined": [{"name": n, "reason": w} for n, w in rules.quarantined], "load_error": self.error, "permission_warning": self.permission_warning()}


def keywords(path: str | os.PathLike | None = None, variable: str = "SENSITIVITY_KEYWORDS_PATH") -> Keywords:
    """Keyword lists of the classification: from ``path``, else from the file that an environment variable names, else the built-in ones.

    The document has ``tier3_special_categories`` (lists by category),
    ``tier2_context_words``, ``tier2_patterns`` (by name),
    ``person_linking_entities`` and ``person_indicators``.  A file that can't
    be read, a missing or empty list is an error: nothing is classified blindly.
    """
    chosen = path or os.environ.get(variable)
    if not chosen:
        return Keywords()
    try:
        raw = _parse(Path(chosen).read_text(encoding="utf-8"))
        return Keywords.of(raw)
    except (OSError, ValueError) as e:
        raise ValueError(f"keyword lists can't be used ({type(e).__name__})") from e


def _parse(text: str) -> object:
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        raise ValueError("not a rule document") from None

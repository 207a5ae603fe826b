"""User-defined detection rules: validation, quarantine, budgeted scans, and the native path for trusted ones."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .detect import Pattern, quoted
from .spans import mask_rows

# Limits and default scores.
SCORES = {"term": 0.9, "regex": 0.85}
BUDGET, LEAST_SHARE = 0.25, 0.05
MAX_ENTITY, MAX_WORDS, MIN_TOKEN = 40, 3, 3
_NAME = regex.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
_TOKEN = regex.compile(r"[^\W_]+")


class RuleError(ValueError):
    """Says what is wrong with a rule, never its value."""


@dataclass(frozen=True)
class Rule:
    name: str
    entity: str
    kind: str
    value: str
    score: float
    case_sensitive: bool = False
    examples: tuple[str, ...] = ()
    counter_examples: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        if self.kind == "regex":
            return self.value
        word = lambda c: c.isalnum() or c == "_"
        return (r"\b" if word(self.value[0]) else "") + quoted(self.value) + (r"\b" if word(self.value[-1]) else "")

    def compiled(self) -> regex.Pattern:
        return regex.compile(self.pattern, regex.DOTALL | regex.MULTILINE | (0 if self.case_sensitive else regex.IGNORECASE))


@dataclass
class RuleSet:
    active: list[Rule] = field(default_factory=list)
    quarantined: list[tuple[str, str]] = field(default_factory=list)


def entity_type(entity: str) -> str:
    name = regex.sub(r"[^A-Z0-9]+", "_", entity.upper()).strip("_")
    if not name:
        raise RuleError("entity has no usable character")
    return "CUSTOM_" + name


def _words(text: str) -> set[str]:
    return {t.lower() for t in _TOKEN.findall(text) if len(t) >= MIN_TOKEN}


def build(raw: dict) -> Rule:
    """A checked rule: its shape, its category's name, its own examples."""
    if not isinstance(raw, dict):
        raise RuleError("a rule is a mapping")
    name, entity, value = (raw.get(k) for k in ("name", "entity", "value"))
    kind = raw.get("type", "term")
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise RuleError("name does not fit")
    if not isinstance(entity, str) or not entity.strip():
        raise RuleError("entity is missing")
    if not isinstance(kind, str) or kind not in SCORES:
        raise RuleError("type is term or regex")
    if not isinstance(value, str) or not value.strip():
        raise RuleError("value is missing")
    try:
        score = float(raw.get("score", SCORES[kind]))  # a number may be given as text
    except (TypeError, ValueError):
        raise RuleError("score is no number") from None
    if not 0 < score <= 1:
        raise RuleError("score lies in (0, 1]")
    clean = entity.strip()
    if len(clean) > MAX_ENTITY or len(clean.split()) > MAX_WORDS:
        raise RuleError("entity is too long for a category")
    if _words(clean) & _words(value):
        raise RuleError("entity and value share a word")
    entity_type(clean)
    examples, counters = tuple(raw.get("examples") or ()), tuple(raw.get("counter_examples") or ())
    if not examples:
        raise RuleError("examples are missing")
    rule = Rule(name, clean, kind, value, score, bool(raw.get("case_sensitive", False)), examples, counters)
    try:
        rx = rule.compiled()
    except regex.error:
        raise RuleError("value is not a valid pattern") from None
    try:
        if not all(any(m.end() > m.start() for m in rx.finditer(e, timeout=BUDGET)) for e in examples):
            raise RuleError("an example does not match")
        if any(any(m.end() > m.start() for m in rx.finditer(e, timeout=BUDGET)) for e in counters):
            raise RuleError("a counter example matches")
    except TimeoutError:
        raise RuleError("the pattern takes too long") from None
    return rule


def load(document: object) -> RuleSet:
    """Rules of a document (None, a list, or a mapping with ``rules``); bad ones are set aside with a reason, disabled ones skipped."""
    raw = document.get("rules") if isinstance(document, dict) else document
    if raw is None:
        raw = []
    if not isinstance(raw, list):
        raise RuleError("rules must be a list")
    out, names = RuleSet(), set()
    for k, r in enumerate(raw):
        label = r.get("name") if isinstance(r, dict) and isinstance(r.get("name"), str) else f"#{k}"
        try:
            if isinstance(r, dict) and r.get("enabled", True) is False:
                continue
            rule = build(r)
            if rule.name in names:
                raise RuleError("name occurs twice")
            names.add(rule.name)
            out.active.append(rule)
        except RuleError as e:
            out.quarantined.append((label, str(e)))
    return out


def safe_reason(name: str, kind: str, detail: str = "", secrets: Iterable[str] = ()) -> str:
    """A reason for logs: the rule's name, what is wrong, and a detail without any of the secrets (longest first, so that none is left in part)."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        detail = detail.replace(s, "[…]")
    return f"rule {name!r}: {kind}" + (f" ({detail})" if detail else "")


def preview(df: DataFrame, rules: list[Rule], text_col: str = "text", budget: float = BUDGET) -> DataFrame:
    """What rules would do to texts: ``rule_spans``, ``rule_status``, ``masked`` and ``reid_map``; a blocked text has no masked one."""
    done = mask_rows(scan(df, rules, text_col, budget), text_col, "rule_spans")
    ok = F.col("rule_status") == "ok"
    return done.withColumn("masked", F.when(ok, F.col("masked"))).withColumn("reid_map", F.when(ok, F.col("reid_map")))


def native_patterns(rules: list[Rule]) -> list[Pattern]:
    """Reviewed rules as detector patterns, to run inside the JVM without a time limit."""
    return [Pattern(entity_type(r.entity), r.name, r.pattern, r.score, "(?msU)" if r.case_sensitive else "(?imsU)") for r in rules]


def scan_text(rules: list[tuple[str, regex.Pattern, float]], text: str, budget: float = BUDGET) -> list[tuple[str, int, int, float]] | None:
    """Spans of all rules, or None where the budget of the text ran out: never a part of them."""
    out, end = [], time.monotonic() + budget
    for k, (kind, rx, score) in enumerate(rules):
        left = end - time.monotonic()
        if left <= 0:
            return None
        share = min(left, max(left / (len(rules) - k), LEAST_SHARE))
        try:
            out += [(kind, m.start(), m.end(), score) for m in rx.finditer(text, timeout=share) if m.end() > m.start()]
        except TimeoutError:
            return None
    return out


def scan(df: DataFrame, rules: list[Rule], text_col: str = "text", budget: float = BUDGET) -> DataFrame:
    """Adds ``rule_spans`` and ``rule_status``: incomplete scans have no spans and are blocked."""
    ship(df.sparkSession)
    own = list(rules)

    @F.pandas_udf("rule_spans array<struct<entity_type:string,start:int,end:int,score:double>>, rule_status string")
    def run(texts: pd.Series) -> pd.DataFrame:
        compiled = [(entity_type(r.entity), r.compiled(), r.score) for r in own]
        rows = []
        for t in texts:
            found = scan_text(compiled, t, budget) if t else []
            rows.append(([{"entity_type": k, "start": a, "end": b, "score": s} for k, a, b, s in found], "ok") if found is not None else (None, "blocked"))
        return pd.DataFrame(rows, columns=["rule_spans", "rule_status"])

    return df.withColumn("_r", run(F.col(text_col))).select(*[c for c in df.columns if c not in ("rule_spans", "rule_status")], "_r.rule_spans", "_r.rule_status")

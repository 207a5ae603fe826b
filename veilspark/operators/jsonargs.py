"""Masking inside JSON arguments of tool calls: strict parse, depth-first nodes, rebuild, verification."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import ship
from .spans import sweep

MAX_DEPTH = 64


class Blocked(Exception):
    """Raised with a code; never with a value."""


def strict_loads(text: str) -> object:
    """JSON without duplicate keys, NaN or infinities; these block, plain garbage raises ValueError."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise Blocked("duplicate_key")
        return out

    def constant(_: str) -> object:
        raise Blocked("not_a_number")

    try:
        return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except RecursionError:
        raise Blocked("depth") from None


def walk(node: object, change: Callable[[str], str], depth: int = 0) -> object:
    """Keys before their values, depth first; numbers become text only if something in them is replaced."""
    if depth > MAX_DEPTH:
        raise Blocked("depth")
    if isinstance(node, dict):
        out: dict = {}
        for key, value in node.items():
            new = change(key)
            if new in out:
                raise Blocked("duplicate_key")
            out[new] = walk(value, change, depth + 1)
        return out
    if isinstance(node, list):
        return [walk(x, change, depth + 1) for x in node]
    if isinstance(node, str):
        return change(node)
    if isinstance(node, (int, float)) and not isinstance(node, bool):
        text = json.dumps(node)
        new = change(text)
        return node if new == text else new
    return node


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return len(digits) >= 12 and sum(doubled) % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    turned = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return 15 <= len(plain) <= 34 and int(turned) % 97 == 1


def _ipv4(text: str) -> bool:
    return all(1 <= len(x) <= 3 and int(x) <= 255 for x in text.split("."))


def _phone(text: str) -> bool:
    digits = "".join(c for c in text if c in "0123456789")
    if not text.startswith("+") and not digits.startswith("00"):
        return S.TRUNK_LENGTHS[0] <= len(digits) <= S.TRUNK_LENGTHS[1]
    plain = digits.removeprefix("00")
    size = 1 if plain[:1] in ("1", "7") else 2 if plain[:2] in S.TWO_DIGIT_CODES else 3
    low, high = S.NATIONAL_LENGTHS.get(plain[:size], (5, 15 - size))
    return not plain.startswith("0") and low <= len(plain) - size <= high


#: Python forms of the detectors' checks, by the detector's name.
CHECKS: dict[str, Callable[[str], bool]] = {"iban": _iban, "card": _luhn, "ipv4": _ipv4, "phone": _phone}


class Masker:
    """Numbers values by type and first occurrence, across the texts of one request; ``patterns`` are those of ``compiled``."""

    def __init__(self, patterns: Iterable[tuple[str, regex.Pattern, float, Callable[[str], bool] | None]]):
        self.patterns = list(patterns)
        self.known: dict[tuple[str, str], str] = {}
        self.counts: dict[str, int] = {}
        self.found: set[str] = set()

    def detect(self, text: str) -> list[tuple[str, int, int, float]]:
        return [(e, m.start(), m.end(), s) for e, rx, s, check in self.patterns for m in rx.finditer(text) if m.end() > m.start() and (check is None or check(m.group()))]

    def mask(self, text: str) -> str:
        out, at = [], 0
        for kind, a, b, _ in sweep(self.detect(text)):
            self.found.add(kind)
            key = (kind, text[a:b])
            if key not in self.known:
                self.known[key] = f"<{kind}_{self.counts.get(kind, 0)}>"
                self.counts[kind] = self.counts.get(kind, 0) + 1
            out += [text[at:a], self.known[key]]
            at = b
        return "".join(out) + text[at:]

    def verified(self, made: str) -> tuple[str | None, str]:
        bare = made
        for p in sorted(self.known.values(), key=len, reverse=True):
            bare = bare.replace(p, " ")
        left = sorted({k for k, a, b, _ in self.detect(bare) if bare[a:b].strip()})
        return (None, "blocked:left:" + ",".join(left)) if left else (made, "ok")

    def plain(self, text: str) -> tuple[str | None, str]:
        """(masked text, status) of a text that is no JSON."""
        return self.verified(self.mask(text))

    def arguments(self, text: str) -> tuple[str | None, str]:
        """(masked text, status); unchanged arguments stay byte for byte, a hit that is left blocks."""
        try:
            try:
                tree = strict_loads(text)
            except ValueError:
                made = self.mask(text)
            else:
                new = walk(tree, self.mask)
                made = text if new == tree else json.dumps(new, ensure_ascii=False, allow_nan=False)
            return self.verified(made)
        except Blocked as e:
            return None, f"blocked:{e}"


def python_patterns(entities: Iterable[str]) -> list[tuple[str, str, float, str, str | None]]:
    """(entity, pattern, score, flags, check) of the asked entities for Python's regex module (Unicode is its default); an entity without a Python form is an error, as it would stay in clear."""
    from .detect import PATTERNS

    wanted = set(entities)
    found = [p for p in PATTERNS if p.entity in wanted]
    missing = wanted - {p.entity for p in found} | {p.entity for p in found if p.check is not None and p.name not in CHECKS}
    if missing:
        raise ValueError(f"no detector inside arguments for {', '.join(sorted(missing))}")
    return [(p.entity, p.regex, p.score, "(?ims)" if p.flags else "", p.name if p.check is not None else None) for p in found]


@cache
def compiled(patterns: tuple[tuple, ...]) -> tuple:
    """Compiled once per worker."""
    return tuple((e, regex.compile(f + rx), s, CHECKS[check] if check else None) for e, rx, s, f, check in patterns)


def mask_arguments(df: DataFrame, entities: Iterable[str], column: str = "arguments") -> DataFrame:
    """Each row a request: adds ``masked`` and ``json_status``."""
    ship(df.sparkSession)
    patterns = tuple(python_patterns(entities))

    @F.pandas_udf("masked string, json_status string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, "ok") if t is None else Masker(compiled(patterns)).arguments(t) for t in texts]
        return pd.DataFrame(rows, columns=["masked", "json_status"])

    return df.withColumn("_j", run(F.col(column))).select(*[c for c in df.columns if c not in ("masked", "json_status")], "_j.masked", "_j.json_status")


def mask_request_arguments(df: DataFrame, entities: Iterable[str], column: str = "arguments") -> DataFrame:
    """Each row a request with an array of argument texts in their order: one numbering for all of them; adds ``masked`` (array) and ``json_status`` (the first that blocks, else ok)."""
    ship(df.sparkSession)
    patterns = tuple(python_patterns(entities))

    @F.pandas_udf("masked array<string>, json_status string")
    def run(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for texts in lists:
            masker = Masker(compiled(patterns))
            made = [(None, "ok") if t is None else masker.arguments(t) for t in (texts if texts is not None else ())]
            bad = [status for _, status in made if status != "ok"]
            rows.append(([] if bad else [m for m, _ in made], bad[0] if bad else "ok"))
        return pd.DataFrame(rows, columns=["masked", "json_status"])

    return df.withColumn("_j", run(F.col(column))).select(*[c for c in df.columns if c not in ("masked", "json_status")], "_j.masked", "_j.json_status")


_CALL = "struct<name:string,arguments:string>"


def mask_calls(df: DataFrame, entities: Iterable[str], column: str = "calls") -> DataFrame:
    """Each row a request with an array of calls (name, arguments) in their order: adds ``masked`` (the same array), ``entity_types`` (those found in each call's arguments and name) and ``json_status``.

    Names are masked as plain text, arguments as JSON, all with one numbering.
    A name in which something is left blocks like arguments do.
    """
    ship(df.sparkSession)
    patterns = tuple(python_patterns(entities))

    @F.pandas_udf(f"masked array<{_CALL}>, entity_types array<array<string>>, json_status string")
    def run(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for calls in lists:
            masker = Masker(compiled(patterns))
            made, kinds, bad = [], [], []
            for c in calls if calls is not None else ():
                masker.found = set()
                parts = [(None, "ok") if c is None or c[k] is None else masker.plain(c[k]) if k == "name" else masker.arguments(c[k]) for k in ("name", "arguments")]
                bad += [status for _, status in parts if status != "ok"]
                made.append({"name": parts[0][0], "arguments": parts[1][0]})
                kinds.append(sorted(masker.found))
            rows.append(([] if bad else made, kinds, bad[0] if bad else "ok"))
        return pd.DataFrame(rows, columns=["masked", "entity_types", "json_status"])

    added = ("masked", "entity_types", "json_status")
    return df.withColumn("_j", run(F.col(column))).select(*[c for c in df.columns if c not in added], *(f"_j.{c}" for c in added))


def gate_calls(df: DataFrame, entities: Iterable[str], column: str = "calls", approved: str | None = None) -> DataFrame:
    """``mask_calls`` behind the tiers: adds ``tier``, ``status`` and ``reason_code`` of each row's worst call.

    The words of a tier are looked for in a call's whole raw arguments and in
    its name, as a word and the person that it is about often stand in
    different fields; a person may also be one of the types found anywhere in
    the call.  A blocked row has an empty ``masked``.
    """
    from . import classify as C

    masked = mask_calls(df, entities, column)
    texts = F.flatten(F.zip_with(column, "entity_types", lambda c, t: F.array(F.struct(c["name"].alias("text"), t.alias("types")), F.struct(c["arguments"].alias("text"), t.alias("types")))))
    tiers = F.transform(texts, lambda x: C.tier(F.coalesce(x["text"], F.lit("")), x["types"]))
    gated = C.gate(masked.withColumn("tier", F.coalesce(F.array_max(tiers), F.lit(1))), approved)
    reason = F.coalesce("reason_code", F.when(F.col("json_status") != "ok", F.col("json_status")))
    gated = gated.withColumn("reason_code", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("blocked"))
    return gated.withColumn("masked", F.when(F.col("status") == "ok", F.col("masked")).otherwise(F.array().cast(f"array<{_CALL}>")))


def reidentify_json(text: str, reid: dict[str, str]) -> str:
    """Placeholders in keys and values replaced; without any the text stays byte for byte, broken JSON is replaced as text."""
    names = sorted((p for p in reid if p in text), key=len, reverse=True)
    if not names:
        return text

    def back(s: str) -> str:
        for p in names:
            s = s.replace(p, reid[p])
        return s

    try:
        return json.dumps(walk(json.loads(text), back), ensure_ascii=False)
    except (ValueError, Blocked, RecursionError):
        for p in names:
            text = text.replace(p, json.dumps(reid[p], ensure_ascii=False)[1:-1])
        return text


def reidentify_arguments(df: DataFrame, column: str, map_col: str) -> DataFrame:
    """``column`` restored from a map<string,string> column."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None else reidentify_json(t, dict(m)) for t, m in zip(texts, maps, strict=True)])

    return df.withColumn(column, run(F.col(column), F.col(map_col)))


def top_level_duplicates(raw: Column) -> Column:
    """Native check of the top level: whether a key occurs twice."""
    keys = F.json_object_keys(raw)
    return F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))

"""Thousands of term rules in one pass over each text, by an Aho-Corasick automaton.

One pattern for each rule costs texts times rules.  All terms together are one
automaton, which reads a text once whatever their number.  It is broadcast
behind a check of its size; term tables beyond it are scanned in groups, each
of which is broadcast in its turn.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .rules import Rule, entity_type

#: Characters of the terms of one automaton.
GROUP_CHARS = 8_000_000
_SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"


def fold(text: str) -> str:
    """Case-folded character by character, so that offsets stay."""
    whole = text.casefold()
    if len(whole) == len(text):
        return whole
    return "".join(next(x for x in (c.casefold(), c.lower(), c) if len(x) == 1) for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """Finds all terms of rules (entity type, term, score, case-sensitive) in a text."""

    def __init__(self, rules: Iterable[tuple[str, str, float, bool]]):
        import ahocorasick

        self.rules = list(rules)
        self.tries = {}
        for exact in (True, False):
            trie = ahocorasick.Automaton()
            for k, (_, term, _, case) in enumerate(self.rules):
                if case == exact:
                    key = term if exact else fold(term)
                    trie.add_word(key, (*trie.get(key, ()), k))
            if len(trie):
                trie.make_automaton()
                self.tries[exact] = trie

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        """Of every rule the places that its own pattern would find: whole words at word edges, from left to right without overlap."""
        found: list[tuple[int, int, int]] = []
        ends: dict[int, int] = {}
        for exact, trie in self.tries.items():
            for last, ks in trie.iter(text if exact else fold(text)):
                for k in ks:
                    term = self.rules[k][1]
                    end, start = last + 1, last + 1 - len(term)
                    if _word(term[0]) and start > 0 and _word(text[start - 1]) or _word(term[-1]) and end < len(text) and _word(text[end]):
                        continue
                    if start >= ends.get(k, 0):
                        ends[k] = end
                        found.append((k, start, end))
        return [(self.rules[k][0], a, b, self.rules[k][2]) for k, a, b in sorted(found)]


_MADE: dict[int, Automaton] = {}


def term_rules(rules: Iterable[Rule]) -> list[tuple[str, str, float, bool]]:
    """The term rules among rules, for ``scan_terms``."""
    return [(entity_type(r.entity), r.value, r.score, r.case_sensitive) for r in rules if r.kind == "term"]


def scan_terms(df: DataFrame, rules: Iterable[tuple[str, str, float, bool]], text_col: str = "text", out: str = "term_spans") -> DataFrame:
    """Adds ``out``: the spans of all term rules (entity type, term, score, case-sensitive), by rule and then by place; a null text has none.

    Terms are split into groups of ``GROUP_CHARS`` characters; each group is an
    automaton that a worker builds once.
    """
    ship(df.sparkSession)
    groups: list[list] = [[]]
    size = 0
    for rule in rules:
        if not rule[1]:
            raise ValueError("a term is empty")
        if size + len(rule[1]) > GROUP_CHARS and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(rule)
        size += len(rule[1])
    columns: list[Column] = []
    for group in groups:
        sent = df.sparkSession.sparkContext.broadcast(group)

        def run(texts: pd.Series, sent=sent) -> pd.Series:
            key = id(sent)
            if key not in _MADE:
                _MADE.clear()
                _MADE[key] = Automaton(sent.value)
            return texts.map(lambda t: [] if t is None else [{"entity_type": e, "start": a, "end": b, "score": s} for e, a, b, s in _MADE[key].spans(t)])

        columns.append(F.pandas_udf(run, _SPANS, F.PandasUDFType.SCALAR)(F.col(text_col)))
    return df.withColumn(out, F.concat(*columns))

"""Admission of stop words: what may be taken off the findings, and what would hide a name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heads that a term has to end in, names and spans that no entry may hide.
HEADS = ("nummer", "datum", "art", "status", "betrag", "preis", "gebuehr", "grund", "fenster")
CONTROL_SPANS = (
    "Zahlungsart\nLoewenstein", "Bestellnummer\nKraemer", "Rechnungsbetrag\nSchroeder", "Menge", "MENGE", "Fuege", "Mueller", "Herr Mueller",
    "Schroeder", "Weiss", "Kraemer", "Baecker", "Stoecker", "Loewenstein", "Maria Meier", "Müller", "Schröder",
)
#: The patterns that can be judged: fixed words between absolute anchors, alternatives and case only inside a group.
SHAPE = r"\A\\A(?:[\p{L}\p{N}_ -]+|\(\?(?:i|-i)?:[\p{L}\p{N}_ -]+(?:\|[\p{L}\p{N}_ -]+)*\))\\z\z"


def pattern_of(term: Column) -> Column:
    """The usual pattern of a term: whole span, any case."""
    return F.concat(F.lit(r"\A(?i:"), term, F.lit(r")\z"))


def lint(entries: DataFrame, controls: Iterable[str] = CONTROL_SPANS, heads: Iterable[str] = HEADS) -> DataFrame:
    """Entries (term, pattern, probe, and the finding it is meant for in ``measured_span``, null: the term) with ``faults``, an array of codes; none means that the entry may be used.

    ``head``: the term ends in no known head; ``bare_head``: it is one, and
    some heads are names; ``anchor``: line anchors, or no absolute ones;
    ``global_flag``: a flag that changes all entries once they are joined;
    ``shape``: a pattern of another form, which is not judged and so refused;
    ``hides``: it matches one of ``controls``; ``misses``: it doesn't match its
    own finding; ``no_probe``: nothing shows the false alarm; ``twice``: the
    pattern occurs again.  A null term or pattern has the faults of an empty one.
    """
    heads, controls = tuple(heads), tuple(controls)
    term, pattern = F.coalesce("term", F.lit("")), F.coalesce("pattern", F.lit(""))
    fits = pattern.rlike(SHAPE)
    judged = F.when(fits, pattern)
    hit = lambda text: F.coalesce(F.regexp_like(text, judged), F.lit(False))
    ends = F.lit(False)
    for h in heads:
        ends = ends | term.endswith(h)
    codes = {
        "head": ~ends,
        "bare_head": F.lower(term).isin(*heads),
        "anchor": pattern.rlike(r"[\^$]") | ~pattern.contains(r"\A") | ~pattern.contains(r"\z"),
        "global_flag": pattern.rlike(r"\A\(\?-?i\)"),
        "shape": ~fits,
        "hides": F.exists(F.array(*(F.lit(c) for c in controls)), hit),
        "misses": ~hit(F.coalesce("measured_span", term)),
        "no_probe": F.trim(F.coalesce("probe", F.lit(""))) == "",
        "twice": F.col("_n") > 1,
    }
    # counted beside and joined: a pattern that very many entries share needs no task of its own
    counts = entries.groupBy(F.col("pattern").alias("_pattern")).agg(F.count("*").alias("_n"))
    counted = entries.join(counts, entries["pattern"].eqNullSafe(counts["_pattern"])).drop("_pattern")
    return counted.withColumn("faults", F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in codes.items())))).drop("_n")


def conflicts(words: DataFrame, names: DataFrame, word: str = "term", name: str = "name") -> DataFrame:
    """(term, n) of the stop words that would hide a name: those that equal one, with its number of rows; case and outer blanks don't count."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    held = names.select(plain(name).alias("_w")).where("_w <> ''").groupBy("_w").agg(F.count("*").alias("n"))
    return words.select(F.col(word).alias("term"), plain(word).alias("_w")).distinct().join(held, "_w").select("term", "n")


def allowed(spans: Column, text: Column, patterns: Iterable[str]) -> Column:
    """Spans without those whose whole text an admitted pattern matches."""
    patterns = tuple(patterns)
    if not patterns:
        return spans
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.filter(spans, lambda s: ~F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike(joined))

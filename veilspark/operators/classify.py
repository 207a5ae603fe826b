"""Three-tier sensitivity classification and its gates."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import quoted, whole_words

# Keyword lists (literal spelling, matched as whole words, case-insensitive).
TIER3 = {
    "gesundheit": (
        "Diagnose", "Diagnosen", "Erkrankung", "Krankheit", "psychische Erkrankung", "psychisch krank", "Depression", "Burnout", "Krebs", "Tumor", "HIV", "AIDS", "Hepatitis", "Schwangerschaft", "schwanger",
        "Behinderung", "Schwerbehinderung", "Grad der Behinderung", "Pflegegrad", "Medikament", "Medikamente", "Therapie", "Psychotherapie", "Reha", "Rehabilitation", "Krankschreibung", "arbeitsunfaehig",
        "Attest", "Befund", "Patientenakte", "Krankengeschichte", "Suchterkrankung", "Sucht",
    ),
    "biometrisch_genetisch": ("genetisch", "Gentest", "DNA", "Erbkrankheit", "biometrisch", "Fingerabdruck", "Gesichtserkennung", "Iris-Scan"),
    "religion_weltanschauung": ("Religion", "Glaubensrichtung", "Konfession", "getauft", "Kirchenaustritt", "muslimisch", "juedisch", "christlich", "atheistisch", "Weltanschauung"),
    "politisch": ("Parteimitglied", "Parteizugehoerigkeit", "politische Einstellung", "waehlt"),
    "gewerkschaft": ("Gewerkschaft", "Gewerkschaftsmitglied", "Betriebsrat", "Streik"),
    "sexualleben": ("sexuelle Orientierung", "homosexuell", "heterosexuell", "bisexuell", "transgender", "queer", "Sexualleben"),
    "strafrechtlich": ("Vorstrafe", "vorbestraft", "verurteilt", "Verurteilung", "Strafverfahren", "Ermittlungsverfahren", "Anklage", "Haftstrafe", "Bewaehrung", "Straftat", "Gefaengnis"),
}
TIER2_WORDS = ("vertraulich", "intern", "streng vertraulich", "nicht weitergeben", "NDA", "Geheimhaltung", "Verschwiegenheit", "Betriebsgeheimnis", "Geschaeftsgeheimnis")
TIER2_PATTERNS = {
    "vertragsnummer": r"vertrags?(?:nummer|nr\.?)\s*:?\s*[A-Za-z0-9][A-Za-z0-9\-/]{2,}",
    "gehalt": r"(?:gehalt|jahresgehalt|monatsgehalt|lohn|verdienst|verdient)\D{0,20}\d{1,3}(?:[.\s]?\d{3})*(?:\s?(?:eur|euro|€))?",
}
PERSON_TYPES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "DE_STEUER_ID", "DE_SOZIALVERSICHERUNG", "DE_KFZ_KENNZEICHEN")
PERSON_WORDS = (
    "Patient", "Patientin", "Mandant", "Mandantin", "Mitarbeiter", "Mitarbeiterin", "Kollege", "Kollegin", "Kunde", "Kundin", "Bewerber", "Bewerberin", "Angestellte", "Angestellter", "Herr", "Frau",
    "mein Bruder", "meine Schwester", "mein Vater", "meine Mutter", "mein Sohn", "meine Tochter", "mein Mann", "meine Frau", "mein Kollege", "meine Kollegin", "mein Chef", "meine Chefin",
)


@dataclass(frozen=True)
class Keywords:
    """The lists that a classification uses; an empty one is an error, as it would switch a category off."""

    tier3: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: TIER3)
    tier2_words: tuple[str, ...] = TIER2_WORDS
    tier2_patterns: Mapping[str, str] = field(default_factory=lambda: TIER2_PATTERNS)
    person_types: tuple[str, ...] = PERSON_TYPES
    person_words: tuple[str, ...] = PERSON_WORDS

    def __post_init__(self) -> None:
        if not self.tier3 or any(not words for words in (*self.tier3.values(), self.tier2_words, self.tier2_patterns, self.person_types, self.person_words)):
            raise ValueError("a keyword list is empty")

    @classmethod
    def of(cls, raw: object) -> Keywords:
        """From a parsed document; every list has to be there and hold texts."""
        if not isinstance(raw, dict):
            raise ValueError("keyword lists are a mapping")

        def texts(given: object) -> tuple[str, ...]:
            if not isinstance(given, list) or not all(isinstance(w, str) and w.strip() for w in given):
                raise ValueError("a keyword list holds texts")
            return tuple(given)

        tier3, patterns = raw.get("tier3_special_categories"), raw.get("tier2_patterns")
        if not isinstance(tier3, dict) or not isinstance(patterns, dict) or not all(isinstance(p, str) and p for p in patterns.values()):
            raise ValueError("categories and patterns are mappings")
        return cls({k: texts(v) for k, v in tier3.items()}, texts(raw.get("tier2_context_words")), dict(patterns), texts(raw.get("person_linking_entities")), texts(raw.get("person_indicators")))


def configured(given: Iterable[str] | None, variable: str, default: tuple[str, ...]) -> tuple[str, ...]:
    """Words of a list: those given, else those of an environment variable (separated by commas), else the default; an empty list is an error, as it would switch a category off."""
    if given is None:
        raw = os.environ.get(variable)
        given = default if raw is None else raw.split(",")
    words = tuple(dict.fromkeys(w.strip() for w in given if w.strip()))
    if not words:
        raise ValueError(f"{variable} has no word")
    return words


def has_word(text: Column, words: tuple[str, ...], fold_umlauts: bool = False) -> Column:
    source = text
    if fold_umlauts:
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
            source = F.replace(source, F.lit(a), F.lit(b))
    return F.coalesce(source.rlike("(?iU)" + whole_words(words)), F.lit(False))


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first entry of the list, in its order, that the text has."""
    out = F.lit(None).cast("string")
    for w in reversed(words):
        out = F.when(has_word(text, (w,)), F.lit(w)).otherwise(out)
    return out


def _names(found: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit in found.items())))


def _found(text: Column, types: Column | None, words: Keywords, fold_umlauts: bool) -> tuple[Column, dict[str, Column], dict[str, Column]]:
    """(person, hits of the third tier's categories, of the second's) of a text that isn't null."""
    person = has_word(text, words.person_words, fold_umlauts)
    if types is not None:
        person = F.coalesce(F.arrays_overlap(types, F.array(*(F.lit(t) for t in words.person_types))), F.lit(False)) | person
    three = {c: has_word(text, w, fold_umlauts) for c, w in words.tier3.items()}
    two = {"kontextwort": has_word(text, words.tier2_words, fold_umlauts)} | {n: F.coalesce(text.rlike("(?iU)" + rx), F.lit(False)) for n, rx in words.tier2_patterns.items()}
    return person, three, two


def _any(hits: Iterable[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def tier(text: Column, types: Column | None = None, keywords: Keywords | None = None, fold_umlauts: bool = False) -> Column:
    """The heuristic tier of one text, also inside arrays."""
    words = keywords or Keywords()
    person, _, two = _found(text, types, words, fold_umlauts)
    every = tuple(w for ws in words.tier3.values() for w in ws)  # one search for the words of all categories
    three = has_word(text, every, fold_umlauts) if every else F.lit(False)
    return F.coalesce(F.when(~person, 1).when(three, 3).when(_any(two.values()), 2).otherwise(1), F.lit(2))


def classify(df: DataFrame, text_col: str = "text", types_col: str | None = None, level_col: str | None = None, fold_umlauts: bool = False, signals: bool = False, keywords: Keywords | None = None) -> DataFrame:
    """Adds ``heuristic_tier``, ``tier`` (not lowered by a requested level) and ``reasons``; ``matched_signals`` on request.

    A null text classifies as tier 1 of an empty one; a null result of any
    predicate counts as tier 2, never 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = keywords or Keywords()
    person, three, two = _found(text, F.col(types_col) if types_col else None, words, fold_umlauts)
    out = df.withColumn("_person", person).withColumn("_three", _names(three)).withColumn("_two", _names(two))
    tier = F.when((F.size("_three") > 0) & F.col("_person"), 3).when((F.size("_two") > 0) & F.col("_person"), 2).otherwise(1)
    out = out.withColumn("heuristic_tier", F.coalesce(tier, F.lit(2)))
    requested = F.col(level_col) if level_col else F.lit(None).cast("int")
    out = out.withColumn("tier", F.greatest(F.col("heuristic_tier"), F.coalesce(requested, F.lit(1))))
    out = out.withColumn("reasons", F.array_sort(F.concat("_three", "_two", F.when(F.col("_person"), F.array(F.lit("personenbezug"))).otherwise(F.array().cast("array<string>")))))
    if signals:
        out = out.withColumn("matched_signals", F.array_compact(F.array(*(F.when(F.array_contains("_three", c), first_word(text, w)) for c, w in words.tier3.items()), F.when(F.array_contains("_two", "kontextwort"), first_word(text, words.tier2_words)))))
    return out.drop("_person", "_three", "_two")


def gate(df: DataFrame, approved_col: str | None = None) -> DataFrame:
    """Adds ``status`` and ``reason_code``: tier 3 is always blocked, tier 2 without approval."""
    ok = F.coalesce(F.col(approved_col), F.lit(False)) if approved_col else F.lit(False)
    reason = F.when(F.col("tier") == 3, "tier_3").when((F.col("tier") == 2) & ~ok, "tier_2_not_approved")
    return df.withColumn("reason_code", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("blocked"))

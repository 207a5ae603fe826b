"""Detectors: patterns, native span extraction, allow list, context, custom rules and a pluggable NER hook."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Flags of every German pattern: case-insensitive, multi-line, dot matches all, Unicode classes.
FLAGS = "(?imsU)"
SPAN = "struct<entity_type:string,start:int,end:int,score:double>"


@dataclass(frozen=True)
class Pattern:
    entity: str
    name: str
    regex: str
    score: float
    flags: str = FLAGS
    check: Callable[[Column], Column] | None = None
    #: What any text with a match holds, cheap to look for; "" where nothing is.
    needs: str = ""


# Patterns and scores.  A look-behind stands after a look at what follows, as it is slow and would else be tried at every character.
_HOUSE = r"[ ]+\d{1,4}[ ]?[a-zA-Z]?(?:[ ]*[-–][ ]*\d{1,4}[ ]?[a-zA-Z]?)?\b"
_NAME = r"(?-i:[A-ZÄÖÜ])[A-Za-zÄÖÜäöüß]*"
_FORMS = r"GmbH[ ]?&[ ]?Co\.[ ]?KG|gGmbH|GmbH|KGaA|UG[ ]?\(haftungsbeschränkt\)|mbH|AG|KG|OHG|GbR|e\.[ ]?V\.|e\.[ ]?G\.|SE|Inc\.|Ltd\.|LLC"
_CAPITAL = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\-]+"
GENDERS = ("männlich", "weiblich", "divers", "männl.", "weibl.", "nichtbinär", "non-binär")
PROFESSIONS = (
    "Bürgermeister", "Bürgermeisterin", "Oberbürgermeister", "Landrat", "Landrätin", "Chefarzt", "Chefärztin", "Oberarzt", "Pfarrer", "Pfarrerin", "Priester", "Rabbiner", "Imam",
    "Geschäftsführer", "Geschäftsführerin", "Vorstandsvorsitzender", "Vorstand", "Aufsichtsratsvorsitzender", "Schulleiter", "Schulleiterin", "Rektor", "Rektorin", "Dekan", "Professor", "Professorin",
    "Polizeipräsident", "Polizeichef", "Feuerwehrkommandant", "Amtsleiter", "Amtsleiterin", "Notar", "Notarin", "Staatsanwalt", "Staatsanwältin", "Richter", "Richterin", "Ingenieur", "Ingenieurin",
    "Apotheker", "Apothekerin", "Steuerberater", "Steuerberaterin", "Ortsvorsteher", "Gemeindevorsteher",
)
STOP_WORDS = (
    "bestellnummer", "kundennummer", "rechnungsnummer", "vertragsnummer", "sendungsnummer", "buchungsnummer", "lieferdatum", "zahlungsart", "bearbeitungsstatus", "rechnungsbetrag", "einzelpreis",
    "rueckrufgrund", "bearbeitungsgebuehr", "wartungsfenster",
)


def quoted(term: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in term)


def deny_list(terms: Iterable[str]) -> str:
    """Alternation of whole terms, longest first."""
    return whole_words(sorted(terms, key=lambda t: (-len(t), t)))


def whole_words(terms: Iterable[str]) -> str:
    """Alternation of whole terms in their order; where no term can begin, nothing behind is looked at."""
    terms = list(terms)
    first = "".join(sorted({quoted(t[0]) for t in terms if t}))
    return (f"(?=[{first}])" if all(terms) and first else "") + r"(?<!\w)(?:" + "|".join(quoted(t) for t in terms) + r")(?!\w)"


_H16, _OCTET = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ipv6() -> str:
    """An address grammar as a pattern: eight groups, or fewer around one ``::``; the last two may be an IPv4 address; a zone may follow."""
    v4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
    forms = [f"(?:{_H16}:){{7}}{_H16}", f"(?:{_H16}:){{6}}{v4}"]
    for left in range(8):
        head = "::" if left == 0 else f"{_H16}(?::{_H16}){{{left - 1}}}::"
        tails = [f"(?:{_H16}:){{0,{5 - left}}}{v4}"] if left <= 5 else []
        if left < 7:
            tails.append(f"{_H16}(?::{_H16}){{0,{6 - left}}}")
        forms.append(head + "(?:" + "|".join(tails) + ")" + ("?" if left else "") if tails else head)
    return r"(?<![0-9A-Za-z_:.])(?:" + "|".join(forms) + r")(?:%[0-9A-Za-z]+)?(?![0-9A-Za-z_:]|\.[0-9])"


_DIGIT, _BIRTH = r"(?U)\d", "(?iU)geb|jahrgang"
PATTERNS = (
    Pattern("DE_STEUER_ID", "tax_id", r"\b\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}\b", 0.4, needs=_DIGIT),
    Pattern("DE_SOZIALVERSICHERUNG", "social_security", r"\b\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}\b", 0.6, needs=_DIGIT),
    Pattern("DE_HANDELSREGISTER", "register", r"\bHR[AB][ ]?\d{1,6}\b", 0.7, needs=_DIGIT),
    Pattern("DE_KFZ_KENNZEICHEN", "plate", r"\b[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}[ ]?\d{1,4}\b", 0.5, needs=_DIGIT),
    Pattern("DE_STRASSE", "street_one_word", _NAME + r"(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|steig|chaussee|pfad)" + _HOUSE, 0.85, needs=_DIGIT),
    Pattern("DE_STRASSE", "street_two_words", _NAME + r"[ ](?:straße|strasse|allee|platz|gasse|ring|damm|ufer|steig|chaussee|pfad)" + _HOUSE, 0.4, needs=_DIGIT),
    Pattern("DE_PLZ", "postal_code", r"\b\d{5}\b", 0.35, needs=_DIGIT),
    Pattern("DE_GEBURTSJAHR", "birth_year", r"(?=19|20)(?<=(?:geboren|jahrgang|geburtsjahr|geb\.)[ ]{0,4})(?:19\d{2}|20[0-2]\d)\b", 0.6, needs=_BIRTH),
    Pattern("DE_GEBURTSDATUM", "birth_date", r"(?=\d{1,2}\.\d)(?<=(?:geboren(?:[ ]{1,8}am)?|geburtsdatum|geb\.)[ :]{0,4})\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})\b", 0.65, needs=_BIRTH),
    Pattern("DE_TVOED_STUFE", "pay_grade", r"\b(?:TVöD|TVoeD|TV-L|Besoldungsgruppe|Entgeltgruppe|BesGr)[ ]*[A-W]?[ ]?\d{1,2}\b", 0.6, needs=_DIGIT),
    Pattern("DE_TVOED_STUFE", "pay_grade_short", r"\b(?:EG|E|A|B|R|W)[ ]?\d{1,2}\b", 0.3, needs=_DIGIT),
    Pattern("DE_GENDER", "gender", deny_list(GENDERS), 0.9),
    Pattern("DE_BERUF", "profession", deny_list(PROFESSIONS), 0.7),
    Pattern("DE_AKTENZEICHEN", "court_reference", r"\b(?:\d{1,4}|[IVX]{1,4})[ ][A-ZÄÖÜ][A-Za-zÄÖÜ]{0,4}[ ]\d{1,5}/\d{2,4}\b", 0.55, needs=_DIGIT),
    Pattern("DE_AKTENZEICHEN", "office_reference", r"\b\d{1,4}-\d{1,6}\.\d{1,3}-\d{1,3}/\d{1,4}\b", 0.5, needs=_DIGIT),
    Pattern("DE_FIRMA", "company", rf"\b(?-i:{_CAPITAL}(?:[ ]+(?:&[ ]+)?{_CAPITAL}){{0,4}})[ ]+(?-i:{_FORMS})(?![A-Za-zÄÖÜäöüß])", 0.6),
    # approximations of what external recognisers find
    Pattern("EMAIL_ADDRESS", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, "", needs="@"),
    Pattern("PHONE_NUMBER", "phone", r"(?<![0-9A-Za-z_+])(?:\+|0)[0-9](?:[ /()-]{0,2}[0-9]){6,13}(?![0-9])", 0.4, "", S.phone_ok, needs=_DIGIT),
    Pattern("IBAN_CODE", "iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 1.0, "", S.iban_ok, needs=_DIGIT),
    Pattern("CREDIT_CARD", "card", r"(?<![0-9A-Za-z_])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z_])", 1.0, "", S.luhn_ok, needs=_DIGIT),
    Pattern("IP_ADDRESS", "ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", 0.95, "", S.ipv4_ok, needs=_DIGIT),
    Pattern("IP_ADDRESS", "ipv6", _ipv6(), 0.95, "", needs="::|:[0-9A-Fa-f]{1,4}:"),
)
# Words that raise a score when they stand near.
CONTEXT = {
    "DE_STEUER_ID": ("steuer", "steuer-id", "steueridentifikationsnummer", "idnr", "identifikationsnummer"),
    "DE_SOZIALVERSICHERUNG": ("sozialversicherung", "rentenversicherung", "sv-nummer", "versicherungsnummer"),
    "DE_HANDELSREGISTER": ("handelsregister", "amtsgericht"),
    "DE_KFZ_KENNZEICHEN": ("kennzeichen", "kfz", "auto", "fahrzeug"),
    "DE_STRASSE": ("straße", "strasse", "anschrift", "adresse", "wohnhaft"),
    "DE_PLZ": ("plz", "postleitzahl"),
    "DE_GEBURTSDATUM": ("geboren", "jahrgang", "geburtsjahr", "geb."),
    "DE_TVOED_STUFE": ("tvöd", "tvoed", "tarif", "besoldung", "besoldungsgruppe", "entgeltgruppe", "eingruppierung"),
    "DE_GENDER": ("geschlecht",),
    "DE_BERUF": ("beruf", "tätig", "arbeitet", "position"),
    "DE_AKTENZEICHEN": ("aktenzeichen", "az", "geschäftszeichen", "gz", "gericht"),
    "DE_FIRMA": ("firma", "unternehmen", "gesellschaft", "rechtsform"),
}
ENTITIES = tuple(dict.fromkeys(p.entity for p in PATTERNS))


#: Hits whose offsets are made in one go.
BLOCK = 256


def matches(text: Column, regex: str, needs: str = "") -> Column:
    """array<struct<value,start,end>> of all matches, with code-point offsets and no UDF.

    The pieces between matches and the matches themselves alternate, so running
    lengths give the offsets.  ``needs`` is a pattern that any text with a match
    has, and that is looked for first.
    """
    rx, kind = F.lit(regex), "array<struct<value:string,start:int,end:int>>"
    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["p"])
        b = a + F.length(x["h"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(x["h"].alias("value"), a.alias("start"), b.alias("end")))).alias("out"))

    # the hits as one row, so that they are made once however often they are named; a text without one isn't split
    hits = F.array(F.regexp_extract_all(text, rx, F.lit(0)))
    pairs = lambda h: F.when(F.size(h) > 0, F.zip_with(h, F.slice(F.split(text, regex, -1), F.lit(1), F.size(h)), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))

    def block(s: Column, own: Column) -> Column:
        # a block of hits goes on from where the last one ended; arrays grow by blocks, so very many hits cost little more than their number
        done = F.array(F.aggregate(own, F.struct(s["at"].alias("at"), F.array().cast(kind).alias("out")), step))
        return F.get(F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out"))), F.lit(0))

    def spans(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), block)["out"])

    single = lambda x: F.struct(x["h"].alias("value"), F.length(x["p"]).alias("start"), (F.length(x["p"]) + F.length(x["h"])).alias("end"))
    empty = F.array().cast(kind)
    found = F.element_at(F.transform(F.transform(hits, pairs), lambda x: F.when(F.size(x) == 1, F.transform(x, single)).when(x.isNotNull(), spans(x)).otherwise(empty)), 1)
    return F.when(text.rlike(needs) if needs else text.isNotNull(), found).otherwise(empty)


def pattern_spans(text: Column, p: Pattern) -> Column:
    """Spans of one pattern, as array<SPAN>."""
    found = matches(text, p.flags + p.regex, p.needs)
    if p.check is not None:
        check = p.check
        found = F.filter(found, lambda m: check(m["value"]))
    return F.transform(found, lambda m: F.struct(F.lit(p.entity).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(p.score).alias("score")))


def spans_of(text: Column, patterns: Iterable[Pattern]) -> Column:
    """Spans of all patterns: those that need a digit are left at once by a text without one."""
    patterns = list(patterns)
    empty = F.array().cast(f"array<{SPAN}>")
    digits = [pattern_spans(text, p) for p in patterns if p.needs in (_DIGIT, _BIRTH)]
    others = [pattern_spans(text, p) for p in patterns if p.needs not in (_DIGIT, _BIRTH)]
    return F.concat(F.when(text.rlike(_DIGIT), F.concat(empty, *digits)).otherwise(empty), *others)


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)\\S"), F.lit(False))


def detect(df: DataFrame, text_col: str = "text", entities: Iterable[str] = ENTITIES, out: str = "spans", score_threshold: float = 0.0, allow_list: Iterable[str] | None = None, ner: Callable[[DataFrame], Column] | None = None, rules: Iterable[Pattern] = ()) -> DataFrame:
    """``df`` with an array of spans.

    ``allow_list`` (off by default) drops spans whose whole text is one of its
    words, ``rules`` are further patterns, ``ner`` is a hook for a model: it
    gets the frame and returns a column of spans.  Blank texts have no spans.
    """
    wanted = set(entities)
    chosen = [p for p in PATTERNS if p.entity in wanted] + list(rules)
    columns = [spans_of(F.col(text_col), chosen)]
    if ner is not None:
        columns.append(ner(df))
    empty = F.array().cast(f"array<{SPAN}>")
    spans = F.when(not_blank(F.col(text_col)), F.concat(empty, *columns)).otherwise(empty)
    if score_threshold > 0:
        spans = F.filter(spans, lambda s: s["score"] >= score_threshold)
    if allow_list is not None:
        words = [w.lower() for w in allow_list]
        spans = F.filter(spans, lambda s: ~F.lower(F.substring(F.col(text_col), s["start"] + 1, s["end"] - s["start"])).isin(words))
    # a generated column: what is asked of it later (whether it is empty, each span) doesn't make it again
    return df.withColumn(out, F.explode(F.array(spans)))


def context_boost(df: DataFrame, text_col: str = "text", spans_col: str = "spans", window: int = 40, boost: float = 0.35) -> DataFrame:
    """Scores raised (to 1 at most) where one of the type's context words stands in the characters before or after."""
    near = lambda s: F.lower(F.substring(F.col(text_col), F.greatest(F.lit(1), s["start"] + 1 - window), s["end"] - s["start"] + 2 * window))

    def raised(s: Column) -> Column:
        hit = F.lit(False)
        for entity, words in CONTEXT.items():
            hit = hit | ((s["entity_type"] == entity) & near(s).rlike("|".join(quoted(w) for w in words)))
        return F.when(hit, F.least(F.lit(1.0), s["score"] + boost)).otherwise(s["score"])

    return df.withColumn(spans_col, F.transform(spans_col, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), raised(s).alias("score"))))


def honorific_person_spans(text_col: str = "text") -> Callable[[DataFrame], Column]:
    """A plain baseline for the NER hook: capitalised names after a form of address."""
    p = Pattern("PERSON", "honorific", r"(?<=\b(?:Herr|Herrn|Frau|Dr\.|Prof\.)[ ])(?:(?:Dr\.|Prof\.)[ ])*[A-ZÄÖÜ][\p{L}-]+(?:[ ][A-ZÄÖÜ][\p{L}-]+){0,2}", 0.85, "(?U)")
    return lambda df: pattern_spans(F.col(text_col), p)

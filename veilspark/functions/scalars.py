"""Scalar functions as Column expressions: checksums, generalisers, parsers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First digit of a postal code -> region.
PLZ_REGIONS = {
    "0": "Region Sachsen/Thüringen",
    "1": "Region Berlin/Brandenburg/Mecklenburg-Vorpommern",
    "2": "Region Hamburg/Schleswig-Holstein/Nord-Niedersachsen",
    "3": "Region Niedersachsen/Sachsen-Anhalt",
    "4": "Region Nordrhein-Westfalen (Ruhrgebiet)",
    "5": "Region Nordrhein-Westfalen (Süd)/Rheinland-Pfalz (Nord)",
    "6": "Region Hessen/Rheinland-Pfalz (Süd)/Saarland",
    "7": "Region Baden-Württemberg (Nord/Ost)",
    "8": "Region Bayern (Süd)/Baden-Württemberg (Süd)",
    "9": "Region Bayern (Nord/Ost)",
}
# Markers and thresholds.
PLZ_UNKNOWN = "Region in Deutschland"
DECADE_UNKNOWN = "unbekanntes Jahrzehnt"
PAY_UNKNOWN = "Einkommensband (öffentlicher Dienst)"
GENDER_MARKER = "[Geschlecht anonymisiert]"
BERUF_CATEGORY = "Berufsangabe (Kategorie)"
OTHER_CATEGORY = "Quasi-Identifier (Kategorie)"
PRESETS = {"utility": 5, "balanced": 3, "paranoid": 1}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn check over the digits of a string of at least 12 of them."""
    d = F.reverse(F.filter(F.split(digits(number), ""), lambda x: x != ""))
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda s, x: s + x,
    )
    return (F.length(digits(number)) >= 12) & (total % 10 == 0)


def iban_ok(iban: Column) -> Column:
    """ISO 13616 check: four characters moved to the end, letters as numbers, modulo 97 is 1."""
    plain = F.upper(F.regexp_replace(iban, " ", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), lambda s, x: F.pmod(s * F.when(value(x) > 9, 100).otherwise(10) + value(x), F.lit(97)))
    return F.length(plain).between(15, 34) & (rest == 1)


def ipv4_ok(address: Column) -> Column:
    return F.forall(F.split(address, "\\."), lambda x: F.length(x).between(1, 3) & (x.cast("int") <= 255))


# The calling codes of two digits (1 and 7 stand alone, all others have three), and lengths of national numbers where they are fixed.
TWO_DIGIT_CODES = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
NATIONAL_LENGTHS = {"1": (10, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (7, 10), "49": (6, 13)}
#: Digits of a number with a leading zero, in Germany.
TRUNK_LENGTHS = (7, 13)


def phone_ok(number: Column) -> Column:
    """Whether the digits fit a numbering plan: the calling code by its prefix, then as many digits as its numbers have (15 in all at most); with a leading zero as many as a domestic number has."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    plain = F.when(digits.startswith("00"), F.substring(digits, F.lit(3), F.length(digits))).otherwise(digits)
    size = F.when(F.substring(plain, 1, 1).isin("1", "7"), 1).when(F.substring(plain, 1, 2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
    code, rest = F.substring(plain, F.lit(1), size), F.length(plain) - size
    fits = (rest >= 5) & (F.length(plain) <= 15)
    for known, (low, high) in NATIONAL_LENGTHS.items():
        fits = F.when(code == known, rest.between(low, high)).otherwise(fits)
    return F.when(number.startswith("+") | digits.startswith("00"), ~plain.startswith("0") & fits).otherwise(F.length(digits).between(*TRUNK_LENGTHS))


def generalize_plz(value: Column) -> Column:
    first = F.regexp_extract(F.coalesce(value, F.lit("")), "[0-9]", 0)
    table = F.create_map(*(F.lit(x) for pair in PLZ_REGIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, first), F.lit(PLZ_UNKNOWN))


def generalize_birth_year(value: Column) -> Column:
    d = digits(F.coalesce(value, F.lit("")))
    year = F.substring(d, 1, 4).try_cast("int")
    phase = F.when(year % 10 <= 2, "Anfang").when(year % 10 <= 6, "Mitte").otherwise("Ende")
    return F.when(F.length(d) < 4, F.lit(DECADE_UNKNOWN)).otherwise(F.concat(phase, F.lit(" der "), (year - year % 10).cast("string"), F.lit("er")))


def generalize_pay_grade(value: Column) -> Column:
    level = F.regexp_extract(F.coalesce(value, F.lit("")), "[0-9]+", 0).try_cast("int")
    band = F.when(level <= 6, "unteres").when(level <= 11, "mittleres").otherwise("gehobenes")
    return F.when(level.isNull(), F.lit(PAY_UNKNOWN)).otherwise(F.concat(band, F.lit(" " + PAY_UNKNOWN)))


def generalize(entity_type: Column, value: Column) -> Column:
    """Generalised form of a quasi-identifier; null where the value stays in the text."""
    return (
        F.when(entity_type == "DE_PLZ", generalize_plz(value))
        .when(entity_type == "DE_GEBURTSJAHR", generalize_birth_year(value))
        .when(entity_type == "DE_TVOED_STUFE", generalize_pay_grade(value))
        .when(entity_type == "DE_GENDER", F.lit(GENDER_MARKER))
    )


def state_category(entity_type: Column, value: Column) -> Column:
    """What a session may remember of a value: never the value itself."""
    return F.coalesce(generalize(entity_type, value), F.when(entity_type == "DE_BERUF", F.lit(BERUF_CATEGORY)).otherwise(F.lit(OTHER_CATEGORY)))


def threshold(preset: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PRESETS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(preset))), F.lit(PRESETS["balanced"]))


def custom_entity_type(entity: Column) -> Column:
    """CUSTOM_ and the upper-cased name with runs of other characters as one underscore; null for an empty result."""
    name = F.regexp_replace(F.regexp_replace(F.upper(entity), "[^A-Z0-9]+", "_"), "\\A_+|_+\\z", "")
    return F.when(name != "", F.concat(F.lit("CUSTOM_"), name))


def leak_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("(?U)[^\\W_]+"), F.lit(0)), lambda x: F.length(x) >= 3)


def leaks(entity: Column, value: Column) -> Column:
    """Whether a category's name says a word of the secret value, or is too long for a category."""
    return F.arrays_overlap(leak_tokens(entity), leak_tokens(value)) | (F.length(F.trim(entity)) > 40) | (F.size(F.split(F.trim(entity), "\\s+")) > 3)


def requested_level(raw: Column) -> Column:
    """null stays null, 1 to 3 are themselves, everything else is 3."""
    n = F.trim(raw).try_cast("int")
    return F.when(raw.isNull(), F.lit(None).cast("int")).when(n.between(1, 3), n).otherwise(3)


def approved(raw: Column) -> Column:
    """Strings only; an integer 1 is not an approval (callers pass booleans as 'true')."""
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "1", "yes", "ja"), F.lit(False))


def opaque_id_ok(value: Column) -> Column:
    return value.rlike("\\A[A-Za-z0-9_.:-]{1,128}\\z")


def session_key(*named: tuple[str, Column]) -> Column:
    """First non-empty of (prefix, value) pairs, as prefix:value."""
    return F.coalesce(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(p + ":"), v)) for p, v in named))


def data_url_outcome(url: Column) -> Column:
    """ok, external, empty or invalid."""
    payload = F.regexp_extract(url, "(?s)\\Adata:[^,]*;base64,(.*)\\z", 1)
    return (
        F.when(url.isNull() | ~url.rlike("\\Adata:[^,]*;base64,"), "external")
        .when(payload == "", "empty")
        .when((F.length(payload) % 4 == 0) & payload.rlike("\\A[A-Za-z0-9+/]+={0,2}\\z"), "ok")
        .otherwise("invalid")
    )


def cleared(detail: Column, secrets: Column) -> Column:
    """A text for logs without any of the array's values, longest first; a null array clears nothing."""
    ordered = F.array_sort(F.transform(F.filter(secrets, lambda s: F.coalesce(s, F.lit("")) != ""), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    return F.when(secrets.isNull(), detail).otherwise(F.aggregate(ordered, detail, lambda d, s: F.replace(d, s["s"], F.lit("[…]"))))


def field_fingerprint(name: Column) -> Column:
    """First 8 hex digits of the hash of a quoted field name, to report a field without its name."""
    return F.substring(F.sha2(F.concat(F.lit("'"), name, F.lit("'")), 256), 1, 8)


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the shorter span."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.try_divide(both.cast("double"), F.least(a_end - a_start, b_end - b_start).cast("double"))

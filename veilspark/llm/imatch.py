"""I-Match fingerprints, DataFrame functions only.

Terms are words (lower-cased, split at blanks and common punctuation).  The
lexicon holds the terms whose document frequency, counted over all documents,
lies in the band ``BAND`` of the documents; it is kept as a bitmap of
``BITS`` hash positions.  A document's distinct terms of the lexicon are sorted
and ``SUBSETS`` random subsets of the lexicon are hashed, each into 16 bits.
So that a subset meets about one term of a short text as of a long one, subsets
are thinned by powers of two: a fingerprint has the hashes at the level that
fits its number of terms, and at the next one.  The likeness of two
fingerprints is the share of equal hashes among the subsets that either meets,
over the levels they have in common.

A text without a term of the lexicon has a fingerprint of its exact words, so
it is like equal texts alone.

Every term of the band is kept, at every size.  A term of the lexicon is in
``BAND[0]`` of the documents at least, so there are at most as many as a
document's mean number of terms over ``BAND[0]`` (500,000 at 250 terms).
A bitmap lets a term from outside the band in when its position is taken: a
share of that number over 2 ** ``BITS`` at most (3 % then).  Next documents are found inside ranges of
ids, so no task sorts the table.

Defined results: a null text is an empty one; equal texts have equal
fingerprints; rows of one id follow each other by a hash of the text; rows
with a null id come first and never count as the one after the last; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Least and largest share of the documents.
BAND = (0.0005, 0.08)
BITS = 24
SUBSETS = 32
#: Terms that a document has at its level: this many to twice as many.
TERMS = 24
RANGE_ROWS = 1000
MAX_RANGES = 1024
_MARKS = ".,;:!?()[]{}\"'|*#%&$\n\t\r"


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    flat = F.translate(F.lower(text), _MARKS, " " * len(_MARKS))
    return F.array_remove(F.array_distinct(F.transform(F.split(flat, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row with the lexicon's bitmap, as an array of 2 ** (BITS - 6) longs."""
    n = docs.count()
    found = docs.select(F.explode(terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    found = stored(found.where((F.col("df") >= max(2, int(band[0] * n))) & (F.col("df") <= max(2, int(band[1] * n)))), "lexicon")
    at = F.col("t").bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast((t & {(1 << BITS) - 1}) & 63 as int))")
    words = found.select(F.shiftright(at, 6).alias("i"), bit.alias("b"))
    marked = words.groupBy("i").agg(F.bit_or("b").alias("b"))
    slots = docs.sparkSession.range(0, 1 << (BITS - 6), 1, 4).select(F.col("id").alias("i"))
    dense = slots.join(marked, "i", "left").select("i", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return stored(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda s: s["b"]).alias("bitmap")), "bitmap")


def _thinned(kept: Column, level: Column) -> Column:
    return F.filter(kept, lambda t: F.shiftrightunsigned(t, 40).bitwiseAND(F.pow(F.lit(2.0), level).cast("long") - 1) == 0)


def _level(thin: Column, level: Column) -> Column:
    """'level:hash,hash,...' of the subsets of the thinned terms; '-' where a subset meets none.

    ``thin`` is named twice so that the optimiser keeps it as a column of its
    own and does not move it into the lambda, once for every subset.
    """
    one = lambda own: F.when(F.size(own) == 0, F.lit("-")).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(own).bitwiseAND(F.lit(65535)))), 4, "0"))
    bits = lambda t, at, n: F.shiftrightunsigned(t, at).bitwiseAND(F.lit(n - 1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS // 8 - 1)), lambda g: F.filter(thin, lambda t: bits(t, 35, SUBSETS // 8) == g))
    parts = F.flatten(F.transform(groups, lambda own: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.filter(own, lambda t: bits(t, 32, 8) == j))))
    return F.concat(level.cast("string"), F.lit(":"), F.when(F.size(thin) == 0, F.array_join(F.array_repeat(F.lit("-"), SUBSETS), ",")).otherwise(F.array_join(F.transform(parts, one), ",")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    levels = lambda f: F.split(f, ";")
    head = lambda p: F.substring_index(p, ":", 1)
    hashes = lambda p: F.split(F.substring_index(p, ":", -1), ",")

    def of(p: Column) -> Column:
        other = F.get(F.filter(levels(b), lambda q: head(q) == head(p)), F.lit(0))
        both = F.zip_with(hashes(p), hashes(other), lambda x, y: F.struct(((x != "-") | (y != "-")).cast("int").alias("met"), ((x != "-") & (x == y)).cast("int").alias("same")))
        return F.when(other.isNull(), F.struct(F.lit(0).alias("met"), F.lit(0).alias("same"))).otherwise(
            F.aggregate(both, F.struct(F.lit(0).alias("met"), F.lit(0).alias("same")), lambda s, z: F.struct((s["met"] + z["met"]).alias("met"), (s["same"] + z["same"]).alias("same")))
        )

    total = F.aggregate(F.transform(levels(a), of), F.struct(F.lit(0).alias("met"), F.lit(0).alias("same")), lambda s, z: F.struct((s["met"] + z["met"]).alias("met"), (s["same"] + z["same"]).alias("same")))
    plain = a.startswith("=") | b.startswith("=")
    return F.when(a == b, F.lit(1.0)).when(plain, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(total["same"].cast("double"), total["met"].cast("double")), F.lit(0.0)))


def fingerprints(df: DataFrame, texts: dict[str, str], bitmap: DataFrame) -> DataFrame:
    """``df`` with, for each name -> text column of ``texts``, a column with that text's fingerprint."""
    mask = (1 << (BITS - 6)) - 1
    table = bitmap.scalar()
    for name, text in texts.items():
        df = df.withColumn("_t", terms(F.col(text)))
        # a subquery may not be written inside a lambda; the optimiser puts it there from the column, so no row carries it
        df = df.withColumn("_lexicon", table)
        df = df.withColumn("_k", F.array_sort(F.filter("_t", lambda t: F.getbit(F.get(F.col("_lexicon"), F.shiftright(t, 6).bitwiseAND(F.lit(mask)).cast("int")), t.bitwiseAND(F.lit(63)).cast("int")) == 1)))
        df = df.withColumn("_s", F.greatest(F.lit(0), F.floor(F.log2(F.size("_k") / F.lit(float(TERMS))))).cast("int"))
        df = df.withColumn("_a", _thinned(F.col("_k"), F.col("_s"))).withColumn("_b", _thinned(F.col("_k"), F.col("_s") + 1))
        plain = F.concat(F.lit("="), F.sha2(F.concat_ws(" ", F.split(F.lower(F.col(text)), r"\s+")).cast("binary"), 256))
        df = df.withColumn(name, F.when(F.size("_k") == 0, plain).otherwise(F.concat(_level(F.col("_a"), F.col("_s")), F.lit(";"), _level(F.col("_b"), F.col("_s") + 1))))
        df = df.drop("_t", "_k", "_s", "_a", "_b", "_lexicon")
    return df


def with_next(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, _text, _next, _own, _after): every row with the next row's text, its own place and the next one's.

    A place is (range of ids, number in it) in one long.  Ranges are split at
    approximate quantiles of the ids; each range also gets the row after it.
    """
    body = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ranges = min(MAX_RANGES, max(1, n // RANGE_ROWS))
    cuts = sorted(set(docs.stat.approxQuantile(id_col, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    inside = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.array(*(F.lit(int(c)).cast("long") for c in cuts)), lambda c: c < F.col("_id"))), F.lit(0))
    placed = body.withColumn("_range", F.when(F.col("_id").isNull(), F.lit(0)).otherwise(inside))
    firsts = placed.where(F.col("_id").isNotNull()).groupBy("_range").agg(F.min("_id").alias("f")).collect()
    firsts = sorted((r["_range"], r["f"]) for r in firsts)  # at most MAX_RANGES
    if not firsts:
        firsts = [(0, None)]
    follow = {a[0]: b for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)}
    copies = [(f, to) for to, (_, f) in follow.items() if f is not None]
    if copies:
        heads = docs.sparkSession.createDataFrame(copies, "_id long, _to int")
        again = placed.join(F.broadcast(heads), "_id").select("_id", "_text", F.col("_to").alias("_range"), F.lit(1).alias("_extra"))
        placed = placed.withColumn("_extra", F.lit(0)).unionByName(again)
    else:
        placed = placed.withColumn("_extra", F.lit(0))
    order = Window.partitionBy("_range").orderBy("_extra", F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    jump = F.create_map(*(F.lit(x) for k, (r, _) in follow.items() for x in (k, r)))
    lead = placed.withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("_text").over(order), F.col("_text"))).withColumn("_last", F.coalesce(F.lead("_extra").over(order), F.lit(1)) == 1)
    place = lambda r, k: F.shiftleft(r.cast("long"), 40) + k.cast("long")
    first_of = F.element_at(jump, F.col("_range"))
    return lead.where("_extra = 0").select(
        F.col("_id").alias(id_col), "_text", "_next", place(F.col("_range"), F.col("_rn")).alias("_own"), F.when(F.col("_last"), place(F.coalesce(first_of, F.col("_range")), F.lit(1))).otherwise(place(F.col("_range"), F.col("_rn") + 1)).alias("_after")
    )


def match(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter replaced by the next one's head), and likenesses."""
    n = docs.count()
    bitmap = lexicon(docs, text_col, band)
    rows = with_next(docs, n, id_col, text_col).withColumn("n_chars", F.char_length("_text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("_next"), F.lit(1), cut))
    rows = rows.withColumn("_edited", edited).drop("_next")
    made = fingerprints(rows, {"fingerprint": "_text", "edited_fingerprint": "_edited"}, bitmap)
    made = stored(made.select(id_col, "_own", "_after", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "fingerprints")
    after = made.select(F.col("_own").alias("_after"), F.col("fingerprint").alias("_f"))
    return made.join(after, "_after", "left").select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round(likeness(F.col("fingerprint"), F.col("edited_fingerprint")), 9).alias("near_edited"), F.round(likeness(F.col("fingerprint"), F.coalesce("_f", "fingerprint")), 9).alias("near_next")
    )

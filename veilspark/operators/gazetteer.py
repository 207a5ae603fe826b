"""Names of many words from a table, found in texts by a join on all their words.

The names are never collected or broadcast on purpose: a table of names may be
as large as the texts.  A text's words are narrow rows that meet the first
words of names; where one is met, as many words as a name of it has are a row,
and rows meet names by all their folded words.  The longest name at each word
wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .detect import matches

WORD = r"(?U)\w+"
# How umlauts are written without them.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def folded(text: Column) -> Column:
    out = F.lower(text)
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def name_words(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(WORD), F.lit(0)), folded)


def find_names(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", entity: str = "entity_type") -> DataFrame:
    """(``key``, entity_type, start, end, value) of every name (``name``, ``entity``) that stands in a text as whole words.

    Words are compared lower-cased and with umlauts written out; between them
    any characters that belong to no word may stand.  Of the names that start
    at one word the longest counts, and of equal ones the first entity in the
    alphabet; names that start at different words may overlap, which overlap
    resolution settles.  Names without a word, null names and null texts give
    nothing; a name that occurs twice counts once.
    """
    known = names.select(F.col(entity).alias("entity_type"), name_words(F.col(name)).alias("_name")).where("size(_name) > 0").groupBy("_name").agg(F.min("entity_type").alias("entity_type"))
    known = written(known, "names")
    # the lengths of the names that begin with a word: many names may begin with the same one, so it never meets the names themselves
    firsts = written(known.groupBy(F.get("_name", F.lit(0)).alias("_first")).agg(F.sort_array(F.collect_set(F.size("_name"))).alias("_sizes")), "first-words")
    own = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    words = own.select("_key", F.posexplode(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).alias("_k", "_first")).withColumn("_first", folded(F.col("_first")))
    hits = words.join(firsts, "_first").groupBy(F.col("_key").alias("_of")).agg(F.collect_list(F.struct("_k", "_sizes")).alias("_hits"))
    # each text comes once, with the places where a name may begin; only the words of a possible name go on
    def possible(w: Column, k: Column, n: Column) -> Column:
        start, end = F.get(w, k)["start"], F.get(w, k + n - 1)["end"]
        return F.struct(k.alias("_k"), n.alias("_n"), F.transform(F.slice(w, k + 1, n), lambda x: folded(x["value"])).alias("_name"), start.alias("start"), end.alias("end"), F.substring("_text", start + 1, end - start).alias("value"))

    fitting = lambda w: F.flatten(F.transform("_hits", lambda h: F.transform(F.filter(h["_sizes"], lambda n: h["_k"] + n <= F.size(w)), lambda n: possible(w, h["_k"], n))))
    near = own.join(hits, F.col("_key").eqNullSafe(F.col("_of"))).select("_key", F.explode(F.flatten(F.transform(F.array(matches(F.col("_text"), WORD)), fitting))).alias("_p")).select("_key", "_p.*")
    met = near.join(known, "_name")
    longest = Window.partitionBy("_key", "_k").orderBy(F.desc("_n"), "entity_type")
    best = met.withColumn("_r", F.row_number().over(longest)).where("_r = 1")
    return best.select(F.col("_key").alias(key), "entity_type", "start", "end", "value")

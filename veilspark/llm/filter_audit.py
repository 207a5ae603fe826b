"""Audit of filter orders by Walsh-Hadamard sums.

Filters that fail independently of one another make every order of them a
question about masks: bit ``i`` of a row's mask says that filter ``i`` fails.
For each part and label the 2 ** k signed parity sums

    W(s) = sum over rows of (-1) ** popcount(mask & s)

are aggregated in one pass (fixed-width sums, so partial sums are made before
the shuffle), and the inverse transform gives the exact number of rows of every
mask: ``cell(m) = sum over s of (-1) ** popcount(m & s) * W(s) / 2 ** k``.
What any order keeps, removes or finds removed already is a sum of cells, and
a row that fails ``f`` filters is removed by each of them in ``k! / f`` of all
orders (120 / f for five), which gives the Shapley sum in closed form.

Defined results: a null part is the empty text; a null mask bit counts as
passed; a null or absent label is none; labels of an id that occurs twice are
joined by their maximum; rows that share an id count one by one; an empty table
has no parts and so no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
#: Of each row: a seed that the second half of a text's 128-bit identity starts from.
_SEED = 0x51F15EED


def identity(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a whole text."""
    return F.xxhash64(text), F.xxhash64(F.lit(_SEED), text)


def _popcount_odd(a: Column | int, b: int) -> Column:
    return F.bit_count(F.lit(a).bitwiseAND(F.lit(b)) if isinstance(a, int) else a.bitwiseAND(F.lit(b))) % 2 == 1


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of every document: which of the five filters it fails.

    A: under 200 words; B: fewer distinct words than half of them; C: more than
    3 % of A-Z among the code points; D: one of ``#$%&*|``; E: equal to the text
    of a smaller id anywhere in the table.  The copies of a text meet only as
    one minimum for each text; a null id is no smaller one and has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = "\t\n\x0b\f\r"
    words = F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), "")
    h1, h2 = identity(text)
    told = docs.select(
        "doc_id",
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        h1.alias("_h1"), h2.alias("_h2"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0].alias("_w"),  # the words are made once, for both counts
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_upper"),
        F.length(text).alias("_n"),
        text.rlike("[#$%&*|]").alias("D"),
    )
    told = told.select("doc_id", "part", "_h1", "_h2", (F.col("_w.n") < 200).alias("A"), (100 * F.col("_w.d").cast("long") < 50 * F.col("_w.n").cast("long")).alias("B"), (100 * F.col("_upper").cast("long") > 3 * F.col("_n").cast("long")).alias("C"), "D")
    first = docs.where(F.col("doc_id").isNotNull()).select("doc_id", h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1", "_h2").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    # written first: a join with it may be split where one text holds very many rows
    joined = told.join(stored(first.select("_h1", "_h2", "_first"), "firsts"), ["_h1", "_h2"], "left")
    return joined.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"))


def parity_sums(rows: DataFrame, part: str, filters: str, marks: dict[str, Column]) -> DataFrame:
    """(part, one array of 2 ** k parity sums for each mark): ``marks`` name boolean columns, and ``all`` is every row."""
    k = len(filters)
    mask = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    signs = rows.select(F.col(part).alias("part"), mask.alias("_m"), *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"_{n}") for n, c in marks.items()), F.lit(1).alias("_all"))
    sums = [F.sum(F.when(_popcount_odd(F.col("_m"), s), -F.col(f"_{n}")).otherwise(F.col(f"_{n}"))).alias(f"{n}_{s}") for n in ("all", *marks) for s in range(1 << k)]
    made = signs.groupBy("part").agg(*sums)
    return made.select("part", *(F.array(*(F.col(f"{n}_{s}") for s in range(1 << k))).alias(n) for n in ("all", *marks)))


def cells(sums: DataFrame, filters: str, names: tuple[str, ...]) -> DataFrame:
    """The inverse transform: of every mark an array of the rows of each mask, exact in integers."""
    size = 1 << len(filters)
    # the signs of the transform as one literal matrix
    signs = F.array(*(F.array(*(F.lit(-1 if (m & s).bit_count() % 2 else 1) for s in range(size))) for m in range(size)))

    def inverse(w: Column) -> Column:
        return F.transform(signs, lambda row: F.aggregate(F.zip_with(row, w, lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda x, y: x + y).cast("decimal(38,0)").cast("long") / size).cast("array<long>")

    return sums.select("part", *(inverse(F.col(n)).alias(n) for n in names))


def orders(table: DataFrame, filters: str, good: str = "good", bad: str = "toxic") -> DataFrame:
    """A row for each part, order of the filters and step, from cells: what the step keeps, removes and finds removed."""
    k = len(filters)
    plan = [("".join(filters[i] for i in p), s + 1, sum(1 << i for i in p[:s]), 1 << p[s]) for p in permutations(range(k)) for s in range(k)]
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(own).alias("own")) for o, s, b, own in plan))
    masks = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def count(name: str, keep) -> Column:
        return F.aggregate(F.zip_with(masks, F.col(name), lambda m, n: F.when(keep(m), n).otherwise(0)), F.lit(0).cast("long"), lambda x, y: x + y)

    before, own = F.col("_s.before"), F.col("_s.own")
    out = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    total = F.lit(factorial(k)).cast("long")
    shapley = F.aggregate(F.zip_with(masks, F.col("all"), lambda m, n: F.when(fails(m), n * (total / F.bit_count(m)).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda x, y: x + y)
    laid = table.select("*", F.explode(steps).alias("_s"))
    return laid.select(
        "part", F.col("_s.filter_order").alias("filter_order"), F.col("_s.step").alias("step"),
        count("all", lambda m: out(m) & ~fails(m)).alias("kept"), count("all", lambda m: out(m) & fails(m)).alias("removed"),
        count("all", lambda m: ~out(m) & fails(m)).alias("redundant"), count("all", lambda m: m == own).alias("unique_fails"),
        count(good, lambda m: out(m) & fails(m)).alias("good_lost"), count(bad, lambda m: out(m) & fails(m)).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Part, order and step of the five filters over whole documents, with labelled losses."""
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t"))
    rows = failures(docs).join(told, "doc_id", "left")
    sums = parity_sums(rows, "part", FILTERS, {"good": F.col("_q") == 1, "toxic": F.col("_t") == 1})
    return orders(cells(sums, FILTERS, ("all", "good", "toxic")), FILTERS)

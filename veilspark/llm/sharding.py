"""Range sharding by sampled splitters, DataFrame functions only.

The key is a 64-bit hash of the text, so equal texts sit next to each other.

1. a size-weighted sample of keys is drawn (a row is taken with probability
   ``size * sample / total``) and its weighted quantiles split the key space
   into ``shards * RANGES`` ranges;
2. each range is divided evenly into ``BINS`` bins whose bytes are counted
   exactly over all rows;
3. texts whose copies together exceed 1/``HOT`` of a shard are overfull and
   are subdivided by a hash of the id; every other text stays whole;
4. the bins are laid end to end and cut where their bytes reach equal shares.

What reaches the driver is bounded by the parameters: the sample, one row per
bin, and at most ``shards * HOT`` overfull texts.

Defined results: a null text counts as an empty one (size 8); null and repeated
ids are rows like others; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RANGES = 4
BINS = 128
HOT = 32
SAMPLE = 24_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _range_of(key: Column, cuts: list[int], first: int = 0) -> Column:
    """Index of the range that a key falls in: a balanced tree of comparisons, inside code generation."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key <= F.lit(cuts[mid]), _range_of(key, cuts[:mid], first)).otherwise(_range_of(key, cuts[mid + 1 :], first + mid + 1))


def splitters(sample: list[tuple[int, float]], parts: int) -> list[int]:
    """Weighted quantiles of sampled (key, weight) pairs; fewer when keys repeat."""
    sample = sorted(sample)
    total, seen, cuts = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        seen += weight
        if seen >= total * (len(cuts) + 1) / parts and len(cuts) < parts - 1:
            while len(cuts) < parts - 1 and seen >= total * (len(cuts) + 1) / parts:
                cuts.append(key)
    return sorted(set(cuts))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; see the module's description."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(F.col(id_col).alias(id_col), body.alias("_t")).select(
            id_col,
            (F.octet_length("_t") + F.lit(8)).cast("long").alias("size"),
            F.crc32(F.col("_t").cast("binary")).alias("text_crc32"),
            F.xxhash64("_t").alias("_key"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / shards)

    weight = F.col("size") * F.lit(sample / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(7), id_col, "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(draw < weight).select("_key", F.greatest(weight, F.lit(1.0)).alias("w")).collect()
    cuts = splitters([(r[0], r[1]) for r in drawn], shards * RANGES)

    key = F.col("_key")
    lows = F.array(*(F.lit(float(x)) for x in [_LOW, *cuts]))
    widths = F.array(*(F.lit(max(1.0, float(b) - float(a))) for a, b in zip([_LOW, *cuts], [*cuts, _HIGH], strict=True)))
    ranged = rows.withColumn("_range", _range_of(key, cuts))
    inside = (key.cast("double") - F.get(lows, F.col("_range"))) / F.get(widths, F.col("_range")) * BINS
    binned = ranged.withColumn("_bin", (F.col("_range") * BINS + F.least(F.greatest(F.floor(inside), F.lit(0)), F.lit(BINS - 1))).cast("int"))

    counted = binned.groupBy("_bin").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    full = [r["_bin"] for r in counted if r["b"] > share / HOT]
    hot = {}
    if full:
        # only texts of more than 1/HOT of a shard: at most shards * HOT rows, whatever the input
        copies = binned.where(F.col("_bin").isin(full)).groupBy("_bin", "_key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        hot = {r["_key"]: (r["_bin"], r["b"], r["n"]) for r in copies.where((F.col("b") > share / HOT) & (F.col("n") > 1)).collect()}
    parts = {k: min(n, int(b * HOT * 2 // share) + 1) for k, (_, b, n) in hot.items()}
    if hot:
        table = spark.createDataFrame([(k, p) for k, p in parts.items()], "_key long, _parts int")
        binned = binned.join(F.broadcast(table), "_key", "left")
        part = F.when(F.col("_parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(11), id_col), F.col("_parts")).cast("int"))
        hot_key = F.when(F.col("_parts").isNull(), F.lit(None).cast("long")).otherwise(key)
    else:
        part, hot_key = F.lit(-1), F.lit(None).cast("long")
    celled = binned.withColumn("_hot", hot_key).withColumn("_part", part)
    cells = celled.groupBy("_bin", "_hot", "_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    cells = sorted(cells, key=lambda r: (r["_bin"], r["_hot"] is not None, r["_hot"] or 0, r["_part"]))

    ends, seen = [], 0
    for r in cells:
        seen += r["b"]
        ends.append(seen - r["b"] / 2)
    bounds = [total * k / shards for k in range(1, shards)]
    placed, used = [], [0] * shards
    for r, middle in zip(cells, ends, strict=True):
        to = bisect_left(bounds, middle)
        placed.append((r["_bin"], r["_hot"], r["_part"], to, used[to]))
        used[to] += r["n"]
    # one row per cell: shards * RANGES * BINS bins and the parts of overfull texts at most
    where = spark.createDataFrame(placed, "_bin int, _hot long, _part int, shard int, _from long")
    own = Window.partitionBy("_bin", "_hot", "_part").orderBy("_key", id_col, "text_crc32")
    numbered = celled.withColumn("_n", F.row_number().over(own) - 1).alias("c")
    same = (F.col("c._bin") == F.col("w._bin")) & F.col("c._hot").eqNullSafe(F.col("w._hot")) & (F.col("c._part") == F.col("w._part"))
    return numbered.join(F.broadcast(where).alias("w"), same).select(
        F.col(f"c.{id_col}").alias(id_col), F.col("c.size").alias("size"), F.col("c.text_crc32").alias("text_crc32"), F.col("w.shard").alias("shard"), (F.col("w._from") + F.col("c._n")).cast("long").alias("slot")
    )

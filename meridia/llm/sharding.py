"""Sharding by sampled splitters (DataFrame operations only).

1. The key of a row is the 64-bit hash of its text, so equal texts are neighbours.
2. A sample is drawn with probability proportional to size (a hash decides, so a task that is run
   again draws the same rows); its weighted quantiles are the boundaries of ``n_ranges`` ranges.
3. One aggregation weighs the ranges exactly.  A range over twice its share is subdivided by a hash of the
   text, and every range again into parts of a half, a quarter and so on, which even the shards out; one text whose copies alone weigh more than a shard's share is subdivided by row, as no shard can hold it.
4. The pieces, at most fifteen times n_ranges rows, are dealt to the shards, heaviest first, each to
   the lightest shard; a row's slot is its piece's first slot plus its rank in the piece.

Law ``bytes``: shard sizes differ by little more than one small piece or one text.  Equal texts share
a shard unless their copies exceed a shard's share.  Ranks are taken within pieces, the copies of a heavy text being
several pieces of one shard, so no task sorts a shard.

Defined cases: a null text counts as empty (size 1, crc 0); rows with equal ids or texts each get
their own slot; fewer rows than shards leave shards empty; an empty table gives no rows; input
columns named like the operator's are replaced.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, columns_but

PREFIX_BITS = 10
OWN = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def choose_boundaries(sample: list[tuple[int, float]], n_ranges: int) -> list[int]:
    """Upper ends of ranges: the keys at which the sample's running weight passes each n-th part."""
    sample = sorted(sample)
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        run += weight
        if run >= total * (len(out) + 1) / n_ranges and (not out or key > out[-1]):
            out.append(key)
    return out


def deal(weights: list[tuple[tuple[int, int], int, int]], n_shards: int, together: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(piece, bytes, rows) to (range, part, shard, first slot), heaviest first to the lightest shard; pieces that together maps to one number go as one."""
    units: dict = {}
    for piece, size, _ in weights:
        unit = together.get(piece, piece)
        units[unit] = units.get(unit, 0) + size
    heap = [(0, s) for s in range(n_shards)]
    shard_of = {}
    for unit, size in sorted(units.items(), key=lambda w: (-w[1], str(w[0]))):
        load, s = heapq.heappop(heap)
        shard_of[unit] = s
        heapq.heappush(heap, (load + size, s))
    first, out = [0] * n_shards, []
    for piece, _, rows in sorted(weights):
        s = shard_of[together.get(piece, piece)]
        out.append((*piece, s, first[s]))
        first[s] += rows
    return out


def shard(docs: DataFrame, n_shards: int = 16, n_ranges: int = 1024, sample_rows: int = 16_384, keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to the kept columns (all of them by default)."""
    spark = docs.sparkSession
    kept = columns_but(docs, OWN) if keep is None else keep
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*kept, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("__key"), F.monotonically_increasing_id().alias("__row"))
    base = checkpointed(base).withColumn("__tie", F.xxhash64("__row"))  # rows that are equal in all columns part as well
    total = base.agg(F.sum("size")).first()[0]
    if not total:
        return base.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    step = max(1, total // sample_rows)
    draw = F.pmod(F.xxhash64("__tie", F.lit("splitters")), F.lit(step))
    sample = [(r[0], float(max(r[1], step))) for r in base.where(draw < F.col("size")).select("__key", "size").collect()]  # about sample_rows rows of two numbers
    ends = choose_boundaries(sample, n_ranges)
    shift, half = 64 - PREFIX_BITS, 1 << (PREFIX_BITS - 1)
    by_prefix: dict[int, list[int]] = {p: [] for p in range(-half, half)}
    for e in ends:
        by_prefix[e >> shift].append(e)
    prefixes = spark.createDataFrame([(p, bisect.bisect_left(ends, p << shift), own) for p, own in by_prefix.items()], "__p int, __base int, __ends array<long>")  # 2^PREFIX_BITS rows
    ranged = base.withColumn("__p", F.shiftright("__key", shift).cast("int")).join(F.broadcast(prefixes), "__p")
    ranged = ranged.withColumn("__range", F.col("__base") + F.size(F.filter("__ends", lambda e: e < F.col("__key")))).drop("__p", "__base", "__ends")
    share = max(1, -(-total // n_ranges))
    heavy = [(r[0], int(-(-r[1] // share))) for r in ranged.groupBy("__range").agg(F.sum("size").alias("w")).where(F.col("w") > 2 * share).collect()]
    parts = F.broadcast(spark.createDataFrame(heavy, "__range int, __parts int"))  # at most n_ranges / 2 rows
    full = -(-total // n_shards)
    keys = ranged.join(parts, "__range", "left_semi").groupBy("__range", "__key").agg(F.sum("size").alias("w")).where(F.col("w") > share)
    heavy_keys = keys.orderBy("__key").collect()  # fewer than n_ranges rows
    hot = [(r["__key"], k, int(-(-r["w"] // share))) for k, r in enumerate(heavy_keys)]
    together = {(heavy_keys[k]["__range"], -1 - k - len(hot) * i): k for _, k, own in hot for i in range(own) if heavy_keys[k]["w"] <= full}
    hots = F.broadcast(spark.createDataFrame(hot, "__key long, __nth int, __own int"))
    halving = F.floor(F.log2(F.pmod(F.xxhash64("__key", F.lit("halving")), F.lit(64)) + 1))  # 0 to 6, each twice as often as the one before
    by_key = 7 * F.pmod(F.xxhash64("__key", F.lit("part")), F.coalesce("__parts", F.lit(1))) + halving
    by_row = -1 - F.col("__nth") - len(hot) * F.pmod("__tie", F.col("__own"))
    cut = ranged.join(parts, "__range", "left").join(hots, "__key", "left").withColumn("__part", F.coalesce(by_row, by_key).cast("int")).drop("__parts", "__nth", "__own")
    weights = [((r[0], r[1]), r[2], r[3]) for r in cut.groupBy("__range", "__part").agg(F.sum("size"), F.count(F.lit(1))).collect()]  # at most 15 n_ranges rows
    dealt = spark.createDataFrame(deal(weights, n_shards, together), "__range int, __part int, shard int, __first long")
    order = Window.partitionBy("__range", "__part").orderBy("__key", "__row")
    out = cut.withColumn("__rank", F.row_number().over(order) - 1).join(F.broadcast(dealt), ["__range", "__part"])
    return out.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__first") + F.col("__rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

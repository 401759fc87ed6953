"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. ``targets``: the sources share the words of all of them by weight; a target stops at ``most`` times its source's words and
   the excess is shared again.  The level at which the others stand is found by sums over the table of sources.
2. A source is a line of its documents, ordered by a hash, cut into blocks of ``block_words`` words.  A document's place on the
   line is the sum of hash ranges before it plus the sum before it within its range.
3. Of a source's target come its whole epochs and one part of an epoch: so many blocks that their words just reach the target,
   the last cut to it.  In each epoch the blocks are drawn in an order of their own, a keyed permutation (a Feistel network).
4. ``split``: the draws of all sources are partitioned among the output shards.  A node of the tree holds the quotas of its
   sources; its left half gets a multivariate hypergeometric draw of them, exactly as many blocks as its shards take, its right
   half the rest, and so on to the single shard.  So a shard's blocks are what cutting one random order of all draws into
   shards would give, and their sums are the quotas.  Each level of jobs splits a node in up to FAN; sources are split in
   groups of GROUP, the groups' sums before, so a task holds GROUP times FAN numbers whatever the corpus.
5. ``mixture``: a shard takes the next blocks of each source's order (disjoint from all others'); blocks meet the documents on
   them by a join on (source, block), and a shard's pieces are shuffled by hash.

Seeds and hashes of the rows' own values decide everything, so reruns agree whatever the partitioning.

Defined cases: a null text has no words; null is a source, the last; sources without words get a target of 0; weights of 0 get
nothing; rows that are equal in id, source and text are taken each; without any words there are no pieces; an empty table gives
no rows; input columns named like the operator's are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import numbered
from .common import BROADCAST_KEYS, checkpointed, columns_but, join_counted, map_rows

WORD = r"[^\x20\x09-\x0D]++"
MOST = 3
#: Words of a block and of an output shard.
BLOCK_WORDS, SHARD_WORDS = 1024, 1 << 22
#: Blocks up to which numpy draws hypergeometric numbers; beyond, blocks are made longer.
MOST_BLOCKS = 500_000_000
GROUP, FAN = 256, 256
#: Documents of a hash range of a source's line.
RANGE_ROWS = 16_384
OWN = {"size", "source_size", "target"}
PIECES = ["shard", "slot", "source_no", "epoch", "block", "start", "length"]


def cyclic_weight(number: Column) -> Column:
    """1, 2, 3, repeating, by the source's number."""
    return (F.pmod(number, F.lit(3)) + 1).cast("double")


def sized(docs: DataFrame, keep: list[str] | None = None, seed: int = 0) -> DataFrame:
    """The kept columns with source, size (words), __row and the 128-bit key that orders a source's line."""
    kept = columns_but(docs, OWN) if keep is None else keep
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    parts = [F.col("doc_id").cast("long"), text.isNull(), text, source.isNull(), source]
    return docs.select(*kept, source.alias("__source"), size.alias("size"), F.xxhash64(F.lit(seed), *parts).alias("__key"), F.xxhash64(F.lit(~seed), *parts[::-1]).alias("__key2"), F.monotonically_increasing_id().alias("__row"))


def targets(sources: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """sources (__source, source_size; checkpointed) with source_no, in order of code points, null last, and target.

    weight: of the columns source, source_no and source_size; cyclic_weight by default."""
    each = numbered(sources, [F.col("__source").asc_nulls_last()], "source_no")
    value = cyclic_weight(F.col("source_no")) if weight is None else weight
    each = checkpointed(each.withColumn("__weight", value.cast("double")))
    room = F.col("source_size") * most
    total = each.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round that goes on fills a source more; sums only come to the driver
        stops = room <= F.col("__weight") * level
        n, held, open_weight = each.agg(F.count_if(stops), F.coalesce(F.sum(F.when(stops, room)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("__weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        level, full = (total - held) / open_weight, n
    return each.withColumn("target", F.least(room.cast("double"), F.col("__weight") * level)).drop("__weight")


def draws(sources: DataFrame, block_words: int, seed: int = 0) -> DataFrame:
    """targets() with words to take, whole epochs, n_blocks, quota (blocks to draw) and last_words, what the last draw keeps.

    A source's last block is short, at place short in the order of the partial epoch."""
    words, size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    s = sources.withColumn("words", words).withColumn("epochs", F.when(size > 0, F.floor(F.col("words") / size)).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("n_blocks", F.ceil(size / block_words).cast("long")).withColumn("rest", F.col("words") - F.col("epochs") * size)
    s = s.withColumn("short", place_of("source_no", "epochs", F.col("n_blocks") - 1, "n_blocks", seed))
    missing = F.col("n_blocks") * block_words - size  # what the short block lacks
    plain = F.ceil(F.col("rest") / block_words).cast("long")
    part = F.when(plain <= F.col("short"), plain).otherwise(F.ceil((F.col("rest") + missing) / block_words).cast("long"))
    s = s.withColumn("part", F.when(F.col("rest") > 0, part).otherwise(F.lit(0).cast("long")))
    before = (F.col("part") - 1) * block_words - F.when(F.col("part") - 1 > F.col("short"), missing).otherwise(F.lit(0))
    return s.withColumn("last_words", F.col("rest") - before).withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.col("part")).drop("rest", "short", "part", "words")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(key: np.ndarray, x: np.ndarray, n: np.ndarray, back: bool = False) -> np.ndarray:
    """Where the permutation of 0 to n - 1 that key names sends x (back: whence it comes): four Feistel rounds over the next
    power of four, walked on until the place is below n."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask, key = (np.uint64(1) << bits) - np.uint64(1), _mixed(key.astype(np.uint64))
    out, todo = x.astype(np.uint64), np.arange(len(x))
    limit = n.astype(np.uint64)
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(3, -1, -1) if back else range(4):
            stirred = lambda half: _mixed(half + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) & m  # noqa: B023, E731
            left, right = (right ^ stirred(left), left) if back else (right, left ^ stirred(right))
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _permuting(seed: int, back: bool):
    @F.pandas_udf("long")
    def run(source_no: pd.Series, epoch: pd.Series, x: pd.Series, n: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            key = _mixed(_mixed(source_no.to_numpy(np.int64).astype(np.uint64) + np.uint64(seed)) + epoch.to_numpy(np.int64).astype(np.uint64))
            live = n.to_numpy(np.int64) > 0
            out = np.zeros(len(x), np.int64)
            out[live] = permuted(key[live], x.to_numpy(np.int64)[live], n.to_numpy(np.int64)[live], back)
            return pd.Series(out)

    return run


def block_at(source_no: str, epoch: str, place: Column | str, n: str, seed: int = 0) -> Column:
    """The block drawn at a place of an epoch of a source."""
    return _permuting(seed, False)(source_no, epoch, place, n)


def place_of(source_no: str, epoch: str, block: Column | str, n: str, seed: int = 0) -> Column:
    """The place at which an epoch of a source draws a block."""
    return _permuting(seed, True)(source_no, epoch, block, n)


def capacity(lo: int, hi: int, n_blocks: int, n_shards: int) -> int:
    """Blocks that shards lo to hi - 1 take of n_blocks: as many each, give or take one."""
    return n_blocks * hi // n_shards - n_blocks * lo // n_shards


def halved(rng: np.random.Generator, quotas: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """quotas parted among children that take sizes blocks: halves by a multivariate hypergeometric draw, again and again."""
    if len(sizes) == 1:
        return [quotas]
    mid = len(sizes) // 2
    left = rng.multivariate_hypergeometric(quotas, sum(sizes[:mid]), method="marginals")
    return halved(rng, left, sizes[:mid]) + halved(rng, quotas - left, sizes[mid:])


def _children(lo: int, hi: int, fan: int) -> list[tuple[int, int]]:
    n = min(fan, hi - lo)
    return [(lo + (hi - lo) * i // n, lo + (hi - lo) * (i + 1) // n) for i in range(n)]


def split(quotas: DataFrame, n_blocks: int, n_shards: int, seed: int = 0, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """source_no, shard, from and to: the places of a source's draws that each shard takes.  quotas: source_no, quota; n_blocks, their sum."""
    sources = quotas.where("quota > 0").select("source_no", "quota", F.floor(F.col("source_no") / group).cast("long").alias("grp"), F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"))
    groups = sources.groupBy("lo", "hi", "grp").agg(F.sum("quota").alias("quota"))
    node = "lo long, hi long, grp long, quota long"

    def part_groups(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = map(int, key)
        rows = rows.sort_values("grp")
        kids = _children(lo, hi, fan)
        parts = halved(np.random.default_rng([seed, 0, lo, hi]), rows["quota"].to_numpy(np.int64), [capacity(a, b, n_blocks, n_shards) for a, b in kids])
        return pd.concat([pd.DataFrame({"lo": a, "hi": b, "grp": rows["grp"], "quota": q}) for (a, b), q in zip(kids, parts, strict=True)]).query("quota > 0")

    def part_sources(key: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        lo, hi, grp = map(int, key)
        rows = rows.sort_values("source_no")
        kids = _children(lo, hi, fan)
        takes = dict(zip(sums["lo"], sums["quota"], strict=True))
        parts = halved(np.random.default_rng([seed, 1, lo, hi, grp]), rows["quota"].to_numpy(np.int64), [int(takes.get(a, 0)) for a, _ in kids])
        return pd.concat([pd.DataFrame({"source_no": rows["source_no"], "quota": q, "grp": grp, "lo": a, "hi": b}) for (a, b), q in zip(kids, parts, strict=True)]).query("quota > 0")

    width = n_shards
    while width > 1:
        below = groups.groupBy("lo", "hi").applyInPandas(part_groups, node)
        n = F.least(F.lit(fan), F.col("p_hi") - F.col("p_lo"))
        parent = groups.select(F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi")).distinct()
        kid = F.floor(((F.col("p_hi") - F.col("p_lo")) * F.col("i")) / n)
        kids = parent.withColumn("i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))).select("p_lo", "p_hi", (F.col("p_lo") + kid).alias("lo"))
        sums = below.join(kids, "lo")
        sources = sources.groupBy("lo", "hi", "grp").cogroup(sums.select(F.col("p_lo"), F.col("p_hi"), "grp", "lo", "quota").groupBy("p_lo", "p_hi", "grp")).applyInPandas(part_sources, "source_no long, quota long, grp long, lo long, hi long")
        sources, groups = checkpointed(sources), checkpointed(below)
        width = -(-width // fan)
    upto = F.sum("quota").over(Window.partitionBy("source_no").orderBy("lo"))  # at most as many rows as shards
    return sources.select("source_no", F.col("lo").alias("shard"), (upto - F.col("quota")).alias("from"), upto.alias("to"))


def lines(rows: DataFrame) -> DataFrame:
    """rows of sized() (checkpointed; with source_no and source_rows) with at: the words before the document on its source's line."""
    ranges = F.ceil(F.col("source_rows") / RANGE_ROWS)
    cut = rows.withColumn("__range", F.shiftright(F.shiftrightunsigned("__key", 33) * ranges, 31)).drop("source_rows")
    full = cut.groupBy("source_no", "__range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * RANGE_ROWS).select("source_no", "__range")
    # Rows that are equal may fill a range: they have one size, so any order of them gives the same places.
    hot = checkpointed(cut.join(full, ["source_no", "__range"], "left_semi").groupBy("source_no", "__key", "__key2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANGE_ROWS).select("source_no", "__key", "__key2", F.ceil(F.col("n") / RANGE_ROWS).alias("__parts")))
    parted = cut.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, ["source_no", "__key", "__key2"], "left")
    by_row = F.pmod(F.xxhash64("__row"), F.col("__parts"))
    parted = parted.withColumn("__bit", F.when(F.col("__parts").isNull(), F.struct("__range", F.lit(False).alias("own"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("part"))).otherwise(F.struct("__range", F.lit(True).alias("own"), F.col("__key").alias("key"), by_row.alias("part")))).drop("__parts")
    weights = parted.groupBy("source_no", "__bit").agg(F.sum("size").alias("w"))
    before = F.sum("w").over(Window.partitionBy("source_no").orderBy("__bit").rowsBetween(Window.unboundedPreceding, -1))
    starts = weights.select("source_no", "__bit", F.coalesce(before, F.lit(0).cast("long")).alias("__start"))
    within = F.sum("size").over(Window.partitionBy("source_no", "__bit").orderBy("__key", "__key2", "__row").rowsBetween(Window.unboundedPreceding, -1))
    placed = parted.withColumn("__within", F.coalesce(within, F.lit(0).cast("long"))).join(starts, ["source_no", "__bit"])
    return placed.withColumn("at", F.col("__start") + F.col("__within")).drop("__start", "__within", "__bit", "__range")


def mixture(docs: DataFrame, keep: list[str] | None = None, weight: Column | None = None, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: the kept columns of every row with __row, __key, __key2, size, source_size and target.
    pieces: what the mix takes: __row and keys of the document, shard, slot (place in the shard, from 0), source_no, epoch, block, start
    (the document's words before the piece) and length."""
    spark = docs.sparkSession
    base = checkpointed(sized(docs, keep, seed))
    totals = base.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = targets(checkpointed(totals), weight, most)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while total > MOST_BLOCKS * block_words:
        block_words *= 2
    planned = checkpointed(draws(sources, block_words, seed))
    n_blocks = planned.agg(F.sum("quota")).first()[0] or 0
    name = F.coalesce(F.concat(F.lit("="), "__source"), F.lit("")).alias("__name")
    names = planned.select(name, "source_no", "source_size", "source_rows", "target")
    rows = base.select("*", name).drop("__source")
    named = rows.join(F.broadcast(names), "__name") if names.count() <= BROADCAST_KEYS else join_counted(rows, names, "__name", "source_rows", RANGE_ROWS)
    documents = checkpointed(named.drop("__name"))
    if not n_blocks:
        empty = spark.createDataFrame([], "__row long, __key long, __key2 long, shard long, slot int, source_no long, epoch long, block long, start long, length long")
        return documents, empty
    n_shards = max(1, -(-n_blocks * block_words // shard_words))
    leaves = split(planned.select("source_no", "quota"), n_blocks, n_shards, seed)
    plan = planned.select("source_no", "n_blocks", "quota", "last_words")
    each = leaves.join(plan, "source_no").withColumn("position", F.explode(F.sequence("from", F.col("to") - 1)))
    each = each.withColumns({"epoch": F.floor(F.col("position") / F.col("n_blocks")), "place": F.pmod("position", "n_blocks")})
    drawn = each.select("source_no", "shard", "epoch", block_at("source_no", "epoch", "place", "n_blocks", seed).alias("block"), F.when((F.col("position") == F.col("quota") - 1) & (F.col("last_words") > 0), F.col("last_words")).otherwise(F.lit(block_words)).alias("upto"))
    line = lines(documents.where("size > 0").select("__row", "__key", "__key2", "source_no", "source_rows", "size"))
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    cut = line.withColumn("block", F.explode(F.sequence(first, last)))
    met = cut.join(drawn, ["source_no", "block"])
    begin, end = F.greatest(F.col("at"), F.col("block") * block_words), F.least(F.col("at") + F.col("size"), F.col("block") * block_words + F.col("upto"))
    pieces = met.withColumns({"start": begin - F.col("at"), "length": end - begin}).where("length > 0")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "source_no", "epoch", "block", "__key", "start"), "__key", "__key2", "__row")  # a shard is of shard_words words at most
    return documents, pieces.withColumn("slot", F.row_number().over(order) - 1).select("__row", "__key", "__key2", *PIECES)


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """documents with taken, the words that the mix has of them, and the first shard and slot that hold some."""
    per = pieces.groupBy("__row").agg(F.sum("length").alias("taken"), F.min(F.struct("shard", "slot")).alias("first"))
    joined = documents.join(per, "__row", "left")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).withColumns({"first_shard": F.col("first.shard"), "first_slot": F.col("first.slot")}).drop("first")


def texts(docs: DataFrame, pieces: DataFrame, seed: int = 0) -> DataFrame:
    """shard, slot and text of every piece: the document from its first to its last word of the piece, as it is written there."""
    own = sized(docs, ["text"], seed).groupBy("__key", "__key2").agg(F.first("text").alias("text"))
    word = re.compile(WORD)

    def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
        spans: dict[str, list[tuple[int, int]]] = {}
        out = []
        for text, start, length in zip(*(rows.column(n).to_pylist() for n in ("text", "start", "length")), strict=True):
            if text not in spans:
                spans[text] = [m.span() for m in word.finditer(text)]
            own = spans[text]
            out.append(text[own[start][0] : own[start + length - 1][1]])
        return pa.RecordBatch.from_arrays([rows.column("shard"), rows.column("slot"), pa.array(out, pa.string())], names=["shard", "slot", "text"])

    return map_rows(pieces.join(own, ["__key", "__key2"]).select("shard", "slot", "start", "length", "text"), cut, "shard long, slot int, text string")

"""URL filter: a blocked Bloom filter before an exact hash join (DataFrame operations only).

A list entry is a canonical URL pattern (host, path): it fits its host and all subdomains, and paths
that start with its path.  Every URL gives the candidates (host suffix, path prefix): suffixes of as many labels, and
prefixes as long, as some entry has, so a long host or path costs no more than the list's own shapes.  A candidate
passes if all its bits are set in the one 256-bit block that its hash names; candidates that pass go to an
exact hash join with the list, which removes the false positives.  The longest entry decides (ties:
the host's length, then the order of the list).

The filter is built by one aggregation.  Up to ``max_inline_blocks`` blocks it is a constant array in
the plan, and candidates are dropped inside their row, before anything is exploded or shuffled; a larger one is a table
joined by the block's number.  The list is joined by Spark's choice of join (broadcast only below the session's
size threshold).  Hits come back by a row number written to a checkpoint: no popular URL is a key, and
only rows with a hit are shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path and is matched by nothing;
repeated urls are judged one by one; an empty list lets everything through; a list entry with a null
host or path is ignored; an empty table gives no rows; columns named like the operator's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, columns_but

WORDS = 4  # of 64 bits a block
HASHES = 6
OWN = {"host", "path", "rule", "verdict"}


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(word: int) -> str:
    """SQL for the bits of one word of the block, from the hash __bits."""
    bits = [f"(shiftright(__bits, {8 * i}) & 255)" for i in range(HASHES)]
    return " | ".join(f"if(shiftright({b}, 6) = {word}, shiftleft(1L, cast({b} & 63 as int)), 0L)" for b in bits)


def build_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block and its words w0..w3, from a column key."""
    hashed = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"), F.xxhash64("key", F.lit("bits")).alias("__bits"))
    masks = hashed.select("block", *[F.expr(_mask(w)).alias(f"w{w}") for w in range(WORDS)])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def inline_filter(built: DataFrame, n_blocks: int) -> tuple[Column, ...]:
    """The filter's words as constant arrays; built has at most n_blocks rows."""
    words = [["0"] * n_blocks for _ in range(WORDS)]
    for r in built.collect():
        for w in range(WORDS):
            words[w][r["block"]] = str(r[f"w{w}"])
    return tuple(F.split(F.lit(",".join(own)), ",").cast("array<bigint>") for own in words)


def passing(keys: Column, inline: tuple[Column, ...], n_blocks: int) -> Column:
    """The elements of an array of keys that an inline filter lets pass."""
    hashed = F.transform(keys, lambda k: F.struct(k.alias("key"), F.pmod(F.xxhash64(k), F.lit(n_blocks)).cast("int").alias("block"), F.xxhash64(k, F.lit("bits")).alias("bits")))

    def ok(x: Column) -> Column:
        out = F.lit(True)
        for w in range(WORDS):
            mask = F.lit(0).cast("long")
            for i in range(HASHES):
                b = F.shiftright(x["bits"], 8 * i).bitwiseAND(F.lit(255))
                mask = mask.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
            out = out & (F.get(inline[w], x["block"]).bitwiseAND(mask) == mask)
        return out

    return F.transform(F.filter(hashed, ok), lambda x: x["key"])


def probe(candidates: DataFrame, built: DataFrame, n_blocks: int, max_inline_blocks: int = 256) -> DataFrame:
    """The rows of candidates (column key) that the filter lets pass."""
    if n_blocks <= max_inline_blocks:
        return candidates.where(F.size(passing(F.array("key"), inline_filter(built, n_blocks), n_blocks)) > 0)
    hashed = candidates.withColumns({"__block": F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"), "__bits": F.xxhash64("key", F.lit("bits"))})
    renamed = built.select(F.col("block").alias("__block"), *[F.col(f"w{w}").alias(f"__w{w}") for w in range(WORDS)])
    hit = " and ".join(f"(__w{w} & ({_mask(w)})) = ({_mask(w)})" for w in range(WORDS))
    return hashed.join(renamed, "__block").where(hit).select(candidates.columns)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def canonical(rules: DataFrame) -> DataFrame:
    """key, rule, verdict, weight of each usable list entry (host, path, verdict)."""
    host = ascii_lower(F.col("host"))
    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    keyed = usable.select(F.concat(host, "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length"), _labels(F.col("host")).alias("labels"))
    return keyed.groupBy("key").agg(F.min_by(F.struct("rule", "verdict", "host_length", "path_length", "labels"), F.struct("rule", "verdict")).alias("r")).select("key", "r.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", bits_per_key: int = 16, max_inline_blocks: int = 256, keep: list[str] | None = None) -> DataFrame:
    """Add host, path, rule and verdict to the kept columns (all of them by default)."""
    kept = columns_but(pages, OWN) if keep is None else keep
    rules = checkpointed(canonical(rules))
    n_rules = rules.count()
    url = F.col("url").cast("string")
    parsed = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    if not n_rules:
        return parsed.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = max(1, -(-n_rules * bits_per_key // (64 * WORDS)))
    shapes = rules.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("path_length"))).first()  # no more than the longest host and path
    built = build_filter(rules, n_blocks)
    own = _labels(F.col("host"))
    suffixes = F.filter(F.array(*[F.when((F.lit(n) <= own) & (F.col("host") != ""), F.substring_index("host", ".", -n)) for n in shapes[0]]), lambda x: x.isNotNull())
    ends = F.filter(F.array(*[F.lit(x) for x in shapes[1]]), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(ends, lambda x: F.concat(s, F.substring("path", F.lit(1), x)))))
    inline = n_blocks <= max_inline_blocks
    found = parsed.withColumns({"__row": F.monotonically_increasing_id(), "__keys": passing(keys, inline_filter(built, n_blocks), n_blocks) if inline else keys})
    found = checkpointed(found)
    candidates = found.select("__row", F.explode("__keys").alias("key"))
    hits = (candidates if inline else probe(candidates, built, n_blocks, max_inline_blocks)).join(rules, "key")
    order = F.struct(F.col("host_length") + F.col("path_length"), F.col("host_length"))
    judged = hits.groupBy("__row").agg(F.max_by(F.struct("rule", "verdict"), order).alias("__hit"))
    maybe = F.size("__keys") > 0
    met = found.where(maybe).drop("__keys").join(judged, "__row", "left")
    alone = found.where(~maybe).drop("__keys").withColumn("__hit", F.lit(None).cast(judged.schema["__hit"].dataType))
    out = met.unionByName(alone)
    return out.select(*kept, "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))

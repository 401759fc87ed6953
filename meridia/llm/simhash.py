"""Near-duplicates by SimHash fingerprints and bit-sliced comparison.

``near_duplicates``: links of at most ``radius`` differing bits of 64, exact.

1. Fingerprints: 64 bits, a bit set where over half the text's three-word shingles have it set.
2. Equal fingerprints are one node (pre-aggregated before any shuffle).
3. Within radius r two fingerprints agree on at least one of r + 1 bands, so each node goes to r + 1
   buckets.  For radii up to 2 a bucket of over ``hot`` nodes is refined instead, at every size of the
   table: each of its nodes goes to the buckets of every fingerprint that differs from it in at most one
   bit outside the band; two nodes within the radius share such a middle.  No refined bucket can hold
   more than 44 nodes, so the work stays in proportion to the nodes.  For wider radii it is cut into cells (4).

``keep_one``: texts whose five-word shingles (as sets) have a Jaccard similarity of 0.8 or more.

1. Texts of equal words are one node.  A node's fingerprint has ``BITS`` bits; two sets of similarity s differ in a
   share of arccos(2s / (1 + s)) / pi of them, so the radius is that share of BITS at 0.8 and 2.5 standard
   deviations more.  Links are decided on the distance: of the pairs at 0.8 over 99 % are within the radius, at 0.7
   about three quarters, under 0.55 none (measured figures in the README).
2. Nodes meet in ``BANDS`` buckets, each named by ``ROWS`` least shingle hashes: of two nodes at 0.8 all but
   (1 - 0.8^3)^12 = 0.02 % share one.
3. A bucket of over ``hot`` nodes is cut into chunks of about ``hot`` nodes by a hash of the node, and every pair of
   chunks is a cell of its own: all pairs still meet, no task holds the bucket.

Both: in a bucket the fingerprints are stored as vertical bit planes.  A query's planes are XORed with them and
added with carry-save counters, 64 candidates to a machine word; a block of candidates is given up
as soon as all of them exceed the radius.  In a long bucket the first nodes without a link are compared with all
others, so that a crowd of copies becomes one part at once; what remains is compared across parts only.
Links of a bucket are reduced to one label for each of its connected parts; the parts of all buckets are
joined by passing on least labels until nothing changes, with a checkpoint each round.

Defined cases: null and empty texts are one node (fingerprint zero) and linked like any other; rows with equal
texts are of one component; null ids never become a component's name unless all its ids are
null; an empty table gives no rows; other columns are ignored (``near_duplicates``) or kept (``keep_one``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, by_key, checkpointed, join_counted, keyed, map_rows, released

RADIUS = 2
SHINGLE = 3
HOT = 2048
SIMILARITY, WORDS = 0.8, 5
BITS, BANDS, ROWS = 512, 12, 3
LEADERS = 32
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of size words (of all words, where there are fewer), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: space and \\t-\\r
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :][:n].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last, strict=True)), np.uint64, n)


def _majority(hashes: np.ndarray, mix: np.ndarray | None = None) -> np.ndarray:
    """Bytes of the bits that over half the hashes have; mix: multipliers, one for every 64 bits wanted."""
    width = 1 if mix is None else len(mix)
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, len(hashes), _CHUNK // width):
        h = hashes[at : at + _CHUNK // width, None]
        if mix is not None:
            h = _scattered(h, mix)
        counts += np.unpackbits(np.ascontiguousarray(h.astype("<u8")).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little")


def _scattered(h: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One further hash of h for each odd multiplier."""
    h = h * multipliers
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_ODD = np.random.default_rng(8).integers(0, 1 << 63, BITS // 64 + BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return int(_majority(shingle_hashes(text, size)).view("<u8")[0])


def sketch(text: str | None, size: int = WORDS) -> tuple[bytes, bytes, list[int]]:
    """A text's node (128 bits of its words), its SimHash of BITS bits, and its buckets' keys (none without words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    node = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    h = np.unique(shingle_hashes(text, size))
    if not len(h):
        return node, bytes(BITS // 8), []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), _CHUNK // 8):
        least = np.minimum(least, _scattered(h[at : at + _CHUNK // 8, None], _ODD[BITS // 64 :]).min(0))
    keys = [xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), b) - (1 << 63) for b, own in enumerate(least.reshape(BANDS, ROWS))]
    return node, _majority(h, _ODD[: BITS // 64]).tobytes(), keys


def radius_of(similarity: float, bits: int = BITS, deviations: float = 2.5) -> int:
    """Differing bits that two shingle sets of that Jaccard similarity keep within."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and its fingerprint as a signed long (fp), and the carried columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *carried])

    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return map_rows(inner, run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *inner.schema.fields[2:]]))


def bit_planes(words: np.ndarray) -> np.ndarray:
    """Fingerprints (n x w words of 64 bits) as 64 w planes of ceil(n / 64) words: bit i of plane p is bit p of fingerprint i."""
    n = -(-len(words) // 64) * 64
    padded = np.zeros((n, words.shape[1]), "<u8")
    padded[: len(words)] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in every lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within_planes(differing: Iterator[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Words whose bits mark the lanes with at most radius differing planes (their number is a multiple of eight)."""
    k = max(4, radius.bit_length())
    counters = [np.zeros(shape, np.uint64) for _ in range(k)]
    over = np.zeros(shape, np.uint64)

    def exceeds() -> np.ndarray:
        greater, equal = over.copy(), ~np.zeros(shape, np.uint64)
        for j in range(k - 1, -1, -1):
            if radius >> j & 1:
                equal &= counters[j]
            else:
                greater |= equal & counters[j]
                equal &= ~counters[j]
        return greater

    planes, done = iter(differing), 0
    while (first := next(planes, None)) is not None:
        p = [first, *(next(planes) for _ in range(7))]
        ones, twos, fours = counters[:3]
        fours_in = []
        for i in (0, 4):
            ones, a = _carry_save(ones, p[i], p[i + 1])
            ones, b = _carry_save(ones, p[i + 2], p[i + 3])
            twos, c = _carry_save(twos, a, b)
            fours_in.append(c)
        fours, carry = _carry_save(fours, *fours_in)
        counters[:3] = [ones, twos, fours]
        for j in range(3, k):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        done += 8
        if done > radius and (exceeds() == ~np.uint64(0)).all():
            return np.zeros(shape, np.uint64)
    return ~exceeds()


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(*words.shape[:-1], -1), axis=-1, bitorder="little")[..., :n].astype(bool)


def _matches(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> np.ndarray:
    """queries x n booleans: which of n fingerprints, given as planes, each query is within the radius of."""
    masks = np.zeros(1, np.uint64) - np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)  # all ones where the query's bit is set
    differing = (planes[p][None, :] ^ masks[:, p][:, None] for p in range(len(planes)))
    return _lanes(within_planes(differing, (len(queries), planes.shape[1]), radius), n)


class _Parts:
    """Connected parts of indices; the least index names a part."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def _link_small(words: np.ndarray, starts: np.ndarray, size: int, radius: int, parts: _Parts) -> None:
    """Runs of one small size together, one lane for each pair of members."""
    i, j = np.triu_indices(size, 1)
    step = max(1, (1 << 18) // len(i) // words.shape[1])
    for at in range(0, len(starts), step):
        s = starts[at : at + step]
        a, b = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
        planes = bit_planes(words[a] ^ words[b])
        hit = _lanes(within_planes(iter(planes), planes.shape[1:], radius), len(a))
        for x, y in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
            parts.link(x, y)


def _link_run(words: np.ndarray, start: int, size: int, radius: int, parts: _Parts) -> None:
    """A long run: a few leaders against all, then many queries against vertical blocks, across parts only."""
    own = words[start : start + size]
    planes = bit_planes(own)
    left = np.ones(size, bool)
    for _ in range(LEADERS):
        at = int(left.argmax())
        hit = np.flatnonzero(_matches(own[at : at + 1], planes, size, radius)[0])
        for x in hit.tolist():
            parts.link(start + at, start + x)
        left[hit] = False
        if not left.any():
            break
    label = np.array([parts.root(start + x) for x in range(size)])
    if (label == label[0]).all():
        return
    order = np.argsort(label, kind="stable")
    label = label[order]
    for block in range(0, size, 4096):
        place = order[block : block + 4096]
        planes = bit_planes(own[place])
        for at in range(0, block + len(place), 256):
            q = order[at : at + 256]
            low, high = min(label[at], label[block]), max(label[min(at + 256, size) - 1], label[min(block + 4096, size) - 1])
            if low == high:
                continue
            a, b = np.nonzero(_matches(own[q], planes, len(place), radius))
            for x, y in zip(q[a].tolist(), place[b].tolist(), strict=True):
                if x != y:
                    parts.link(start + x, start + y)


def linked_parts(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Least index of each index's connected part, links being pairs within the radius in one run of words (n x w)."""
    parts = _Parts(len(words))
    small = sizes <= 16
    for size in np.unique(sizes[small & (sizes > 1)]):
        _link_small(words, starts[small & (sizes == size)], int(size), radius, parts)
    for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        _link_run(words, s, m, radius, parts)
    return parts.roots()


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints (long, or binary of one length) as rows of 64-bit words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _bucket_parts(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Sorted (band, key, fp, bits) rows to (fp, root, band, key): root names the node's connected part in one bucket."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        band, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])]))
        roots = linked_parts(_words(rows.column(3)), new, np.diff(np.append(new, len(band))), radius)
        linked = np.bincount(roots, minlength=len(band))[roots] > 1
        if not linked.any():
            return None
        own = roots[linked]
        fp = rows.column(2)
        return pa.RecordBatch.from_arrays([fp.filter(pa.array(linked)), fp.take(pa.array(own)), pa.array(band[own]), pa.array(key[own])], names=["fp", "root", "band", "key"])

    rest: list[pa.RecordBatch] = []  # the last bucket may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        band, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = np.flatnonzero((band != band[-1]) | (key != key[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or rest and (rest[-1].column(0)[-1].as_py(), rest[-1].column(1)[-1].as_py()) != (band[0], key[0]):
            out = solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()[0]) if rest or cut else None
            if out is not None:
                yield out
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        out = solve(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])
        if out is not None:
            yield out


def _bands(radius: int) -> list[tuple[int, int]]:
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _band_key(band: tuple[int, int]) -> Column:
    lo, hi = band
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _heavy(rows: DataFrame, hot: int) -> DataFrame:
    """band, key, n of the buckets of over hot nodes."""
    return checkpointed(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))


def in_cells(rows: DataFrame, hot: int) -> DataFrame:
    """Buckets (band, key, fp, ...) of over hot nodes as cells, one for every two of their chunks of about hot nodes: all pairs still meet."""
    heavy = _heavy(rows, hot)
    n_heavy = heavy.count()
    if not n_heavy:
        return rows
    small = F.broadcast(heavy) if n_heavy <= 100_000 else heavy
    chunks = F.ceil(F.col("n") / hot)
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
    cells = rows.join(small, ["band", "key"]).withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))})
    cells = cells.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn("band", F.col("band") + 1000)
    return rows.join(small, ["band", "key"], "left_anti").unionByName(cells.select(rows.columns))


def bucketed(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """band, key, fp rows: the buckets in which every pair within the radius meets at least once."""
    bands = _bands(radius)
    plain = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("band"), _band_key(b).cast("long").alias("key")) for k, b in enumerate(bands)])).alias("b")).select("b.band", "b.key", "fp")
    if radius > 2:  # one middle bit serves radii up to 2
        return in_cells(plain, hot)
    heavy = _heavy(plain, hot).select("band", "key")
    n_heavy = heavy.count()
    if not n_heavy:
        return plain
    small = F.broadcast(heavy) if n_heavy <= 100_000 else heavy
    light = plain.join(small, ["band", "key"], "left_anti")
    middles = F.lit(None).cast("array<bigint>")
    for k, (lo, hi) in enumerate(bands):
        flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(64) if not lo <= i < hi]
        middles = F.when(F.col("band") == k, F.array(*flips)).otherwise(middles)
    fine = plain.join(small, ["band", "key"], "left_semi").select((F.col("band") + len(bands)).alias("band"), F.explode(middles).alias("key"), "fp")
    return light.unionByName(fine)


def parts_of(rows: DataFrame, radius: int) -> DataFrame:
    """fp, part from buckets (band, key, fp, bits): nodes with equal part (one bucket's connected part) are linked."""
    spread = rows.select("band", "key", "fp", "bits").repartition("band", "key").sortWithinPartitions("band", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(_bucket_parts(batches, radius))

    kind = rows.schema["fp"].dataType.simpleString()
    parts = spread.mapInArrow(run, f"fp {kind}, root {kind}, band long, key long")
    return parts.select("fp", F.xxhash64("root", "band", "key").alias("part"))


def link_parts(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """fp, part of nodes (fp: 64-bit fingerprints)."""
    return parts_of(bucketed(nodes, radius, hot).withColumn("bits", F.col("fp")), radius)


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """fp, component (least fp that can be reached), from fp, part rows; nodes without a part are left out.

    Each round takes a part's least label and a node's least part label (both aggregated before the
    shuffle), then follows the label once, which halves long chains."""
    links = checkpointed(links)
    labels = links.select("fp").distinct().withColumn("label", F.col("fp"))
    for _ in range(max_rounds):
        of_part = links.join(labels, "fp").groupBy("part").agg(F.min("label").alias("label"))
        least = links.join(of_part, "part").groupBy("fp").agg(F.min("label").alias("least"))
        jump = least.select(F.col("fp").alias("least"), F.col("least").alias("next"))
        new = labels.join(least, "fp").join(jump, "least", "left").select("fp", F.least("label", "least", F.coalesce("next", "least")).alias("new"), "label")
        new = checkpointed(new)
        changed = new.where(F.col("new") != F.col("label")).limit(1).count()
        labels = new.select("fp", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels still change; raise max_rounds")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (of distinct fp) with their component, the least fp of it."""
    return nodes.join(components(links), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component), component_size."""
    fps = checkpointed(fingerprints(docs))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labelled = checkpointed(_labelled(nodes, link_parts(nodes.select("fp"), radius, hot)))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("members"))
    named = join_counted(labelled, names, "component", "members", hot).select("fp", "component_id", "component_size", "n")
    return join_counted(fps, named, "fp", "n", hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def sketches(docs: DataFrame, carried: tuple[str, ...], size: int = WORDS) -> DataFrame:
    """The carried columns, fp (the node), bits and keys of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, bits, keys = zip(*(sketch(t, size) for t in batch.column(0).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*carried, "fp", "bits", "keys"])

    inner = docs.select(F.col("text").cast("string").alias("text"), *carried)
    return map_rows(inner, run, T.StructType([*inner.schema.fields[1:], T.StructField("fp", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def similar_parts(nodes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """fp, part of nodes (fp, bits, keys) whose bits differ in at most radius places."""
    each = nodes.select("fp", "bits", F.posexplode("keys").alias("band", "key"))
    rows = each.select(F.col("band").cast("long").alias("band"), "key", "fp", "bits")
    return parts_of(in_cells(rows, hot), radius)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, size: int = WORDS, hot: int = 2 * HOT) -> DataFrame:
    """Exactly one row of each component, one of its least id (a null id only where all are null), with all its columns.

    Rows are told apart by id and text; of rows equal in both any one stays."""
    rows = keyed(docs.withColumn("__id", F.col("doc_id").cast("long")), "__id", "text")
    found = sketches(rows, (*KEY, "__id"), size).groupBy(*KEY, "fp", "bits", "keys").agg(F.min("__id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    found = checkpointed(found)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), *KEY)
    nodes = checkpointed(found.groupBy("fp", "bits", "keys").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("texts")))
    labelled = checkpointed(_labelled(nodes.select("fp", "least", "texts"), similar_parts(nodes, radius_of(similarity), hot)))
    names = labelled.groupBy("component").agg(F.min("least").alias("winner"), F.count(F.lit(1)).alias("members"))
    named = join_counted(labelled, names, "component", "members", hot).select("fp", "winner", "texts")
    wins = (F.col(KEY[0]) == F.col(f"winner.{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"winner.{KEY[1]}"))
    touched = checkpointed(join_counted(found.select(*KEY, "fp", "n"), named, "fp", "texts", hot).select(*KEY, wins.alias("wins"), "n").where(~F.col("wins") | (F.col("n") > 1)))
    out = by_key(rows, touched.select(*KEY), "left_anti")
    repeated = touched.where("wins").select(*KEY)
    if repeated.limit(1).count():
        out = out.unionByName(by_key(rows, repeated, "left_semi").dropDuplicates(list(KEY)))
    return out.select(docs.columns)

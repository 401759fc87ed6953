"""Benchmark decontamination through a distributed positional inverted index.

``build_index`` turns blocks of documents into posting lists: for every term of every document
the sorted positions where it stands, plus one header row with the block's document table.  A gap
between documents keeps phrases from running across them.  Blocks are cut by text size, so memory
is bounded, and no posting is shuffled; ``store_index`` writes the table for later test sets.

``search`` keeps the posting lists of the test set's terms and, block by block, takes from each
window of an item its rarest term, aligns the item with each of that term's positions and
intersects with the offset-adjusted lists of the other terms, rarest first.  What is left are the
exact phrases; with ``span`` set, items whose ``near_terms`` rarest terms (by their count in the whole corpus,
of those that occur in it) lie within span words of one document are reported as proximity matches too.

The test set is collected in parts of at most ``max_part_bytes`` of text, one search over the index for
each, so what a worker holds is bounded.

Words: A-Z lower-cased, runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].  An item of fewer than
``width`` words, but not none, is one window.

Defined cases: null and empty texts have no words (they are never hit, and such items have no window);
items with a null id are ignored; rows of items with one id count as one item; documents with equal
or null ids are judged one by one; an empty test set hits nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, released, slices

WIDTH = 10
SPAN, NEAR_TERMS = 50, 5
BLOCK_BYTES = 8 << 20
MAX_PART_BYTES = 16 << 20
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
INDEX = T.StructType([T.StructField("block", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("postings", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType()))])
HITS = T.StructType([T.StructField("row", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item_id", T.StringType())]))), T.StructField("near", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Block:
    """Terms of one block of documents as they arrive."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.at, self.bytes = 0, 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        terms, found = self.terms, words(text)
        put = terms.setdefault
        self.parts.append(np.fromiter([put(w, len(terms)) for w in found], np.int32, len(found)))
        self.doc_ids.append(doc_id)
        self.starts.append(self.at)
        self.counts.append(len(found))
        self.at += len(found) + 1
        self.bytes += len(text or "") + 64

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b""]), pa.array([len(self.doc_ids)], pa.int64()), pa.array([None], pa.binary()), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.starts], pa.list_(pa.int64())), pa.array([self.counts], pa.list_(pa.int64()))], schema=schema)
        ids = np.concatenate(self.parts)
        if not len(ids):
            return
        where = np.concatenate([np.arange(s, s + n, dtype=np.uint32) for s, n in zip(self.starts, self.counts, strict=True)])
        order = np.argsort(ids, kind="stable")
        data = where[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(ids, minlength=len(self.terms)))
        terms, bounds = list(self.terms), np.concatenate([[0], ends])
        postings = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), pa.py_buffer(data)])
        n = pa.array(np.diff(bounds), pa.int64())
        names, empty = pa.array(terms, pa.binary()), pa.nulls(len(terms), pa.list_(pa.int64()))
        for at in range(0, len(terms), 20_000):
            k = min(20_000, len(terms) - at)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k), names.slice(at, k), n.slice(at, k), postings.slice(at, k), empty.slice(at, k), empty.slice(at, k), empty.slice(at, k)], schema=schema)


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each term of each block (postings: little-endian uint32 positions), after the block's header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for cut in slices(batch):
                for doc_id, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    block.add(doc_id, text)
                    if block.bytes >= block_bytes:
                        yield from block.rows(f"{part}-{k}")
                        k, block = k + 1, _Block()
        if block.doc_ids:
            yield from block.rows(f"{part}-{k}")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(run(batches)), INDEX)


def store_index(index: DataFrame, path: str) -> DataFrame:
    index.write.mode("overwrite").parquet(path)
    return index.sparkSession.read.schema(INDEX).parquet(path).repartition("block").sortWithinPartitions("block", "term")


def items_in_parts(benchmark: DataFrame, max_part_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set's items, a bounded part at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    part, size = [], 0
    for item_id, text in rows.toLocalIterator():
        part.append((item_id, words(text)))
        size += len(text)
        if size >= max_part_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


class _Test:
    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.terms = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.items = [(i, np.array([self.terms[w] for w in ws], np.int64)) for i, ws in items if ws]
        self.width = width

    def alignments(self, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each item and each word that is the rarest of some window: item, its offset, first and last window."""
        out = []
        for k, (_, ids) in enumerate(self.items):
            own = df[ids]
            w = min(self.width, len(ids))
            view = np.lib.stride_tricks.sliding_window_view(own, w)
            live = np.flatnonzero(view.min(1) > 0)
            if not len(live):
                continue
            anchor = live + view[live].argmin(1)
            for a in np.unique(anchor):
                mine = live[anchor == a]
                out.append((k, a, mine[0], mine[-1]))
        return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def _find(test: _Test, n_of: np.ndarray, first: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, start, end) in block positions of all phrases.  keys: term << 32 | position, sorted."""
    item, offset, lo, hi = test.alignments(n_of)
    if not len(item):
        return []
    anchors = np.array([test.items[k][1][a] for k, a in zip(item, offset, strict=True)])
    reps = n_of[anchors]
    which = np.repeat(np.arange(len(item)), reps)
    start_of = np.cumsum(reps) - reps
    at = first[anchors][which] + (np.arange(len(which)) - start_of[which])
    base = (keys[at] & 0xFFFFFFFF) - offset[which]
    # Terms that all windows of the alignment share, rarest first.
    checks = []
    for k, a, x, y in zip(item, offset, lo, hi, strict=True):
        ids = test.items[k][1]
        span = np.arange(y, x + min(test.width, len(ids)))
        span = span[span != a]
        checks.append(span[np.argsort(n_of[ids[span]], kind="stable")])
    for depth in range(max(map(len, checks))):
        if not len(which):
            return []
        o = np.array([c[depth] if depth < len(c) else -1 for c in checks])[which]
        term = np.array([test.items[k][1][c[depth]] if depth < len(c) else -1 for k, c in zip(item, checks, strict=True)])[which]
        want = (term << 32) + base + o
        ok = (o < 0) | ((base + o >= 0) & (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want))
        which, base = which[ok], base[ok]
    out = []
    for k, b in zip(which, base, strict=True):
        i = item[k]
        ids = test.items[i][1]
        w = min(test.width, len(ids))
        o = np.arange(lo[k], hi[k] + w)
        want = (ids[o] << 32) + b + o
        ok = (b + o >= 0) & (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want)
        run = 0
        for pos, good in zip(o, ok, strict=True):
            run = run + 1 if good else 0
            if run >= w:
                out.append((int(i), int(b + pos - w + 1), int(b + pos + 1)))
    return out


def _rarest(test: _Test, total: np.ndarray, near_terms: int) -> list[np.ndarray]:
    """Each item's rarest terms by their count in the corpus; none where the corpus holds too few of its terms."""
    out = []
    for _, ids in test.items:
        own = np.unique(ids)
        live = own[total[own] > 0]
        out.append(live[np.argsort(total[live], kind="stable")][:near_terms] if len(live) >= min(near_terms, len(own)) else live[:0])
    return out


def _near(chosen: list[np.ndarray], n_of: np.ndarray, first: np.ndarray, keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(item, document) where the item's chosen terms all stand within span words of the document."""
    out = []
    for k, own in enumerate(chosen):
        if not len(own) or not (n_of[own] > 0).all():
            continue
        own = own[np.argsort(n_of[own], kind="stable")]
        at = keys[first[own[0]] : first[own[0]] + n_of[own[0]]] & 0xFFFFFFFF
        doc = np.searchsorted(begins, at, "right") - 1
        for t in own[1:]:
            low = np.searchsorted(keys, (t << 32) + np.maximum(at - span + 1, begins[doc]))
            ok = (low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] < (t << 32) + np.minimum(at + span, ends[doc]))
            at, doc = at[ok], doc[ok]
        done = set()
        for p, d in zip(at.tolist(), doc.tolist(), strict=True):
            if d not in done and _within(own, keys, max(p - span + 1, int(begins[d])), min(p + span, int(ends[d])), span):
                done.add(d)
                out.append((k, d))
    return out


def _within(terms: np.ndarray, keys: np.ndarray, start: int, end: int, span: int) -> bool:
    """Whether span words in a row between start and end hold all terms."""
    found = []
    for t in terms.tolist():
        lo, hi = np.searchsorted(keys, [(t << 32) + start, (t << 32) + end])
        found += [(p, t) for p in (keys[lo:hi] & 0xFFFFFFFF).tolist()]
    last: dict[int, int] = {}
    for p, t in sorted(found):
        last[t] = p
        if len(last) == len(terms) and p - min(last.values()) < span:
            return True
    return False


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], width: int = WIDTH, span: int | None = None, near_terms: int = NEAR_TERMS) -> DataFrame:
    """One row for each document of the index: its merged phrase hits (word offsets), and near items."""
    test = _Test(items, width)
    spark = index.sparkSession
    terms = spark.createDataFrame([(bytearray(b""),), *((bytearray(w),) for w in test.terms)], "term binary")
    kept = index.join(F.broadcast(terms), "term", "left_semi").select(INDEX.fieldNames())  # bounded by the part of the test set
    chosen: list[np.ndarray] = []
    if span is not None:
        kept = checkpointed(kept)  # read for the counts, then for the search
        total = np.zeros(len(test.terms), np.int64)
        for r in kept.where(F.length("term") > 0).groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            total[test.terms[bytes(r["term"])]] = r["n"]
        chosen = _rarest(test, total, near_terms)
    shared = spark.sparkContext.broadcast((test, chosen))

    def finish(name: str, header: tuple, postings: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        test, chosen = shared.value
        doc_ids, starts, counts = header
        n_of = np.zeros(len(test.terms), np.int64)
        parts = []
        for w, p in sorted(postings.items()):
            n_of[test.terms[w]] = len(p)
            parts.append((test.terms[w] << 32) + p.astype(np.int64))
        keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        first = np.cumsum(n_of) - n_of
        hits: list[list] = [[] for _ in doc_ids]
        near: list[set] = [set() for _ in doc_ids]
        begins = np.array(starts)
        if len(keys):
            for item, start, end in sorted(_find(test, n_of, first, keys)):
                d = int(np.searchsorted(begins, start, "right") - 1)
                own, s, e, name_of = hits[d], start - starts[d], end - starts[d], test.items[item][0]
                if own and own[-1]["item_id"] == name_of and s <= own[-1]["end"] and s >= own[-1]["start"]:
                    own[-1]["end"] = max(own[-1]["end"], e)
                else:
                    own.append({"start": s, "end": e, "item_id": name_of})
            if span is not None:
                for item, d in _near(chosen, n_of, first, keys, begins, begins + np.array(counts), span):
                    near[d].add(test.items[item][0])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array([f"{name}-{i}" for i in range(len(doc_ids))]), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, kind), pa.array([sorted(x) for x in near], pa.list_(pa.string()))], names=HITS.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, header, postings = None, None, {}
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            blocks, terms = cols[0].to_pylist(), cols[1].to_pylist()
            for i, (b, t) in enumerate(zip(blocks, terms, strict=True)):
                if b != name:
                    if header is not None:
                        yield finish(name, header, postings)
                    name, header, postings = b, None, {}
                if t == b"":
                    header = tuple(cols[j][i].as_py() for j in (4, 5, 6))
                else:
                    postings[t] = np.frombuffer(cols[3][i].as_py(), "<u4")
        if header is not None:
            yield finish(name, header, postings)

    return kept.mapInArrow(lambda batches: released(run(batches)), HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, span: int | None = None, max_part_bytes: int = MAX_PART_BYTES, index: DataFrame | None = None) -> DataFrame:
    """One row for each document: row, doc_id, n_words, hits (start, end, item_id), near."""
    index = build_index(docs) if index is None else index
    parts = list(itertools.islice(items_in_parts(benchmark, max_part_bytes), 2))
    if len(parts) < 2:
        return search(index, parts[0] if parts else [], width, span)
    index = checkpointed(index)  # read once for each part, with the same block names
    return merge_parts(functools.reduce(DataFrame.unionByName, (search(index, items, width, span) for items in items_in_parts(benchmark, max_part_bytes))))


def merge_parts(found: DataFrame) -> DataFrame:
    """One row a document where the test set came in several parts."""
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("near")).alias("near"))


def verdicts(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and near_items)."""
    ordered = F.array_sort("hits")
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("upto"))
    merged = F.aggregate(ordered, start, lambda a, h: F.struct((a["covered"] + F.greatest(F.lit(0).cast("long"), h["end"] - F.greatest(h["start"], a["upto"]))).alias("covered"), F.greatest(a["upto"], h["end"]).alias("upto")), lambda a: a["covered"])
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    hit = F.size("hits") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.when(hit, merged).otherwise(F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        hit.alias("contaminated"),
        F.array_sort(F.array_distinct("near")).alias("near_items"),
    )

"""Ranked lexical search: a blocked sparse matrix product of items by documents.

``build_index`` turns blocks of documents into the term-document matrix: for every term of a block one row with the places
of its documents in the block and its counts there, after a header row with the documents' ids and lengths.  Blocks are cut
by text size; no posting is shuffled.  ``store_index`` writes it for later queries.

``rank`` makes the item-term matrix (how often each item has each term), keeps the index rows of its terms, sums document
frequencies and lengths over all documents, and multiplies block by block: a term's counts become int64 impacts, an item's
row of the product is the sum of its terms' impact rows, merged into one row over the block's documents (Gustavson's
row-wise product).  Each task keeps an item's k best over its blocks, then groups of tasks, then all.

Score: sum over the item's terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with m = 10 + ((90 * n * N) div L) of the
document and w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); N documents have a term, all L terms together, one n and df the
term.  Terms: A-Z lower-cased, runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Items are taken in parts of at most ``max_part_bytes`` of terms (one item at least), one product over the index each, so what
a worker holds is bounded by that.

Defined cases: null and empty texts have no terms and are never found, such items find nothing; rows of items with one id
(null like any other) are one item; documents with equal ids are ranked each; null document ids come after all others of a
score; no items or documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, checkpointed, slices
from .decontamination import words

K = 10
BLOCK_BYTES = 8 << 20
MAX_PART_BYTES = 16 << 20
#: Groups of tasks whose best are reduced before all are.
GROUPS = 64
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "block string, term binary, n long, places binary, counts binary, doc_ids array<long>, lengths array<long>"
_FIELDS = pa.schema([("block", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_NAMES = [f.name for f in _FIELDS]


class _Block:
    """The terms of one block of documents as they arrive."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        terms, found = self.terms, words(text)
        put = terms.setdefault
        self.parts.append(np.fromiter([put(w, len(terms)) for w in found], np.int64, len(found)))
        self.doc_ids.append(doc_id)
        self.bytes += len(text or "") + 64

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p) for p in self.parts])
        one = lambda value, kind: pa.array([value], kind)
        yield pa.RecordBatch.from_arrays([one(name, pa.string()), one(b"", pa.binary()), one(int((lengths > 0).sum()), pa.int64()), one(None, pa.binary()), one(None, pa.binary()), one(self.doc_ids, pa.list_(pa.int64())), one(lengths, pa.list_(pa.int64()))], schema=_FIELDS)
        if not self.terms:
            return
        keys, counts = np.unique((np.concatenate(self.parts) << 32) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        n = np.bincount(keys >> 32, minlength=len(self.terms))
        ends = 4 * np.concatenate([[0], np.cumsum(n)])
        packed = lambda values: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])
        places, amounts, terms = packed(keys & 0xFFFFFFFF), packed(counts), pa.array(list(self.terms), pa.binary())
        nothing = pa.nulls(len(n), pa.list_(pa.int64()))
        for at in range(0, len(n), 20_000):
            k = min(20_000, len(n) - at)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k), terms.slice(at, k), pa.array(n[at : at + k]), places.slice(at, k), amounts.slice(at, k), nothing.slice(at, k), nothing.slice(at, k)], schema=_FIELDS)


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each term of each block (places and counts: little-endian uint32), after the block's header."""

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

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index as a table, read so that a block's rows stay together, its header first."""
    index.write.mode("overwrite").parquet(path)
    return index.sparkSession.read.schema(INDEX).parquet(path).repartition("block").sortWithinPartitions("block", "term")


def item_terms(items: DataFrame) -> DataFrame:
    """The item-term matrix: item_id, term, times."""
    each = items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


Item = tuple[object, dict[bytes, int]]


def items_in_parts(items: DataFrame, max_part_bytes: int) -> Iterator[list[Item]]:
    """Items with their terms and how often they have them, a bounded part at a time."""
    part: list[Item] = []
    size = 0
    for item_id, term, times in item_terms(items).orderBy("item_id").toLocalIterator():
        if not part or part[-1][0] != item_id:
            if size >= max_part_bytes:
                yield part
                part, size = [], 0
            part.append((item_id, {}))
        part[-1][1][term.encode()] = times
        size += len(term) + 16
    if part:
        yield part


class _Query:
    """A part of the items, its terms numbered."""

    def __init__(self, items: list[Item], once: bool):
        self.terms = {t: k for k, t in enumerate(sorted({t for _, own in items for t in own}))}
        self.rows = [[(self.terms[t], 1 if once else times) for t, times in own.items()] for _, own in items]


def _impacts(counts: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    tf = counts.astype(np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _best(score: np.ndarray, doc_id: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then least id, those without id last."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((doc_id[at], ~known[at], -score[at]))[:k]]


def search(index: DataFrame, items: list[Item], k: int = K, once: bool = True) -> DataFrame:
    """item (its place in items), doc_id, score, part: each task's k best of each item, over the blocks of the index."""
    query, spark = _Query(items, once), index.sparkSession
    named = spark.createDataFrame([(bytearray(b""),), *((bytearray(t),) for t in query.terms)], "term binary")
    kept = checkpointed(index.join(F.broadcast(named), "term", "left_semi").select(_NAMES))  # bounded by the part; read for the counts, then for the product
    header = F.length("term") == 0
    n_docs, n_words = kept.where(header).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    weights = np.zeros(len(query.terms), np.int64)
    for term, df in kept.where(~header).groupBy("term").agg(F.sum("n")).toLocalIterator():
        weights[query.terms[bytes(term)]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast((query, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, weights = shared.value
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def multiply(ids: list[int | None], lengths: list[int], rows: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
            known = np.array([d is not None for d in ids], bool)
            doc_id = np.array([d or 0 for d in ids], np.int64)
            m = np.array([10 + 90 * n * n_docs // n_words for n in lengths], np.int64) if n_words else np.zeros(len(ids), np.int64)
            impacts = {t: (at, _impacts(counts, m[at], int(weights[t]))) for t, (at, counts) in rows.items() if weights[t]}
            for i, own in enumerate(query.rows):
                merged = np.zeros(len(ids), np.int64)
                for t, times in own:
                    if t in impacts:
                        at, values = impacts[t]
                        merged[at] += times * values  # a document stands once in a term's row
                at = np.flatnonzero(merged)
                if not len(at):
                    continue
                found = (merged[at], doc_id[at], known[at])
                if i in top:
                    found = tuple(np.concatenate(p) for p in zip(top[i], found, strict=True))
                keep = _best(*found, k)
                top[i] = tuple(c[keep] for c in found)

        ids: list = []
        lengths: list = []
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for cut in slices(batch):
                terms, places, counts = cut.column(1).to_pylist(), cut.column(3), cut.column(4)
                for r, term in enumerate(terms):
                    if term == b"":  # a block begins
                        multiply(ids, lengths, rows)
                        ids, lengths, rows = cut.column(5)[r].as_py(), cut.column(6)[r].as_py(), {}
                    else:
                        rows[query.terms[term]] = (np.frombuffer(places[r].as_py(), "<u4"), np.frombuffer(counts[r].as_py(), "<u4"))
        multiply(ids, lengths, rows)
        part = TaskContext.get().partitionId()
        for i, (score, doc_id, known) in top.items():
            n = len(score)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(doc_id, pa.int64(), mask=~known), pa.array(score), pa.array([part] * n, pa.int64())], names=["item", "doc_id", "score", "part"])

    return kept.mapInArrow(run, "item long, doc_id long, score long, part long")


def best_of(found: DataFrame, k: int = K) -> DataFrame:
    """The k best of each item with their rank: of groups of tasks, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    group = found.withColumn("group", F.col("part") % GROUPS)
    some = group.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, once: bool = True, max_part_bytes: int = MAX_PART_BYTES, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item, of those with a score above 0.

    once: an item's term counts once, however often the item has it.  index: a stored index of docs, whose texts are then not read."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    parts = items_in_parts(items, max_part_bytes)
    part, following = next(parts, None), next(parts, None)
    if part is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    index = build_index(docs) if index is None else index
    if following is not None:
        index = checkpointed(index)  # read once for each part
    out = []
    while part is not None:
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(part)], f"item long, item_id {kind}")
        out.append(best_of(search(index, part, k, once), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        part, following = following, next(parts, None)
    return functools.reduce(DataFrame.unionByName, out)

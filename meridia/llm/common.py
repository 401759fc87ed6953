"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of text, handed to Python code at a time (one row at least).
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make one only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meridia-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and, but for a longer single row, SLICE_BYTES of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + SLICE_BYTES
        upto = min(max(int(np.searchsorted(ends, limit, "right")), at + 1), at + SLICE_ROWS)
        yield batch.slice(at, upto - at)
        at = upto


def _trim() -> None:
    """Give what a worker no longer uses back to the machine: the worker lives on, and its next task may need other things."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, the worker's free memory is given back."""
    yield from batches
    _trim()


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply fn to slices of every Arrow batch (Spark bounds the batch, the slices bound what fn makes of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def columns_but(df: DataFrame, taken: set[str]) -> list[str]:
    """The input's columns apart from those that the operator itself returns (names compare without case)."""
    taken = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in taken]


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys of 16 bytes that may be broadcast; above this the join shuffles.
BROADCAST_KEYS = 500_000
KEY = ("__key", "__key2")


def keyed(docs: DataFrame, *of: str) -> DataFrame:
    """docs with KEY, 128 bits that equal rows of the named columns share; null is a value like any other."""
    parts = [c for name in of for c in (F.col(name).isNull(), F.col(name))]
    return docs.withColumns({KEY[0]: F.xxhash64(*parts), KEY[1]: F.xxhash64(F.lit("second"), *parts)})


def by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of keyed docs by the keys' columns; keys (checkpointed) are broadcast only up to BROADCAST_KEYS rows."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, keys.columns, how)


#: A key of over this share of all rows is hot; there are fewer such keys than SHARES.
SHARES = 10_000


def join_counted(rows: DataFrame, names: DataFrame, key: str, count: str, least: int) -> DataFrame:
    """rows (checkpointed) with the columns of names: one row for each of their keys, count being the key's number of rows.

    The names of hot keys, of over least rows and a SHARES-th of all, are broadcast, so that their rows stay where they are."""
    limit = max(least, rows.count() // SHARES)
    names = checkpointed(names)
    hot = F.broadcast(names.where(F.col(count) > limit))  # fewer than SHARES, whatever the size of rows
    rest = rows.join(hot.select(key), key, "left_anti").join(names.where(F.col(count) <= limit), key)
    return rest.unionByName(rows.join(hot, key))


def join_repeated(rows: DataFrame, names: DataFrame, key: str, count: str, least: int) -> DataFrame:
    """rows left-joined with names, which holds the keys of several rows only (count: how many).

    Up to BROADCAST_KEYS names are broadcast; of more, those of hot keys (see join_counted), and the rest are joined by shuffle."""
    names = checkpointed(names)
    if names.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(names), key, "left")
    limit = max(least, rows.count() // SHARES)
    hot = F.broadcast(names.where(F.col(count) > limit))
    rest = rows.join(hot.select(key), key, "left_anti").join(names.where(F.col(count) <= limit), key, "left")
    return rest.unionByName(rows.join(hot, key))


def bound(col, fn):
    """fn of col with col computed once: a lambda variable holds it, where a repeated column expression might be copied."""
    return F.element_at(F.transform(F.array(col), fn), 1)

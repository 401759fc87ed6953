"""Best-fit packing of token pieces into fixed-length sequences, improved by swap-based local search.

1. Every text becomes ids of a public byte-level BPE vocabulary plus one end id.  Documents longer
   than a sequence are cut into full pieces; only the first may be shorter.
2. Pieces, counted and numbered in a checkpoint, are dealt by a hash of their numbers into groups of about
   ``group_pieces`` (no group grows with the data, nor with one document's length or with equal rows).
3. In a group, best-fit decreasing makes bins; local search then takes the emptiest bin and moves
   its pieces out, exchanges one for one, two for one or one for two with other underfull bins (every pair of
   pieces of a bin is tried), each step raising the sum of squared fills, until it is empty or no step helps.  The
   search ends when the free space left is under one sequence: fewer bins cannot exist then.

Only six numbers a piece are shuffled.  A group's result depends on its pieces alone (they are
sorted first), so a task that is run again gives the same sequences.

Defined cases: a null or empty text is the end id alone; documents with equal or null ids are
separate pieces; no documents give no sequences; other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows

SEQUENCE = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


class Encoder:
    """Text to packed little-endian uint32 ids, equal to the tokenizers library's ids.

    The rank-based encoder of the same vocabulary is several times faster; texts that spell a
    special token go to the library itself."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece (and its ids, packed, if asked for)."""
    path = path or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(path), []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = (encode(text) if text else b"") + end
            n, at, k = len(ids) // 4, 0, 0
            while at < n:
                size = n % capacity if at == 0 and n > capacity and n % capacity else min(capacity, n - at)
                own = ids[4 * at : 4 * (at + size)]
                rows.append((doc_id, k, at, size, crc32(own), own)[: len(names)])
                at, k = at + size, k + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class _Bins:
    """Bins of lengths; open bins can be found by the least free space that suffices."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0

    def _link(self, b: int) -> None:
        r = self.free[b]
        if r:
            insort(self.by_free.setdefault(r, []), b)
            self.mask |= 1 << r

    def _unlink(self, b: int) -> None:
        r = self.free[b]
        if r:
            own = self.by_free[r]
            own.remove(b)
            if not own:
                self.mask &= ~(1 << r)

    def best(self, size: int, but: int = -1) -> int:
        """The open bin with the least free space of at least size, or -1."""
        mask = self.mask >> size
        base = size
        while mask:
            low = (mask & -mask).bit_length() - 1
            for b in self.by_free[base + low]:
                if b != but:
                    return b
            mask >>= low + 1
            base += low + 1
        return -1

    def add(self, item: tuple[int, int]) -> None:
        b = self.best(item[0])
        if b < 0:
            self.items.append([item])
            self.free.append(self.capacity - item[0])
            self._link(len(self.items) - 1)
        else:
            self.change(b, [], [item])

    def change(self, b: int, out: list, into: list) -> None:
        self._unlink(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b].extend(into)
        self.free[b] += sum(x[0] for x in out) - sum(x[0] for x in into)
        if self.items[b]:
            self._link(b)


def local_search(bins: _Bins) -> int:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills; returns how many went."""
    emptied, cap = 0, bins.capacity

    def slack() -> int:
        return sum(r for r, own in zip(bins.free, bins.items, strict=True) if own)

    progress = True
    while progress and slack() >= cap:
        progress = False
        for source in sorted((b for b, r in enumerate(bins.free) if r and bins.items[b]), key=lambda b: -bins.free[b]):
            if not bins.items[source] or bins.free[source] == 0:
                continue
            others = [b for b, r in enumerate(bins.free) if r and b != source and bins.items[b]]
            if sum(bins.free[b] for b in others) < cap - bins.free[source]:
                break
            while bins.items[source]:
                if not _step(bins, source, others):
                    break
            if not bins.items[source]:
                bins.free[source] = 0
                emptied, progress = emptied + 1, True
                if slack() < cap:
                    break
    return emptied


def _step(bins: _Bins, source: int, others: list[int]) -> bool:
    """One move or exchange that fills another bin at the expense of source."""
    own = sorted(bins.items[source], reverse=True)
    fill = bins.capacity - bins.free[source]
    for x in own:  # a move into the tightest bin
        b = bins.best(x[0], source)
        if b >= 0 and bins.capacity - bins.free[b] + x[0] > fill:
            bins.change(source, [x], [])
            bins.change(b, [], [x])
            return True
    rows = [(y[0], bins.free[b], b, i) for b in others if bins.free[b] for i, y in enumerate(bins.items[b])]
    if not rows:
        return False
    size, free, where, index = np.array(rows, np.int64).T
    gain_best, chosen = 0, None
    full = bins.capacity - free

    def note(delta: np.ndarray, k_of) -> None:
        """delta: what the other bin gains; it must be over 0, at most its free space, and raise the squares."""
        nonlocal gain_best, chosen
        ok = (delta > 0) & (delta <= k_of[1]) & (k_of[0] + delta > fill)
        if ok.any():
            left = np.where(ok, k_of[1] - delta, bins.capacity + 1)
            k = int(left.argmin())
            score = bins.capacity + 1 - int(left[k])
            if score > gain_best:
                gain_best, chosen = score, k

    best = None
    for x in own:  # one for one
        before = gain_best
        note(x[0] - size, (full, free))
        if gain_best > before:
            best = ([x], [(where[chosen], index[chosen])])
    pairs = {own[i][0] + own[j][0]: (own[i], own[j]) for i in range(len(own)) for j in range(i + 1, len(own))}
    for both, two in pairs.items():  # two for one: two of source for one of another bin
        before = gain_best
        note(both - size, (full, free))
        if gain_best > before:
            best = (list(two), [(where[chosen], index[chosen])])
    if best is None:  # one of source for two of another bin
        ends = np.append(np.flatnonzero(where[1:] != where[:-1]) + 1, len(where))
        reps = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(where)) - 1  # later pieces of the same bin
        one = np.repeat(np.arange(len(where)), reps)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(reps) - reps, reps)
        for x in {x[0]: x for x in own}.values():
            before = gain_best
            note(x[0] - size[one] - size[two], (full[one], free[one]))
            if gain_best > before:
                a, b = one[chosen], two[chosen]
                best = ([x], [(where[a], index[a]), (where[b], index[b])])
    if best is None:
        return False
    out, picks = best
    b = int(picks[0][0])
    back = [bins.items[b][int(i)] for _, i in picks]
    bins.change(source, out, back)
    bins.change(b, back, out)
    return True


def pack_lengths(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length; the third is the number of bins that local search emptied."""
    order = np.argsort(-lengths, kind="stable")
    bins = _Bins(capacity)
    for i in order:
        bins.add((int(lengths[i]), int(i)))
    emptied = local_search(bins)
    which, offset, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for own in bins.items:
        if not own:
            continue
        at = 0
        for size, i in sorted(own, key=lambda x: x[1]):
            which[i], offset[i] = k, at
            at += size
        k += 1
    return which, offset, emptied


def pack(cut: DataFrame, n_groups: int, capacity: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (of pieces(), with a column number that tells them apart)."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "number"]
    names = [*(c.split()[0] for c in columns), "sequence_id", "offset"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "number"], ascending=[False, True], kind="stable")
        which, offset, _ = pack_lengths(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=int(key[0]) * (1 << 40) + which, offset=offset)[names]

    group = F.pmod(F.xxhash64("number"), F.lit(n_groups)).cast("int")
    return cut.withColumn("pack_group", group).groupBy("pack_group").applyInPandas(run, ", ".join([*columns, "sequence_id long", "offset long"]))


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE, group_pieces: int = 16_384, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = checkpointed(pieces(docs, path, capacity, with_ids).withColumn("number", F.monotonically_increasing_id()))
    return pack(cut, max(1, round(cut.count() / group_pieces)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from packed pieces that carry their ids: sequence_id, n_tokens, ids (packed uint32)."""

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [int(rows["length"].sum())], "ids": [b"".join(rows["ids"])]})

    return packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids binary")

"""Conversation structure repair: a forward Viterbi pass over four grammar states.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``.  ``label`` tells blank, duplicate and
truncated rows; ``repair`` finds the cheapest edits (keep 0, change the role 3, delete 4, insert an empty turn 3; a
truncated row that stays costs 3 more, blank and duplicate rows must go) that make it well formed, of equally cheap ones the
one whose edit letters D, I, K, R read least, and applies them.

The states are: nothing yet, after the system turn, after a user, after an assistant.  Each state carries its least
(cost, letters) and a running hash of the repaired rows.  A row's layer takes each state by keep, change and delete; it is
closed by insertions, at most two in a row, as a third would only come back to a state at a higher cost.  Appending to the
lesser of two equally dear letter strings keeps it the lesser: neither begins the other, as the longer would have cost more.

Rows are dealt by conversation, sorted and streamed: no task holds a conversation.  What is kept of one is four letter
strings beyond the beginning that they share, and four hash states.  Whether a row repeats an earlier one is found by an
aggregation over (conversation, role, text) beforehand, whose frequent keys are joined by broadcast.

Defined cases: a null conversation id is a conversation; null roles and texts are one space; null turns come first; rows of
one turn come by role, then text; a role without a first letter s, u or a cannot be kept; an empty table gives no rows; other
columns are left out by label and repair.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_repeated

CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What a user or assistant turn may follow, and the state that each state reaches by one.
FOLLOWS = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_FILLED, _END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Letters of a state's string beyond which the beginning that all share is put aside.
LETTERS = 4096
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
HOT_ROWS = 4096


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and dropped: rows changed by crc32 of "conv_id:turn" modulo 20.

    0 drops the row (it stays as dropped, so that its conversation is not lost), 1 empties its text, 2 removes . ! and ?,
    3 repeats it, 4 makes it the user's."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies, (F.col("kind") == 0).alias("dropped"))


def label(rows: DataFrame) -> DataFrame:
    """rows of damage() with first_turn, whether the row is of the first turn that holds its role and text, and fault.

    Within a turn, equal rows are neighbours once sorted, so that repair() tells the first of them from the others."""
    key = F.xxhash64("conv_id", F.col("conv_id").isNull(), "role", "text", "dropped")
    keyed = rows.withColumn("__key", F.concat_ws(":", key, F.xxhash64(F.lit("second"), "text", "role", "conv_id")))
    # A null turn comes first: within a struct, min() takes nulls for the least.
    repeated = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("turn")).alias("__first")).where("__n > 1")
    joined = join_repeated(keyed, repeated, "__key", "__n", HOT_ROWS)
    blank, cut = ~F.col("text").rlike(_FILLED), ~F.col("text").rlike(_END)
    first_turn = F.col("__first").isNull() | F.col("__first.turn").eqNullSafe(F.col("turn"))
    return joined.select("conv_id", "turn", "role", "text", "copy", "dropped", first_turn.alias("first_turn"), F.when(blank, BLANK).when(cut, CUT).alias("fault"))


class _Path:
    """The best way to a state: cost, letters since the shared beginning, hash of the repaired rows."""

    __slots__ = ("cost", "letters", "sha", "empty")

    def __init__(self, cost: int, letters: str, sha, empty: bool):
        self.cost, self.letters, self.sha, self.empty = cost, letters, sha, empty

    def rank(self) -> tuple[int, str]:
        return self.cost, self.letters

    def then(self, cost: int, letter: str, row: bytes | None) -> _Path:
        """This way and one edit more; row: what it adds to the repaired rows."""
        sha = self.sha
        if row is not None:
            sha = sha.copy()
            sha.update(row if self.empty else b"\n" + row)
        return _Path(self.cost + cost, self.letters + letter, sha, self.empty and row is None)


def _closed(layer: dict[int, _Path]) -> dict[int, _Path]:
    """The layer with the states that one or two insertions reach at less."""
    for _ in range(2):
        for state, path in list(layer.items()):
            to = FOLLOWS[state]
            if to not in layer or (path.cost + INSERT, path.letters + "I") < layer[to].rank():
                layer[to] = path.then(INSERT, "I", f"{ROLE[to]}:".encode())
    return layer


def _after(layer: dict[int, _Path], role: str, text: str, fault: str | None) -> dict[int, _Path]:
    """The layer after one row: the least of keep, change and delete for every state."""
    best: dict[int, tuple[tuple[int, str], _Path, str, int, bytes | None]] = {}

    def offer(to: int, path: _Path, cost: int, letter: str, row: bytes | None) -> None:
        rank = (path.cost + cost, path.letters + letter)
        if to not in best or rank < best[to][0]:
            best[to] = (rank, path, letter, cost, row)

    extra, stays = (TRUNCATED if fault == CUT else 0), fault not in (BLANK, DUPLICATE)
    own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1])
    for state, path in layer.items():
        offer(state, path, DELETE, "D", None)
        if stays:
            to = FOLLOWS[state]
            offer(to, path, CHANGE + extra, "R", f"{ROLE[to]}:{text}".encode("utf-8", "surrogatepass"))
            if own == to or (own == SYSTEM and state == EMPTY):
                offer(own, path, extra, "K", f"{role}:{text}".encode("utf-8", "surrogatepass"))
    return {to: path.then(cost, letter, row) for to, (_, path, letter, cost, row) in best.items()}


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.layer = _closed({EMPTY: _Path(0, "", hashlib.sha256(), True)})
        self.shared: list[str] = []
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, first_turn: bool, fault: str | None) -> None:
        if fault != BLANK and (not first_turn or self.before == (turn, role, text)):
            fault = DUPLICATE
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.before = (turn, role, text)
        self.layer = layer = _closed(_after(self.layer, role, text, fault))
        # What can no longer win goes: after an assistant, all is open that is open here, but for a system turn to be kept.
        if EMPTY in layer and layer[ASSISTANT].cost + DELETE < layer[EMPTY].cost:
            del layer[EMPTY]
        if SYSTEM in layer and layer[ASSISTANT].cost < layer[SYSTEM].cost:
            del layer[SYSTEM]
        if len(layer[ASSISTANT].letters) > LETTERS:
            shared = os.path.commonprefix([p.letters for p in self.layer.values()])
            self.shared.append(shared)
            for p in self.layer.values():
                p.letters = p.letters[len(shared) :]

    def row(self) -> tuple:
        best = min((self.layer[s] for s in (EMPTY, ASSISTANT) if s in self.layer), key=_Path.rank)
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, best.cost, "".join(self.shared) + best.letters, best.sha.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row a conversation."""
    names = [re.match(r"\s*(\w+)", c)[1] for c in REPAIRED.split(",")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPAIRED.split(",")]

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    now: _Conversation | None = None
    done: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for conv_id, turn, role, text, _, dropped, first_turn, fault in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                if not dropped:
                    now.add(turn, role, text, first_turn, fault)
            if len(done) >= 256:
                yield batch_of(done)
                done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield batch_of(done)


def repair(labelled: DataFrame) -> DataFrame:
    """One row a conversation of label(): REPAIRED."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    return labelled.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_stream, REPAIRED)

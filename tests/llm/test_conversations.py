"""Conversation repair against a search over all edits, and on the defined edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from meridia.llm import conversations

FILLED, WELL = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, copy string, fault int"


def damaged(rows):
    """(conv_id, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        last = FILLED.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edits, an insertion at most twice in a row: least (cost, letters) and what is left, by plain search."""
    best = None
    todo = [(0, "", "", [], 0)]
    while todo:
        cost, letters, roles, kept, k = todo.pop()
        if best and cost > best[0]:
            continue
        if k == len(rows) and WELL.fullmatch(roles):
            best = min(best or (cost, letters, kept), (cost, letters, kept))
        if not letters.endswith("II"):
            todo += [(cost + 3, letters + "I", roles + r[0], [*kept, f"{r}:"], k) for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            todo.append((cost + 4, letters + "D", roles, kept, k + 1))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                if role:
                    todo.append((cost + more, letters + "K", roles + role[0], [*kept, f"{role}:{text}"], k + 1))
                todo += [(cost + 3 + more, letters + "R", roles + r[0], [*kept, f"{r}:{text}"], k + 1) for r in ("user", "assistant")]
        todo = [t for t in todo if re.fullmatch(r"(s|s?(ua)*u?)", t[2])]
    return best


def expected(rows):
    out = []
    for conv, own in damaged(rows).items():
        faults, turns = faults_of(own), [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, letters, kept = cheapest(own, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(df):
    return sorted((tuple(r) for r in conversations.repair(conversations.label(conversations.damage(df))).collect()), key=str)


def test_against_all_edits(spark, monkeypatch):
    rng, rows = random.Random(5), []
    texts = ["Yes.", "No!", "and then", " \t", "", None, "Good? \n", "日本。", "x.", "x.\u2028", "x!\n", "a.\x85"]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "User"]
    for conv in [*range(150), None]:
        for turn in rng.sample([*range(12), None, -3], rng.randrange(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, turn, rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert repaired(df) == expected(rows)
    monkeypatch.setattr(conversations, "join_repeated", lambda *a: __import__("meridia.llm.common", fromlist=["x"]).join_repeated(*a[:4], 1))
    assert repaired(df) == expected(rows)


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark.createDataFrame([], SCHEMA)) == []
    gone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark.createDataFrame([(gone, 0, "user", "All.", "", 0)], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    conv = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(2)))
    long = "word " * 400_000 + "end."
    got = repaired(spark.createDataFrame([(conv, 0, "user", long, "", 0), (conv, 1, "assistant", long, "", 0)], SCHEMA))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest())]


@pytest.mark.parametrize("letters", [8, 4096])
def test_one_long_conversation(spark, monkeypatch, letters):
    """Half a conversation's worth of alike turns in one key: letters that all states share are put aside."""
    rows = [(7, t, "user" if t % 2 == 0 or t % 91 == 0 else "assistant", f"Turn {t % 4000}.") for t in range(6000)]
    own = damaged(rows)[7]
    faults = faults_of(own)
    now = conversations._Conversation(7)
    monkeypatch.setattr(conversations, "LETTERS", letters)
    seen = {}
    for turn, role, text in own:
        first = seen.setdefault((role, text), turn) == turn
        now.add(turn, role, text, first, "blank" if not FILLED.search(text) else "truncated" if not re.search(r"[.!?]\s*$", text) else None)
    want = now.row()
    assert max(len(p.letters) for p in now.layer.values()) <= 6000 and (letters > 8 or sum(map(len, now.shared)) > 5000)
    assert want[2:5] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    assert len(want[7]) >= len(own) and repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == [want]

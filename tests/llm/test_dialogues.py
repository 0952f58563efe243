"""Conversation repair against a plain search over edits, whole and by blocks."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from topolake.llm import dialogues

SPACE, STOP = " \t\n\x0b\x0c\r", ".!?"


def plain(rows):
    """One conversation's result from its original rows (turn, role, text), by trying every edit."""
    conv_id, rows = rows
    after = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in STOP) if harm == 2 else text
        after += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in after:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in STOP else "")
        seen.add((role, text))

    @cache
    def best(i, said, inserted=0):
        """(cost, letters, lines) from row i on, after this initial, with so many inserts just made."""
        options = [(0, "", ())] if i == len(after) and said in ("", "a") else []
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[said]

        def add(cost, letter, role, text, rest):
            options.append((rest[0] + cost, letter + rest[1], (f"{role}:{text}", *rest[2])))

        if i < len(after):
            _, role, text = after[i]
            more = 3 * (faults[i] == "truncated")
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follows:
                    add(more, "K", role, text, best(i + 1, role[0]))
                for r in ("user", "assistant"):
                    if r[0] in follows:
                        add(3 + more, "R", r, text, best(i + 1, r[0]))
            rest = best(i + 1, said)
            options.append((rest[0] + 4, "D" + rest[1], rest[2]))
        if inserted < 3:
            for r in ("user", "assistant"):
                if r[0] in follows:
                    add(3, "I", r, "", best(i, r[0], inserted + 1))
        return min(options, default=(10**6, "", ()))

    for i in range(len(after), -1, -1):  # from behind, so that no search goes deep
        for said in ("", "s", "u", "a"):
            best(i, said)
    cost, audit, lines = best(0, "")
    turns = [r[0] for r in after if r[0] is not None]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    return (
        conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum((a[1][:1], b[1][:1]) not in legal for a, b in zip(after, after[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(n, seed, longest=9, roles=("system", "user", "assistant", "tool", None, "")):
    r = random.Random(seed)
    words = ["Yes.", "No!", "Why?", "and so", "Fine. ", "", " \t", "Well.\n", None]
    out = []
    for conv in [None, *range(n)]:
        size, turn = r.randint(0, longest), 0
        for _ in range(size):
            turn += r.choice([1, 1, 1, 1, 2, 0])
            out.append((conv, None if r.random() < 0.03 else turn, r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[turn % 2], r.choice(words) if r.random() < 0.4 else f"Line {r.randint(0, 40)}."))
    return out


def expected(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return sorted(map(str, (plain(x) for x in by.items())))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [512, 3])
def test_repair_equals_plain_search(spark, block):
    rows = conversations(120, 1) + conversations(1, 7, 60)[1:]
    found = dialogues.repair(spark.createDataFrame(rows, SCHEMA), block)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(rows)


def test_long_texts_go_by_blocks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "word " * 50 + ".") for t in range(9)] + [(2, 0, "user", "Hi.")]
    found = dialogues.repair(spark.createDataFrame(rows, SCHEMA), 4, 400)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected(rows)


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA + ", cost string, gone int")
    assert dialogues.repair(none).count() == 0
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Yes.", "x", 1)]
    assert [r["conv_id"] for r in dialogues.repair(spark.createDataFrame(rows, SCHEMA + ", cost string, gone int")).collect()] == [1]


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(conv, 0, "user", "Hi.")] * 5
    for block in (512, 2):
        found = dialogues.repair(spark.createDataFrame(rows, SCHEMA), block).collect()
        assert [tuple(r) for r in found] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

import hashlib
import random
import zlib

import numpy as np
import pytest

from seqframe.llm import conversations as C, queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string, `at` int, conv string"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out.setdefault(conv, [])
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def order(row):
    turn, role, text = row
    same = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return turn is not None, turn, same


def cheapest(rows, faults):
    """Cost, audit and lines of the cheapest edits, by memory over (turn, state); states are what may come next."""
    known = {}
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    for i in range(len(rows), -1, -1):
        best = {}
        for state in forced:
            options = []
            if i == len(rows):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, role, text = rows[i]
                c, audit, lines = known[i + 1][state]
                options.append((2 + c, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more, first = 5 * (faults[i] == "truncated"), role[:1]
                    if first == forced[state] or first == "s" and state == "":
                        c, audit, lines = known[i + 1][first]
                        options.append((more + c, "K" + audit, (f"{role}:{text}", *lines)))
                    c, audit, lines = known[i + 1][forced[state]]
                    options.append((1 + more + c, "R" + audit, (f"{names[forced[state]]}:{text}", *lines)))
            best[state] = min(options, default=(1 << 50, "", ()))
        for _ in range(3):  # inserts before the turn
            for state, after in forced.items():
                c, audit, lines = best[after]
                best[state] = min(best[state], (5 + c, "I" + audit, (f"{names[after]}:", *lines)))
        known[i] = best
    return known[0][""]


def plain(convs):
    out = []
    for conv, rows in convs.items():
        rows, seen, faults = sorted(rows, key=order), set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [role[:1] for _, role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit, lines = cheapest(rows, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
                   for r in df.collect()), key=repr)


def some_rows(seed, convs=60, longest=25):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u", "User"])
            if rng.random() < .5:
                role = ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No!", "why?", "cut", "", " \n", None, "é. ", f"unique {rng.random()}.", "Long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_plain_version(spark, seed):
    rows = some_rows(seed)
    damaged = C.damaged(frame(spark, rows).repartition(5))
    assert found(C.repair(damaged)) == plain(plain_damage(rows))


def test_parts_of_long_conversations(spark):
    """Chunks of a few turns, conversations over many ranges; one of them holds a third of all turns."""
    rows = some_rows(4, 12, 60)
    rng = random.Random(5)
    rows += [(777, i, ["user", "assistant"][(i + i // 50) % 2], rng.choice([f"t{i}.", f"t{i}", "Same.", "Same."]))
             for i in range(300)]
    damaged = C.damaged(frame(spark, rows).repartition(6))
    want = plain(plain_damage(rows))
    assert found(C.repair(damaged, chunk=500)) == want
    assert found(C.repair(damaged, chunk=1)) == want


def test_ties_and_repaired_text(spark):
    rows = [(1, 0, "assistant", "Hello."), (2, 0, "user", "Hi."), (3, 0, "system", "Be."), (3, 1, "user", "A?"),
            (3, 2, "user", "B?"), (3, 3, "assistant", "C.")]
    df = spark.createDataFrame([(*r, False) for r in rows], "conv_id long, turn long, role string, text string, dropped boolean")
    got = {r.conv_id: (r.cost, r.audit, r.repaired) for r in C.repair(df, texts=True).collect()}
    assert got == {1: (2, "D", ""), 2: (2, "D", ""), 3: (2, "KDKK", "system:Be.\nuser:B?\nassistant:C.")}


def test_conversations_without_turns_and_no_rows(spark):
    empty = hashlib.sha256(b"").hexdigest()
    kind = "conv_id string, turn long, role string, text string, dropped boolean"
    df = spark.createDataFrame([("a", 1, "user", "x.", True), (None, None, None, None, True), ("", 1, "user", "x", True)], kind)
    got = found(C.repair(df))
    assert got == [("", 0, 0, 0, 0, 0, 0, "", empty), ("a", 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
    assert C.repair(spark.createDataFrame([], kind)).count() == 0
    assert C.damaged(frame(spark, [])).count() == 0


def test_powers_of_a_run_equal_single_steps():
    for symbol in range(len(C.SYMBOLS)):
        for many in (1, 2, 3, 7, 64, 100):
            single = C.END
            for _ in range(many):
                single = C._times(C.power(symbol, 0), single)
            assert np.array_equal(C.before_run(symbol, many, C.END), single)


def test_query_is_the_operator_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op12_conversation_repair"](spark, d)) == plain(plain_damage(rows))

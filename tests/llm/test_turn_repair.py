"""Repairs against all possible edits of short conversations and against a table of whole strings for longer ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyglass.llm import turn_repair
from tallyglass.llm.turn_repair import BLANK, DUPLICATE, NO_FAULT, TRUNCATED, Survivors

SHAPE = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def all_edits(rows):
    """(cost, audit) of every sequence of edits with up to two inserts in a gap, by the shape of its result."""
    for kinds in itertools.product("KUAD", repeat=len(rows)):
        cost, letters, roles = 0, [], []
        for (initial, fault), kind in zip(rows, kinds):
            if kind != "D" and fault in (BLANK, DUPLICATE):
                break
            cost += {"K": 0, "U": 1, "A": 1, "D": 2}[kind] + (5 if fault == TRUNCATED and kind != "D" else 0)
            letters.append({"K": "K", "U": "R", "A": "R", "D": "D"}[kind])
            roles.append({"K": initial, "U": "u", "A": "a", "D": ""}[kind])
        else:
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                shape = gaps[0] + "".join(r + g for r, g in zip(roles, gaps[1:]))
                if SHAPE.fullmatch(shape):
                    yield cost + 5 * sum(map(len, gaps)), "I" * len(gaps[0]) + "".join(x + "I" * len(g) for x, g in zip(letters, gaps[1:]))


def by_strings(rows):
    """The cheapest audit by whole strings per state, nothing dropped early."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                for new in (x for x in "ua" if x in follow[state]):
                    best[new] = min(best.get(new, (cost + 5, audit + "I")), (cost + 5, audit + "I"))
        return best

    best = {"": (0, "")}
    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(state, 2, "D")]
            if fault in (NO_FAULT, TRUNCATED):
                extra = 5 if fault == TRUNCATED else 0
                ways += [(initial, extra, "K")] if initial in follow[state] else []
                ways += [(x, 1 + extra, "R") for x in "ua" if x in follow[state]]
            for new, more, letter in ways:
                after[new] = min(after.get(new, (cost + more, audit + letter)), (cost + more, audit + letter))
        best = after
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def decided(rows):
    survivors, out = Survivors(), b""
    for row in rows:
        out += survivors.step(*row)
    return (out + survivors.finish()).decode()


def random_rows(rng, n, roles="suat", faults=(0, 0, 0, 1, 2, 3)):
    return [(rng.choice(roles), rng.choice(faults)) for _ in range(n)]


def test_all_edits_of_short_conversations():
    rng = random.Random(1)
    for rows in [[], *([x] for x in itertools.product("suat", range(4))), *(random_rows(rng, 2) for _ in range(60)), *(random_rows(rng, 3) for _ in range(25))]:
        want = min(all_edits(rows))
        assert by_strings(rows) == want
        assert decided(rows) == want[1]


@pytest.mark.parametrize("roles,faults", [("suat", (0, 0, 0, 1, 2, 3)), ("ua", (0, 0, 0, 0, 0, 3)), ("t", (0,)), ("ut", (0, 3)), ("sa", (0, 1)), ("u", (3,))])
def test_longer_conversations(roles, faults):
    rng = random.Random(2)
    for n in [*range(4, 40), 200]:
        for _ in range(6):
            rows = random_rows(rng, n, roles, faults)
            assert decided(rows) == by_strings(rows)[1]


def test_memory_is_bounded():
    def held(survivors):
        nodes, todo = 0, [survivors.root]
        letters = 0
        while todo:
            node = todo.pop()
            nodes, letters = nodes + 1, letters + len(node.letters)
            todo += node.branches
        return nodes, letters

    rng, survivors, out = random.Random(3), Survivors(), 0
    for i in range(30_000):
        out += len(survivors.step("ua"[i % 2] if rng.random() > 0.1 else "t", rng.choice((0,) * 12 + (1, 3))))
        nodes, letters = held(survivors) if i % 100 == 0 else (0, 0)
        assert nodes <= 7 and letters < 500
    # without any user or assistant the first edit depends on the number of rows: all stays open, at a byte a survivor
    survivors = Survivors()
    for _ in range(30_000):
        assert survivors.step("t", 0) == b""
    assert held(survivors)[0] <= 7 and held(survivors)[1] < 4 * 30_000


def test_a_node_left_with_one_branch_joins_it():
    rng = random.Random(4)
    for _ in range(300):
        survivors = Survivors()
        for row in random_rows(rng, 60):
            survivors.step(*row)
            todo = [survivors.root]
            while todo:
                node = todo.pop()
                assert len(node.branches) != 1 and all(b.parent is node for b in node.branches)
                todo += node.branches


def expected(rows, order=True):
    """The contract's columns for (conv, turn, role, text) rows, in plain Python."""
    text = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, words in (r for r in rows if r[0] == conv):
            case = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
            role, words = text(role), text(words)
            words = "" if case == 1 else re.sub("[.!?]", "", words) if case == 2 else words
            role = "user" if case == 4 else role
            after += [(turn, role, words)] * {0: 0, 3: 2}.get(case, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, words in after:
            kept = words.rstrip(BLANKS)
            faults.append(BLANK if not kept else DUPLICATE if (role, words) in seen else TRUNCATED if kept[-1] not in ".!?" else NO_FAULT)
            seen.add((role, words))
        cost, audit = by_strings([(r[1][:1], f) for r, f in zip(after, faults)])
        lines, at, state = [], iter(after), ""
        for letter in audit:
            role, words = ("", "") if letter == "I" else next(at)[1:]
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{words}")
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest)
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, conv int, fault int, chunk int"


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 12)):
            turn = rng.choice([turn, turn, turn, turn + 5, None, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            words = rng.choice(["Yes.", "No", "Yes.", " \t ", "", None, "Why?\n", f"Word {rng.random()}!", "é", "z ", "\x1c."])
            rows += [(conv, turn, role, words)] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert found(turn_repair.damaged_and_repaired(df)) == expected(rows)


def test_empty_and_vanished(spark):
    assert turn_repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, 1, 1)], SCHEMA)
    assert found(turn_repair.damaged_and_repaired(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_of_many_chunks_and_long_texts(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), rng.choice(["Hm.", f"{i}.", f"{i}", "x" * 50])) for i in range(3 * turn_repair.CHUNK)]
    rows += [(2, i, "tool", f"{i}.") for i in range(turn_repair.CHUNK + 1)] + [(3, 0, "user", "long " * 400_000 + "!")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert found(turn_repair.damaged_and_repaired(df)) == expected(rows)
    made = turn_repair.edits(df).collect()
    assert sum(r.edit != "I" for r in made) == len(rows)
    for conv in (1, 2, 3):
        roles = "".join(r.role[:1] for r in sorted((r for r in made if r.conv == conv), key=lambda r: r.step) if r.role is not None)
        assert SHAPE.fullmatch(roles)


def test_query(spark):
    from conftest import SMALL

    from tallyglass.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_turn_repair"](spark, SMALL)) == expected(rows)

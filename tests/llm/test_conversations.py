import hashlib
import heapq
import random
import re
import zlib

import pytest

from givetide.llm import conversations
from givetide.llm.conversations import SYMBOLS, Tables

NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """Least (cost, audit) and the repaired rows, by trying all edits in the order of their cost and letters."""
    heap, settled = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if settled.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and last in ("", "a"):
            ended = [(cost, audit, out)] + [(c, a, o) for c, a, j, e, o in heap if c == cost and j == len(rows) and e in ("", "a")]
            return min(ended)[:3]
        role = NEXT[last]
        heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            kind, initial, role_now, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if kind < 2:
                if last + initial in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + 3 * kind, audit + "K", i + 1, initial, (*out, (role_now, text))))
                heapq.heappush(heap, (cost + 3 + 3 * kind, audit + "R", i + 1, role[0], (*out, (role, text))))


def plain(rows):
    """The whole report, row by row."""
    result = {}
    damaged = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        damaged[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, some in damaged.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, states = set(), []
        for _, role, text in some:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            kind = 2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            seen.add((role, text))
            states.append((kind, role[:1] if role[:1] in ("s", "u", "a") else "x", role, text))
        cost, audit, out = cheapest(states)
        turns = {t for t, *_ in some if t is not None}
        result[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(k == want for k, *_ in states) for want in (2, 3, 1)],
            sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(states, states[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return result


def made(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  \t", "Well. ", "und so…", "same.", "ends.\n\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", None]
    rows = []
    for conv in [None, *range(n)]:
        length = rng.choice([1, 2, 3, 5, 8, 12, 30])
        for turn in range(length):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(roles), rng.choice([*texts, None, f"text {turn}."])))
    rows += [(n + 1, 0, "user", "Hello."), (n + 1, 0, "user", "Hello."), (n + 1, 0, "assistant", "x" * 200_000 + ".")]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashes = ["conv", "pos", "sub", "symbol", "chunk", "vector", "place", "kind", "fate", "one", "tie", "part_", "before", "added", "hash", "steps"]
    return df.selectExpr("*", *[f"'x' as {c}" for c in clashes])


@pytest.mark.parametrize("seed", range(4))
def test_tables_give_the_cheapest_edits_least_in_ascii(seed):
    rng, tables = random.Random(seed), Tables()
    for _ in range(400):
        kinds = [(rng.choice([0, 0, 0, 1, 2, 3]), rng.choice("suuaax")) for _ in range(rng.randint(0, 10))]
        symbols = "".join(chr(65 + SYMBOLS.index(s)) for s in kinds)
        edits, place = tables.edits(symbols, 0, 0)
        _, audit, _ = cheapest([(k, r, r, "t") for k, r in kinds])
        assert "".join(edits) + tables.ending[place] == audit


def test_blocks_equal_single_steps():
    rng, tables = random.Random(9), Tables()
    for _ in range(50):
        symbols = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randint(0, 23)))
        for vector, found in enumerate(tables.before(symbols)):
            at = vector
            for s in reversed(symbols):
                at = tables.steps[at, ord(s) - 65]
            assert at == found


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 4])
def test_report_equals_a_plain_reading(spark, chunk):
    rows = made(3)
    got = conversations.repair_report(frame(spark, rows), chunk).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len({r[0] for r in rows})


def test_a_long_conversation_spreads_over_chunks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"Line {t}.", "again.", "cut"])) for t in range(3000)] + [(2, 0, "user", "Hi.")]
    whole, parts = (sorted(map(tuple, conversations.repair_report(frame(spark, rows), c).collect())) for c in (conversations.CHUNK, 64))
    assert whole == parts
    assert len(whole[0][-2]) >= 2700


def test_an_empty_table_and_a_conversation_that_is_lost(spark):
    assert conversations.repair_report(frame(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversations.repair_report(frame(spark, [(lost, 0, "user", "Gone.")])).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_are_sound(spark):
    damaged = conversations.damage(frame(spark, made(8)))
    report, repaired = conversations.repair(damaged)
    by_conv = {}
    for r in repaired.orderBy("pos", "sub").collect():
        by_conv.setdefault(r["conv"], []).append(r)
    for rows in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in rows))
    assert report.count() == damaged.select("conv").distinct().count()

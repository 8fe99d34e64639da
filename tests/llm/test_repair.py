"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chronopanel.llm import repair

FIELDS = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
LONG = {"u": "user", "a": "assistant"}


def cheapest(rows, faults):
    """(cost, audit, texts) of the cheapest edits, the ASCII-least of them, by best-first search."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, left = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, left
        for r in "ua":
            if r in FOLLOWS[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*left, f"{LONG[r]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, left))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] and role[:1] in FOLLOWS[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*left, f"{role}:{text}")))
                for r in "ua":
                    if r in FOLLOWS[last]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, r, (*left, f"{LONG[r]}:{text}")))


def plain(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        held = conversations.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, held in conversations.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in held:
            core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, left = cheapest(held, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def drawn(seed, n, convs, turns):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "sys", "unk"]
    texts = ["ok.", "ok", "hm?", "", "  ", None, "yes! ", "a\n", "é.", "long " * 10, " ", "x. "]
    return [(r.choice([None, *range(convs)]), r.choice([None, *range(turns)]), r.choice(roles), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(
    "rows,options",
    [
        (drawn(1, 400, 3, 200), {"chunk_rows": 7}),  # conversations over many chunks
        (drawn(2, 80, 30, 9), {}),
        (drawn(3, 90, 1, 60), {"chunk_rows": 3}),
        (drawn(4, 60, 1, 40), {"chunk_bytes": 1}),
        ([(5, 1, "user", "same."), (5, 1, "user", "same.")] * 40 + [(5, None, None, None)] * 9, {"chunk_rows": 4}),  # equal rows
        ([(i, i, "user", f"{i}.") for i in range(99)], {}),  # some conversations lose all their rows
        ([(1, i, "assistant" if i % 2 else "user", f"{i}.") for i in range(300)], {"chunk_rows": 20}),
        ([(1, i, "assistant", f"{i}.") for i in range(120)], {"chunk_rows": 10}),
    ],
)
def test_cheapest_edits(spark, rows, options):
    table = spark.createDataFrame([(*r, 3, "x") for r in rows], FIELDS + ", copies int, key string").repartition(4)
    out = repair.repaired(repair.damaged(table), **options).select("conv_id", *repair.NAMES_OUT).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == plain(rows)
    assert len(out) == len({r[0] for r in rows})


def test_no_rows_and_string_ids(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], FIELDS))).collect() == []
    table = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], FIELDS.replace("conv_id long", "conv_id string"))
    out = repair.repaired(repair.damaged(table)).collect()
    assert [(r.conv_id, r.audit, r.cost) for r in out] == [("a", *plain([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")])["a"][6:4:-1])]


def test_very_long_text(spark):
    rows = [(1, i, r, "word " * 400_000 + end) for i, (r, end) in enumerate([("user", "."), ("assistant", ""), ("user", "!"), ("assistant", "?" + " " * 100_000)])]
    out = repair.repaired(repair.damaged(spark.createDataFrame(rows, FIELDS))).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == plain(rows)


def test_vectors_converge_in_rank():
    """From any assumed end the vectors soon differ by constants only."""
    r = random.Random(1)
    steps = repair.Steps()
    codes = bytes(4 * r.randrange(3) + r.randrange(4) for _ in range(200))
    paths = [repair.backward(codes, end, steps)[0] for end in (repair.UNKNOWN, repair.AT_END, (3, 0, 9, 1))]
    assert paths[0][0] == paths[1][0] == paths[2][0]

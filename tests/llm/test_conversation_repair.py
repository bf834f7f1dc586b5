"""Conversation repair against enumeration and against a shortest path of its own, and the edge cases of its docstrings."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from lumicube.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, known int, m string, list int"  # clashing names
WHITE = " \t\n\x0b\x0c\r"
ALLOWED = [s + "ua" * n for n in range(40) for s in ("", "s") if n or not s]


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(kind, text)
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def judged(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(WHITE)
        again = bool(said) and (role, text) in seen
        seen.add((role, text))
        out.append((role, text, not said, again, bool(said) and not again and said[-1] not in ".!?"))
    return rows, out


def enumerated(turns):
    """Cheapest (cost, edits) by trying all edits with up to two insertions at each place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(e != "D" and (t[2] or t[3]) for e, t in zip(edits, turns, strict=True)):
            continue
        for gaps in itertools.product(("", "I", "II"), repeat=len(turns) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            rest, made = iter(turns), []
            for e in audit:
                t = None if e == "I" else next(rest)
                if e != "D":
                    made.append(t[0][:1] if e == "K" else "?")
            if any(len(p) == len(made) and all(m == x or m == "?" and x in "ua" for m, x in zip(made, p, strict=True)) for p in ALLOWED):
                cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit) + sum(t[4] for e, t in zip(edits, turns, strict=True) if e != "D")
                best = min(best or (cost, audit), (cost, audit))
    return best


def shortest(turns):
    """Cheapest (cost, edits, lines) by a priority queue over (turns read, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(turns) and last in ("", "a"):
            return cost, audit, lines
        if (at, last) in done:
            continue
        done.add((at, last))
        due = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 2, audit + "I", at, due, (*lines, f"{name}:")))
        if at < len(turns):
            role, text, blank, again, cut = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, lines))
            if not (blank or again):
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, due, (*lines, f"{name}:{text}")))
                if role[:1] == due or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
    raise AssertionError


def expected(rows):
    rows, turns = judged(rows)
    cost, audit, lines = shortest(turns)
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return gaps, *(sum(t[k] for t in turns) for k in (2, 3, 4)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversations(r, n, most):
    rows = []
    for c in range(n):
        roles = r.choices(["user", "assistant", "system", "tool", "", None, "User", "sys"], [6, 6, 1, 1, 0.3, 0.3, 0.3, 0.3], k=r.randint(1, most))
        texts = r.choices(["Yes.", "No", "Why?", "", " \t\n", None, "Ja!  ", "é", "a" * 30 + "."], k=len(roles))
        rows += [(c if c else None, r.choice([k, k, k, 3, None]), role, f"{text}" if r.random() < 0.4 and text is not None else text and f"{k} {text}") for k, (role, text) in enumerate(zip(roles, texts, strict=True))]
    return rows


def held(got, rows):
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert sorted((x["conv_id"] for x in got), key=str) == sorted(by, key=str)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    for x in got:
        assert tuple(x[n] for n in names) == expected(hurt(by[x["conv_id"]])), by[x["conv_id"]]


def table_of(spark, rows):
    return spark.createDataFrame([(*row, "k", 1, 2, "m", 3) for row in rows], SCHEMA)


def test_the_shortest_path_is_the_least_of_all_edits():
    r = random.Random(4)
    for _ in range(150):
        turns = [(r.choice(["user", "assistant", "system", "x"]), "t", r.random() < 0.1, r.random() < 0.1, r.random() < 0.3) for _ in range(r.randint(0, 4))]
        assert shortest(turns)[:2] == (enumerated(turns) or (0, ""))


def test_conversations(spark):
    rows = conversations(random.Random(5), 300, 9)
    held(C.digests(C.damaged(table_of(spark, rows))).collect(), rows)


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4)
    r = random.Random(6)
    rows = conversations(r, 12, 60) + conversations(r, 1, 1) + [(99, 5, "user", "same.")] * 30 + [(98, k, "user", "again.") for k in range(30)]
    got = C.digests(C.damaged(table_of(spark, rows).repartition(3)))
    held(got.collect(), rows)
    parts = C.repair(C.damaged(table_of(spark, rows))).collect()
    assert all(len(x["audit"].replace("I", "")) <= 4 for x in parts if x["conv_id"] in (98, 99)) and len(parts) > 30
    assert {x["part"] for x in parts if x["conv_id"] == 98} == set(range(max(x["part"] for x in parts if x["conv_id"] == 98) + 1))


@pytest.mark.parametrize("block", [2, 256])
def test_odd_tables(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    long_text = "word " * 200_000
    rows = [(1, 0, "user", long_text + "end."), (1, 1, "assistant", long_text), (2, None, None, None), (2, None, "user", "x."), (None, 3, "user", "x."), (3, 2**62, "a", "b."), (3, 2**62, "a", "b."), (3, 2**62, "a", "b."), (3, 2**62, "a", "b.")]
    held(C.digests(C.damaged(table_of(spark, rows))).collect(), rows)
    assert C.digests(C.damaged(table_of(spark, rows[:1]).limit(0))).count() == 0
    gone = next(k for k in range(200) if zlib.crc32(f"7:{k}".encode()) % 20 == 0)
    (x,) = C.digests(C.damaged(table_of(spark, [(7, gone, "user", "x.")]))).collect()
    assert (x["gaps"], x["blank"], x["cost"], x["audit"], x["repaired_sha256"]) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_registered_query(spark, data, same_as_oracle):
    from lumicube.llm import queries

    assert same_as_oracle(queries.QUERIES["op11_conversation_repair"](spark, data), queries.ORACLE_SQL["op11_conversation_repair"]) > 0

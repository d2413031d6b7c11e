"""Conversation repair against an enumeration of all edits, in one chunk and in many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from equipledger.llm import audit_repair as A

from .conftest import SF

COLUMNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        if not re.search("[^\x20\x09-\x0d]", text):
            out.append("b")
        elif (role, text) in [(r, t) for _, r, t in rows[:i]]:
            out.append("d")
        else:
            out.append("" if re.search("[.!?][\x20\x09-\x0d]*\\Z", text) else "t")
    return out


def enumerated(rows):
    """(cost, audit, messages) over all edits with at most two inserts in a gap, by listing every one of them."""
    fault = faults(rows)

    @lru_cache(None)
    def rest(i):
        out = []
        for extra in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            head = (3 * len(extra), "I" * len(extra), tuple((r, "") for r in extra))
            if i == len(rows):
                out.append(head)
                continue
            _, role, text = rows[i]
            own = [(4, "D", ())]
            if fault[i] not in ("b", "d"):
                cut = 3 * (fault[i] == "t")
                own += [(cut, "K", ((role, text),)), (3 + cut, "R", (("user", text),)), (3 + cut, "R", (("assistant", text),))]
            for o in own:
                for t in rest(i + 1):
                    out.append((head[0] + o[0] + t[0], head[1] + o[1] + t[1], head[2] + o[2] + t[2]))
        least = {}
        for c, a, m in out:      # of equal role strings only the best can matter
            key = "".join(r[:1] for r, _ in m) if all(r for r, _ in m) else None
            if key is not None and (key not in least or (c, a) < least[key][:2]):
                least[key] = (c, a, m)
        return list(least.values())

    return min((x for x in rest(0) if LEGAL.match("".join(r[:1] for r, _ in x[2]))), key=lambda x: x[:2])


def walked(rows):
    """The same by whole strings: per legal beginning of the roles (as its last state) the least (cost, audit, messages)."""
    def state(messages):
        initials = "".join(r[:1] if r else "?" for r, _ in messages)
        return next((k for k, p in enumerate(("", "s", "s?(ua)*u", "s?(ua)+")) if re.fullmatch(p, initials)), None)

    def least(options):
        out = {}
        for o in options:
            k = state(o[2])
            if k is not None and (k not in out or o < out[k]):
                out[k] = o
        return list(out.values())

    def inserted(now):
        for _ in range(2):
            now = least(now + [(c + 3, a + "I", (*m, (r, ""))) for c, a, m in now for r in ("user", "assistant")])
        return now

    now = [(0, "", ())]
    for f, (_, role, text) in zip(faults(rows), rows):
        cut, before = 3 * (f == "t"), inserted(now)
        now = [(c + 4, a + "D", m) for c, a, m in before]
        if f not in ("b", "d"):
            now += [(c + cut, a + "K", (*m, (role, text))) for c, a, m in before]
            now += [(c + 3 + cut, a + "R", (*m, (r, text))) for c, a, m in before for r in ("user", "assistant")]
        now = least(now)
    return min(o for o in inserted(now) if state(o[2]) in (0, 3))


def expected(rows, best=walked):
    """The row of one conversation from its (turn, role, text) in order."""
    f = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, messages = best(rows)
    text = "\n".join(f"{r}:{t}" for r, t in messages)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def conversations(seed, n, most):
    rng, out = random.Random(seed), {}
    for c in range(n):
        turns = sorted(rng.choice([None, *range(12)][rng.randint(0, 1):]) or 0 for _ in range(rng.randint(1, most)))
        out[c] = ordered([(t if rng.random() < .95 else None, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]),
                           rng.choice(["yes.", "no", "why?", "", " \t", "a b!", "c"])) for t in turns])
    return out


def test_cheapest_edits_of_all():
    for rows in conversations(3, 120, 4).values():
        c = A.Chunk([(*r, True) for r in rows])
        cost, audit = c.solve(A.Prefixes()).end()
        want = expected(rows, enumerated)
        assert expected(rows) == want
        assert (cost, audit) == want[5:7]
        assert A.digest(A.repaired(c.rows, audit)) == want[7]


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(A, "_MOD", 3)
    for rows in conversations(4, 300, 12).values():
        assert A.Chunk([(*r, True) for r in rows]).solve(A.Prefixes()).end() == expected(rows)[5:7]


def test_prefix_search():
    rng, s = random.Random(5), A.Prefixes()
    nodes = {0: ""}
    for _ in range(300):
        parent = rng.choice(list(nodes))
        ch = rng.choice("DIKR")
        nodes[s.push(parent, ord(ch))] = nodes[parent] + ch
    for a, b in (rng.choices(list(nodes), k=2) for _ in range(4000)):
        x, y = rng.choice("DIKR"), rng.choice("DIKR")
        assert s.less(a, ord(x), b, ord(y)) == (nodes[a] + x < nodes[b] + y)
        assert "".join(map(chr, s.spelled(a))) == nodes[a]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_chunks_give_the_whole(spark, chunk):
    convs = conversations(7, 60, 7)
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], COLUMNS)
    got = {r.conv_id: tuple(r)[1:] for r in A.audited(df, chunk).collect()}
    assert got == {c: expected(rows) for c, rows in convs.items()}


def test_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{'text' if rng.random() < .2 else t}{rng.choice('.?x')}") for t in range(1500)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert [tuple(r) for r in A.audited(df, 50).collect()] == [tuple(r) for r in A.audited(df).collect()]


def test_query_rows(spark):
    convs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet")
    want = defaultdict(list)
    for conv, turn, role, text in convs.select("conv_id", "turn", "role", "text").collect():
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        want[conv] += [] if h == 0 else [row, row] if h == 3 else [row]
    got = {r.conv_id: tuple(r)[1:] for r in A.audited(A.damaged(convs)).collect()}
    assert got == {c: expected(ordered(rows)) for c, rows in want.items()}


@pytest.mark.parametrize("chunk", [2, 4096])
def test_odd_rows(spark, chunk):
    long = "word " * 100000 + "end."
    rows = [(1, None, None, None), (1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "x."), (None, 0, "user", "hi."),
            (None, 9, "assistant", "no id."), (2, None, None, "text."), (2, None, "user", None), (3, -5, "user", "a."), (3, 5, "assistant", "b.")]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(c) for c in ("chunk", "seen", "entry", "tail", "cost", "audit", "k")})
    got = {r.conv_id: tuple(r)[1:] for r in A.audited(df, chunk).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    assert got == {c: expected(ordered(r)) for c, r in by.items()}


def test_nothing_and_all_dropped(spark):
    assert A.audited(spark.createDataFrame([], COLUMNS)).count() == 0
    assert A.audited(A.damaged(spark.createDataFrame([], COLUMNS))).count() == 0
    df = spark.createDataFrame([(1, 2, "user", "x.")], COLUMNS).withColumn("here", F.lit(False))
    assert tuple(A.audited(df).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

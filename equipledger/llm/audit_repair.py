"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``, as an audit string.

A dynamic programme over (row, grammar state) keeps per state the cheapest edits so far, ties to the ASCII-least string. Edit
strings are persistent: a state holds the last node of a linked list that shares its prefix with the other states. A node
has binary-lifting ancestors and a rolling hash, so two strings are compared by searching their longest common prefix in
logarithmic steps; equal hashes of different nodes are verified letter by letter.

Of two strings of one cell and one cost none is a prefix of the other: same letters lead to the same state, so the longer one
would only add inserts, which cost. So the lesser prefix stays the lesser string whatever follows, and the programme is exact.

Conversations are cut into chunks of turns. One chunk is solved in one group; a conversation with several of them, however
long, is solved by chunk: from each entry state the cheapest edits to each exit state and their order (16 small numbers a
chunk), folded chunk by chunk with the same shared prefixes, and then applied to each chunk on its own. Only the digest of the
repaired text passes through a chunk sequence in order, as a running hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipledger.llm.common import saved, table

CHUNK = 4096             # turns
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 3, 4, 3, 3
# grammar states: nothing yet, after s, after u, after a; the first and the last may end
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)          # the state that a rerole or an insert leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\v\f\r"
_BASE, _MOD = 1_000_003, (1 << 61) - 1


class Prefixes:
    """Strings that share their prefixes: node 0 is the empty string, every other node adds a letter to its parent's."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [0], [0], [0], [[]]

    def push(self, parent: int, letter: int) -> int:
        up, j = [parent], 0
        while j < len(self.up[up[j]]):
            up.append(self.up[up[j]][j])
            j += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + letter + 1) % _MOD)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][min(len(self.up[node]), (self.depth[node] - depth).bit_length()) - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same; equal hashes alone are not believed."""
        if a == b or self.hash[a] != self.hash[b]:
            return a == b
        while a != b and self.letter[a] == self.letter[b]:
            a, b = self.up[a][0], self.up[b][0]
        return a == b

    def less(self, a: int, after_a: int, b: int, after_b: int) -> bool:
        """Whether string ``a`` + letter ``after_a`` comes before ``b`` + ``after_b``."""
        n = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, n), self.ancestor(b, n)
        if self.same(x, y):       # the shorter one goes on with its added letter
            p = after_a if self.depth[a] == n else self.letter[self.ancestor(a, n + 1)]
            q = after_b if self.depth[b] == n else self.letter[self.ancestor(b, n + 1)]
            return p < q if p != q else self.depth[a] < self.depth[b]
        j = len(self.up[x]) - 1
        while j >= 0:             # up to the last ancestors that differ: behind the longest common prefix
            if j < len(self.up[x]) and not self.same(self.up[x][j], self.up[y][j]):
                x, y = self.up[x][j], self.up[y][j]
            j -= 1
        return self.letter[x] < self.letter[y]

    def spelled(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]


class Programme:
    """The cheapest edits per grammar state, row by row. ``cells[state]`` is (cost, node) or None."""

    def __init__(self, strings: Prefixes, entry: int = START):
        self.strings = strings
        self.cells: list[tuple[int, int] | None] = [None] * 4
        self.cells[entry] = (0, 0)

    def _best(self, offers: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
        best = None
        for o in offers:
            if best is None or o[0] < best[0] or (o[0] == best[0] and self.strings.less(o[1], o[2], best[1], best[2])):
                best = o
        return best

    def with_inserts(self) -> list[tuple[int, int] | None]:
        """The cells if up to two messages are inserted here; more would come back to a state at a cost."""
        out, letter = list(self.cells), ord(INSERT)
        for into, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            new = self._best([(out[s][0] + INSERT_COST, out[s][1], letter) for s in sources if out[s]])
            if new is None:
                continue
            have = out[into]
            if have is None or new[0] < have[0] or (new[0] == have[0] and self._before(new, have[1])):
                out[into] = (new[0], self.strings.push(new[1], letter))
        return out

    def _before(self, offer: tuple[int, int, int], node: int) -> bool:
        """Whether the string of an offer comes before that of a node that isn't empty."""
        return self.strings.less(offer[1], offer[2], self.strings.up[node][0], self.strings.letter[node]) if node else False

    def row(self, initial: str, must_go: bool, cut: bool) -> None:
        offers: list[list] = [[], [], [], []]
        extra = CUT_COST if cut else 0
        for state, cell in enumerate(self.with_inserts()):
            if cell is None:
                continue
            cost, node = cell
            offers[state].append((cost + DELETE_COST, node, ord(DELETE)))
            if not must_go:
                kept = KEPT.get((state, initial))
                if kept is not None:
                    offers[kept].append((cost + extra, node, ord(KEEP)))
                if kept != NEXT[state]:
                    offers[NEXT[state]].append((cost + REROLE_COST + extra, node, ord(REROLE)))
        best = [self._best(o) for o in offers]
        self.cells = [b and (b[0], self.strings.push(b[1], b[2])) for b in best]

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits that end in a legal state."""
        out = self.with_inserts()
        legal = [(out[s][0], "".join(map(chr, self.strings.spelled(out[s][1])))) for s in (START, ASSISTANT) if out[s]]
        return min(legal)


def repaired(rows: list[tuple], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the messages that the edits of ``audit`` leave of ``rows`` (turn, role, text, here)."""
    at = iter(rows)
    for edit in audit:
        if edit == INSERT:
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        _, role, text, *_ = next(at)
        if edit == KEEP:
            state = KEPT[state, role[:1]]
            yield role, text
        elif edit == REROLE:
            state = NEXT[state]
            yield ROLE[state], text


class Chunk:
    """Rows (turn, role, text) of one chunk in order, their faults and counts. ``seen`` tells rows seen in earlier chunks."""

    def __init__(self, rows: list[tuple], seen: list[bool] | None = None):
        self.rows = rows
        turns = [r[0] for r in rows if r[0] is not None]
        self.turns = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
        self.faults: list[str] = []
        known = set()
        for i, (_, role, text, *_) in enumerate(rows):
            body = text.rstrip(BLANKS)
            if not body.strip(BLANKS):
                self.faults.append("blank")
            elif (seen and seen[i]) or (role, text) in known:
                self.faults.append("duplicate")
            else:
                self.faults.append("" if body[-1] in ".!?" else "truncated")
            known.add((role, text))
        self.initials = [r[1][:1] for r in rows]
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))

    def counts(self) -> tuple[int, int, int]:
        return tuple(self.faults.count(f) for f in ("blank", "duplicate", "truncated"))

    def solve(self, strings: Prefixes, entry: int = START) -> Programme:
        p = Programme(strings, entry)
        for initial, fault in zip(self.initials, self.faults):
            p.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        return p


def digest(messages: Iterator[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode("utf-8", "surrogatepass")).hexdigest()


def _groups(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same first ``keys`` columns."""
    for key, members in groupby(rows, lambda r: r[:keys]):
        yield key, [r[keys:] for r in members]


def _batches(out: Iterator[tuple], schema: pa.Schema, at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in out:
        held.append(r)
        if len(held) == at_once:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema=schema)


def _streamed(rows: DataFrame, keys: list[str], order: list[Column], work, fields: dict[str, str], conv: str) -> DataFrame:
    """``work(rows)`` over the rows dealt by a hash of ``keys`` and sorted by them and ``order``; conv_id comes first."""
    arrow = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field(0).type), *((n, arrow[t]) for n, t in fields.items())])

        tuples = (r for b in chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(work(tuples), schema)

    return dealt.mapInArrow(run, ", ".join([f"conv_id {conv}", *(f"{n} {t}" for n, t in fields.items())]))


COUNTS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long"}
RESULT = {**COUNTS, "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _here(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[3]]


def _gaps(low, high, distinct) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _whole(stream):
    """Every chunk solved as if it were its whole conversation."""
    for (conv, chunk), rows in _groups(stream, 2):
        c = Chunk(_here(rows))
        cost, audit = c.solve(Prefixes()).end()
        yield conv, chunk, _gaps(*c.turns), *c.counts(), c.illegal, cost, audit, digest(repaired(c.rows, audit))


def _summaries(stream):
    """Per chunk its counts, and for every entry and exit state the least cost (-1: none) and the rank of its string among the
    exits of that entry."""
    for (conv, chunk), rows in _groups(stream, 2):
        rows = _here(rows)
        c = Chunk(rows, [r[4] for r in rows])
        strings, costs, ranks = Prefixes(), [], []
        for entry in range(4):
            cells = c.solve(strings, entry).cells
            order = sorted((s for s in range(4) if cells[s]), key=cmp_to_key(
                lambda x, y: -1 if strings.less(cells[x][1], 0, cells[y][1], 0) else 1))
            costs += [cells[s][0] if cells[s] else -1 for s in range(4)]
            ranks += [order.index(s) if cells[s] else -1 for s in range(4)]
        edge = (c.initials[0], c.initials[-1]) if rows else (None, None)
        yield conv, chunk, len(rows), *c.turns, *c.counts(), c.illegal, *edge, costs, ranks


SUMMARY = {"chunk": "long", "n": "long", "low": "long", "high": "long", "turns": "long", "blank": "long", "duplicate": "long",
           "truncated": "long", "illegal": "long", "first": "string", "last": "string", "costs": "array<long>", "ranks": "array<long>"}


def _folded(stream):
    """Per chunk the entry and exit state of its conversation's cheapest edits, with the counts and cost so far on each row;
    the last row of a conversation has its totals and the inserts behind all rows (``tail``)."""
    for (conv,), chunks in _groups(stream, 1):
        strings, came = Prefixes(), {}
        cells: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        p = Programme(strings)
        for *_, costs, ranks in chunks:
            offers: list[list] = [[], [], [], []]
            for entry, cell in enumerate(cells):
                for leave in range(4):
                    if cell and costs[4 * entry + leave] >= 0:
                        offers[leave].append((cell[0] + costs[4 * entry + leave], cell[1], ranks[4 * entry + leave], entry))
            cells = [None] * 4
            for leave, offer in enumerate(offers):
                best = p._best(offer)
                if best:
                    node = strings.push(best[1], best[2])
                    came[node], cells[leave] = (best[3], leave), (best[0], node)
        ends = [(cells[s][0] + len(tail) * INSERT_COST, cells[s][1], tail) for s, tail in (
            (START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II"), (START, "II")) if cells[s]]
        cost, node, tail = min(ends, key=cmp_to_key(
            lambda x, y: x[0] - y[0] or (-1 if x[1] != y[1] and strings.less(x[1], 0, y[1], 0) else 1)))
        path = []
        while node:
            path.append(came[node])
            node = strings.up[node][0]
        last, illegal = None, 0
        for k, ((chunk, n, low, high, turns, blank, dup, cut, bad, head, back, *_), (entry, leave)) in enumerate(zip(chunks, path[::-1])):
            if n:
                illegal += bad + (last is not None and last + head not in ("su", "ua", "au"))
                last = back
            end = k == len(chunks) - 1
            yield conv, chunk, entry, leave, tail if end else "", low, high, turns, blank, dup, cut, illegal if end else None, \
                cost if end else None


PATH = {"chunk": "long", "entry": "long", "leave": "long", "tail": "string", "low": "long", "high": "long", "turns": "long",
        "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long"}


def _applied(stream):
    """Per chunk its part of the audit and of the repaired text."""
    for (conv, chunk), rows in _groups(stream, 2):
        entry, leave, tail = rows[0][5:8]
        rows = _here(rows)
        c = Chunk(rows, [r[4] for r in rows])
        strings = Prefixes()
        cell = c.solve(strings, entry).cells[leave]
        audit = "".join(map(chr, strings.spelled(cell[1]))) + tail
        yield conv, chunk, audit, "\n".join(f"{r}:{t}" for r, t in repaired(rows, audit, entry)), \
            sum(a != DELETE for a in audit)


def _joined(stream):
    """Audit and digest of a conversation from its chunks in order: one running hash, no text is held."""
    for conv, parts in groupby(stream, lambda r: r[0]):
        sha, some, audit = hashlib.sha256(), False, []
        for _, _, piece, text, messages in parts:
            audit.append(piece)
            if messages:
                sha.update((("\n" if some else "") + text).encode("utf-8", "surrogatepass"))
                some = True
        yield conv, "".join(audit), sha.hexdigest()


def _long(rows: DataFrame, conv: str, order: list[Column]) -> DataFrame:
    """Conversations of several chunks, chunk by chunk."""
    # a row was seen earlier if an earlier chunk has its role and text; inside a chunk the chunk looks for itself
    rows = rows.withColumn("__same", F.sha2(F.to_json(F.struct("role", "text")), 256))
    firsts = (rows.where("here").groupBy(F.col("conv_id").alias("__c"), F.col("__same").alias("__s"))
              .agg(F.min("chunk").alias("__first"), F.max("chunk").alias("__last")).where("__first < __last"))
    firsts = saved(firsts, "firsts")
    rows = rows.join(firsts, rows["conv_id"].eqNullSafe(F.col("__c")) & (F.col("__same") == F.col("__s")), "left").withColumn(
        "seen", F.coalesce(F.col("chunk") > F.col("__first"), F.lit(False)))
    cols = ["conv_id", "chunk", "turn", "role", "text", "here", "seen"]
    parts = _streamed(rows.select(*cols), ["conv_id", "chunk"], order, _summaries, SUMMARY, conv)
    path = saved(_streamed(parts, ["conv_id"], [F.col("chunk")], _folded, PATH, conv), "paths")
    totals = path.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
    way = path.select(F.col("conv_id").alias("__p"), F.col("chunk").alias("__k"), "entry", "leave", "tail")
    chosen = rows.join(way, rows["conv_id"].eqNullSafe(F.col("__p")) & (rows["chunk"] == F.col("__k"))).select(*cols, "entry", "leave", "tail")
    pieces = _streamed(chosen, ["conv_id", "chunk"], order, _applied,
                       {"chunk": "long", "audit": "string", "lines": "string", "messages": "long"}, conv)
    whole = _streamed(pieces, ["conv_id"], [F.col("chunk")], _joined, {"audit": "string", "repaired_sha256": "string"}, conv)
    whole = whole.withColumnRenamed("conv_id", "__w")
    return totals.join(whole, F.col("conv_id").eqNullSafe(F.col("__w"))).select("conv_id", *RESULT)


def audited(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, optionally ``here`` and ``copy``): gaps, counts of faults,
    least cost, audit and the digest of the repaired conversation.

    Rows with ``here`` false only name their conversation. Null role or text reads as one space (a blank text must be
    deleted); rows without a turn come first; null conv_id is a conversation of its own. Ties of turn go by role, then text.
    Repeated rows are rows (all but the first are duplicates). A conversation without rows has zeros, an empty audit and the
    digest of the empty string; an empty table gives no rows; other columns are ignored."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    extra = {c: F.col(c) if c in rows.columns else F.lit(v) for c, v in (("here", True), ("copy", 0))}
    part = F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.expr(f"turn div {chunk}"))
    rows = rows.select("conv_id", part.cast("long").alias("chunk"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       extra["here"].alias("here"), extra["copy"].alias("copy"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    slim = rows.select("conv_id", "chunk", "turn", "role", "text", "here")
    one = saved(_streamed(slim, ["conv_id", "chunk"], order, _whole, {"chunk": "long", **RESULT}, conv), "chunks")
    many = saved(one.groupBy(F.col("conv_id").alias("__m")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("__m"), "long")
    if many.isEmpty():
        return one.select("conv_id", *RESULT)
    short = one.join(many, F.col("conv_id").eqNullSafe(F.col("__m")), "left_anti").select("conv_id", *RESULT)
    several = rows.join(many, F.col("conv_id").eqNullSafe(F.col("__m")), "left_semi")
    return short.unionByName(_long(several, conv, order))


def damaged(convs: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults that crc32 of ``conv_id:turn`` mod 20 calls for: 0 the row goes (``here``
    false), 1 no text, 2 no ``.!?``, 3 the row twice, 4 role user. Nulls read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    d = convs.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                     (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("__h"))
    h = F.col("__h")
    return d.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (h != 0).alias("here"), F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(damaged(table(spark, sf_dir, "conversations")))


def _oracle() -> str:
    """The same in SQL: a recursive walk over the rows that carries cost, audit and text of the four states as values."""
    def ins(s: str, role: str) -> str:
        return (f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {INSERT_COST}, 'a': {s}.a || 'I', "
                f"'t': list_append({s}.t, '{role}:')}} END")

    def dele(s: str) -> str:
        return f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {DELETE_COST}, 'a': {s}.a || 'D', 't': {s}.t}} END"

    def keep(s: str, initial: str) -> str:
        return (f"CASE WHEN {s} IS NOT NULL AND fault NOT IN ('b', 'd') AND initial = '{initial}' THEN {{'c': {s}.c + extra, "
                f"'a': {s}.a || 'K', 't': list_append({s}.t, role || ':' || text)}} END")

    def rerole(s: str, role: str) -> str:
        return (f"CASE WHEN {s} IS NOT NULL AND fault NOT IN ('b', 'd') THEN {{'c': {s}.c + {REROLE_COST} + extra, "
                f"'a': {s}.a || 'R', 't': list_append({s}.t, '{role}:' || text)}} END")

    def gap(source: str) -> str:
        return (f"SELECT * REPLACE (least(s3, {ins('s2', 'assistant')}) AS s3) FROM (SELECT * REPLACE (least(s2, "
                f"{ins('s0', 'user')}, {ins('s1', 'user')}, {ins('s3', 'user')}) AS s2) FROM ({source}))")

    cell = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    byte = "lambda y, i: xor(y >> 1, 3988292384 * (y & 1))"
    crc = (f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: "
           f"CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), {byte})))")
    walk = gap("SELECT w.conv_id, w.s0, w.s1, w.s2, w.s3, f.* EXCLUDE (conv_id) FROM walk w JOIN faults f "
               "ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1")
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT *, {crc} % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         left(role, 1) AS initial FROM damaged),
faults AS MATERIALIZED (
  SELECT conv_id, turn, pos, role, text, initial, fault, CASE WHEN fault = 't' THEN {CUT_COST} ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair
  FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN again > 1 THEN 'd'
                       WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 't' ELSE '' END AS fault FROM placed)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
         max(pos) AS n FROM faults GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, CAST({{'c': 0, 'a': '', 't': []}} AS {cell}) AS s0,
         CAST(NULL AS {cell}) AS s1, CAST(NULL AS {cell}) AS s2, CAST(NULL AS {cell}) AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, pos, {dele('s0')}, least({dele('s1')}, {keep('s0', 's')}),
         least({dele('s2')}, {keep('s0', 'u')}, {keep('s1', 'u')}, {keep('s3', 'u')}, {rerole('s0', 'user')},
               {rerole('s1', 'user')}, {rerole('s3', 'user')}),
         least({dele('s3')}, {keep('s2', 'a')}, {rerole('s2', 'assistant')}) FROM ({walk})),
done AS ({gap("SELECT w.* FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.pos = coalesce(c.n, 0)")}),
best AS (SELECT conv_id, least(s0, s3) AS s FROM done)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c AS cost, s.a AS audit,
       sha256(array_to_string(s.t, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()

"""Stock ledger: movement legs (L1-L6), bulk stock import (L7), warehouse retirement (L8) and the batch
application of movements with the original acceptance rules (L9).

L9 contract: events are judged in the total order (event_time, event_id); each is accepted or rejected
against the balances left by the *accepted* ones. A rejected event consumes nothing. Rows that share an id are events of their
own: each gets a position when the batch is materialised, and ties of time and id go by a hash of the content.

Plan. Every event touches keys of one (item, size) only: stock keys (warehouse) and holding keys (holding id;
a return takes item and size from its holding). So (item, size) groups are independent; a group without
transfers and returns splits further into independent stock keys. Such an independent piece is a *fold unit*.

1. Fast tier (pure SQL). Events become signed legs (debit before credit). Running balances per key are built
   chunk-parallel: per (key, hour) totals (partial aggregation), hour offsets by a window over the small per-hour
   table, running sums inside each (key, hour). A unit whose balances never go below zero and that holds no
   reset (set / drop) has every event accepted.
2. Slow tier. For the remaining units, everything before the first negative balance or reset is still
   accepted (at that point every earlier event was accepted), so only the tail from that *cut* is replayed: in the
   partitions in which the fast tier left them, rows are sorted by unit (Spark sorts and spills) and walked by one
   ``mapInPandas``, which holds the balances of the unit it is at and nothing else. The first leg of a key brings its balance at
   the cut; events that the fast tier decided go by as they are, so that no decision is joined to its event.
3. Hot units. A unit with more than ``HOT_EVENTS`` legs is cut at hours. Each (key, hour) is summed up to its total and the
   balance it needs at entry. A walk over these summaries with a lower bound of every balance finds the hours that are
   accepted whole whatever happened before; only the events of the other hours are replayed, and for a sure hour
   the replay adds its totals and notes the balances at its entry.
4. Results (stock, holdings, movements, audit, rejections) are derived set-wise from the per-event decisions.
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipledger.functions.scalars import (HOLDING_ACTIVE, HOLDING_RETURNED, IMPORT_STOCK_DOC_PREFIX,
                                           IMPORT_STOCK_NOTE, ADJUST_DEFAULT_NOTE, js_parse_int, js_trim,
                                           stable_id)
from equipledger.operators.changes import audit_rows
from equipledger.plans.joins import left_labels
from equipledger.schemas import conform
from equipledger.session import materialized

# The slow tier ships ``_fold`` to the Python workers. Its module is pickled by value, so the workers need not
# have this package installed (installing it on the cluster, or --py-files, works as well).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECEIPT, TRANSFER, ISSUE, RETURN, SET, DROP = "receipt", "transfer", "issue", "return", "set", "drop"
MOVEMENT_KINDS = (RECEIPT, TRANSFER, ISSUE, RETURN)
STOCK, HOLDING = "stock", "holding"

# ``stock_changes`` and ``holding_changes`` hold the touched keys only (a stock row that went has ``gone``); ``accepted`` are the events
# that movements and audit rows are made from.
LedgerResult = namedtuple("LedgerResult", "decisions stock holdings movements audit stock_changes holding_changes accepted")
# Internal result of the decision plan: all judged events with their columns, the static rejects, final stock key
# states, and the plans of the two tiers (the fast tier is pure SQL; the slow tier is the Python fold).
Decided = namedtuple("Decided", "judged rejects finals fast slow")

# The fold returns events with their decisions (rec 'f': by the fast tier, 'd': by the fold), the final states of stock keys (rec
# 's'; for a key that no replay touched also beside an 'f') and the balances at the entry of the hours that it took whole (rec 'e').
FAST, FOLDED, STATE, ENTRY = "f", "d", "s", "e"
WHOLE_NUMBERS = {"event_us": "Int64", "chunk": "Int64", "quantity": "Int32", "available": "Int32", "balance": "Int32"}
DECISION = ["event_id", "accepted", "reason", "available"]
HOT_EVENTS = 100_000
ITEM = ["siz_item_id", "size_value"]
UNIT = [*ITEM, "sub"]
POS = ["event_time", "event_id", "tie", "pos"]      # order of the events, unique by pos
ORDER = [*POS, "leg_order"]
OPENING, WHOLE, EVENT, PASSED = range(4)      # parts of a fold's input


# ---------------------------------------------------------------- static checks (F13) and legs

def static_reason() -> Column:
    """F13 for movement events: required fields per kind; quantity >= 1 for movements (the original accepted
    any truthy quantity for transfer / issue / return; we reject < 1 as receipts do), >= 0 for set. NULL when
    the event passes."""
    k = F.col("kind")
    res = F.lit("unknown_kind")
    for name in (DROP, SET, RETURN, ISSUE, TRANSFER, RECEIPT):
        res = F.when(k == name, F.when(_bad(name), F.lit("invalid"))).otherwise(res)
    return res


def _bad(kind: str) -> Column:
    q = F.col("quantity")
    miss = lambda *cs: [F.col(c).isNull() for c in cs]
    conds = {
        RECEIPT: miss("warehouse_id", "siz_item_id") + [q.isNull(), q < 1],
        TRANSFER: miss("warehouse_id", "to_warehouse_id", "siz_item_id") + [q.isNull(), q < 1],
        ISSUE: miss("warehouse_id", "employee_id", "siz_item_id") + [q.isNull(), q < 1],
        RETURN: miss("warehouse_id", "holding_id") + [q.isNull(), q < 1],
        SET: miss("warehouse_id", "siz_item_id") + [q.isNull(), q < 0],
        DROP: miss("warehouse_id", "siz_item_id"),
    }[kind]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(True))


def prepare_events(events: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(valid events with item / size resolved, statically rejected decisions, whether returns were resolved).

    Sizes default to '' (``size_value || ''``). A return takes item and size from its holding: a stored one,
    or one created by an issue of the same batch (holding id = issue event id). The checked events are
    materialised once, so the source is read once; the return lookup (a join) runs only when the batch holds a
    return, which a LIMIT-1 probe of the materialised events tells. Event ids are taken as given: rows that share one are
    judged one by one, told apart by ``pos``; ``tie`` orders them if their times are equal, too.
    """
    ev = conform(events, "movement_events").withColumn("size_value", F.coalesce("size_value", F.lit("")))
    ev = materialized(ev.withColumns({"__static": static_reason(), "pos": F.monotonically_increasing_id()}), "ledger-events")
    bad = ev.where(F.col("__static").isNotNull()).select(
        "event_id", F.lit(False).alias("accepted"), F.col("__static").alias("reason"),
        F.lit(None).cast("int").alias("available"))
    ev = ev.where(F.col("__static").isNull()).drop("__static")
    if ev.where(F.col("kind") == RETURN).limit(1).count() == 0:
        return ev.withColumn("tie", _tie()), bad, False

    rets = ev.where(F.col("kind") == RETURN)
    others = ev.where(F.col("kind") != RETURN)
    known = (holdings.select(F.col("id").alias("holding_id"), F.col("siz_item_id").alias("__h_item"),
                             F.coalesce("size_value", F.lit("")).alias("__h_size"),
                             F.col("employee_id").alias("__h_emp"))
             .unionByName(others.where(F.col("kind") == ISSUE).select(
                 F.col("event_id").alias("holding_id"), F.col("siz_item_id").alias("__h_item"),
                 F.col("size_value").alias("__h_size"), F.col("employee_id").alias("__h_emp"))))
    # written once: rejects and legs read it, and the legs of all events stay a cheap explode over what is written
    r = materialized(rets.join(known, "holding_id", "left"), "ledger-returns")
    no_holding = r.where(F.col("__h_item").isNull()).select(
        "event_id", F.lit(False).alias("accepted"), F.lit("no_holding").alias("reason"),
        F.lit(None).cast("int").alias("available"))
    r = (r.where(F.col("__h_item").isNotNull()).withColumn("tie", _tie())
          .withColumn("siz_item_id", F.col("__h_item")).withColumn("size_value", F.col("__h_size"))
          .withColumn("employee_id", F.col("__h_emp")).drop("__h_item", "__h_size", "__h_emp"))
    return others.withColumn("tie", _tie()).unionByName(r), bad.unionByName(no_holding), True


def _tie() -> Column:
    """Order of events with equal time and id: a hash of the request."""
    return F.xxhash64("kind", "warehouse_id", "to_warehouse_id", "siz_item_id", "size_value", "holding_id", "employee_id", "quantity")


def legs(ev: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """L1-L6 as signed legs: one row per (event, key). Debit legs get leg_order 0, credits 1; resets (set /
    drop) are legs with ``reset`` = the new balance. ``keep`` columns of the event are carried along."""
    base = ["event_id", "event_time", "kind", "siz_item_id", "size_value", *keep]
    x = ev.select(*base, F.explode(_legs_of()).alias("l"))
    return x.select(*base, "l.*")


def _legs_of() -> Column:
    """The array of an event's legs."""
    k, q = F.col("kind"), F.col("quantity")

    def leg(ktype, key, delta, order, reset=None):
        return F.struct(F.lit(ktype).alias("key_type"), key.alias("key"), delta.cast("int").alias("delta"),
                        F.lit(order).alias("leg_order"), (reset if reset is not None else F.lit(None)).cast("int")
                        .alias("reset"))

    return (F.when(k == RECEIPT, F.array(leg(STOCK, F.col("warehouse_id"), q, 1)))
             .when(k == TRANSFER, F.array(leg(STOCK, F.col("warehouse_id"), -q, 0),
                                          leg(STOCK, F.col("to_warehouse_id"), q, 1)))
             .when(k == ISSUE, F.array(leg(STOCK, F.col("warehouse_id"), -q, 0),
                                       leg(HOLDING, F.col("event_id"), q, 1)))
             .when(k == RETURN, F.array(leg(HOLDING, F.col("holding_id"), -q, 0),
                                        leg(STOCK, F.col("warehouse_id"), q, 1)))
             .when(k == SET, F.array(leg(STOCK, F.col("warehouse_id"), F.lit(0), 0, q)))
             .when(k == DROP, F.array(leg(STOCK, F.col("warehouse_id"), F.lit(0), 0, F.lit(0)))))


# ---------------------------------------------------------------- L9

def _openings(stock: DataFrame, holdings: DataFrame, lg: DataFrame | None, all_stock: bool = True) -> DataFrame:
    """Opening balance and existence of the stock keys (``all_stock``; else of those the legs touch) and, given legs, of the
    holdings they debit (missing stock row = 0, not existing; a holding stored as 'returned' opens at 0)."""
    s = stock.select("warehouse_id", "siz_item_id", F.coalesce("size_value", F.lit("")).alias("size_value"),
                     "quantity")
    if not all_stock:
        skeys = lg.where(F.col("key_type") == STOCK).select(
            F.col("key").alias("warehouse_id"), "siz_item_id", "size_value").distinct()
        s = s.join(skeys, ["warehouse_id", "siz_item_id", "size_value"], "left_semi")
    s = s.groupBy("warehouse_id", "siz_item_id", "size_value").agg(F.sum("quantity").cast("int").alias("balance"))
    so = s.select("siz_item_id", "size_value", F.lit(STOCK).alias("key_type"), F.col("warehouse_id").alias("key"),
                  "balance", F.lit(True).alias("exists"))
    if lg is None:
        return so
    hkeys = lg.where((F.col("key_type") == HOLDING) & (F.col("delta") < 0)).select(F.col("key").alias("id")).distinct()
    h = holdings.join(hkeys, "id", "left_semi")
    ho = h.select(F.col("siz_item_id"), F.coalesce("size_value", F.lit("")).alias("size_value"),
                  F.lit(HOLDING).alias("key_type"), F.col("id").alias("key"),
                  F.when(F.col("status") == HOLDING_ACTIVE, F.col("quantity")).otherwise(F.lit(0)).cast("int")
                  .alias("balance"), F.lit(True).alias("exists"))
    return so.unionByName(ho)


def _links() -> Column:
    """Does the leg link stock keys of its (item, size) group (a transfer or return)? Unlinked groups fold per stock key
    (sub = warehouse), linked ones as a whole (sub = '*')."""
    return F.col("kind").isin(TRANSFER, RETURN)


def _judge(bal: dict, exists: dict, linked: bool, eid, kind, wh, to, hid, q: int) -> tuple:
    """One event against the balances of its unit, which it changes if accepted: (accepted, reason, available)."""
    src = (STOCK, wh)
    if kind == RECEIPT:
        bal[src] = bal.get(src, 0) + q
        exists[src] = True
        return True, None, None
    if kind in (TRANSFER, ISSUE):
        avail = bal.get(src, 0)
        if avail < q:
            return False, "insufficient_stock", avail
        bal[src] = avail - q
        into = (STOCK, to) if kind == TRANSFER else (HOLDING, eid)
        if kind == TRANSFER or linked:      # a unit without returns never looks at its holdings
            bal[into] = bal.get(into, 0) + q
            exists[into] = True
        return True, None, avail
    if kind == RETURN:
        held = (HOLDING, hid)
        avail = bal.get(held, 0)
        if avail < q or avail <= 0:
            return False, "insufficient_holding" if exists.get(held) else "no_holding", avail
        bal[held] = avail - q
        bal[src] = bal.get(src, 0) + q
        exists[src] = True
        return True, None, avail
    avail = bal.get(src, 0)
    if not exists.get(src, False):
        return False, "no_stock_row", avail
    bal[src] = q if kind == SET else 0
    exists[src] = kind == SET
    return True, None, avail


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replay the tails of fold units: rows come sorted by unit and in order; a row that brings a key's balance at the cut comes
    before the key is looked at, an hour is either the totals of a sure one or the events of another. Rows that are not looked
    at go by as they are. Only the balances of the current unit are held."""
    unit, bal, exists = None, {}, {}

    def frame(found):     # whole numbers beside nulls must not pass through floats
        return pd.DataFrame({n: pd.array([r.get(n) for r in found], dtype=WHOLE_NUMBERS.get(n, "object")) for n in names})

    def states():
        return [{"rec": STATE, **dict(zip(UNIT, unit)), "key_type": kt, "key": k, "balance": bal[kt, k], "exists": bool(exists.get((kt, k), False))}
                for kt, k in bal if kt == STOCK]

    names = []
    for df in batches:
        names = [c for c in df.columns if c != "part"]
        looked = (df["part"] != PASSED).to_numpy()
        cols = [df.loc[looked, c].astype(object) for c in (*UNIT, "part", "chunk", "key_type", "key", "balance", "exists", "event_id", "kind",
                                                           "warehouse_id", "to_warehouse_id", "holding_id", "quantity")]
        rec, decided, more = df.loc[looked, "rec"].tolist(), [], []
        given = zip(*(df.loc[looked, c].tolist() for c in ("accepted", "available")))      # those that the fast tier decided
        for i, (item, size, sub, part, chunk, kt, k, at, there, eid, kind, wh, to, hid, q) in enumerate(zip(*(c.where(c.notna(), None) for c in cols))):
            accepted, available = next(given)
            if (item, size, sub) != unit:
                more += states()
                unit, bal, exists = (item, size, sub), {}, {}
            k = kt, k
            if part == WHOLE:
                more.append({"rec": ENTRY, **dict(zip(UNIT, unit)), "chunk": chunk, "key_type": kt, "key": k[1], "balance": bal.get(k, 0),
                             "exists": exists.get(k, False)})
                bal[k], exists[k] = bal.get(k, 0) + int(at), exists.get(k, False) or bool(there)
            elif at is not None:
                bal[k], exists[k] = int(at), bool(there)
            if part == EVENT:
                rec[i] = FOLDED
                decided.append(_judge(bal, exists, sub == "*", eid, kind, wh, to, hid, int(q or 0)))
            else:
                decided.append((accepted, None, None if pd.isna(available) else available))
        out = pd.DataFrame({n: df[n].astype(WHOLE_NUMBERS[n]) if n in WHOLE_NUMBERS else df[n].astype(object) for n in names})
        if decided:
            for n, values in zip(("accepted", "reason", "available"), zip(*decided)):
                out.loc[looked, n] = pd.array(values, dtype=WHOLE_NUMBERS.get(n, "object"))
            out.loc[looked, "rec"] = pd.array(rec, dtype="object")
            out.loc[looked, "balance"] = None
        yield out[out["rec"].notna()]
        yield frame(more)
    if unit is not None:
        yield frame(states())


SURE_SCHEMA = "siz_item_id string, size_value string, sub string, chunk long"


def _sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hours of hot units in which every event is accepted whatever the hours before decided.

    Rows come sorted by unit and hour, the balances at the cut first. ``low`` bounds the balance of a key from below: a sure
    hour adds its totals; after any other one the certain legs (all debits, and receipts) count, and a balance that was
    refused a debit has stayed at or above the floor, so it ends at no less than what came in after its lowest point."""
    names = [f.split()[0] for f in SURE_SCHEMA.split(", ")]
    unit, hour, low, floor, rows, out = None, None, {}, {}, [], []

    def close():
        sure = all(not r[3] and low.get(r[0], 0) >= r[2] for r in rows)
        for key, total, need, _, certain, dip in rows:
            now = low.get(key, 0)
            low[key] = now + total if sure else max(floor.get(key, 0), certain + max(now, dip + floor.get(key, 0)))
        for r in rows:
            if r[3]:
                low[r[0]] = min(floor.get(r[0], 0), 0)
        if sure and rows:
            out.append((*unit, hour))

    for df in batches:
        for item, size, sub, part, chunk, kt, k, total, need, reset, certain, dip in zip(
                df["siz_item_id"], df["size_value"], df["sub"], df["part"], df["chunk"], df["key_type"], df["key"], df["total"],
                df["need"], df["reset"], df["certain"], df["dip"]):
            if (item, size, sub) != unit or chunk != hour:
                close()
                rows = []
                if (item, size, sub) != unit:
                    unit, low, floor = (item, size, sub), {}, {}
                hour = chunk
            if part == OPENING:
                low[kt, k], floor[kt, k] = int(total), min(0, int(total))
            else:
                rows.append(((kt, k), int(total), int(need), bool(reset), int(certain), int(dip)))
        yield pd.DataFrame(out, columns=names).astype({"chunk": "int64"})
        out.clear()
    close()
    yield pd.DataFrame(out, columns=names).astype({"chunk": "int64"})


def _by_unit(rows: DataFrame, *order) -> DataFrame:
    # dealt by a hash of the unit: a plain repartition by its columns may be dropped as already given by a union,
    # whose two sides AQE can still change
    return rows.repartition(F.xxhash64(*UNIT)).sortWithinPartitions(*UNIT, *order)


def sure_hours(state: DataFrame, sums: DataFrame) -> DataFrame:
    """Hours (unit, chunk) of hot units that are accepted whole: ``state`` at the cut, ``sums`` per (unit, hour, key)."""
    rows = state.select(*UNIT, F.lit(OPENING).alias("part"), F.lit(-(1 << 62)).alias("chunk"), "key_type", "key",
                        F.col("balance").cast("long").alias("total"),
                        *[F.lit(0).cast("long").alias(c) for c in ("need", "certain", "dip")], F.lit(False).alias("reset"))
    rows = rows.unionByName(sums.select(*UNIT, F.lit(WHOLE).alias("part"), "chunk", "key_type", "key", "total", "need", "certain",
                                        "dip", "reset"))
    return _by_unit(rows, "chunk").mapInPandas(_sure, SURE_SCHEMA)


def _folded(rows: DataFrame) -> DataFrame:
    """The fold over rows that lie by unit and in order: their columns but ``part``. Missing columns are added as nulls."""
    more = {"rec": "string", "chunk": "long", "accepted": "boolean", "reason": "string", "available": "int"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in rows.columns})
    rows = rows.withColumn("event_us", F.unix_micros("event_time")).drop("event_time", "tie", "pos", "leg_order")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name != "part"])
    return rows.mapInPandas(_fold, schema).withColumn("event_time", F.timestamp_micros("event_us")).drop("event_us")


def replay_tails(state: DataFrame, tail: DataFrame, whole: DataFrame) -> DataFrame:
    """Slow tier of hot items: ``state`` (unit, key_type, key, balance, exists at the cut), ``tail`` (unit, chunk and events from the
    cut on) and ``whole`` (sums of the sure hours of hot units) -> what the fold returns. One sort per unit, done and spilled by
    Spark."""
    key = [*UNIT, "key_type", "key"]
    rows = state.select(*key, F.lit(OPENING).alias("part"), F.lit(-(1 << 62)).alias("chunk"), "balance", "exists")
    rows = rows.unionByName(whole.select(*key, F.lit(WHOLE).alias("part"), "chunk", F.col("total").cast("int").alias("balance"),
                                         F.col("credit").alias("exists")))
    rows = rows.unionByName(tail.withColumn("part", F.lit(EVENT)), allowMissingColumns=True)
    return _folded(_by_unit(rows, "chunk", "part", *POS))


def replay_cold(lb: DataFrame, event: list[str]) -> DataFrame:
    """Slow tier of the other items, in the partitions in which ``lb`` lies: per unit the events in order. The first leg of a key of
    a cut unit brings the key's balance at the cut, credits before debits, so that it is there when the event is judged; in
    a unit that is not cut the last leg of a stock key brings its final balance."""
    lead, ahead = _is_lead(), F.col("ahead")
    opens = F.col("is_cut") & F.col("is_first")
    ends = ~F.col("is_cut") & F.col("is_last") & (F.col("key_type") == STOCK)
    rows = lb.where(lead | opens | ends).select(
        *event, "sub", "tie", "pos", "leg_order", "key_type", "key",
        F.when(lead & ~ahead, EVENT).when(opens, OPENING).otherwise(PASSED).alias("part"),
        F.when(lead & ahead, FAST).when(ends, STATE).alias("rec"),
        F.when(opens, F.col("state")).when(ends, F.col("bal_after")).cast("int").alias("balance"),
        F.when(opens, F.col("there")).when(ends, True).alias("exists"), F.when(lead & ahead, True).alias("accepted"),
        F.when(lead & ahead, _had(F.col("bal_after"))).alias("available"))
    return _folded(rows.sortWithinPartitions(*UNIT, *POS, F.desc("leg_order")))


# Event columns that judging needs, and those that only the written results need.
JUDGED = ("warehouse_id", "to_warehouse_id", "holding_id", "quantity")
WRITTEN = ("employee_id", "document_reference", "notes", "actor_id")


def _is_lead() -> Column:
    """The lead leg of an event: its debit (or reset) leg, or the single leg of a receipt."""
    return (F.col("leg_order") == 0) | (F.col("kind") == RECEIPT)


def _had(after: Column) -> Column:
    """``available`` of an event whose lead leg leaves the balance ``after``. A receipt has no debit leg, so it reports none."""
    return F.when(F.col("leg_order") == 0, after - F.col("delta")).cast("int")


def decide(stock: DataFrame, holdings: DataFrame, events: DataFrame, hot_events: int = HOT_EVENTS) -> DataFrame:
    """L9 decisions: one row per event (event_id, accepted, reason, available = balance of the debited key just
    before the event; for set / drop the old quantity)."""
    d = _decide(stock, holdings, events, hot_events=hot_events)
    return d.judged.select(*DECISION).unionByName(d.rejects)


def _decide(stock: DataFrame, holdings: DataFrame, events: DataFrame, carry: tuple[str, ...] = (),
            hot_events: int = HOT_EVENTS, written: bool = False) -> Decided:
    """Judged events (with their columns and those of ``carry``), static rejects, final stock key states and the two
    tiers. The prepared events (valid, returns resolved to their holding's item, size and employee) are written
    once: every later step reads them instead of the source plan. The events that are judged, their balances and decisions take
    one shuffle and no file; ``written`` writes them at the end, for callers that read judged events or states several times."""
    ev, static_rejects, resolved = prepare_events(events, holdings)
    carry = tuple(dict.fromkeys(["employee_id", *carry]))       # ``tie`` needs it
    event = ["event_id", "event_time", "kind", "siz_item_id", "size_value", *JUDGED, *carry]
    # The legs carry the event's columns, so that no later step joins the events again; they are an explode over written rows.
    lg = legs(ev, keep=("tie", "pos", *JUDGED, *carry)).where(F.col("key").isNotNull())
    if not resolved:       # no return looks at a holding
        lg = lg.where(F.col("key_type") == STOCK)
    hot_items = _hot_items(lg, hot_events)
    some_hot = not hot_items.isEmpty()
    cold, cold_lg = (x.join(hot_items, ITEM, "left_anti") if some_hot else x for x in (ev, lg))
    opening = materialized(_openings(stock, holdings, cold_lg if resolved else None), "ledger-openings")
    lb = _cold_balances(cold.select(*event, "tie", "pos"), opening, resolved)
    done = [F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")]
    fast = lb.where(F.col("ahead") & _is_lead()).select(*event, *done, _had(F.col("bal_after")).alias("available"))
    replay = replay_cold(lb, event)
    out = materialized(replay, "ledger-judged") if written else replay
    judged = out.where(F.col("rec").isin(FAST, FOLDED)).select(*event, *DECISION[1:])
    finals = out.where(F.col("balance").isNotNull()).select(*ITEM, "key", "balance", "exists")
    if not some_hot:
        return Decided(judged, static_rejects, finals, fast, replay)
    hot_lg = lg.join(hot_items, ITEM, "left_semi").withColumn("chunk", F.expr("unix_seconds(event_time) div 3600"))
    h = _decide_hot(hot_lg, _openings(stock, holdings, hot_lg, all_stock=False), event, hot_events)
    hot_judged = materialized(h.judged, "ledger-judged-hot") if written else h.judged
    return Decided(judged.unionByName(hot_judged), static_rejects, finals.unionByName(h.finals), fast.unionByName(h.fast), h.slow)


def _decide_hot(lg: DataFrame, opening: DataFrame, event: list[str], hot_events: int) -> Decided:
    """The same for the legs of items with many events."""
    lb, hot = _hot_balances(lg, opening, hot_events)
    # Read several times below: materialise once in the shared checkpoint folder (cuts the lineage; a lost
    # executor does not recompute the joins and windows).
    lb = materialized(lb, "ledger-balances")
    lead, ahead = _is_lead(), F.col("ahead")   # one lead leg per event: read it instead of grouping legs by event
    done = [F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")]
    fast = lb.where(ahead & lead).select(*event, *done, _had(F.col("bal_after")).alias("available"))

    # Slow tier: state at the cut = opening + legs before the cut, for every key of a cut unit.
    cut = lb.where("is_cut")
    state = cut.groupBy(*UNIT, "key_type", "key").agg(
        (F.first("open") + F.sum(F.when(ahead, F.col("delta")).otherwise(0))).cast("int")
        .alias("balance"),
        (F.first("open_exists") | (F.max(F.when(ahead & (F.col("delta") > 0), 1).otherwise(0)) == 1)).alias("exists"))
    tail, sums = cut.where(~ahead & lead), _hour_sums(cut.where(F.col("is_hot") & ~ahead))
    sure = materialized(sure_hours(state.join(hot, UNIT, "left_semi"), sums), "ledger-sure")
    sums = sums.join(sure, [*UNIT, "chunk"], "left_semi")
    calm, tail = tail.join(sure, [*UNIT, "chunk"], "left_semi"), tail.join(sure, [*UNIT, "chunk"], "left_anti")
    replay = replay_tails(state, tail.select(*event, "sub", "chunk", "tie", "pos"), sums)
    folded = materialized(replay, "ledger-fold")      # decisions and final states are read from the one written fold
    slow = folded.where(F.col("rec") == FOLDED).select(*event, *DECISION[1:])
    entry = folded.where(F.col("rec") == ENTRY).select(*UNIT, "chunk", "key_type", "key", F.col("balance").alias("__entry"))
    slow = slow.unionByName(calm.join(entry, [*UNIT, "chunk", "key_type", "key"]).select(
        *event, *done, _had(F.col("__entry") + F.col("run")).alias("available")))
    # Final balance of every touched stock key: the last leg's balance in units decided without replay (every
    # event accepted, no resets, so the key exists), the fold's end state elsewhere.
    skey = [*ITEM, "key"]
    finals = (lb.where(F.col("is_last") & ~F.col("is_cut") & (F.col("key_type") == STOCK))
                .select(*skey, F.col("bal_after").cast("int").alias("balance"), F.lit(True).alias("exists"))
                .unionByName(folded.where(F.col("rec") == STATE).select(*skey, "balance", "exists")))
    return Decided(fast.unionByName(slow), None, finals, fast, replay)


def _hot_items(lg: DataFrame, hot_events: int) -> DataFrame:
    """(item, size) groups of more than ``hot_events`` legs, at most all legs / ``hot_events``. Legs are counted by hash bucket
    first, and by group only in the buckets that can hold such a group."""
    bucket = F.pmod(F.xxhash64(*ITEM), F.lit(1 << 16)).cast("int").alias("__bucket")
    keyed = lg.select(*ITEM, bucket)
    many = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_events).drop("__n")
    full = materialized(many(keyed, ["__bucket"]), "ledger-buckets")
    return materialized(many(keyed.join(full, "__bucket", "left_semi"), ITEM), "ledger-hot")


def _cold_balances(rows: DataFrame, opening: DataFrame, held: bool = True) -> DataFrame:
    """Legs of items with few events, with their balances and what the cut makes of them: ``rows`` (events, or legs made before)
    and the openings of an item meet in one partition by the one shuffle, sorted once for all windows. The legs of events are
    made behind the shuffle, without those of holdings unless ``held``; so is ``tie`` but for returns, whose item was resolved."""
    own = opening.select(*ITEM, "key_type", "key", F.col("balance").alias("__opening"))
    if "key" in rows.columns:
        rows = rows.unionByName(own, allowMissingColumns=True).repartition(*ITEM)
    else:
        k, cols = F.col("kind"), rows.columns
        rows = rows.withColumn("tie", F.when(k == RETURN, F.col("tie"))).unionByName(own, allowMissingColumns=True).repartition(*ITEM)
        rows = rows.withColumn("tie", F.when(k == RETURN, F.col("tie")).otherwise(_tie()))
        none = F.lit(None).cast("int")
        it = F.array(F.struct("key_type", "key", none.alias("delta"), none.alias("leg_order"), none.alias("reset")))
        rows = rows.select(*cols, "__opening", F.explode(F.when(k.isNull(), it).otherwise(_legs_of())).alias("__l"))
        rows = rows.select(*cols, "__opening", "__l.*").where(F.col("key").isNotNull() | k.isNull())
        if not held:
            rows = rows.where(F.col("key_type") == STOCK)
    rows = rows.withColumn("__leg", F.col("delta").isNotNull())
    key = [*ITEM, "key_type", "key"]
    in_order = Window.partitionBy(*key).orderBy("__leg", *ORDER)        # openings come first
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "run": F.sum("delta").over(so_far), "open": F.coalesce(F.sum("__opening").over(so_far), F.lit(0)).cast("int"),
        "open_exists": F.count(F.when(~F.col("__leg"), 1)).over(so_far) > 0, "is_last": F.lead(F.lit(1)).over(in_order).isNull()})
    of_key, of_item = Window.partitionBy(*key), Window.partitionBy(*ITEM)
    rows = rows.withColumns({"__linked": F.max(_links()).over(of_item), "__debited": F.coalesce(F.min("delta").over(of_key) < 0, F.lit(False))})
    # a holding that no return debits is never looked at
    rows = rows.where((F.col("key_type") == STOCK) | F.col("__debited"))
    # events without a time count in the balances of those with one, as the first ones, and are not judged
    rows = rows.where(F.col("__leg") & F.col("event_time").isNotNull()).withColumn("bal_after", F.col("open") + F.col("run"))
    bad, pos = (F.col("bal_after") < 0) | F.col("reset").isNotNull(), F.struct(*POS)
    rows = rows.withColumn("__key_cut", F.min(F.when(bad, pos)).over(of_key))
    rows = rows.withColumn("__item_cut", F.min("__key_cut").over(of_item))
    # an unlinked unit is one stock key; its holdings are never looked at
    rows = rows.where(F.col("__linked") | (F.col("key_type") == STOCK)).withColumns({
        "sub": F.when(F.col("__linked"), F.lit("*")).otherwise(F.col("warehouse_id")),
        "__cut": F.when(F.col("__linked"), F.col("__item_cut")).otherwise(F.col("__key_cut"))})
    ahead = F.col("ahead")
    rows = rows.withColumns({"is_cut": F.col("__cut").isNotNull(), "ahead": F.col("__cut").isNull() | (pos < F.col("__cut"))})
    # the key's balance at the cut: opening + legs before the cut
    rows = rows.withColumns({
        "is_first": F.lag(F.lit(1)).over(in_order).isNull(),
        "state": F.col("open") + F.sum(F.when(ahead, F.col("delta")).otherwise(0)).over(of_key),
        "there": F.col("open_exists") | (F.max(F.when(ahead & (F.col("delta") > 0), 1).otherwise(0)).over(of_key) == 1)})
    return rows.drop("__opening", "__leg", "__key_cut", "__item_cut", "__linked", "__debited", "__cut")


def _hot_balances(lg: DataFrame, opening: DataFrame, hot_events: int) -> tuple[DataFrame, DataFrame]:
    """The same for items with many events, chunk-parallel (a hot key is split by hour), and the units that are hot: per
    (key, hour) totals, their running offsets (plus the opening balance) over the small per-hour table, then running sums
    inside each (key, hour)."""
    key = [*ITEM, "key_type", "key"]
    chunk_tot = lg.groupBy(*key, "chunk").agg(F.sum("delta").alias("__tot")).join(
        opening.select(*key, F.col("balance").alias("open"), F.col("exists").alias("open_exists")), key, "left")
    w_chunks = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_off = chunk_tot.select(
        *key, "chunk", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("open_exists", F.lit(False)).alias("open_exists"),
        (F.coalesce("open", F.lit(0)) + F.coalesce(F.sum("__tot").over(w_chunks), F.lit(0))).alias("__off"))
    in_hour = Window.partitionBy(*key, "chunk").orderBy(*ORDER)
    lb = (lg.join(chunk_off, [*key, "chunk"]).withColumns({
        "run": F.sum("delta").over(in_hour.rowsBetween(Window.unboundedPreceding, 0)), "__end": F.lead(F.lit(1)).over(in_hour).isNull()})
            .withColumn("bal_after", F.col("__off") + F.col("run")).drop("__off"))
    linked = lg.groupBy(*ITEM).agg(F.max(_links()).alias("__linked"))
    lb = lb.join(linked, ITEM).withColumn("sub", F.when(F.col("__linked"), F.lit("*")).otherwise(F.col("warehouse_id")))
    lb = materialized(lb.where(F.col("__linked") | (F.col("key_type") == STOCK)).drop("__linked"), "ledger-hot-balances")
    # Cut per fold unit: first event with a negative balance after its leg, or first reset. Units with very many legs, a bounded
    # number of them (all legs / hot_events): cut at the start of an hour.
    pos = F.struct(*POS)
    cuts = (lb.where((F.col("bal_after") < 0) | F.col("reset").isNotNull())
              .groupBy(*UNIT).agg(F.min(pos).alias("__cut"), F.min("chunk").alias("__cut_chunk")))
    hot = materialized(lb.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_events).drop("__n"), "ledger-hot-units")
    last = lb.groupBy(*key).agg(F.max("chunk").alias("__last"))
    lb = lb.join(cuts.join(hot.withColumn("__hot", F.lit(True)), UNIT, "left"), UNIT, "left").join(last, key)
    lb = lb.withColumns({"is_hot": F.coalesce("__hot", F.lit(False)), "is_cut": F.col("__cut").isNotNull(),
                         "is_last": F.col("__end") & (F.col("chunk") == F.col("__last"))})
    lb = lb.withColumn("ahead", ~F.col("is_cut") | F.when(F.col("is_hot"), F.col("chunk") < F.col("__cut_chunk")).otherwise(pos < F.col("__cut")))
    return lb.drop("__cut", "__cut_chunk", "__hot", "__last", "__end"), hot


def _hour_sums(rows: DataFrame) -> DataFrame:
    """Per (unit, hour, key) of the legs ``rows``: total, the balance ``need``ed at entry for all legs to pass, the ``certain``
    total (debits and receipts; a transfer or return may be refused and bring nothing) with its ``dip`` (how far it falls
    below its start), whether a reset or a credit is among them. Keys that judging never looks at are left out."""
    key = [*UNIT, "chunk", "key_type", "key"]
    w = Window.partitionBy(*key).orderBy("event_time", "event_id", "tie", "pos", "leg_order").rowsBetween(Window.unboundedPreceding, 0)
    certain = F.when((F.col("delta") < 0) | (F.col("kind") == RECEIPT), F.col("delta")).otherwise(0)
    rows = rows.where((F.col("key_type") == STOCK) | (F.col("sub") == "*")).withColumn("__sure", certain)
    rows = rows.withColumn("__low", F.sum("__sure").over(w))
    depth = lambda c: F.greatest(-F.min(c), F.lit(0)).cast("long")
    return rows.groupBy(*key).agg(
        F.sum("delta").cast("long").alias("total"), depth("run").alias("need"), F.sum("__sure").cast("long").alias("certain"),
        depth("__low").alias("dip"), F.max(F.col("reset").isNotNull()).alias("reset"), F.max(F.col("delta") > 0).alias("credit"))


def apply_movements(stock: DataFrame, holdings: DataFrame, events: DataFrame, items: DataFrame,
                    materialize: bool = True) -> LedgerResult:
    """(new stock snapshot, new holdings, accepted movements, audit rows, decisions) for a batch.

    ``materialize`` writes the judged events (to the shared ``spark.checkpoint.dir``) because four outputs
    read them; it also cuts the lineage, so a lost executor does not re-run the whole decision plan.
    """
    d = _decide(stock, holdings, events, WRITTEN, written=materialize)
    judged = d.judged
    acc = judged.where("accepted").drop("accepted", "reason")
    back = acc.where(F.col("kind") == RETURN).select(F.col("holding_id").alias("id"))
    touched = new_holdings(holdings.join(back, "id", "left_semi"), acc, items)
    return LedgerResult(judged.select(*DECISION).unionByName(d.rejects), stock_from_finals(stock, d.finals),
                        new_holdings(holdings, acc, items), movements(acc), ledger_audit(acc), changed_stock(stock, d.finals), touched, acc)


def changed_stock(stock: DataFrame, finals: DataFrame) -> DataFrame:
    """The stock rows that a batch changed, made or dropped (``gone``)."""
    k = ["warehouse_id", "siz_item_id", "size_value"]
    f = finals.select(F.col("key").alias("warehouse_id"), "siz_item_id", "size_value", "balance", "exists")
    s = stock.select("id", "warehouse_id", "siz_item_id", F.coalesce("size_value", F.lit("")).alias("size_value"), "quantity")
    j = f.join(s, k, "left").where(F.when(F.col("exists"), F.col("id").isNull() | (F.col("quantity") != F.col("balance")))
                                   .otherwise(F.col("id").isNotNull()))
    return j.select(F.coalesce("id", stable_id(*k)).alias("id"), *k, F.col("balance").alias("quantity"), (~F.col("exists")).alias("gone"))


def stock_from_finals(stock: DataFrame, finals: DataFrame) -> DataFrame:
    """New stock snapshot: touched keys take their final balance (a key that ends dropped disappears),
    untouched rows pass through; a full outer join on the stock key."""
    k = ["warehouse_id", "siz_item_id", "size_value"]
    f = finals.select(F.col("key").alias("warehouse_id"), "siz_item_id", "size_value", "balance", "exists")
    s = stock.select("id", "warehouse_id", "siz_item_id", F.coalesce("size_value", F.lit("")).alias("size_value"),
                     "quantity")
    j = s.join(f, k, "full")
    return (j.where(F.coalesce(F.col("exists"), F.lit(True)))
             .select(F.coalesce("id", stable_id(*k)).alias("id"), *k,
                     F.coalesce("balance", "quantity").cast("int").alias("quantity")))


def new_stock(stock: DataFrame, acc: DataFrame) -> DataFrame:
    """Stock after the given accepted events, derived from the events alone: last reset (or the stored
    balance) plus the legs after it; rows that end dropped disappear; untouched keys pass through. An
    independent derivation of what ``stock_from_finals`` reads off the decision plan (used to cross-check it,
    and to apply an already-decided event log to another snapshot)."""
    lg = legs(acc).where(F.col("key_type") == STOCK).select(
        F.col("key").alias("warehouse_id"), "siz_item_id", "size_value", "event_time", "event_id", "leg_order",
        "delta", "reset", "kind")
    k = ["warehouse_id", "siz_item_id", "size_value"]
    pos = F.struct("event_time", "event_id", "leg_order")
    last_reset = lg.where(F.col("reset").isNotNull()).groupBy(*k).agg(
        F.max(F.struct(pos.alias("p"), F.col("reset").alias("r"), F.col("kind").alias("k"))).alias("__lr"))
    j = lg.join(last_reset, k, "left")
    after = F.col("__lr").isNull() | (pos > F.col("__lr.p"))
    agg = j.groupBy(*k).agg(
        F.sum(F.when(after, F.col("delta")).otherwise(0)).alias("__d"),
        F.max(F.when(after & (F.col("delta") > 0), 1).otherwise(0)).alias("__credit_after"),
        F.first("__lr", ignorenulls=True).alias("__lr"))
    s = stock.withColumn("size_value", F.coalesce("size_value", F.lit("")))
    j2 = s.join(agg, k, "full")
    base = F.when(F.col("__lr").isNotNull(), F.col("__lr.r")).otherwise(F.coalesce("quantity", F.lit(0)))
    dropped = (F.col("__lr.k") == DROP) & (F.col("__credit_after") == 0)
    out = (j2.where(~F.coalesce(dropped, F.lit(False)))
             .select(F.coalesce("id", stable_id(*k)).alias("id"), *k,
                     (base + F.coalesce("__d", F.lit(0))).cast("int").alias("quantity")))
    return out


def new_holdings(holdings: DataFrame, acc: DataFrame, items: DataFrame) -> DataFrame:
    """Holdings after the accepted events: new holdings from issues (id = event id; exploitation starts on the
    issue date only when the item has exploitation_years); returns lower the quantity; the closing return sets
    status 'returned', returned_date, and keeps its own quantity as the stored one."""
    # issues and returns in one pass over the events: a return lies with its holding and is summed up there
    issue, d = F.col("kind") == ISSUE, F.to_date("event_time")
    batch = acc.where(issue | ((F.col("kind") == RETURN) & F.col("holding_id").isNotNull())).select(
        F.when(issue, F.col("event_id")).otherwise(F.col("holding_id")).alias("id"), "employee_id", "siz_item_id", "size_value", "quantity",
        d.alias("issued_date"), F.lit(None).cast("date").alias("exploitation_start"),
        F.lit(None).cast("int").alias("exploitation_paused_days"), F.lit(HOLDING_ACTIVE).alias("status"),
        F.lit(None).cast("date").alias("returned_date"), F.col("warehouse_id").alias("from_warehouse_id"),
        F.col("event_time").alias("created_at"), F.when(issue, F.col("siz_item_id")).alias("__new"),
        F.when(~issue, F.struct("event_time", "event_id", "quantity")).alias("__return"))
    rows = conform(holdings, "employee_siz").unionByName(batch, allowMissingColumns=True)
    of_holding = Window.partitionBy("id")
    rows = rows.withColumns({"__ret": F.sum("__return.quantity").over(of_holding), "__last": F.max("__return").over(of_holding)})
    j = left_labels(rows.where(F.col("__return").isNull()), items, "__new", cols={"exploitation_years": "__years"})
    j = j.withColumn("exploitation_start", F.when(F.col("__new").isNull(), F.col("exploitation_start")).when(
        F.col("__years").isNotNull(), F.col("issued_date")))
    remaining = F.col("quantity") - F.coalesce("__ret", F.lit(0))
    closed = F.col("__ret").isNotNull() & (remaining == 0)
    return j.select(
        "id", "employee_id", "siz_item_id", "size_value",
        F.when(closed, F.col("__last.quantity")).otherwise(remaining).cast("int").alias("quantity"),
        "issued_date", "exploitation_start", "exploitation_paused_days",
        F.when(closed, F.lit(HOLDING_RETURNED)).otherwise(F.col("status")).alias("status"),
        F.when(closed, F.to_date("__last.event_time")).otherwise(F.col("returned_date")).alias("returned_date"),
        "from_warehouse_id", "created_at")


def movements(acc: DataFrame) -> DataFrame:
    """Movement ledger rows of the accepted receipts, transfers, issues and returns (resets leave none)."""
    m = acc.where(F.col("kind").isin(*MOVEMENT_KINDS))
    k = F.col("kind")
    return conform(m.select(
        F.col("event_id").alias("id"), k.alias("movement_type"), "siz_item_id", "size_value", "quantity",
        F.when(k.isin(TRANSFER, ISSUE), F.col("warehouse_id")).alias("from_warehouse_id"),
        F.when(k == TRANSFER, F.col("to_warehouse_id")).when(k.isin(RECEIPT, RETURN), F.col("warehouse_id"))
         .alias("to_warehouse_id"),
        F.when(k.isin(ISSUE, RETURN), F.col("employee_id")).alias("employee_id"),
        "document_reference", "notes", F.col("actor_id").alias("moved_by"),
        F.to_date("event_time").alias("movement_date"), F.col("event_time").alias("created_at")), "stock_movements")


def ledger_audit(acc: DataFrame) -> DataFrame:
    """Audit rows: 'create' per movement (the request as JSON); 'update' per adjustment with old / new
    quantity and notes; 'delete' per dropped stock row with its last state."""
    k = F.col("kind")
    body = F.to_json(F.struct("warehouse_id", "to_warehouse_id", "siz_item_id", "size_value", "employee_id",
                              "holding_id", "quantity", "document_reference", "notes"))
    adjust = F.to_json(F.struct(F.col("available").alias("old_quantity"), F.col("quantity").alias("new_quantity"),
                                F.coalesce("notes", F.lit(ADJUST_DEFAULT_NOTE)).alias("notes")))
    deleted = F.to_json(F.struct(F.struct("warehouse_id", "siz_item_id", "size_value",
                                          F.col("available").alias("quantity")).alias("deleted_entry")))
    table = F.when(k.isin(*MOVEMENT_KINDS), "stock_movements").otherwise("warehouse_stock")
    record = F.when(k.isin(*MOVEMENT_KINDS), F.col("event_id")).otherwise(
        stable_id("warehouse_id", "siz_item_id", "size_value"))
    return conform(acc.select(
        stable_id(F.lit("audit"), "event_id").alias("id"), F.col("actor_id").alias("user_id"),
        table.alias("table_name"), record.alias("record_id"),
        F.when(k == SET, "update").when(k == DROP, "delete").otherwise("create").alias("action"),
        F.when(k == SET, adjust).when(k == DROP, deleted).otherwise(body).alias("changes"),
        F.col("event_time").alias("created_at")), "audit_log")


# ---------------------------------------------------------------- L7, L8

def import_stock(rows: DataFrame, items: DataFrame, warehouse_id: str, actor_id: str | None = None,
                 document_reference: str | None = None, today=None, warehouses: DataFrame | None = None,
                 batch: str | None = None) -> dict[str, DataFrame]:
    """Bulk receipt of stock rows into one (active) warehouse.

    Per row: no item id, or parseInt(quantity) NaN / <= 0 -> 'skipped'; item missing or inactive, or a quantity
    that the column cannot hold -> 'error';
    else a receipt of the trimmed size (repeated keys add up). Returns ``rows`` (with outcome), ``deltas``
    (per key, for M5), ``movements``, ``summary`` (A4) and ``audit`` (one bulk row). Given ``warehouses``, a
    warehouse that is missing there or inactive refuses every row ('no_warehouse', no audit). ``batch`` names the
    request: ids of two imports of the same list differ by it."""
    here = (F.lit(True) if warehouses is None else warehouses.where(
        (F.col("id") == warehouse_id) & F.col("is_active")).select(F.count(F.lit(1))).scalar() > 0)
    today_c = F.current_date() if today is None else F.lit(today).cast("date")
    r = conform(rows, "import_stock")
    r = r.withColumn("__asked", js_parse_int("quantity", "decimal(38,0)"))
    r = r.withColumn("qty", F.col("__asked").try_cast("int")).withColumn("sv", js_trim(F.coalesce(F.col("size_value").cast("string"), F.lit(""))))
    act = items.where(F.col("is_active")).select(F.col("id").alias("__item"))
    r = r.join(act, r["siz_item_id"] == act["__item"], "left")
    outcome = (F.when(~here, "no_warehouse").when(F.col("siz_item_id").isNull() | (F.col("siz_item_id") == "") | F.col("__asked").isNull()
                      | (F.col("__asked") <= 0), "skipped")
                .when(F.col("__item").isNull() | F.col("qty").isNull(), "error").otherwise("imported"))
    r = r.withColumn("outcome", outcome).drop("__item", "__asked")
    ok = r.where(F.col("outcome") == "imported")
    doc = (F.lit(document_reference.strip()) if document_reference and document_reference.strip()
           else F.concat(F.lit(IMPORT_STOCK_DOC_PREFIX), F.date_format(today_c, "dd.MM.yyyy")))
    deltas = ok.groupBy(F.lit(warehouse_id).alias("warehouse_id"), "siz_item_id",
                        F.col("sv").alias("size_value")).agg(F.sum("qty").cast("int").alias("quantity"))
    # One movement per imported row. Identical rows are indistinguishable, so they are counted (partial
    # aggregation, skew-safe) and re-expanded with an occurrence number: ids stay deterministic on retry.
    same = ok.groupBy("siz_item_id", "sv", "qty").agg(F.count(F.lit(1)).alias("__n"))
    same = same.select("*", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__occ"))
    mv = conform(same.select(
        stable_id(F.lit(warehouse_id), "siz_item_id", "sv", "qty", doc, today_c, "__occ",
                  *([F.lit(batch)] if batch is not None else []))
        .alias("id"), F.lit(RECEIPT).alias("movement_type"), "siz_item_id", F.col("sv").alias("size_value"),
        F.col("qty").alias("quantity"), F.lit(warehouse_id).alias("to_warehouse_id"),
        doc.alias("document_reference"), F.lit(IMPORT_STOCK_NOTE).alias("notes"),
        F.lit(actor_id).cast("string").alias("moved_by"), today_c.alias("movement_date")), "stock_movements")
    summary = r.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))
    of = lambda o: F.count_if(F.col("outcome") == o)
    counts = r.agg(of("imported").alias("count"), of("skipped").alias("skipped"), of("error").alias("errors"))
    audit = audit_rows(counts.where(here), "warehouse_stock", "bulk_import", None, F.to_json(
        F.struct(F.lit(warehouse_id).alias("warehouse_id"), "count", "skipped", "errors")),
        F.lit(actor_id), salt=F.lit(batch))
    return {"rows": r, "deltas": deltas, "movements": mv, "summary": summary, "audit": audit}


def retire_warehouses(warehouses: DataFrame, stock: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Soft-delete the requested warehouses unless their stock sums to > 0 (a negative sum passes).
    Returns ``warehouses`` (new snapshot), ``refused`` (id, total), ``missing`` (unknown ids) and ``audit`` (a
    'delete' row per retired warehouse)."""
    req = ids.select(F.col("id").alias("id")).distinct()
    totals = stock.join(req.select(F.col("id").alias("warehouse_id")), "warehouse_id", "left_semi") \
        .groupBy(F.col("warehouse_id").alias("id")).agg(F.sum("quantity").cast("bigint").alias("total"))
    chk = req.join(totals, "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    refused = chk.where(F.col("total") > 0)
    go = chk.where(F.col("total") <= 0).select("id", F.lit(True).alias("__retire"))
    missing = req.join(warehouses.select("id"), "id", "left_anti")
    w = warehouses.join(go, "id", "left")
    w = w.withColumn("is_active", F.when(F.col("__retire").isNotNull(), F.lit(False)).otherwise(F.col("is_active")))
    audit = audit_rows(go.join(missing, "id", "left_anti"), "warehouses", "delete", "id", F.lit("{}"), salt="id")
    return {"warehouses": w.drop("__retire"), "refused": refused, "missing": missing, "audit": audit}

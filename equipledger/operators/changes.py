"""Table changes as batch operators (M1-M10) and change audit.

Each operator takes the current snapshot and a table of requests (one request per row) and returns the new
snapshot plus audit rows. Nothing is updated in place: the caller writes the new snapshot as a new version
(``sources.tables.write_snapshot``).
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipledger.operators.blocks import BLOCK_ROWS, blocks, last_before
from equipledger.functions.scalars import ADJUST_DEFAULT_NOTE, js_or, json_merge, stable_id
from equipledger.schemas import SCHEMAS, conform

Change = namedtuple("Change", "table audit rejected")

AUDIT_COLS = ["id", "user_id", "table_name", "record_id", "action", "changes", "ip_address", "created_at"]


def audit_rows(df: DataFrame, table: str, action: str, record: Column | str | None, changes: Column,
               user: Column | str | None = None, ip: Column | str | None = None, ts: Column | None = None,
               salt: Column | str | None = None) -> DataFrame:
    """audit_log rows (user, table, record -- NULL for bulk --, action, changes JSON, ip, time).
    The audit id is derived from (table, action, record, salt) so a replayed batch writes the same ids."""
    col = lambda v: (F.col(v) if isinstance(v, str) else v) if v is not None else F.lit(None)
    rec = col(record).cast("string")
    out = df.select(
        stable_id(F.lit(table), F.lit(action), rec, col(salt)).alias("id"), col(user).cast("string").alias("user_id"),
        F.lit(table).alias("table_name"), rec.alias("record_id"), F.lit(action).alias("action"),
        changes.alias("changes"), col(ip).cast("string").alias("ip_address"),
        (ts if ts is not None else F.current_timestamp()).alias("created_at"))
    return conform(out, "audit_log")


def _json_of(df: DataFrame, cols: list[str]) -> Column:
    """The request row as a JSON object (NULL members kept, as a JSON body carries them)."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- M1, M3, M4

def insert_rows(cur: DataFrame, rows: DataFrame, table: str, request_id: str = "request_id",
                actor: str | None = "actor_id") -> Change:
    """M1: insert; ``extra`` defaults to '{}'; ids derived from the request id (replayable); audit 'create'
    with the full payload."""
    payload = [c for c in rows.columns if c not in (request_id, actor)]
    r = rows.withColumn("id", stable_id(F.lit(table), F.col(request_id)))
    if "extra" in SCHEMAS[table].fieldNames():
        r = r.withColumn("extra", F.coalesce(F.col("extra") if "extra" in rows.columns else F.lit(None), F.lit("{}")))
    if "is_active" in SCHEMAS[table].fieldNames():
        r = r.withColumn("is_active", F.coalesce(F.col("is_active") if "is_active" in rows.columns else F.lit(None),
                                                 F.lit(True)))
    new = conform(r, table)
    audit = audit_rows(r, table, "create", "id", _json_of(rows, payload), actor, salt=request_id)
    return Change(cur.unionByName(new, allowMissingColumns=True), audit, None)


def soft_delete(cur: DataFrame, ids: DataFrame, table: str, actor: str | None = "actor_id", request_id: str = "request_id") -> Change:
    """M3: is_active = false for the requested ids; audit 'delete' with {}; unknown ids change nothing and are
    returned as ``rejected`` (the 404 of norms and warehouses)."""
    salt = [F.col(request_id) if request_id in ids.columns else F.lit(None)]
    req = ids.select(F.col("id").alias("__id"), salt[0].alias("__salt"), *([F.col(actor).alias("__actor")] if actor else []))
    if request_id not in ids.columns:      # requests that nothing tells apart are one
        req = req.distinct()
    hit = cur.select("id").join(req, cur["id"] == req["__id"])
    new = cur.join(req.select("__id").distinct(), cur["id"] == F.col("__id"), "left") \
        .withColumn("is_active", F.when(F.col("__id").isNotNull(), F.lit(False)).otherwise(F.col("is_active"))) \
        .drop("__id")
    audit = audit_rows(hit, table, "delete", "id", F.lit("{}"), "__actor" if actor else None, salt="__salt")
    rejected = req.join(cur.select(F.col("id").alias("__id")), "__id", "left_anti") \
        .select(F.col("__id").alias("id"), F.lit("not_found").alias("reason"))
    return Change(new, audit, rejected)


def hard_delete(cur: DataFrame, ids: DataFrame, table: str, actor: str | None = "actor_id") -> Change:
    """M4: rows removed; audit 'delete' holding the deleted row ({deleted_entry: row}). A request that names a
    warehouse removes the row only there; elsewhere it is 'not_found'."""
    req = ids.select(F.col("id").alias("__id"), *([F.col(actor).alias("__actor")] if actor else []),
                     *([F.col("warehouse_id").alias("__wh")] if "warehouse_id" in ids.columns else []))
    if "__wh" in req.columns and "warehouse_id" in cur.columns:
        there = cur.select(F.col("id").alias("__id"), F.col("warehouse_id").alias("__at"))
        named = req.join(there, "__id", "left")
        fits = F.coalesce(F.col("__wh").isNull() | (F.col("__wh") == F.col("__at")), F.lit(False))
        lost = named.where(F.col("__at").isNotNull() & ~fits).select("__id")
        req = named.where(F.col("__at").isNull() | fits).drop("__wh", "__at")
    else:
        lost = req.select("__id").limit(0)
    gone = cur.join(req, cur["id"] == req["__id"])
    entry = F.to_json(F.struct(F.struct(*[F.col(c) for c in cur.columns]).alias("deleted_entry")),
                      {"ignoreNullFields": "false"})
    audit = audit_rows(gone, table, "delete", "id", entry, "__actor" if actor else None, salt="id")
    new = cur.join(req.select("__id"), cur["id"] == F.col("__id"), "left_anti")
    rejected = req.join(cur.select(F.col("id").alias("__id")), "__id", "left_anti").select("__id").unionByName(lost) \
        .select(F.col("__id").alias("id"), F.lit("not_found").alias("reason"))
    return Change(new, audit, rejected)


# ---------------------------------------------------------------- M2 + D1

def _canonical(doc: Column) -> Column:
    """JSON text in one spelling: members sorted, no white space; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(doc)), doc)


def diff_changes(old: dict[str, Column], new: dict[str, Column], supplied: Column, extra_patch: Column | None = None
                 ) -> Column:
    """``{field: {old, new}}`` for every *supplied* field whose value differs (NULL-safe). ``extra`` compares
    the whole old object with the patch (member order and white space do not count) and records the patch as new."""
    parts = []
    for name in new:
        changed = F.array_contains(supplied, name) & ~(old[name].cast("string").eqNullSafe(new[name].cast("string")))
        obj = F.to_json(F.struct(old[name].alias("old"), new[name].alias("new")), {"ignoreNullFields": "false"})
        parts.append(F.when(changed, F.concat(F.lit(F"\"{name}\":"), obj)))
    if extra_patch is not None:
        before = F.coalesce(old["extra"], F.lit("null"))
        changed = extra_patch.isNotNull() & ~_canonical(before).eqNullSafe(_canonical(extra_patch))
        obj = F.concat(F.lit('{"old":'), before, F.lit(',"new":'), extra_patch, F.lit("}"))
        parts.append(F.when(changed, F.concat(F.lit('"extra":'), obj)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _member_map(pairs: Column) -> Column:
    """``array<struct<key, value>>`` (value: JSON text) as a JSON object, members in key order."""
    m = F.map_from_entries(F.sort_array(pairs))
    return F.to_json(F.transform_values(m, lambda _, v: F.parse_json(v)))


def _extra_states(ok: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the accepted patches ``(id, __req, __p_extra, __merge)``: what all of them together set, per id, and what the
    requests before each one set, per (id, request). Members are handled one by one, so the requests of a hot id
    are spread over its members; an array only ever holds the members of one object."""
    cut = ["__block"] if "__block" in ok.columns else []
    m = ok.where(F.col("__merge")).select("id", "__req", F.explode(F.from_json("__p_extra", "map<string,variant>")))
    m = m.select("id", "__req", "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))
    entry = F.struct("key", "value")
    total = (m.groupBy("id", "key").agg(F.max_by("value", "__req").alias("value"))
              .groupBy("id").agg(_member_map(F.collect_list(entry)).alias("__all")))
    reqs = ok.where(F.col("__p_extra").isNotNull()).select("id", "__req", *cut)
    grid = (reqs.join(m.select("id", "key").distinct(), "id").join(m, ["id", "__req", "key"], "left"))
    before = last_before(grid.withColumnRenamed("value", "__now"), ["id", "key"], "__req", {"value": F.col("__now")})
    before = (before.where(F.col("value").isNotNull()).groupBy("id", "__req")
                    .agg(_member_map(F.collect_list(entry)).alias("__before")))
    return total, before


def patch_rows(cur: DataFrame, patches: DataFrame, table: str, fields_col: str = "set_fields",
               actor: str | None = "actor_id", request_id: str = "request_id", updated_at: Column | None = None,
               block_rows: int = BLOCK_ROWS) -> Change:
    """M2: only the supplied fields change (``set_fields`` lists them: NULL is a legal new value, so presence
    needs its own flag); ``extra`` is merged (C8) when the patch is a non-empty object. All patches of an id apply,
    in the order of ``request_id`` (which is unique): the new row takes each field from the last patch that supplies
    it, and each audit row 'update' holds D1 against the state that the patches before it left. Unknown id ->
    rejected 'not_found'; nothing supplied -> 'no_data'. Empty inputs give empty results. ``request_id`` is a number; an id with
    more than ``block_rows`` patches is cut into blocks of requests. ``updated_at`` stamps the patched rows (M10)."""
    cols = [c for c in cur.columns if c not in ("id", "extra") and c in patches.columns]
    has_extra = "extra" in cur.columns and "extra" in patches.columns
    given = F.col("extra") if has_extra else F.lit(None).cast("string")
    empty_array = F.array().cast("array<string>")
    p = patches.select(
        "id", F.col(request_id).alias("__req"), (F.col(actor) if actor else F.lit(None)).alias("__actor"),
        F.filter(F.coalesce(F.col(fields_col), empty_array), lambda f: f.isin(*cols)).alias("__supplied"),
        given.alias("__p_extra"), F.coalesce(F.trim(given) != "{}", F.lit(False)).alias("__merge"),
        *[F.col(c).cast(cur.schema[c].dataType).alias("__p_" + c) for c in cols])
    stored = cur.select("id", F.lit(True).alias("__found"), *[F.col(c).alias("__c_" + c) for c in cols],
                        (F.col("extra") if "extra" in cur.columns else F.lit(None).cast("string")).alias("__c_extra"))
    j = p.join(stored, "id", "left")
    reason = F.when(F.col("__found").isNull(), "not_found").when(
        (F.size("__supplied") == 0) & ~F.col("__merge"), "no_data")
    rejected = j.where(reason.isNotNull()).select("id", F.col("__req").alias(request_id), reason.alias("reason"))
    ok = j.where(reason.isNull())

    sets = {c: F.array_contains("__supplied", c) for c in cols}
    last = ok.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), *[
        F.max_by(F.struct(F.col("__p_" + c).alias("v")), F.when(sets[c], F.col("__req"))).alias("__n_" + c)
        for c in cols])
    new = cur.join(last, "id", "left")
    values = {c: F.when(F.col("__n_" + c).isNotNull(), F.col(f"__n_{c}.v")).otherwise(F.col(c)) for c in cols}

    ok = blocks(ok, "id", "__req", block_rows)
    if cols:
        ok = last_before(ok, ["id"], "__req", {
            "__b_" + c: F.when(sets[c], F.struct(F.col("__p_" + c).alias("v"))) for c in cols})
    old = {c: F.when(F.col("__b_" + c).isNotNull(), F.col(f"__b_{c}.v")).otherwise(F.col("__c_" + c)) for c in cols}
    if has_extra:
        total, before = _extra_states(ok.select("id", "__req", *(c for c in ("__block",) if c in ok.columns), "__p_extra", "__merge"))
        new = new.join(total, "id", "left")
        values["extra"] = F.when(F.col("__all").isNotNull(), json_merge("extra", "__all")).otherwise(F.col("extra"))
        ok = ok.join(before, ["id", "__req"], "left")
        old["extra"] = F.when(F.col("__before").isNotNull(), json_merge("__c_extra", "__before")) \
            .otherwise(F.col("__c_extra"))
    d = diff_changes(old, {c: F.col("__p_" + c) for c in cols}, F.col("__supplied"),
                     F.col("__p_extra") if has_extra else None)
    audit = audit_rows(ok, table, "update", "id", d, "__actor", salt="__req")
    if updated_at is not None:
        new = touch_updated_at(new, F.col("__n").isNotNull(), updated_at)
    kept = cur.columns + (["updated_at"] if updated_at is not None and "updated_at" not in cur.columns else [])
    return Change(new.select(*[values.get(c, F.col(c)).alias(c) for c in kept]), audit, rejected)


# ---------------------------------------------------------------- keyed upserts M5-M8

def upsert_add(cur: DataFrame, deltas: DataFrame, keys: list[str], qty: str = "quantity") -> DataFrame:
    """M5: insert the key or add to its quantity. Order-free: union + group by key (partial aggregation, so a
    hot key is pre-summed map-side); the stored row's id survives, new keys get a key-derived id."""
    c = cur.select("id", *keys, qty)
    d = deltas.groupBy(*keys).agg(F.sum(qty).alias("__add"))
    j = c.join(d, keys, "full")
    return j.select(F.coalesce("id", stable_id(*keys)).alias("id"), *keys,
                    (F.coalesce(F.col(qty), F.lit(0)) + F.coalesce("__add", F.lit(0))).cast("int").alias(qty))


def upsert_replace(cur: DataFrame, rows: DataFrame, keys: list[str], order: str, set_cols: dict[str, Column],
                   reactivate: bool = True) -> DataFrame:
    """M6 / M8: insert, or on a key conflict overwrite ``set_cols`` (and re-activate). Within the batch the
    last request per key wins (ordered by ``order``); the stored row's id and other columns survive."""
    put = F.struct(*[v.alias("__n_" + k) for k, v in set_cols.items()])
    last = rows.groupBy(*keys).agg(F.max_by(put, F.col(order)).alias("__put"))
    last = last.select(*keys, F.lit(True).alias("__hit"), "__put.*")
    j = cur.join(last, keys, "full")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = []
    for c in cur.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in set_cols:
            out.append(F.when(hit, F.col("__n_" + c)).otherwise(F.col(c)).alias(c))
        elif c == "is_active" and reactivate:
            out.append(F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c))
        elif c == "id":
            out.append(F.coalesce(F.col("id"), stable_id(*keys)).alias("id"))
        else:
            out.append(F.col(c))
    return j.select(*out)


def upsert_norms(norms: DataFrame, requests: DataFrame, order: str = "request_id") -> DataFrame:
    """M6 for norms: quantity defaults to 1 and issue_period_months to 12 when falsy, extra to {}; a conflict on
    (position_id, siz_item_id) overwrites those and re-activates the norm. Writes no audit row."""
    sets = {"quantity": js_or("quantity", 1, numeric=True).cast("int"),
            "issue_period_months": js_or("issue_period_months", 12, numeric=True).cast("int"),
            "extra": F.coalesce(F.col("extra"), F.lit("{}"))}
    return upsert_replace(norms, requests, ["position_id", "siz_item_id"], order, sets)


def insert_absent(cur: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None,
                  only_into_empty: bool = False) -> DataFrame:
    """M7: ``ON CONFLICT DO NOTHING``: the first request per key (in ``order``; without one, the least row by its
    values, so that every run keeps the same one), then only keys not stored yet. ``order`` itself is not stored.
    Idempotent: applying the same rows twice changes nothing. ``only_into_empty``: nothing is inserted if the table has a
    row, whatever its key (a scalar subquery of the plan, not a job of its own)."""
    others = [c for c in rows.columns if c not in keys and c != order]
    first = F.min(F.struct(*([F.col(order).alias("__order")] if order else []), F.lit(0).alias("__tie"),
                           *[F.col(c) for c in others]))
    rows = rows.groupBy(*keys).agg(first.alias("__first")).select(*keys, *[F.col(f"__first.{c}") for c in others])
    new = rows.join(cur.select(*keys), keys, "left_anti")
    if only_into_empty:
        new = new.where(cur.limit(1).select(F.count(F.lit(1))).scalar() == 0)
    if "id" in cur.columns and "id" not in new.columns:
        new = new.withColumn("id", stable_id(*keys))
    return cur.unionByName(new, allowMissingColumns=True)


def set_quantity(stock: DataFrame, rows: DataFrame, actor: str | None = "actor_id", request_id: str = "request_id",
                 block_rows: int = BLOCK_ROWS) -> Change:
    """M9: absolute quantity (>= 0) of an existing stock row of that warehouse; audit old / new / notes; no
    movement row. Corrections of one row apply in the order of ``request_id``: the last one stays, and each audit
    row's old quantity is the one that the correction before it left. Rows without that column are ordered by
    their values. Missing row -> 'not_found'; negative or missing quantity -> 'invalid'."""
    order = F.col(request_id) if request_id in rows.columns else F.struct("quantity", "notes")
    r = rows.select(F.col("id").alias("__sid"), F.col("warehouse_id").alias("__wh"), F.col("quantity").alias("__q"),
                    F.col("notes").alias("__notes"), order.alias("__req"),
                    *([F.col(actor).alias("__actor")] if actor else []))
    j = r.join(stock, (stock["id"] == r["__sid"]) & (stock["warehouse_id"] == r["__wh"]), "left")
    reason = F.when(F.col("__q").isNull() | (F.col("__q") < 0), "invalid").when(F.col("id").isNull(), "not_found")
    j = j.withColumn("__reason", reason)
    ok = j.where(F.col("__reason").isNull()).select("id", "quantity", "__q", "__notes", "__req", *(["__actor"] if actor else []))
    # the leading number of the order cuts a hot row's corrections into blocks
    ok = blocks(ok.withColumn("__by", F.col("__req" if request_id in rows.columns else "__q").cast("double")), "id", "__by", block_rows)
    ok = last_before(ok, ["id"], "__req", {"__prior": F.col("__q")})
    before = F.coalesce("__prior", F.col("quantity"))
    changes = F.to_json(F.struct(F.col("__old").alias("old_quantity"), F.col("__q").alias("new_quantity"),
                                 F.coalesce(F.when(F.col("__notes") != "", F.col("__notes")),
                                            F.lit(ADJUST_DEFAULT_NOTE)).alias("notes")))
    audit = audit_rows(ok.withColumn("__old", before), "warehouse_stock", "update", "id", changes,
                       "__actor" if actor else None, salt=F.to_json(F.struct("__req", "__q")))
    last = ok.groupBy(F.col("id").alias("__u")).agg(F.max_by("__q", "__req").cast("int").alias("__newq"))
    new = stock.join(last, stock["id"] == last["__u"], "left").withColumn(
        "quantity", F.coalesce("__newq", "quantity")).drop("__u", "__newq")
    rejected = j.where(F.col("__reason").isNotNull()).select(F.col("__sid").alias("id"), F.col("__reason").alias("reason"))
    return Change(new, audit, rejected)


def touch_updated_at(df: DataFrame, changed: Column, ts: Column | None = None, col: str = "updated_at") -> DataFrame:
    """The BEFORE UPDATE trigger: ``updated_at`` = now on changed rows."""
    now = ts if ts is not None else F.current_timestamp()
    cur = F.col(col) if col in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn(col, F.when(changed, now).otherwise(cur))

"""Row scoping by role level (F4), actor context (F5) and request admission (G1)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipledger.functions.scalars import SOURCE_WAREHOUSE, json_truthy

# Role levels and the seed roles of the original back end.
LEVELS = ("ia", "enterprise", "spbipk", "res")
SEED_ROLES = [
    # name, display_name, level, description, general_permissions
    ("admin_ia", "Исполнительный аппарат", "ia", "Полный доступ ко всей системе",
     '{"can_create":true,"can_edit":true,"can_delete":true,"can_view_all":true,"can_manage_users":true}'),
    ("admin_enterprise", "Предприятие", "enterprise", "Просмотр данных предприятия (без редактирования)",
     '{"can_create":false,"can_edit":false,"can_delete":false,"can_view_all":false}'),
    ("admin_spbipk", "СПБиПК", "spbipk", "Управление персоналом, ТОН, перемещение СИЗ в пределах предприятия",
     '{"can_create":true,"can_edit":true,"can_delete":false,"can_view_all":false,"can_transfer":true}'),
    ("admin_res", "РЭС / Служба", "res", "Просмотр и управление СИЗ в пределах своего подразделения",
     '{"can_create":true,"can_edit":true,"can_delete":false,"can_view_all":false,"can_transfer":true}'),
]

# Scope rules: table -> level -> (row column, actor field). A level missing from a table's
# rules sees every row; 'ia' always sees everything.
_ENT = ("enterprise_id", "enterprise_id")
_RES = ("res_unit_id", "res_unit_id")
SCOPE_RULES: dict[str, dict[str, tuple[str, str]]] = {
    "enterprises": {"enterprise": ("id", "enterprise_id"), "spbipk": ("id", "enterprise_id"),
                    "res": ("id", "enterprise_id")},
    "spbipk": {"enterprise": _ENT, "spbipk": _ENT, "res": _ENT},
    "res_units": {"enterprise": _ENT, "spbipk": _ENT, "res": ("id", "res_unit_id")},
    "departments": {"res": _RES},
    "positions": {"enterprise": _ENT, "spbipk": _ENT, "res": _RES},
    "warehouses": {"enterprise": _ENT, "spbipk": _ENT, "res": _RES},
    "card_stats": {"enterprise": _ENT, "spbipk": _ENT, "res": _RES},
    "employees": {"enterprise": _ENT, "spbipk": _ENT, "res": _RES},
    "transactions": {"enterprise": ("employee_enterprise_id", "enterprise_id"),
                     "spbipk": ("employee_enterprise_id", "enterprise_id"),
                     "res": ("employee_res_unit_id", "res_unit_id")},
}


def _actor_value(actor: Mapping, field: str) -> Column:
    v = actor.get(field)
    return F.lit(v).cast("string") if v is not None else F.lit(None).cast("string")


def scope_predicate(table: str, actor: Mapping) -> Column | None:
    """F4 for one actor: the row predicate of ``table`` (``None`` = no filter). A NULL actor id compares
    as ``= NULL`` and so keeps no rows, as in SQL."""
    level = actor.get("role_level")
    if level == "ia":
        return None
    if table == "cards":
        if level in ("enterprise", "spbipk"):
            return F.col("enterprise_id") == _actor_value(actor, "enterprise_id")
        if level == "res":
            return ((F.col("res_unit_id") == _actor_value(actor, "res_unit_id"))
                    | ((F.col("source_type") == SOURCE_WAREHOUSE) & (F.col("warehouse_type") != "res")
                       & (F.col("enterprise_id") == _actor_value(actor, "enterprise_id"))))
        return None
    rule = SCOPE_RULES[table].get(level)
    if rule is None:
        return None
    col, field = rule
    return F.col(col) == _actor_value(actor, field)


def row_scope(df: DataFrame, table: str, actor: Mapping) -> DataFrame:
    """rows of ``table`` visible to ``actor`` (a mapping with role_level, enterprise_id, res_unit_id)."""
    p = scope_predicate(table, actor)
    return df if p is None else df.where(F.coalesce(p, F.lit(False)))


def scope_classes(actors: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """F4 for many actors: (``actor_id, scope_class``, ``scope_class, tag``). Actors that see the same rows share a class; a class
    sees the rows that carry one of its tags. An actor whose scope id is NULL is in no class (it sees nothing); a level that
    the table's rules leave out sees everything."""
    rules = {"enterprise": _ENT, "spbipk": _ENT, "res": _RES} if table == "cards" else SCOPE_RULES[table]
    tag = lambda kind, c: F.concat_ws(":", F.lit(kind), c)
    everyone = ~F.col("role_level").isin(*rules)
    tags = F.when(everyone, F.array(F.lit("*")))
    for level, (column, field) in rules.items():
        own = F.when(F.col(field).isNotNull(), tag(column, F.col(field)))
        more = [F.when(F.col("enterprise_id").isNotNull(), tag("central", F.col("enterprise_id")))] if (table, level) == ("cards", "res") else []
        tags = tags.when(F.col("role_level") == level, F.array_compact(F.array(own, *more)))
    a = actors.select(F.col("id").alias("actor_id"), tags.alias("tags")).where(F.size("tags") > 0)
    a = a.withColumn("scope_class", F.array_join("tags", "+"))
    return a.select("actor_id", "scope_class"), a.select("scope_class", "tags").distinct().select("scope_class", F.explode("tags").alias("tag"))


def visible_rows(df: DataFrame, table: str, classes: DataFrame) -> DataFrame:
    """Every row of ``df`` once for each class of ``classes`` (``scope_classes``) that sees it, with its ``scope_class``. A row has
    at most four tags and meets the classes by one equi-join; no actor x row pairs are formed."""
    rules = {"enterprise": _ENT, "res": _RES} if table == "cards" else SCOPE_RULES[table]
    kinds = {column for column, _ in rules.values()}
    tags = [F.lit("*")] + [F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(c), F.col(c))) for c in sorted(kinds)]
    if table == "cards":      # stock of a warehouse that is not a res unit's is seen by the res actors of its enterprise
        central = (F.col("source_type") == SOURCE_WAREHOUSE) & (F.col("warehouse_type") != "res") & F.col("enterprise_id").isNotNull()
        tags.append(F.when(central, F.concat_ws(":", F.lit("central"), F.col("enterprise_id"))))
    rows = df.withColumn("tag", F.explode(F.array_compact(F.array(*tags)))).join(classes, "tag")
    if table == "cards":      # seen as central stock only if not already as the own unit's
        own = F.concat_ws(":", F.lit("res_unit_id"), F.col("res_unit_id"))
        twice = F.col("tag").startswith("central:") & F.col("res_unit_id").isNotNull() & F.startswith(F.col("scope_class"), F.concat(own, F.lit("+")))
        rows = rows.where(~twice)
    return rows.drop("tag")


def tree_scope(t: Mapping[str, DataFrame], actor: Mapping | None) -> dict[str, DataFrame]:
    """Org-tree scoping: a NULL scope id means *no* filter here (unlike the other lists)."""
    ents, sps, units = t["enterprises"], t["spbipk"], t["res_units"]
    level = (actor or {}).get("role_level")
    ent_id, res_id = (actor or {}).get("enterprise_id"), (actor or {}).get("res_unit_id")
    if level in ("enterprise", "spbipk", "res") and ent_id:
        ents = ents.where(F.col("id") == ent_id)
        sps = sps.where(F.col("enterprise_id") == ent_id)
    if level in ("enterprise", "spbipk") and ent_id:
        units = units.where(F.col("enterprise_id") == ent_id)
    elif level == "res" and res_id:
        units = units.where(F.col("id") == res_id)
    return {"enterprises": ents, "spbipk": sps, "res_units": units}


def actor_context(users: DataFrame, roles: DataFrame) -> DataFrame:
    """active users INNER JOIN role -> role_level, general_permissions, scope ids."""
    r = roles.select(F.col("id").alias("__r"), F.col("name").alias("role_name"), F.col("level").alias("role_level"),
                     "general_permissions", "field_permissions", F.col("display_name").alias("role_display_name"))
    u = users.where(F.col("is_active"))
    return u.join(r, u["role_id"] == r["__r"]).drop("__r")


def seed_roles(spark) -> DataFrame:
    """The four seed roles (fixed values); id = name."""
    rows = [(n, n, d, lvl, desc, perms, "{}") for n, d, lvl, desc, perms in SEED_ROLES]
    return spark.createDataFrame(rows, "id string, name string, display_name string, level string, "
                                       "description string, general_permissions string, field_permissions string")


# Admission rules: operation -> (permission, levels or None for "any"). Fixed values.
ADMISSION_RULES: dict[str, tuple[str, tuple[str, ...] | None]] = {
    "organizations.create": ("can_create", ("ia",)), "organizations.edit": ("can_edit", ("ia",)),
    "enterprises.create": ("can_create", ("ia",)), "enterprises.edit": ("can_edit", ("ia",)),
    "spbipk.create": ("can_create", ("ia",)), "spbipk.edit": ("can_edit", ("ia", "spbipk")),
    "res_units.create": ("can_create", ("ia", "spbipk")), "res_units.edit": ("can_edit", ("ia", "spbipk")),
    "departments.create": ("can_create", ("ia", "spbipk", "res")), "departments.edit": ("can_edit", ("ia", "spbipk")),
    "categories.create": ("can_create", ("ia", "spbipk")), "categories.edit": ("can_edit", ("ia", "spbipk")),
    "categories.delete": ("can_edit", ("ia", "spbipk")),
    "items.create": ("can_create", ("ia", "spbipk")), "items.edit": ("can_edit", ("ia", "spbipk")),
    "items.delete": ("can_edit", ("ia", "spbipk")),
    "positions.create": ("can_create", ("ia", "spbipk")), "positions.edit": ("can_edit", ("ia", "spbipk")),
    "positions.delete": ("can_delete", None),
    "employees.create": ("can_create", ("ia", "spbipk")), "employees.edit": ("can_edit", ("ia", "spbipk")),
    "employees.delete": ("can_delete", None),
    "norms.upsert": ("can_create", ("ia", "spbipk")), "norms.delete": ("can_delete", ("ia", "spbipk")),
    "warehouses.create": ("can_create", None), "warehouses.retire": ("can_delete", None),
    "receipt": ("can_create", None), "transfer": ("can_create", None), "issue": ("can_create", None),
    "return": ("can_create", None),
    "stock.adjust": ("can_edit", ("ia",)), "stock.drop": ("can_delete", ("ia",)),
    "import.employees": ("can_create", ("ia", "spbipk")), "import.positions": ("can_create", ("ia", "spbipk")),
    "import.items": ("can_create", ("ia", "spbipk")), "import.stock": ("can_create", ("ia",)),
}


def admit_requests(requests: DataFrame, actors: DataFrame, op_col: str = "operation",
                   actor_col: str = "actor_id") -> DataFrame:
    """G1: each request with ``admitted`` and ``refusal`` ('no_actor', 'permission', 'level' or NULL).

    A request passes if its actor is an active user with a role, the role holds the operation's permission
    (JSON member is truthy) and the role level is allowed (``ia`` always passes the level test). The rule
    table is a literal map, so the whole test is one expression after a join with the actor context.
    """
    ops = list(ADMISSION_RULES)
    perm_map = F.create_map(*[x for op in ops for x in (F.lit(op), F.lit(ADMISSION_RULES[op][0]))])
    lvl_map = F.create_map(*[x for op in ops for x in (
        F.lit(op), F.lit(",".join(ADMISSION_RULES[op][1] or ("*",))))])
    a = actors.select(F.col("id").alias("__a"), "role_level", "general_permissions")
    j = requests.join(a, requests[actor_col] == a["__a"], "left")
    perm = F.element_at(perm_map, F.col(op_col))
    perms = F.try_parse_json(F.col("general_permissions"))
    has_perm = _perm_truthy(perms, perm)
    allowed = F.element_at(lvl_map, F.col(op_col))
    level_ok = (F.col("role_level") == "ia") | (allowed == "*") | F.array_contains(F.split(allowed, ","),
                                                                                  F.col("role_level"))
    refusal = (F.when(F.col("__a").isNull(), "no_actor")
                .when(perm.isNull(), "unknown_operation")
                .when(~has_perm, "permission")
                .when(~F.coalesce(level_ok, F.lit(False)), "level"))
    return (j.withColumn("refusal", refusal).withColumn("admitted", F.col("refusal").isNull())
             .drop("__a", "general_permissions"))


def _perm_truthy(perms: Column, perm: Column) -> Column:
    """``perms?.[perm]`` truthiness for a per-row permission name: the permission names are few and fixed, so
    a CASE over them keeps the JSON paths literal."""
    names = sorted({p for p, _ in ADMISSION_RULES.values()})
    out = F.lit(False)
    for n in names:
        out = F.when(perm == n, F.coalesce(F.try_variant_get(perms, f"$.{n}", "boolean"), F.lit(False))).otherwise(out)
    return out


def permission(actor_perms: Column | str, name: str) -> Column:
    """C9 shortcut."""
    return json_truthy(actor_perms, name)


def stats_per_actor(stats: DataFrame, actors: DataFrame, measures: list[str]) -> DataFrame:
    """Per-actor totals from ``stats`` (scope_kind, scope_key, measures...; see ``cards.card_stats_by_scope``):
    'ia' sees the grand total, enterprise / spbipk actors their enterprise's rows, res actors their res unit's
    rows (SURVEY 2.2.1, statistics form). One join on the scope key; a NULL actor key matches nothing and
    gives zeros. No actor x row pairs are formed."""
    key = (F.when(F.col("role_level") == "ia", F.lit("*"))
            .when(F.col("role_level").isin("enterprise", "spbipk"), F.col("enterprise_id"))
            .when(F.col("role_level") == "res", F.col("res_unit_id")))
    kind = (F.when(F.col("role_level") == "ia", "total").when(F.col("role_level") == "res", "res")
             .otherwise("enterprise"))
    a = actors.select(F.col("id").alias("actor_id"), "role_level", kind.alias("scope_kind"), key.alias("scope_key"))
    # Both sides are small; their size is only known after the cards aggregate runs, so the choice of a
    # broadcast is left to AQE at runtime (proving a bound here would run the aggregate twice).
    j = a.join(stats, ["scope_kind", "scope_key"], "left")
    return j.select("actor_id", "role_level", *[F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in measures])

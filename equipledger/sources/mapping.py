"""The driver's test tables mapped onto the domain schema (FIXTURES.md §2).

Every domain table is a lazy projection / join / aggregate of the driver's parquet tables, so its size grows
with theirs. The oracle SQL (``equipledger.plans.oracle``) repeats these expressions in DuckDB text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipledger.functions.scalars import DEFAULT_UNIT, HOLDING_ACTIVE, HOLDING_RETURNED
from equipledger.schemas import SCHEMAS, conform, empty

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed mapping parameters (must equal the oracle SQL's).
OPENING_BALANCE = 50     # opening stock per (warehouse, item) key of the movement-event fixture
EVENT_WAREHOUSES = 5     # movement events go to warehouse l_suppkey % 5
AS_OF = "1999-01-01"     # fixed as-of date for expiry tests
IMPORT_WAREHOUSE = "1"   # target warehouse of the stock-import fixture
IMPORT_DAY = "2024-01-15"
RES_PER_NATION = 4       # res units of an enterprise


# Surnames whose order by language differs from that by code point.
SURNAMES = ("яшин", "Ёлкин", "Ельцов", "абрамов", "Жуков", "Абрамов", "Еда", "ёлкин", "Яшин", "Аксёнов")


def lineitem_row_id() -> F.Column:
    """Unique, order-preserving text id of a lineitem row: its string order is (orderkey, linenumber, partkey,
    suppkey)."""
    return F.concat_ws("-",
                       F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                       F.lpad(F.col("l_linenumber").cast("string"), 4, "0"),
                       F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
                       F.lpad(F.col("l_suppkey").cast("string"), 10, "0"))


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


def res_unit_id(nation, k) -> F.Column:
    return F.concat(F.lit("R"), (F.col(nation) if isinstance(nation, str) else nation).cast("string"), F.lit("-"),
                    k.cast("string"))


class MappedTables(Mapping):
    """Lazy ``{domain table: DataFrame}`` over one driver data directory. Each table is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    # -- Mapping protocol --
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            builder = getattr(self, f"_build_{name}", None)
            if builder is None:
                if name in SCHEMAS:
                    self._built[name] = empty(self.spark, name)
                else:
                    raise KeyError(name)
            else:
                df = builder()
                self._built[name] = conform(df, name) if name in SCHEMAS else df
        return self._built[name]

    def __iter__(self):
        return iter(SCHEMAS)

    def __len__(self):
        return len(SCHEMAS)

    def derived(self, name: str, build) -> DataFrame:
        """A lazy DataFrame built from these tables once per session (a plan, not data: nothing is cached or
        collected). Saves re-analysing a many-join plan on every call."""
        key = "__derived_" + name
        if key not in self._built:
            self._built[key] = build(self)
        return self._built[key]

    def raw(self, name: str) -> DataFrame:
        key = "__raw_" + name
        if key not in self._built:
            self._built[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._built[key]

    # -- organisation --
    def _build_organizations(self):
        r = self.raw("region")
        return r.select(_s("r_regionkey").alias("id"), F.col("r_name").alias("name"),
                        F.col("r_name").alias("code"), F.lit("{}").alias("extra"), F.lit(True).alias("is_active"))

    def _build_enterprises(self):
        n = self.raw("nation")
        return n.select(_s("n_nationkey").alias("id"), _s("n_regionkey").alias("organization_id"),
                        F.col("n_name").alias("name"), F.col("n_name").alias("code"),
                        F.lit("{}").alias("extra"), F.lit(True).alias("is_active"))

    def _build_spbipk(self):
        n = self.raw("nation")
        return n.select(F.concat(F.lit("S"), _s("n_nationkey")).alias("id"), _s("n_nationkey").alias("enterprise_id"),
                        F.concat(F.lit("SPBIPK "), "n_name").alias("name"), F.lit("{}").alias("extra"),
                        (F.col("n_nationkey") % 12 != 5).alias("is_active"))

    def _build_res_units(self):
        n = self.raw("nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(RES_PER_NATION - 1))))
        return n.select(res_unit_id("n_nationkey", F.col("k")).alias("id"), _s("n_nationkey").alias("enterprise_id"),
                        F.concat(F.lit("S"), _s("n_nationkey")).alias("spbipk_id"),
                        F.concat("n_name", F.lit(" RES "), _s("k")).alias("name"), F.lit("{}").alias("extra"),
                        ((F.col("n_nationkey") + F.col("k")) % 9 != 4).alias("is_active"))

    def _build_departments(self):
        r = self["res_units"].withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
        return r.select(F.concat("id", F.lit("-D"), _s("d")).alias("id"), F.col("id").alias("res_unit_id"),
                        F.concat("name", F.lit(" / "), _s("d")).alias("name"), F.lit("{}").alias("extra"),
                        ((F.col("d") == 0) | F.col("is_active")).alias("is_active"))

    def _build_warehouses(self):
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        wtype = (F.when(F.col("s_suppkey") % 3 == 0, "res").when(F.col("s_suppkey") % 3 == 1, "spbipk")
                 .otherwise("ia"))
        return s.select(_s("s_suppkey").alias("id"), F.col("s_name").alias("name"), wtype.alias("warehouse_type"),
                        F.when(F.col("s_suppkey") % 10 != 0, _s("s_nationkey")).alias("enterprise_id"),
                        F.when(k % 3 == 1, F.concat(F.lit("S"), _s("s_nationkey"))).alias("spbipk_id"),
                        F.when((k % 3 == 0) & (k % 7 != 0), res_unit_id("s_nationkey", k % RES_PER_NATION))
                        .alias("res_unit_id"),
                        (F.col("s_acctbal") >= 0).alias("is_active"))

    # -- people --
    def _build_employees(self):
        c = self.raw("customer")
        k = F.col("c_custkey")
        res = F.when((k % 20 != 0) & (k % 3 != 0), res_unit_id("c_nationkey", k % RES_PER_NATION))
        return c.select(_s("c_custkey").alias("id"), _s("c_custkey").alias("employee_number"),
                        F.col("c_name").alias("last_name"), F.col("c_mktsegment").alias("position_id"),
                        F.when(F.col("c_custkey") % 20 != 0, _s("c_nationkey")).alias("enterprise_id"),
                        res.alias("res_unit_id"),
                        F.when(k % 5 == 1, F.concat(res, F.lit("-D"), (k % 2).cast("string"))).alias("department_id"),
                        F.lit("{}").alias("extra"), (F.col("c_acctbal") >= 0).alias("is_active"))

    def _build_positions(self):
        seg = self.raw("customer").select(F.col("c_mktsegment").alias("id")).distinct()
        return seg.select("id", F.col("id").alias("name"), F.lower("id").alias("code"),
                          F.lit("{}").alias("extra"), F.lit(True).alias("is_active"))

    # -- catalogue --
    def _build_siz_categories(self):
        t = self.raw("part").select(F.col("p_type").alias("id")).distinct()
        return t.select("id", F.col("id").alias("name"), F.lower("id").alias("code"),
                        F.lit("{}").alias("extra"), F.lit(True).alias("is_active"))

    def _build_siz_items(self):
        p = self.raw("part")
        years = F.when(F.col("p_size") % 5 != 0, F.round(F.col("p_size") / F.lit(12.0), 2).cast("decimal(10,2)"))
        return p.select(_s("p_partkey").alias("id"), F.col("p_type").alias("category_id"),
                        F.col("p_name").alias("name"), F.col("p_brand").alias("code"),
                        F.lit(DEFAULT_UNIT).alias("unit"), F.col("p_size").alias("exploitation_months"),
                        years.alias("exploitation_years"), F.lit("{}").alias("extra"),
                        (F.col("p_partkey") % 17 != 0).alias("is_active"))

    def _build_position_siz_norms(self):
        # positions x part on a computed equi-key (p_partkey % 100 = length(segment)): a hash join, not a cross join.
        pos = self["positions"].select(F.col("id").alias("position_id"), F.length("id").alias("k"))
        p = self.raw("part").select("p_partkey", "p_size", (F.col("p_partkey") % 100).alias("k"))
        j = p.join(pos, "k")
        return j.select(F.concat_ws(":", "position_id", _s("p_partkey")).alias("id"), "position_id",
                        _s("p_partkey").alias("siz_item_id"), (F.col("p_size") % 3 + 1).alias("quantity"),
                        F.lit(12).alias("issue_period_months"), F.lit("{}").alias("extra"),
                        (F.col("p_partkey") % 7 != 3).alias("is_active"))

    # -- stock and holdings --
    def _build_warehouse_stock(self):
        li = self.raw("lineitem").where(F.col("l_returnflag") == "N")
        g = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("int").alias("quantity"))
        return g.select(F.concat_ws("/", _s("l_suppkey"), _s("l_partkey"), F.lit("")).alias("id"),
                        _s("l_suppkey").alias("warehouse_id"), _s("l_partkey").alias("siz_item_id"),
                        F.lit("").alias("size_value"), "quantity")

    def _lineitem_orders(self, flags=None) -> DataFrame:
        li = self.raw("lineitem")
        if flags is not None:
            li = li.where(F.col("l_returnflag").isin(*flags))
        o = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return li.join(o, "l_orderkey")

    def _build_employee_siz(self):
        li = self._lineitem_orders(["A"])
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        j = li.join(p, "l_partkey")
        issued = F.to_date("l_shipdate")
        return j.select(lineitem_row_id().alias("id"), _s("o_custkey").alias("employee_id"),
                        _s("l_partkey").alias("siz_item_id"), F.lit("").alias("size_value"),
                        F.col("l_quantity").cast("int").alias("quantity"), issued.alias("issued_date"),
                        F.when(F.col("p_size") % 5 != 0, issued).alias("exploitation_start"),
                        F.when(F.col("l_linestatus") == "F", HOLDING_RETURNED).otherwise(HOLDING_ACTIVE)
                        .alias("status"),
                        _s("l_suppkey").alias("from_warehouse_id"), F.col("l_shipdate").alias("created_at"))

    def _build_stock_movements(self):
        li = self._lineitem_orders()
        flag = F.col("l_returnflag")
        mtype = F.when(flag == "A", "issue").when(flag == "R", "return").otherwise("receipt")
        return li.select(lineitem_row_id().alias("id"), mtype.alias("movement_type"),
                         _s("l_partkey").alias("siz_item_id"), F.lit("").alias("size_value"),
                         F.col("l_quantity").cast("int").alias("quantity"),
                         F.when(flag == "A", _s("l_suppkey")).alias("from_warehouse_id"),
                         F.when(flag != "A", _s("l_suppkey")).alias("to_warehouse_id"),
                         F.when(flag != "N", _s("o_custkey")).alias("employee_id"),
                         F.to_date("l_shipdate").alias("movement_date"), F.col("l_shipdate").alias("created_at"))

    # -- old transaction feed (read only) --
    def _build_siz_transactions(self):
        li = self._lineitem_orders(["R"])
        d = F.to_date("l_shipdate")
        return li.select(lineitem_row_id().alias("id"), _s("o_custkey").alias("employee_id"),
                         _s("l_partkey").alias("siz_item_id"),
                         F.when(F.col("l_linestatus") == "F", "return").otherwise("issue").alias("transaction_type"),
                         F.col("l_quantity").cast("int").alias("quantity"), d.alias("transaction_date"),
                         F.col("l_shipdate").alias("created_at"))

    # -- actors --
    def _build_users(self):
        u = self.raw("events").select("user_id").distinct()
        role = (F.when(F.col("user_id") % 4 == 0, "admin_ia").when(F.col("user_id") % 4 == 1, "admin_enterprise")
                .when(F.col("user_id") % 4 == 2, "admin_spbipk").otherwise("admin_res"))
        return u.select(_s("user_id").alias("id"), F.concat(F.lit("user"), _s("user_id")).alias("username"),
                        F.concat(F.lit("User "), _s("user_id")).alias("full_name"), role.alias("role_id"),
                        (F.col("user_id") % 25).cast("string").alias("enterprise_id"),
                        res_unit_id((F.col("user_id") % 25), F.col("user_id") % 3).alias("res_unit_id"),
                        (F.col("user_id") % 9 != 0).alias("is_active"))

    def _build_roles(self):
        from equipledger.operators.scope import seed_roles
        return seed_roles(self.spark)

    def admission_requests(self) -> DataFrame:
        """One change request per event: actor = user_id, operation by event type."""
        e = self.raw("events")
        op = (F.when(F.col("event_type") == "click", "receipt").when(F.col("event_type") == "purchase", "issue")
              .when(F.col("event_type") == "view", "norms.upsert")
              .when(F.col("event_type") == "signup", "employees.create").otherwise("stock.adjust"))
        return e.select(_s("event_id").alias("request_id"), _s("user_id").alias("actor_id"), op.alias("operation"))

    def all_operation_requests(self) -> DataFrame:
        """One change request per event, dealt over all operations of the admission rules and one unknown one."""
        from equipledger.operators.scope import ADMISSION_RULES
        ops = F.array(*[F.lit(o) for o in [*sorted(ADMISSION_RULES), "unknown.operation"]])
        at = (F.col("event_id") % (len(ADMISSION_RULES) + 1)).cast("int")
        return self.raw("events").select(_s("event_id").alias("request_id"), _s("user_id").alias("actor_id"),
                                         F.get(ops, at).alias("operation"))

    # -- audit --
    def _build_audit_log(self):
        e = self.raw("events")
        tname = F.when(F.col("user_id") % 2 == 0, "warehouse_stock").otherwise("employees")
        return e.select(_s("event_id").alias("id"), _s("user_id").alias("user_id"), tname.alias("table_name"),
                        F.col("event_type").alias("action"), F.col("props").alias("changes"),
                        F.col("ts").alias("created_at"))

    # -- movement requests (L9 input) --
    def _build_movement_events(self):
        li = self._lineitem_orders()
        kind = F.when(F.col("l_returnflag") == "A", "issue").otherwise("receipt")
        return li.select(lineitem_row_id().alias("event_id"), F.col("l_shipdate").alias("event_time"),
                         kind.alias("kind"), (F.col("l_suppkey") % EVENT_WAREHOUSES).cast("string").alias("warehouse_id"),
                         _s("l_partkey").alias("siz_item_id"), F.lit("").alias("size_value"),
                         F.when(F.col("l_returnflag") == "A", _s("o_custkey")).alias("employee_id"),
                         F.col("l_quantity").cast("int").alias("quantity"))

    def mixed_movement_events(self) -> DataFrame:
        """Movement requests of all six kinds, one per lineitem id: 'A' issues; 'R' transfers to the next warehouse
        (even lines) or returns of the order's first issue (odd lines; invalid where the order has none); 'N' drops
        the stock row (line 5), sets it (line 6) or receives."""
        key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey"]
        li = self._lineitem_orders().groupBy(*key).agg(
            F.max("l_quantity").cast("int").alias("quantity"), F.min("l_shipdate").alias("event_time"),
            F.max("l_returnflag").alias("flag"))
        line = F.col("l_linenumber")
        kind = (F.when(F.col("flag") == "A", "issue")
                .when(F.col("flag") == "R", F.when(line % 2 == 0, "transfer").otherwise("return"))
                .when(line == 5, "drop").when(line == 6, "set").otherwise("receipt"))
        li = li.withColumn("kind", kind).withColumn("event_id", lineitem_row_id())
        k = F.col("kind")
        # a window over the rows as they lie: a join with a grouping of them would read and shuffle lineitem once more
        li = li.withColumn("first_issue", F.min(F.when(k == "issue", F.col("event_id"))).over(Window.partitionBy("l_orderkey")))
        wh = lambda shift: ((F.col("l_suppkey") + shift) % EVENT_WAREHOUSES).cast("string")
        return li.select("event_id", "event_time", "kind", wh(0).alias("warehouse_id"),
                         F.when(k == "transfer", wh(1)).alias("to_warehouse_id"),
                         F.when(k != "return", _s("l_partkey")).alias("siz_item_id"), F.lit("").alias("size_value"),
                         F.when(k == "issue", _s("o_custkey")).alias("employee_id"),
                         F.when(k == "return", F.col("first_issue")).alias("holding_id"), "quantity")

    def repeated_movement_events(self) -> DataFrame:
        """The movement events, and those of orders divisible by 5 once more under the same id, an hour later, half as much."""
        ev = self["movement_events"]
        more = ev.where(F.substring("event_id", 1, 12).cast("long") % 5 == 0)
        more = more.withColumns({"event_time": F.col("event_time") + F.expr("interval 1 hour"),
                                 "quantity": F.expr("quantity div 2 + 1")})
        return ev.unionByName(more)

    def hot_movement_events(self) -> DataFrame:
        """The movement events; those of orders divisible by 60 all go to item 1 in warehouse 0."""
        hot = F.substring("event_id", 1, 12).cast("long") % 60 == 0
        return self["movement_events"].withColumns({
            "warehouse_id": F.when(hot, "0").otherwise(F.col("warehouse_id")),
            "siz_item_id": F.when(hot, "1").otherwise(F.col("siz_item_id"))})

    def hot_opening(self) -> DataFrame:
        """The opening row of the hot key."""
        return conform(self.spark.createDataFrame(
            [("0/1/", "0", "1", "", OPENING_BALANCE)], "id string, warehouse_id string, siz_item_id string, size_value string, quantity int"),
            "warehouse_stock")

    def russian_employees(self) -> DataFrame:
        """The active employees under Russian surnames (by customer key), some with a first name."""
        k = F.col("id").cast("long")
        name = F.get(F.array(*[F.lit(n) for n in SURNAMES]), (k % len(SURNAMES)).cast("int"))
        first = F.when(k % 3 == 0, F.lit("Иван")).when(k % 3 == 1, F.lit("ёжик"))
        return self["employees"].where("is_active").withColumns({"last_name": name, "first_name": first})

    def sized_employees(self) -> DataFrame:
        """Employees with a shoe size by customer key, from 33 to 52 (some beyond the list)."""
        return self["employees"].withColumn("shoe_size", (33 + F.col("id").cast("long") % 20).cast("string"))

    def norm_deletions(self) -> DataFrame:
        """Delete requests for the norms of every fifth item and, per such item, one for a norm that doesn't exist."""
        n = self["position_siz_norms"].where(F.col("siz_item_id").cast("long") % 5 == 0)
        some = n.select("id", F.concat(F.lit("d"), "id").alias("request_id"), F.lit("0").alias("actor_id"))
        return some.unionByName(n.select(F.concat(F.lit("no-"), "id").alias("id"), F.concat(F.lit("x"), "id").alias("request_id"),
                                         F.lit("0").alias("actor_id")))

    def role_requests(self) -> DataFrame:
        """Per role of the users one request that sets its description to their number, and one for a new role."""
        u = self["users"].groupBy(F.col("role_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        u = u.select("name", F.lit("res").alias("level"), F.concat(F.lit("users: "), F.col("n").cast("string")).alias("description"))
        return u.unionByName(u.select(F.concat(F.lit("new_"), "name").alias("name"), "level", "description")).withColumn("request_id", F.lit(1))

    def import_stock_rows(self) -> DataFrame:
        """Stock-import payload rows from lineitem 'R' rows: padded sizes, quantities with trailing text or
        <= 0, blank item ids, inactive items -- every rule of the import is exercised."""
        li = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        item = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(_s("l_partkey"))
        size = F.concat(F.lit(" "), F.col("l_linestatus"), F.lit("\t"))
        qty = F.concat((F.col("l_quantity").cast("int") - 10).cast("string"),
                       F.when(F.col("l_linenumber") % 3 == 0, F.lit("pcs")).otherwise(F.lit("")))
        return li.select(item.alias("siz_item_id"), size.alias("size_value"), qty.alias("quantity"))

    def norm_requests(self) -> DataFrame:
        """Norm upserts, one per part: FURNITURE when p_partkey % 100 = 9 (an existing norm key: overwrite +
        re-activate), else BUILDING (mostly new keys, some existing). quantity / period may be 0 (-> defaults)."""
        p = self.raw("part")
        pos = F.when(F.col("p_partkey") % 100 == 9, F.lit("FURNITURE")).otherwise(F.lit("BUILDING"))
        return p.select(F.col("p_partkey").alias("request_id"), pos.alias("position_id"),
                        _s("p_partkey").alias("siz_item_id"), (F.col("p_size") % 4).alias("quantity"),
                        (F.col("p_size") % 18).alias("issue_period_months"), F.lit(None).cast("string").alias("extra"))

    def return_deltas(self) -> DataFrame:
        """Stock deltas of the 'R' lineitems (returns into stock) per (warehouse, item)."""
        li = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        return li.select(_s("l_suppkey").alias("warehouse_id"), _s("l_partkey").alias("siz_item_id"),
                         F.lit("").alias("size_value"), F.col("l_quantity").cast("int").alias("quantity"))

    def import_item_rows(self) -> DataFrame:
        """Item-import payload from part: blank names, months with trailing text / leading blanks / junk,
        years as text, default units."""
        p = self.raw("part")
        k = F.col("p_partkey")
        name = F.when(k % 50 == 0, F.lit("")).otherwise(F.col("p_name"))
        months = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(_s("p_size"), F.lit("m")))
                  .when(k % 4 == 2, F.concat(F.lit(" "), _s("p_size"))).otherwise(F.concat(F.lit("x"), _s("p_size"))))
        years = F.when(k % 8 == 0, F.lit("")).otherwise(
            F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), (k % 10).cast("string")))
        unit = F.when(k % 5 == 0, F.lit("пара")).otherwise(F.lit(""))
        return p.select(name.alias("name"), F.col("p_brand").alias("code"), F.col("p_type").alias("category_id"),
                        months.alias("exploitation_months"), years.alias("exploitation_years"), unit.alias("unit"))

    def import_employee_rows(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(F.when(k % 11 == 0, F.lit("")).otherwise(F.col("c_name")).alias("last_name"),
                        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("0")).otherwise(F.lit("Ivan"))
                        .alias("first_name"),
                        _s("c_custkey").alias("employee_number"),
                        F.when(k % 4 == 0, F.lit("")).otherwise(_s("c_nationkey")).alias("enterprise_id"),
                        F.col("c_mktsegment").alias("position_id"))

    def employee_patches(self) -> DataFrame:
        """One patch per employee: c % 3 = 0 sets last_name; 1 sets last_name and enterprise_id; 2 sets only
        an extra member. last_name is upper-cased (a change) for even keys, kept for odd ones."""
        c = self.raw("customer")
        k = F.col("c_custkey")
        fields = (F.when(k % 3 == 0, F.array(F.lit("last_name")))
                  .when(k % 3 == 1, F.array(F.lit("last_name"), F.lit("enterprise_id")))
                  .otherwise(F.array().cast("array<string>")))
        return c.select(_s("c_custkey").alias("id"), k.alias("request_id"), fields.alias("set_fields"),
                        F.when(k % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("last_name"),
                        ((F.col("c_nationkey") + 1) % 25).cast("string").alias("enterprise_id"),
                        F.when(k % 3 == 2, F.concat(F.lit('{"grade":'), (k % 5).cast("string"), F.lit("}")))
                        .alias("extra"),
                        F.lit("0").alias("actor_id"))

    def employee_patch_series(self) -> DataFrame:
        """Three patches per employee, in the order of request_id: 0 upper-cases the surname and sets member grade;
        1 sets the enterprise (NULL for c % 4 = 0) and leaves the surname as the first patch left it; 2 sets the
        surname back for even c, and member shift, and for c % 5 = 0 grade again."""
        c = self.raw("customer").withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(3)])))
        k, n = F.col("c_custkey"), F.col("n")
        name, ent = F.lit("last_name"), F.lit("enterprise_id")
        fields = (F.when(n == 0, F.array(name)).when(n == 1, F.array(name, ent))
                  .when(k % 2 == 0, F.array(name)).otherwise(F.array().cast("array<string>")))
        grade = lambda v: F.concat(F.lit('"grade":'), v.cast("string"))
        shift = F.concat(F.lit('"shift":'), (k % 3).cast("string"))
        members = (F.when(n == 0, grade(k % 5)).when((n == 2) & (k % 5 == 0), F.concat_ws(",", shift, grade(k % 7)))
                   .when(n == 2, shift))
        return c.select(_s("c_custkey").alias("id"), (n * 1_000_000_000 + k).alias("request_id"),
                        fields.alias("set_fields"),
                        F.when(n < 2, F.upper("c_name")).otherwise(F.col("c_name")).alias("last_name"),
                        F.when(k % 4 != 0, ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("enterprise_id"),
                        F.when(members.isNotNull(), F.concat(F.lit("{"), members, F.lit("}"))).alias("extra"),
                        F.lit("0").alias("actor_id"))

    def stock_adjustment_series(self) -> DataFrame:
        """Two corrections per stock row (first to quantity + 5, then to quantity - 3, negative ones invalid)."""
        st = self["warehouse_stock"].withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        q = F.col("quantity") + F.when(F.col("n") == 0, 5).otherwise(-3)
        return st.select("id", "warehouse_id", F.col("n").alias("request_id"), q.alias("quantity"),
                         F.lit("").alias("notes"), F.lit("0").alias("actor_id"))

    def norm_request_series(self) -> DataFrame:
        """Two requests per (position, item) of ``norm_requests``; the second differs in quantity."""
        r = self.norm_requests().withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        return (r.withColumn("request_id", F.col("request_id") * 2 + F.col("n"))
                 .withColumn("quantity", F.col("quantity") + F.col("n") * 10).drop("n"))

    def stock_adjustments(self) -> DataFrame:
        """M9 requests: every stock row above 40 is set to 40; rows of warehouse keys divisible by 7 are asked
        for under the wrong warehouse (-> not_found)."""
        st = self["warehouse_stock"].where(F.col("quantity") > 40)
        wrong = F.col("warehouse_id").cast("int") % 7 == 0
        return st.select("id", F.when(wrong, F.concat(F.col("warehouse_id"), F.lit("x"))).otherwise(F.col("warehouse_id"))
                         .alias("warehouse_id"), F.lit(40).alias("quantity"), F.lit(None).cast("string").alias("notes"),
                         F.lit("0").alias("actor_id"))

    def empty_stock_rows(self) -> DataFrame:
        """M4 requests: drop every stock row of warehouses that are inactive."""
        wh = self["warehouses"].where(~F.col("is_active")).select(F.col("id").alias("warehouse_id"))
        return self["warehouse_stock"].join(wh, "warehouse_id", "left_semi").select("id", F.lit("0").alias("actor_id"))

    def import_position_rows(self) -> DataFrame:
        """I2 payload: one row per customer naming its segment (duplicates stay: positions have no natural key);
        blank names for c_custkey % 13 = 0."""
        c = self.raw("customer")
        return c.select(F.when(F.col("c_custkey") % 13 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("name"),
                        F.lower("c_mktsegment").alias("code"), _s("c_nationkey").alias("enterprise_id"))

    def opening_stock(self) -> DataFrame:
        """Opening balance of OPENING_BALANCE on every (warehouse, item) key that the events touch."""
        # The keys of the events, read from lineitem alone (every lineitem has its order, so the event
        # mapping's join with orders neither adds nor drops keys).
        li = self.raw("lineitem")
        ev = li.select((F.col("l_suppkey") % EVENT_WAREHOUSES).cast("string").alias("warehouse_id"),
                       _s("l_partkey").alias("siz_item_id"), F.lit("").alias("size_value")).distinct()
        return conform(ev.select(F.concat_ws("/", "warehouse_id", "siz_item_id", "size_value").alias("id"),
                                 "warehouse_id", "siz_item_id", "size_value",
                                 F.lit(OPENING_BALANCE).alias("quantity")), "warehouse_stock")


def mapped_tables(spark: SparkSession, sf_dir: str) -> MappedTables:
    return MappedTables(spark, sf_dir)

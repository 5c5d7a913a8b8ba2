"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions.enums import Enum
from ..functions.identity import object_uuid, oid_of
from ..functions.text import taggify
from ..operators import aggregate as A
from ..operators import diff as D
from ..operators.query import Query, View, deserialize, numbered
from ..operators.spans import in_spans
from ..sources.fixtures import history, stored, view
from ..sources.scratch import scratch_path
from .ir import At, Ids, Tag, Type, no

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


def key():
    """The driver's key of an object."""
    return F.shiftright("oid", 4)


def keys(q: Query) -> DataFrame:
    return q.ids().select(key().alias("o_orderkey"))


def found(name: str, where: str, make: Callable[[View], Query]) -> None:
    """A find() over orders against a WHERE clause."""
    query(name, f"SELECT o_orderkey FROM orders WHERE {where}")(lambda s, d: keys(make(view(s, d))))


def customer(key: int) -> Tag:
    return Tag(str(key * 16 + 3), "obj")


ORDERS = Type("orders")
PRIORITY = Enum("Priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
found("find_tag", "o_orderstatus = 'F'", lambda v: v.find(ORDERS, "F"))
found("find_unknown_tag", "false", lambda v: v.find(ORDERS, "no such tag"))
found("find_and", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", lambda v: v.find(ORDERS, ("F", "1-URGENT")))
found("find_or", "o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'", lambda v: v.find(ORDERS, ["P", "1-URGENT"]))
found("find_not", "o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'", lambda v: v.find(ORDERS, no("F", "1-URGENT")))
found("find_nested", "(o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')) AND NOT o_orderpriority = '5-LOW'", lambda v: v.find(ORDERS, ["F", ("O", "2-HIGH")], no("5-LOW")))
found("find_enum", "o_orderpriority = '3-MEDIUM'", lambda v: v.find(ORDERS, Tag("Priority.3-MEDIUM", "enum")))
found("find_scoped_tag", "o_orderstatus = 'O'", lambda v: v.find(ORDERS, Tag("O", "field", "status")))
found("find_objtag", "o_custkey = 7", lambda v: v.find(ORDERS, customer(7)))
found("find_identity", "o_orderkey IN (1, 2, 3, 5, 8) AND o_orderstatus = 'O'", lambda v: v.find(Ids(tuple(k * 16 + 6 for k in (1, 2, 3, 5, 8))), v.find(ORDERS, "O")))
found("find_subquery", "floor(o_totalprice) BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'", lambda v: v.find(ORDERS, v.select("price", 100000, 200000), v.find("F")))
found("find_except_query", "o_orderstatus = 'F' AND NOT floor(o_totalprice) <= 150000", lambda v: v.find(ORDERS, "F", no(v.select("price", None, 150000, True))))
found("filter_expr", "o_orderstatus = 'F' AND o_totalprice > 3e5", lambda v: v.find(ORDERS, "F").filter("orders", "o_totalprice > 3e5"))
found("filter_python", "o_orderstatus = 'F' AND o_totalprice > 3e5", lambda v: v.find(ORDERS, "F").filter("orders", lambda r: r.o_totalprice > 3e5, ["o_totalprice"]))
found("range_inclusive", "floor(o_totalprice) BETWEEN 50000 AND 60000", lambda v: v.select("price", 50000, 60000))
found("range_low", "o_custkey % 10 >= 5 OR o_custkey % 10 = 0", lambda v: v.select("custmod", 5))
found("range_high", "o_custkey % 10 BETWEEN 1 AND 5", lambda v: v.select("custmod", None, 5))
found("range_nulls_first", "o_custkey % 10 <= 5", lambda v: v.select("custmod", None, 5, null_first=True))
found("range_all", "true", lambda v: v.select("custmod"))
found("set_intersect", "o_orderstatus = 'O' AND o_orderpriority = '5-LOW'", lambda v: v.find(v.find("O"), v.find("5-LOW")))
found("set_union", "o_orderstatus = 'O' OR o_orderpriority = '5-LOW'", lambda v: v.find([v.find("O"), v.find("5-LOW")]))


@query("find_type", "SELECT 'customer' AS kind, c_custkey AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def find_type(s, d):
    """A base class finds its subclasses."""
    return view(s, d).find(Type("party")).ids().select(F.when(F.col("oid") % 16 == 3, "customer").otherwise("supplier").alias("kind"), key().alias("key"))


def ordered(name: str, order: str, make: Callable[[View], Query], where: str = "o_orderstatus = 'F'", keep: str = "true", at: str = "rn") -> None:
    """A sort, with places from 0, against row_number()."""
    query(name, f"SELECT CAST({at} AS BIGINT) AS at, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) - 1 AS rn FROM orders WHERE {where}) WHERE {keep}")(
        lambda s, d: numbered(make(view(s, d))).select("at", key().alias("o_orderkey"))
    )


M = "nullif(o_custkey % 10, 0)"
ordered("sort_asc_nulls_last", f"{M} ASC NULLS LAST, o_orderkey", lambda v: v.sort("custmod", v.find(ORDERS, "F")))
ordered("sort_asc_nulls_first", f"{M} ASC NULLS FIRST, o_orderkey", lambda v: v.sort("custmod", v.find(ORDERS, "F"), null_first=True))
ordered("sort_desc_default", f"{M} DESC NULLS FIRST, o_orderkey DESC", lambda v: v.sort("custmod", v.find(ORDERS, "F"), desc=True))
ordered("sort_desc_nulls_last", f"{M} DESC NULLS LAST, o_orderkey DESC", lambda v: v.sort("custmod", v.find(ORDERS, "F"), desc=True, null_first=True))
ordered("sort_multi", f"{M} ASC NULLS LAST, floor(o_totalprice) DESC, o_orderkey", lambda v: v.sort("custmod", v.sort("price", v.find(ORDERS, "F"), desc=True)))
ordered("topk", "floor(o_totalprice) DESC, o_orderkey DESC", lambda v: v.sort("price", v.find(ORDERS, "F"), desc=True)[:10], keep="rn < 10")
ordered("slice_step", "floor(o_totalprice), o_orderkey", lambda v: v.sort("price", v.find(ORDERS, "F"))[10:100:7], keep="rn >= 10 AND rn < 100 AND (rn - 10) % 7 = 0", at="(rn - 10) // 7")
ordered("slice_then_sort", "floor(o_totalprice), o_orderkey", lambda v: v.sort("price", v.find(ORDERS, "F")[:25]), keep="rn < 25")
ordered("slice_unsorted", "o_orderkey DESC", lambda v: v.find(ORDERS, "F")[5:15], keep="rn >= 5 AND rn < 15", at="rn - 5")


@query("item_pick", "SELECT CAST(rn AS BIGINT) AS at, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice), o_orderkey) - 1 AS rn FROM orders) WHERE rn IN (3, 6, 7)")
def item_pick(s, d):
    v = view(s, d)
    got = v.sort("price", v.find(ORDERS))[3, 6, 7]
    return s.createDataFrame([(at, oid >> 4) for at, oid in zip((3, 6, 7), got, strict=True)], "at long, o_orderkey long")


@query("split_exclusive", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' ELSE 'F' END AS tag FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'")
def split_exclusive(s, d):
    v = view(s, d)
    return v.split_by(["1-URGENT", "F"], v.find(ORDERS)).ids().select(key().alias("o_orderkey"), F.col("tag_1").alias("tag"))


@query("split_all", "SELECT o_orderkey, '1-URGENT' AS tag FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'F' FROM orders WHERE o_orderstatus = 'F'")
def split_all(s, d):
    v = view(s, d)
    return v.split_by(["1-URGENT", "F"], v.find(ORDERS), exclusive=False).ids().select(key().alias("o_orderkey"), F.col("tag_1").alias("tag"))


DAY = "CAST(o_orderdate AS DATE)"
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("group_count", f"SELECT {DAY} AS key_1, count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1")
def group_count(s, d):
    v = view(s, d)
    return A.group_by(v, [DAY], v.find(ORDERS, "F", no("1-URGENT")), "orders")


@query("group_sum", f"SELECT o_orderpriority AS key_1, CAST(sum({CENTS}) AS BIGINT) AS cents, count(*) AS count FROM orders GROUP BY 1")
def group_sum(s, d):
    v = view(s, d)
    return A.group_by(v, ["o_orderpriority"], v.find(ORDERS), "orders", [A.make_sum(CENTS, "cents"), A.count_op])


@query("group_tag", "SELECT o_orderstatus AS key_1, count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def group_tag(s, d):
    v = view(s, d)
    return A.group_by(v, [["F", "O"]], v.find(ORDERS), "orders")


@query("group_multi", "SELECT o_orderstatus AS key_1, o_custkey % 2 AS key_2, count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1, 2")
def group_multi(s, d):
    v = view(s, d)
    return A.group_by(v, [["F", "P"], "o_custkey % 2"], v.find(ORDERS), "orders")


@query("group_custom", "SELECT o_orderpriority AS key_1, floor(max(o_totalprice))::DOUBLE AS highest FROM orders GROUP BY 1")
def group_custom(s, d):
    v = view(s, d)
    op = A.CustomOp("highest", 0.0, lambda state, row: max(state, float(row.o_totalprice // 1)), merge=max, columns=("o_totalprice",))
    return A.group_by(v, ["o_orderpriority"], v.find(ORDERS), "orders", [op])


def last_events(day: int) -> str:
    return f"(SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE dayofmonth(ts) <= {day} GROUP BY user_id)"


@query("group_delta", f"SELECT event_type AS key_1, count(*) AS count, CAST(sum(event_id) AS BIGINT) AS ids FROM {last_events(20)} WHERE event_type <> 'error' GROUP BY 1")
def group_delta(s, d):
    """A kept result of day 10 brought to day 20 by the difference."""
    fast, ops = A.FastQuery(), [A.count_op, A.make_sum("event_id", "ids")]
    for day in (10, 20):
        v = history(s, d, day)
        out = fast.group_by(v, ["event_type"], v.find(Type("users"), no("error")), "users", ops)
    return out


@query("join_tag2", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def join_tag2(s, d):
    v = view(s, d)
    on = v.find(Type("nation"), Tag(str(1 * 16 + 1), "obj"))
    return v.join(Type("customer"), Type("supplier"), on=on).select(F.shiftright("oid_1", 4).alias("c_custkey"), F.shiftright("oid_2", 4).alias("s_suppkey"))


@query("join_tag3", "SELECT c.c_custkey, s.s_suppkey, t.s_suppkey AS other FROM customer c JOIN supplier s ON c_nationkey = s.s_nationkey JOIN supplier t ON t.s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5")
def join_tag3(s, d):
    v = view(s, d)
    on = v.find(Ids(tuple(k * 16 + 2 for k in range(5))))
    out = v.join(v.find(Type("customer"), "BUILDING"), Type("supplier"), Type("supplier"), on=on)
    return out.select(*[F.shiftright(f"oid_{i}", 4).alias(n) for i, n in ((1, "c_custkey"), (2, "s_suppkey"), (3, "other"))])


@query("snap_at", f"SELECT user_id, event_id FROM {last_events(12)} WHERE event_type = 'purchase'")
def snap_at(s, d):
    v = history(s, d, 12)
    return v.find(Type("users"), "purchase").rows("users").select("user_id", "event_id")


@query("snap_intersect", f"SELECT a.user_id FROM {last_events(12)} a JOIN {last_events(18)} b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'click'")
def snap_intersect(s, d):
    v = history(s, d)
    return v.find(At(Tag("click"), 12), At(Tag("click"), 18)).ids().select(key().alias("user_id"))


@query("select_new", f"SELECT user_id FROM {last_events(18)} WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM {last_events(12)} WHERE event_type = 'click')")
def select_new(s, d):
    a, b = history(s, d, 12), history(s, d, 18)
    return D.select_new(b.find("click"), a, b).select(key().alias("user_id"))


@query("select_deleted", f"SELECT user_id FROM {last_events(12)} WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM {last_events(18)} WHERE event_type = 'click')")
def select_deleted(s, d):
    a, b = history(s, d, 12), history(s, d, 18)
    return D.select_deleted(b.find("click"), a, b).select(key().alias("user_id"))


@query("select_modified", f"SELECT a.user_id, a.event_id AS old_event, b.event_id AS new_event FROM {last_events(12)} a JOIN {last_events(18)} b ON a.user_id = b.user_id WHERE a.event_id < b.event_id")
def select_modified(s, d):
    a, b = history(s, d, 12), history(s, d, 18)
    return D.select_modified(b.find(Type("users")), a, b, "users").select(key().alias("user_id"), F.col("old.event_id").alias("old_event"), F.col("new.event_id").alias("new_event"))


@query("split_snapshots", f"SELECT a.user_id, a.event_id AS e1, b.event_id AS e2 FROM {last_events(12)} a JOIN {last_events(18)} b ON a.user_id = b.user_id WHERE b.event_type = 'view'")
def split_snapshots(s, d):
    a, b = history(s, d, 12), history(s, d, 18)
    return D.split_by_snapshots(b.find("view"), a, b, type_name="users").select(key().alias("user_id"), F.col("s1.event_id").alias("e1"), F.col("s2.event_id").alias("e2"))


@query("reference_traversal", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'")
def reference_traversal(s, d):
    v = view(s, d)
    t = v.types
    rows = v.find(ORDERS, "P").rows("orders").drop("oid")
    return rows.join(t["customer"].drop("oid"), F.col("o_custkey") == F.col("c_custkey")).join(t["nation"].drop("oid"), F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"].drop("oid"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "n_name", "r_name")


def arrays(s, d):
    o = view(s, d).types["orders"]
    return o.select("o_orderkey", F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5, F.lit(7)).alias("a"), F.array(F.col("o_orderkey") % 4, F.lit(1)).alias("b"))


AB = "(SELECT o_orderkey, [o_orderkey % 3, o_orderkey % 5, 7] AS a, [o_orderkey % 4, 1] AS b FROM orders)"
T = "array_to_string"


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("set_ops", f"SELECT o_orderkey, {T}(list_sort(list_distinct(a || b)), ',') AS u, {T}(list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))), ',') AS i, {T}(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS m, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS sub, len(list_filter(a, lambda x: list_contains(b, x))) = 0 AS dis FROM {AB}")
def set_ops(s, d):
    a, b = F.col("a"), F.col("b")
    return arrays(s, d).select("o_orderkey", text(C.union(a, b)).alias("u"), text(C.intersection(a, b)).alias("i"), text(C.difference(a, b)).alias("m"), C.is_subset(a, b).alias("sub"), C.is_disjoint(a, b).alias("dis"))


@query("list_ops", f"SELECT o_orderkey, a[3] AS last, {T}(a || [9], ',') AS app, {T}(a || b, ',') AS ext, CAST(len(list_filter(a, lambda x: x = 1)) AS INTEGER) AS ones, {T}(a[2:3], ',') AS cut, {T}(a[1:2], ',') AS popped FROM {AB}")
def list_ops(s, d):
    a, b = F.col("a"), F.col("b")
    return arrays(s, d).select("o_orderkey", C.get(a, -1).alias("last"), text(C.append(a, F.lit(9).cast("long"))).alias("app"), text(C.extend(a, b)).alias("ext"), C.count(a, F.lit(1).cast("long")).alias("ones"), text(C.cut(a, 1, 3)).alias("cut"), text(C.pop(a)).alias("popped"))


@query("dict_ops", "SELECT o_orderkey, o_orderkey % 3 AS got, CAST(-1 AS BIGINT) AS missing, o_custkey AS updated FROM orders")
def dict_ops(s, d):
    o = view(s, d).types["orders"]
    m = F.create_map(F.lit("a"), F.col("o_orderkey") % 3, F.lit("b"), F.col("o_orderkey"))
    new = C.dict_update(m, F.create_map(F.lit("b"), F.col("o_custkey")))
    return o.select("o_orderkey", C.dict_get(m, F.lit("a")).alias("got"), C.dict_get(C.dict_pop(m, F.lit("a")), F.lit("a"), F.lit(-1).cast("long")).alias("missing"), C.dict_get(new, F.lit("b")).alias("updated"))


WORDS = "list_transform(regexp_split_to_array(t, '[\\s.,;:\\-!?\"'']+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))"
LABEL = "concat(p_name, '/', p_brand, '_', p_type, ', Żółw''s (', p_size, ').')"


def unique_in_order(x: str) -> str:
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


def tags_of(cut: str, least: int = 1) -> str:
    return f"array_to_string({unique_in_order(f'list_transform(list_filter({WORDS}, lambda w: length(w) >= {least}), lambda w: translate(upper({cut}), {chr(39)}ĄĆĘŁŃÓŚŻŹ{chr(39)}, {chr(39)}ACELNOSZZ{chr(39)}))')}, ',')"


@query("taggify_parts", f"SELECT p_partkey, {tags_of('left(w, 3)')} AS tags, {tags_of('right(w, 4)', 2)} AS ends, {tags_of('w')} AS whole FROM (SELECT p_partkey, {LABEL} AS t FROM part)")
def taggify_parts(s, d):
    """Signs that don't separate words (slash, underscore, brackets) go within them."""
    t = F.concat("p_name", F.lit("/"), "p_brand", F.lit("_"), "p_type", F.lit(", Żółw's ("), "p_size", F.lit(")."))
    tags = lambda **how: F.array_join(taggify(t, **how), ",")
    return view(s, d).types["part"].select("p_partkey", tags().alias("tags"), tags(max_len=4, min_len=2, suffix=True).alias("ends"), tags(max_len=None).alias("whole"))


@query("schema_stats", "SELECT field, CASE type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE 'double' END AS primary_type FROM (SELECT 'p_size' AS field, mode(typeof(p_size)) AS type FROM part WHERE p_size IS NOT NULL UNION ALL SELECT 'p_name', mode(typeof(p_name)) FROM part WHERE p_name IS NOT NULL UNION ALL SELECT 'p_retailprice', mode(typeof(p_retailprice)) FROM part WHERE p_retailprice IS NOT NULL)")
def schema_stats(s, d):
    return A.get_schema(view(s, d).types["part"].select("p_size", "p_name", "p_retailprice")).select("field", "primary_type")


found("find_nothing", "false", lambda v: v.find())
found("find_by_id", "o_orderkey = 5", lambda v: v.find(ORDERS, Ids((5 * 16 + 6, 5 * 16 + 3))))
found("find_serialized", "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')", lambda v: deserialize(v, v.find(ORDERS, "F", ["1-URGENT", "5-LOW"]).serialize()))
found("find_enum_value", "o_orderpriority IN ('1-URGENT', '5-LOW')", lambda v: v.find(ORDERS, [PRIORITY["1-URGENT"].tag, PRIORITY.deserialize(PRIORITY[4].serialize()).tag]))
found("sort_drops_unindexed", "floor(o_totalprice) > 100000 AND o_orderstatus = 'O'", lambda v: View(v.types, v.tag_rows, {"dear": v.indexes["price"].filter("key > 100000")}).sort("dear", v.find(ORDERS, "O")))


@query("slice_then_filter", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 50) WHERE o_totalprice > 1e5")
def slice_then_filter(s, d):
    """The slice is taken first, whichever was asked for first."""
    return keys(view(s, d).find(ORDERS, "F").filter("orders", "o_totalprice > 1e5")[0:50])


@query("sort_duplicates", "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0) GROUP BY 1")
def sort_duplicates(s, d):
    """An object under two keys stands twice."""
    v = view(s, d)
    twice = v.indexes["price"].union(v.types["orders"].filter("o_custkey % 2 = 0").select(F.lit(0).cast("long"), "oid"))
    return View(v.types, v.tag_rows, {"two": twice}).sort("two", v.find(ORDERS, "P")).ids().groupBy(key().alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("query_length", "SELECT 'F' AS tag, count(*) AS n, count(*) > 0 AS some FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'none', 0, false")
def query_length(s, d):
    v = view(s, d)
    return s.createDataFrame([(t, len(q), bool(q)) for t, q in (("F", v.find(ORDERS, "F")), ("none", v.find(ORDERS, "no such tag")))], "tag string, n long, some boolean")


@query("query_contains", "SELECT o_orderkey, o_orderstatus = 'F' AS found FROM orders WHERE o_custkey = 7")
def query_contains(s, d):
    v = view(s, d)
    return v.find(ORDERS, "F").contains(v.find(ORDERS, customer(7)).ids()).select(key().alias("o_orderkey"), "found")


@query("project", "SELECT o_orderkey, o_orderpriority, o_custkey * 2 AS double_key FROM orders WHERE o_orderstatus = 'P'")
def project(s, d):
    v = view(s, d)
    return v.find(ORDERS, "P").project("orders", "o_orderkey", "o_orderpriority", (F.col("o_custkey") * 2).alias("double_key")).drop("oid")


@query("enum_values", "SELECT o_orderkey, CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) - 1 AS INTEGER) AS place FROM orders")
def enum_values(s, d):
    return view(s, d).types["orders"].select("o_orderkey", PRIORITY.index_of(F.col("o_orderpriority")).alias("place"))


@query("object_uuid", "SELECT c_custkey, substr(sha256('customers'), 1, 16) || '-' || lpad(lower(to_hex(c_custkey * 16 + 3)), 16, '0') AS uuid, c_custkey * 16 + 3 AS back FROM customer")
def uuids(s, d):
    u = object_uuid("customers", F.col("oid"))
    return view(s, d).types["customer"].select("c_custkey", u.alias("uuid"), oid_of(u).alias("back"))


@query("reference_counts", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
def reference_counts(s, d):
    return view(s, d).reference_counts("nation").select(key().cast("int").alias("n_nationkey"), "n")


@query("instance_count", "SELECT 'party' AS class, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
def instance_count(s, d):
    return s.createDataFrame([("party", view(s, d).instance_count("party"))], "class string, n long")


@query("class_as_tag", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def class_as_tag(s, d):
    """A class as a tag finds what carries it, not its instances."""
    v = view(s, d)
    marks = v.types["nation"].filter("n_regionkey = 2").select("oid", F.lit("class").alias("kind"), F.lit("").alias("scope"), F.lit("customer").alias("key"))
    return View(v.types, v.tag_rows.unionByName(marks)).find(Tag("customer", "class")).ids().select(key().cast("int").alias("n_nationkey"))


@query("expired", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O'")
def expired(s, d):
    v = view(s, d)
    left = View({"orders": v.types["orders"].filter("o_orderkey % 3 <> 0")}, v.tag_rows)
    return left.expired(v.find(ORDERS, "O").ids()).select(key().alias("o_orderkey"))


@query("span_join", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 300 OR o_orderkey BETWEEN 250 AND 512 OR o_orderkey = 900")
def span_join(s, d):
    spans = s.createDataFrame([(10 * 16, 300 * 16 + 15), (250 * 16, 512 * 16 + 15), (900 * 16, 900 * 16 + 15), (5, 1), (None, 9)], "first long, last long")
    return in_spans(view(s, d).types["orders"].select("oid"), spans).select(key().alias("o_orderkey"))


@query("group_function", "SELECT CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS key_1, o_orderstatus AS key_2, count(*) AS count FROM orders GROUP BY 1, 2")
def group_function(s, d):
    v = view(s, d)
    by_price = A.Key(lambda r: "dear" if r.o_totalprice > 150000 else "cheap", "string", ("o_totalprice",))
    return A.group_by(v, [by_price, "o_orderstatus"], v.find(ORDERS), "orders")


@query("group_nearest", f"SELECT event_type AS key_1, count(*) AS count FROM {last_events(20)} WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def group_nearest(s, d):
    """A query's result from that of one that differs by a tag, at an earlier state."""
    fast = A.FastQuery()
    a, b = history(s, d, 10), history(s, d, 20)
    fast.group_by(a, ["event_type"], a.find(["click", "view", "error", "purchase"]), "users")
    return fast.group_by(b, ["event_type"], b.find(["click", "view", "error"]), "users")


@query("group_cache_prefix", f"SELECT event_type AS key_1, count(*) AS count, CAST(sum(event_id) AS BIGINT) AS ids FROM {last_events(20)} GROUP BY 1")
def group_cache_prefix(s, d):
    """A result kept in a folder is brought up to date by another session's cache."""
    path, ops = scratch_path(s, "kept"), [A.count_op, A.make_sum("event_id", "ids")]
    for day in (10, 20):
        v = history(s, d, day)
        out = A.FastQuery(s, path).group_by(v, ["event_type"], v.find(Type("users")), "users", ops)
    return out


@query("tuple_ops", f"SELECT o_orderkey, a[1] AS first, CAST(len(a) AS INTEGER) AS size, CAST(len(list_filter(a, lambda x: x = 7)) AS INTEGER) AS sevens, CAST(list_position(a, 7) - 1 AS INTEGER) AS at, a = [0, 0, 7] AS same FROM {AB}")
def tuple_ops(s, d):
    a, seven = F.col("a"), F.lit(7).cast("long")
    zero = F.lit(0).cast("long")
    return arrays(s, d).select("o_orderkey", C.get(a, 0).alias("first"), F.size(a).alias("size"), C.count(a, seven).alias("sevens"), C.index(a, seven).cast("int").alias("at"), C.compare(a, F.array(zero, zero, seven)).alias("same"))


@query("weak_set_ops", f"SELECT o_orderkey, {T}(list_sort(list_distinct(a || [11])), ',') AS added, {T}(list_sort(list_filter(list_distinct(a), lambda x: x <> 7)), ',') AS without, {T}(list_sort(list_filter(list_distinct(a), lambda x: x IN (1, 7))), ',') AS live FROM {AB}")
def weak_set_ops(s, d):
    a, n = C.set_of(F.col("a")), lambda x: F.lit(x).cast("long")
    return arrays(s, d).select("o_orderkey", text(C.add(a, n(11))).alias("added"), text(C.discard(a, n(7))).alias("without"), text(C.live(a, F.array(n(1), n(7)))).alias("live"))


@query("bytes_ops", "SELECT n_nationkey, lower(hex(encode(n_name)) || '21') AS app, lower(hex(encode(substr(n_name, 1, 2) || '--' || substr(n_name, 3)))) AS ins, CAST(length(n_name) - length(replace(n_name, 'A', '')) AS INTEGER) AS n_a, CAST(ascii(substr(n_name, 1, 1)) AS INTEGER) AS first, CAST(ascii(right(n_name, 1)) AS INTEGER) AS last FROM nation")
def bytes_ops(s, d):
    b = F.col("n_name").cast("binary")
    low = lambda c: F.lower(F.hex(c))
    return view(s, d).types["nation"].select("n_nationkey", low(C.bytes_append(b, 33)).alias("app"), low(C.bytes_insert(b, 2, F.lit("--").cast("binary"))).alias("ins"), C.bytes_count(b, b"A").alias("n_a"), C.bytes_get(b, 0).alias("first"), C.bytes_get(b, -1).alias("last"))


@query("content_compare", "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 2 = b.s_suppkey % 2")
def content_compare(s, d):
    """Pairs of one nation with equal contents (here: parity) and tags."""
    t = view(s, d).types["supplier"].select("s_suppkey", "s_nationkey", F.struct((F.col("s_suppkey") % 2).alias("odd"), F.lit(None).alias("none")).alias("own"), F.array(F.lit("b"), F.lit("a")).alias("tags"))
    both = t.alias("a").join(t.withColumn("tags", F.reverse("tags")).alias("b"), "s_nationkey").filter("a.s_suppkey < b.s_suppkey")
    return both.filter(C.compare(F.col("a.own"), F.col("b.own"), F.col("a.tags"), F.col("b.tags"))).select(F.col("a.s_suppkey").alias("s_suppkey"), F.col("b.s_suppkey").alias("other"))


# over a prefix of five states (see fixtures.stored)

CENT = "CAST(round(s_acctbal * 100) AS BIGINT)"
LEFT = "s_suppkey % 5 <> 0"


def by_key(df: DataFrame) -> DataFrame:
    return df.select(F.col("oid").alias("s_suppkey"))


@query("prefix_scan", f"SELECT s_suppkey, s_name AS name, s_nationkey::BIGINT AS country, {CENT} AS cents, CASE WHEN s_suppkey % 3 = 0 THEN 'gold' END AS status FROM supplier WHERE {LEFT}")
def prefix_scan(s, d):
    """After deletions, assignments and a renamed field."""
    return stored(s, d).find(Type("supplier")).project("supplier", "name", "country", "cents", "status").withColumnRenamed("oid", "s_suppkey")


@query("prefix_tags", f"SELECT s_suppkey FROM supplier WHERE {CENT} > 500000 AND s_suppkey % 4 <> 0 AND s_suppkey % 2 = 0 AND {LEFT}")
def prefix_tags(s, d):
    return by_key(stored(s, d).find(Type("supplier"), "rich", "even").ids())


@query("prefix_index", f"SELECT s_suppkey FROM supplier WHERE s_nationkey BETWEEN 3 AND 12 AND {LEFT}")
def prefix_index(s, d):
    return by_key(stored(s, d).snapshot().select("nation", 3, 12).ids())


@query("prefix_index_len", f"SELECT 'nation' AS name, count(*) AS n FROM supplier WHERE {LEFT}")
def prefix_index_len(s, d):
    return s.createDataFrame([("nation", stored(s, d).index_len("nation"))], "name string, n long")


@query("prefix_earlier", "SELECT s_suppkey, s_nationkey::BIGINT AS nation FROM supplier")
def prefix_earlier(s, d):
    """State 2 has all suppliers, and the field under its old name."""
    v = stored(s, d).snapshot(2)
    return v.find(Type("supplier")).project("supplier", "nation").withColumnRenamed("oid", "s_suppkey")


@query("prefix_deleted", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0")
def prefix_deleted(s, d):
    with D.SnapshotWindow(stored(s, d), 2, 5) as (before, after):
        return by_key(D.select_deleted(after.find(Type("supplier")), before, after))


@query("prefix_touched", f"SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 1 AND {LEFT}")
def prefix_touched(s, d):
    """A touched object has a newer version of equal contents."""
    with D.SnapshotWindow(stored(s, d), 3, 4) as (before, after):
        return by_key(D.select_modified(after.find(Type("supplier")), before, after, "supplier").filter("old.cents = new.cents"))


@query("prefix_fetch", f"SELECT s_suppkey, s_name AS name, {CENT} AS cents FROM supplier WHERE s_suppkey = 7")
def prefix_fetch(s, d):
    row = stored(s, d).load("supplier", 7, exclude=["country", "status", "version"])
    return s.createDataFrame([(row["oid"], row["name"], row["cents"])], "s_suppkey long, name string, cents long")


@query("prefix_load_all", f"SELECT s_suppkey, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0 AND {LEFT} AND {CENT} > 500000 AND s_suppkey % 4 <> 0 AND s_suppkey < 100")
def prefix_load_all(s, d):
    p = stored(s, d)
    q = p.find(Type("supplier"), "rich").filter("supplier", "status = 'gold' and oid < 100")
    return s.createDataFrame([(r["oid"], r["name"]) for r in p.load_all(q, "supplier", exclude=["cents"])], "s_suppkey long, name string")


@query("prefix_exists", "SELECT s_suppkey, s_suppkey % 5 <> 0 AS there FROM supplier WHERE s_suppkey IN (4, 5)")
def prefix_exists(s, d):
    return s.createDataFrame([(k, stored(s, d).exists("supplier", k)) for k in (4, 5)], "s_suppkey long, there boolean")


@query("prefix_singleton", "SELECT 'dark' AS theme, false AS other FROM region WHERE r_regionkey = 0")
def prefix_singleton(s, d):
    p = stored(s, d)
    return s.createDataFrame([(p.find_singleton("settings")["theme"], p.find_singleton("nothing") is not None)], "theme string, other boolean")


@query("prefix_states", "SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS state, unnest([(SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0), 0, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 1) + (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0), 0]) AS n_rows")
def prefix_states(s, d):
    """Rows of change of suppliers by state; the prefix's states, one of them without any."""
    p = stored(s, d)
    states = s.range(1, p.get_state_num() + 1).withColumnRenamed("id", "state")
    return states.join(p.stats().filter("table = 'objects_supplier'"), "state", "left").select("state", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("prefix_copy", f"SELECT s_suppkey FROM supplier WHERE {LEFT} AND s_suppkey % 2 = 0")
def prefix_copy(s, d):
    """Read from a copy, opened for reading, beside its original in the workspace's catalog."""
    ws, name = stored(s, d).ws, f"copy-{uuid.uuid4().hex}"
    ws.copy_prefix("suppliers", name)
    assert {"suppliers", name} <= set(ws.get_prefixes())
    return by_key(ws.open(name, "r").find(Type("supplier"), "even").ids())


@query("prefix_describe", "SELECT * FROM (VALUES ('name', 'string'), ('cents', 'bigint'), ('status', 'string'), ('country', 'bigint'), ('theme', 'string')) t(attribute, type)")
def prefix_describe(s, d):
    return stored(s, d).describe().select("attribute", "type")


@query("prefix_atomic", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 2) OR s_suppkey = 6")
def prefix_atomic(s, d):
    """Nested atomic changes: the cancelled and the failed ones go, the others are published together; the log tells."""
    p = stored(s, d).ws.open(f"atomic-{uuid.uuid4().hex}")
    ids = lambda *x: s.createDataFrame([(i,) for i in x], "oid long")
    with p.locked() as log:
        with p.atomic():
            p.put("thing", ids(1, 2))
            with p.atomic() as inner:
                p.put("thing", ids(3))
                inner.cancel()
            try:
                with p.atomic():
                    p.put("thing", ids(4))
                    raise KeyError
            except KeyError:
                p.put("thing", ids(6))
        state = p.commit()
    assert log == [(p.name, state)] and p.wait(state, 1) and not p.wait(state + 1, 0)
    return by_key(p.find(Type("thing")).ids())

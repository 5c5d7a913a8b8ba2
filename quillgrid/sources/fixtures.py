"""The driver's tables as tagged objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import View
from .prefix import Prefix, Workspace
from .scratch import scratch_path

#: Ids are key * 16 + the type's code, so that they differ between types.
CODES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6, "users": 7}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def oid(key: str, kind: str) -> Column:
    return F.col(key).cast("long") * 16 + CODES[kind]


def view(spark: SparkSession, sf_dir: str) -> View:
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in KEYS}
    objects = {t: df.withColumn("oid", oid(KEYS[t], t)) for t, df in raw.items()}

    def tags(t: str, col: str, kind: str = "str", to: str | None = None, scope: str = "") -> DataFrame:
        key = oid(col, to).cast("string") if to else F.concat(F.lit("Priority."), F.col(col)) if kind == "enum" else F.col(col)
        return objects[t].select("oid", F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), key.alias("key"))

    rows = [
        tags("orders", "o_orderstatus"), tags("orders", "o_orderpriority"), tags("orders", "o_orderpriority", "enum"), tags("orders", "o_orderstatus", "field", None, "status"),
        tags("customer", "c_mktsegment"), tags("part", "p_brand"), tags("part", "p_type"),
        tags("orders", "o_custkey", "obj", "customer"), tags("customer", "c_nationkey", "obj", "nation"), tags("supplier", "s_nationkey", "obj", "nation"), tags("nation", "n_regionkey", "obj", "region"),
    ]
    o = objects["orders"]
    indexes = {
        "price": o.select(F.floor("o_totalprice").cast("long").alias("key"), "oid"),
        "custmod": o.select(F.nullif(F.col("o_custkey") % 10, F.lit(0)).cast("long").alias("key"), "oid"),
        "date": o.select(F.col("o_orderdate").alias("key"), "oid"),
        "size": objects["part"].select(F.col("p_size").cast("long").alias("key"), "oid"),
    }
    by_code = {c: t for t, c in CODES.items()}
    return View(objects, reduce(DataFrame.unionByName, rows), indexes, {"customer": "party", "supplier": "party"}, name=sf_dir, type_of=lambda x: by_code.get(x % 16))


def history(spark: SparkSession, sf_dir: str, state: int | None = None) -> View:
    """Users as of a day: a user's version is their last event up to it, tagged with its type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.dayofmonth("ts").cast("long"))
    e = e if state is None else e.filter(F.col("day") <= state)
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value", "day"), F.struct("ts", "event_id")).alias("v"))
    users = last.select((F.col("user_id") * 16 + CODES["users"]).alias("oid"), "user_id", "v.event_id", "v.event_type", "v.value", F.col("v.event_id").alias("version"))
    tags = users.select("oid", F.lit("str").alias("kind"), F.lit("").alias("scope"), F.col("event_type").alias("key"))
    return View({"users": users}, tags, {}, {}, lambda s: history(spark, sf_dir, s), state, f"{sf_dir}/users")


_stored: dict[tuple, Prefix] = {}


def stored(spark: SparkSession, sf_dir: str) -> Prefix:
    """Suppliers and a singleton in a prefix of five states, written once a session in the shared folder.

    1: suppliers (key, nation, balance in cents), tagged rich above 500000 cents, indexed by nation.  2: those of a key
    divisible by 3 get status gold.  3: those divisible by 4 lose rich, even ones gain even.  4: those divisible by 5 are
    deleted and leave the index, those one above a multiple of 7 are touched.  5: nation is renamed to country, settings
    is stored.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _stored:
        return _stored[key]
    p = Workspace(spark, scratch_path(spark, "workspace")).open("suppliers")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("oid"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"), F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    of = lambda where: rows.filter(where).select("oid")
    p.put("supplier", rows.withColumn("status", F.lit(None).cast("string")))
    p.tag(of("cents > 500000"), "rich")
    p.index("nation", rows.select(F.col("nation").alias("key"), "oid"))
    p.commit()
    p.assign("supplier", of("oid % 3 = 0"), status="gold")
    p.commit()
    p.tag(of("oid % 4 = 0"), "rich", remove=True)
    p.tag(of("oid % 2 = 0"), "even")
    p.commit()
    p.touch("supplier", of("oid % 7 = 1"))
    p.delete("supplier", of("oid % 5 = 0"))
    p.index("nation", rows.filter("oid % 5 = 0").select(F.col("nation").alias("key"), "oid"), remove=True)
    p.commit()
    p.rename_field("supplier", "nation", "country")
    p.put("settings", spark.createDataFrame([(1 << 40, "dark")], "oid long, theme string"))
    p.commit()
    _stored[key] = p
    return p

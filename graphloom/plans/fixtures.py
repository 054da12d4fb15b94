"""Graphs and logs made from the test tables, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions.hashing import FIRST, SECOND, STEP
from graphloom.operators.graph import Graph
from graphloom.plans.staging import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts on consecutive lines of an order; the weight is the least quantity."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("a"), "l_quantity")
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where("a <> b")
    edges = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("l_quantity").alias("weight"))
    return Graph(edges.select(F.explode(F.array("lo", "hi")).alias("id")).distinct(), edges)


def placed(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (twice their key) and the orders that they placed (twice the key and one): many components, and
    customers without any order; the weight is the order's price."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).cast("long").alias("a"), (F.col("o_orderkey") * 2 + 1).cast("long").alias("b"), "o_totalprice")
    edges = orders.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("o_totalprice").cast("double").alias("weight"))
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("long").alias("id"))
    return Graph(customers.union(orders.select(F.explode(F.array("a", "b")))).distinct(), edges)


def written(lines: DataFrame, parts: int | None = None) -> str:
    """Lines of text (one column) written to the shared folder; where they are."""
    path = f"{shared_dir(lines.sparkSession)}/graphloom/lines-{uuid.uuid4().hex}"
    (lines.coalesce(parts) if parts else lines).write.text(path)
    return path


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "D").otherwise("U")
    dst = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("src"), dst.alias("dst"), F.col("value").alias("weight"))


ADJ = "adj as (select lo src, hi dst, weight from und union all select hi, lo, weight from und), deg as (select v.id, count(adj.src) degree from v left join adj on v.id = adj.src group by 1)"
#: CTEs und, v and adj of the co-purchase graph, and of that of customers and orders.
UND = f"""und as (select least(a.l_partkey, b.l_partkey) lo, greatest(a.l_partkey, b.l_partkey) hi, min(a.l_quantity) weight
 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_partkey <> b.l_partkey group by 1, 2),
 v as (select lo id from und union select hi from und), {ADJ}"""
PLACED_SQL = f"""und as (select least(2 * o_custkey, 2 * o_orderkey + 1) lo, greatest(2 * o_custkey, 2 * o_orderkey + 1) hi, o_totalprice::double weight from orders),
 v as (select 2 * c_custkey id from customer union select lo from und union select hi from und), {ADJ}"""
LOG = """log as (select event_id seq, case when event_type = 'error' then 'D' else 'U' end op, user_id src, cast(json_extract_string(props, '$.k') as bigint) dst, value weight from events),
 plog as (select *, least(src, dst) lo, greatest(src, dst) hi from log where src <> dst)"""


def snap_sql(version: str = "(select max(seq) from log)") -> str:
    """CTEs und, v and adj of the log as of a version."""
    return f"""{LOG}, und as (select lo, hi, arg_max(weight, seq) weight, max(seq) seq from plog where seq <= {version} group by 1, 2 having arg_max(op, seq) = 'U'),
 v as (select src id from plog where op = 'U' and seq <= {version} union select dst from plog where op = 'U' and seq <= {version}), {ADJ}"""


def hash_sql(seed: int, *keys: str) -> str:
    """The seeded hash in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(keys)})), 1, 15))::bigint"


def mix_sql(name: str, source: str, x: str) -> str:
    """CTEs up to ``name``: the rows of ``source`` with ``mixed``, the 64-bit mixture of ``x``, in wider integers."""
    m = "18446744073709551616::uhugeint"
    return (
        f"{name}_0 as (select *, (({x})::uhugeint + {STEP}::uhugeint) % {m} m0 from {source}), {name}_1 as (select *, (xor(m0, m0 >> 30) * {FIRST}::uhugeint) % {m} m1 from {name}_0), "
        f"{name}_2 as (select *, (xor(m1, m1 >> 27) * {SECOND}::uhugeint) % {m} m2 from {name}_1), {name} as (select * exclude (m0, m1, m2), xor(m2, m2 >> 31) mixed from {name}_2)"
    )

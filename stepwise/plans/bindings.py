"""Bind the generic roles to concrete tables.

Each binding returns a DataFrame whose columns carry role names
(``entity, epoch, step, seq, segment, target`` ...) so the operators can run on
it unchanged.  The same derivations are available as DuckDB SQL CTEs
(``*_CTE``) for the oracle checks.

Derivations (all integer-exact so that every engine agrees):

* ``events``   entity=user_id, epoch=ISO week, step=day of year,
  seq=event_id, segment=event_type, target=value.
* ``orders``   entity=c_nationkey, epoch=year, step=month, seq=o_orderkey,
  segment=c_mktsegment, target=o_totalprice.
* ``fact``     one row per (supplier, order) = (entity, fixture):
  epoch=year(o_orderdate), step=month, side=supplier nation,
  other_side=customer nation, is_home = both nations in one region,
  segment = supplier region, target = total quantity; counting stats derived
  from flags of the lines.  Fixture scores: lines with status O (home) / F (away).
* ``matches``  one row per (epoch, step, side, other_side) two-sided match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.roles import Roles

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

EVENT_ROLES = Roles(entity="entity", epoch="epoch", step="step", seq="seq",
                    segment="segment", target="target")
ORDER_ROLES = EVENT_ROLES
FACT_ROLES = Roles(entity="entity", epoch="epoch", step="step", seq="fixture",
                   segment="segment", target="points", side="side",
                   other_side="other_side", is_home="is_home", fixture="fixture")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------- events
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("entity"),
        F.weekofyear("ts").alias("epoch"),
        F.dayofyear("ts").alias("step"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("segment"),
        F.col("value").alias("target"),
        "ts", "props",
    )


EVENTS_CTE = """ev AS (
  SELECT user_id AS entity, CAST(weekofyear(ts) AS INTEGER) AS epoch,
         CAST(dayofyear(ts) AS INTEGER) AS step, event_id AS seq,
         event_type AS segment, value AS target, ts, props
  FROM events)"""


# --------------------------------------------------------------------- orders
def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("c_nationkey").alias("entity"),
                    F.year("o_orderdate").alias("epoch"),
                    F.month("o_orderdate").alias("step"),
                    F.col("o_orderkey").alias("seq"),
                    F.col("c_mktsegment").alias("segment"),
                    F.col("o_totalprice").alias("target"),
                    "o_custkey", "o_orderstatus", "o_orderpriority"))


ORDERS_CTE = """od AS (
  SELECT c_nationkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS epoch,
         CAST(month(o_orderdate) AS INTEGER) AS step, o_orderkey AS seq,
         c_mktsegment AS segment, o_totalprice AS target,
         o_custkey, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# ----------------------------------------------------------------------- fact
#: Lines that one task of the fact build takes; the number of tasks follows the rows.
LINES_PER_TASK = 500_000


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, built once per application and partitioned by epoch."""
    from stepwise.session import materialized
    return materialized(spark, ("fact", sf_dir), lambda: build_fact(spark, sf_dir), ["epoch"])


def build_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity x fixture fact (the star schema's central table)."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    # nation and region have a fixed size (25 / 5 rows) -> safe to broadcast.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    is_r = F.col("l_returnflag") == "R"
    is_a = F.col("l_returnflag") == "A"
    is_o = F.col("l_linestatus") == "O"
    is_f = F.col("l_linestatus") == "F"
    # One hash partitioning on the order key serves the (order, supplier)
    # aggregate, the per-order score window and the join with orders, so
    # lineitem is shuffled once (keys are near-unique, so no partial
    # aggregation is lost by shuffling before the aggregate).  The count is read off
    # the file footers: a task sorts so many lines, however large the table.
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // LINES_PER_TASK))
    lines = li.join(p, li.l_partkey == p.p_partkey).repartition(tasks, "l_orderkey")
    pts = (lines.groupBy("l_orderkey", "l_suppkey")
           .agg(F.sum("l_quantity").cast("bigint").alias("points"),
                F.least(F.lit(90), F.sum(F.round(F.col("l_discount") * 100).cast("bigint") * 9)).alias("minutes"),
                F.count_if(is_r).alias("goals"),
                F.count_if(is_a).alias("assists"),
                F.count_if(F.col("l_quantity") >= 40).alias("bonus"),
                F.count_if(is_o).alias("yellow"),
                F.count_if(is_o & is_r & (F.col("l_quantity") > 45)).alias("red"),
                F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("saves"),
                (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.lit(10.0)).alias("xg"),
                F.floor(F.max("p_retailprice") / 10).cast("bigint").alias("price"),
                F.count_if(F.col("l_returnflag") == "N").alias("transfers_in"),
                F.count_if(is_f).alias("transfers_out")))
    per_order = Window.partitionBy("l_orderkey")
    pts = (pts.withColumn("home_score", F.sum("yellow").over(per_order))
              .withColumn("away_score", F.sum("transfers_out").over(per_order)))
    ns = F.broadcast(n.select(F.col("n_nationkey").alias("sn"), F.col("n_regionkey").alias("sr")))
    nc = F.broadcast(n.select(F.col("n_nationkey").alias("cn"), F.col("n_regionkey").alias("cr")))
    rr = F.broadcast(r)
    # orders take their customer first: the small side is exchanged, not the fact
    placed = o.join(c, o.o_custkey == c.c_custkey)
    return (pts.join(placed, pts.l_orderkey == placed.o_orderkey)
            .join(s, pts.l_suppkey == s.s_suppkey)
            .join(ns, F.col("s_nationkey") == F.col("sn"))
            .join(nc, F.col("c_nationkey") == F.col("cn"))
            .join(rr, F.col("sr") == F.col("r_regionkey"))
            .select(F.col("l_suppkey").alias("entity"),
                    F.col("l_orderkey").alias("fixture"),
                    F.year("o_orderdate").alias("epoch"),
                    F.month("o_orderdate").alias("step"),
                    F.col("s_nationkey").alias("side"),
                    F.col("c_nationkey").alias("other_side"),
                    (F.col("sr") == F.col("cr")).cast("int").alias("is_home"),
                    F.col("r_name").alias("segment"),
                    "points", "minutes", "goals", "assists", "bonus", "yellow", "red",
                    "saves", "xg", "price",
                    F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("selected"),
                    "transfers_in", "transfers_out", "home_score", "away_score"))


FACT_CTE = """fpts AS (
  SELECT l_orderkey, l_suppkey,
         CAST(sum(l_quantity) AS BIGINT) AS points,
         CAST(least(90, sum(CAST(round(l_discount * 100) AS BIGINT) * 9)) AS BIGINT) AS minutes,
         count(*) FILTER (WHERE l_returnflag = 'R') AS goals,
         count(*) FILTER (WHERE l_returnflag = 'A') AS assists,
         count(*) FILTER (WHERE l_quantity >= 40) AS bonus,
         count(*) FILTER (WHERE l_linestatus = 'O') AS yellow,
         count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R' AND l_quantity > 45) AS red,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS saves,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / 10.0 AS xg,
         CAST(floor(max(p_retailprice) / 10) AS BIGINT) AS price,
         count(*) FILTER (WHERE l_returnflag = 'N') AS transfers_in,
         count(*) FILTER (WHERE l_linestatus = 'F') AS transfers_out
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey, l_suppkey),
fscore AS (
  SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS home_score,
         count(*) FILTER (WHERE l_linestatus = 'F') AS away_score
  FROM lineitem GROUP BY l_orderkey),
fact AS (
  SELECT p.l_suppkey AS entity, p.l_orderkey AS fixture,
         CAST(year(o_orderdate) AS INTEGER) AS epoch, CAST(month(o_orderdate) AS INTEGER) AS step,
         s_nationkey AS side, c_nationkey AS other_side,
         CAST(ns.n_regionkey = nc.n_regionkey AS INTEGER) AS is_home,
         r_name AS segment,
         points, minutes, goals, assists, bonus, yellow, red, saves, xg, price,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS selected,
         transfers_in, transfers_out, home_score, away_score
  FROM fpts p JOIN fscore sc ON p.l_orderkey = sc.l_orderkey
  JOIN orders ON p.l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON p.l_suppkey = s_suppkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN region ON ns.n_regionkey = r_regionkey)"""


# -------------------------------------------------------------------- matches
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepwise.session import materialized
    return materialized(spark, ("matches", sf_dir), lambda: build_matches(spark, sf_dir))


def build_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided matches: supplier nation (home) v customer nation (away) per
    month; home score = lines with status O, away = lines with status F.

    Derived from the materialised fact (whose ``yellow`` / ``transfers_out``
    count exactly those lines per supplier and order), so the raw tables are
    not joined a second time.
    """
    return (fact(spark, sf_dir)
            .groupBy("epoch", "step", F.col("side").alias("home_side"), F.col("other_side").alias("away_side"))
            .agg(F.sum("yellow").alias("home_score"), F.sum("transfers_out").alias("away_score")))


MATCHES_CTE = """mt AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS epoch, CAST(month(o_orderdate) AS INTEGER) AS step,
         s_nationkey AS home_side, c_nationkey AS away_side,
         count(*) FILTER (WHERE l_linestatus = 'O') AS home_score,
         count(*) FILTER (WHERE l_linestatus = 'F') AS away_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3, 4)"""

"""Data-quality audit over the driver tables (DQ0-DQ18)."""

from pyspark.sql import functions as F

from stepwise.catalog import FACT_CTE, ORDERS_CTE, register, with_ctes
from stepwise.operators import quality as Q
from stepwise.plans import bindings as B


def _c(name):
    return F.col(name)


#: Rules of single fact rows: id -> (name, Spark condition of a violation, the same in SQL).
ROW_RULES = {
    "DQ3": ("no null fact keys", lambda: _c("entity").isNull() | _c("fixture").isNull() | _c("epoch").isNull() | _c("step").isNull(),
            "entity IS NULL OR fixture IS NULL OR epoch IS NULL OR step IS NULL"),
    "DQ8a": ("no red cards before 1996", lambda: (_c("epoch") < 1996) & F.nullif("red", F.lit(0)).isNotNull(),
             "epoch < 1996 AND nullif(red, 0) IS NOT NULL"),
    "DQ8b": ("no saves before 1996", lambda: (_c("epoch") < 1996) & F.nullif("saves", F.lit(0)).isNotNull(),
             "epoch < 1996 AND nullif(saves, 0) IS NOT NULL"),
    "DQ10a": ("no negative points", lambda: _c("points") < 0, "points < 0"),
    "DQ10b": ("minutes at most 90", lambda: _c("minutes") > 90, "minutes > 90"),
    "DQ10c": ("red implies yellow", lambda: (_c("red") > 0) & (_c("yellow") == 0), "red > 0 AND yellow = 0"),
    "DQ10d": ("price within band", lambda: ~_c("price").between(90, 99), "NOT (price BETWEEN 90 AND 99)"),
    "DQ10e": ("minutes not negative", lambda: _c("minutes") < 0, "minutes < 0"),
    "DQ10f": ("goals need minutes", lambda: (_c("goals") > 0) & (_c("minutes") == 0), "goals > 0 AND minutes = 0"),
    "DQ10g": ("assists need minutes", lambda: (_c("assists") > 0) & (_c("minutes") == 0), "assists > 0 AND minutes = 0"),
    "DQ10h": ("bonus at most 3", lambda: ~_c("bonus").between(0, 3), "NOT (bonus BETWEEN 0 AND 3)"),
    "DQ10i": ("at most one red", lambda: ~_c("red").between(0, 1), "NOT (red BETWEEN 0 AND 1)"),
    "DQ10j": ("home flag is 0 or 1", lambda: ~F.coalesce(_c("is_home").isin(0, 1), F.lit(False)), "NOT coalesce(is_home IN (0, 1), false)"),
    "DQ10k": ("no negative ownership", lambda: _c("selected") < 0, "selected < 0"),
    "DQ10l": ("no side meets itself", lambda: _c("side") == _c("other_side"), "side = other_side"),
}


def _rules(spark, sf):
    f = B.fact(spark, sf)
    od = B.orders(spark, sf)
    li = B.table(spark, sf, "lineitem")
    o = B.table(spark, sf, "orders")
    c = B.table(spark, sf, "customer")
    s = B.table(spark, sf, "supplier")
    n = B.table(spark, sf, "nation")
    dim_epochs = od.select("epoch").distinct()
    li_q = li.join(o.select("o_orderkey", "o_orderdate"), li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("entity"), F.year("o_orderdate").alias("epoch"), "l_quantity")
    latest = f.groupBy().agg(F.max("epoch").alias("_m"))
    f_hist = f.join(F.broadcast(latest), F.col("epoch") < F.col("_m"))
    li_hist = li_q.join(F.broadcast(latest), F.col("epoch") < F.col("_m"))
    step_pairs = f.groupBy("entity", "epoch", "step").agg(F.max("price").alias("price"))
    nxt = step_pairs.select("entity", "epoch", (F.col("step") - 1).alias("step"), F.col("price").alias("pn"))
    jumps = step_pairs.join(nxt, ["entity", "epoch", "step"])
    R = Q.Rule
    return [
        R("DQ1a", "no empty epoch", lambda: Q.empty_groups(dim_epochs, f, "epoch")),
        R("DQ1b", "order rows in range", lambda: Q.total_in_range(o, 1, 10 ** 12)),
        R("DQ2a", "lineitem orders exist", lambda: Q.orphan_count(li, o, ["l_orderkey"], ["o_orderkey"])),
        R("DQ2b", "order customers exist", lambda: Q.orphan_count(o, c, ["o_custkey"], ["c_custkey"])),
        R("DQ4", "five nations per region", lambda: Q.group_cardinality(n, ["n_regionkey"], "n_nationkey", 5)),
        R("DQ5", "points reconcile with lines", lambda: Q.sums_disagree(
            li_hist, f_hist, ["entity", "epoch"], "l_quantity", "points", 5)),
        R("DQ6", "fact rows agree with order lines within 1", lambda: Q._count(
            li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_a")).join(
                f.groupBy(F.col("fixture").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("_b")), "l_orderkey"),
            F.abs(F.col("_a") - F.col("_b")) > 1)),
        R("DQ7", "twelve steps per epoch", lambda: Q.step_range(f, ["epoch"], "step", 1, 12)),
        R("DQ9a", "fact sides exist", lambda: Q.orphan_count(f, n, ["side"], ["n_nationkey"])),
        R("DQ9b", "fact opponents exist", lambda: Q.orphan_count(f, n, ["other_side"], ["n_nationkey"])),
        R("DQ9c", "fact entities exist", lambda: Q.orphan_count(f, s, ["entity"], ["s_suppkey"])),
        R("DQ9d", "fact fixtures exist", lambda: Q.orphan_count(f, o, ["fixture"], ["o_orderkey"])),
        R("DQ14", "one score per fixture", lambda: Q.distinct_per_group(
            f, ["fixture"], F.struct("home_score", "away_score"), 1)),
        R("DQ15", "price jumps below 5", lambda: Q._count(jumps, F.abs(F.col("pn") - F.col("price")) >= 5)),
        R("DQ17", "customer id maps to one nation", lambda: Q.many_to_one_violations(
            od, ["o_custkey"], "entity")),
        R("DQ18a", "entity in one side per epoch", lambda: Q.many_to_one_violations(
            f, ["entity", "epoch"], "side")),
        R("DQ18b", "fact side matches dimension", lambda: Q._count(
            f.join(s, f.entity == s.s_suppkey), F.col("side") != F.col("s_nationkey"))),
    ]


_DQ_SQL = with_ctes("""
latest AS (SELECT max(epoch) AS m FROM fact),
liq AS (SELECT l_suppkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS epoch, l_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sp AS (SELECT entity, epoch, step, max(price) AS price FROM fact GROUP BY ALL),
checks AS (
  SELECT 'DQ1a' AS rule_id, 'no empty epoch' AS name,
    (SELECT count(*) FROM (SELECT DISTINCT epoch FROM od) d WHERE NOT EXISTS (SELECT 1 FROM fact WHERE fact.epoch = d.epoch)) AS violations,
    NULL AS detail
  UNION ALL SELECT 'DQ1b', 'order rows in range', CASE WHEN (SELECT count(*) FROM orders) BETWEEN 1 AND 1000000000000 THEN 0 ELSE 1 END,
    'rows=' || (SELECT count(*) FROM orders)
  UNION ALL SELECT 'DQ2a', 'lineitem orders exist', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)), NULL
  UNION ALL SELECT 'DQ2b', 'order customers exist', (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)), NULL
  UNION ALL SELECT 'DQ4', 'five nations per region', (SELECT count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) <> 5)), NULL
  UNION ALL SELECT 'DQ5', 'points reconcile with lines', (SELECT count(*) FROM
      (SELECT entity, epoch, sum(l_quantity) AS a FROM liq WHERE epoch < (SELECT m FROM latest) GROUP BY ALL) x
      LEFT JOIN (SELECT entity, epoch, sum(points) AS b FROM fact WHERE epoch < (SELECT m FROM latest) GROUP BY ALL) y USING (entity, epoch)
      WHERE abs(a - coalesce(b, 0)) > 5), NULL
  UNION ALL SELECT 'DQ6', 'fact rows agree with order lines within 1', (SELECT count(*) FROM
      (SELECT l_orderkey, count(*) AS a FROM lineitem GROUP BY 1) x JOIN (SELECT fixture AS l_orderkey, count(*) AS b FROM fact GROUP BY 1) y
      USING (l_orderkey) WHERE abs(a - b) > 1), NULL
  UNION ALL SELECT 'DQ7', 'twelve steps per epoch', (SELECT count(*) FROM (SELECT epoch FROM fact GROUP BY 1 HAVING min(step) <> 1 OR max(step) <> 12)), NULL
  UNION ALL SELECT 'DQ9a', 'fact sides exist', (SELECT count(*) FROM fact WHERE side NOT IN (SELECT n_nationkey FROM nation)), NULL
  UNION ALL SELECT 'DQ9b', 'fact opponents exist', (SELECT count(*) FROM fact WHERE other_side NOT IN (SELECT n_nationkey FROM nation)), NULL
  UNION ALL SELECT 'DQ9c', 'fact entities exist', (SELECT count(*) FROM fact WHERE entity NOT IN (SELECT s_suppkey FROM supplier)), NULL
  UNION ALL SELECT 'DQ9d', 'fact fixtures exist', (SELECT count(*) FROM fact WHERE fixture NOT IN (SELECT o_orderkey FROM orders)), NULL
  UNION ALL SELECT 'DQ14', 'one score per fixture', (SELECT count(*) FROM (SELECT fixture FROM fact GROUP BY 1 HAVING count(DISTINCT (home_score, away_score)) <> 1)), NULL
  UNION ALL SELECT 'DQ15', 'price jumps below 5', (SELECT count(*) FROM sp a JOIN sp b ON a.entity = b.entity AND a.epoch = b.epoch AND b.step = a.step + 1 WHERE abs(b.price - a.price) >= 5), NULL
  UNION ALL SELECT 'DQ17', 'customer id maps to one nation', (SELECT count(*) FROM (SELECT o_custkey FROM od GROUP BY 1 HAVING count(DISTINCT entity) <> 1)), NULL
  UNION ALL SELECT 'DQ18a', 'entity in one side per epoch', (SELECT count(*) FROM (SELECT entity, epoch FROM fact GROUP BY ALL HAVING count(DISTINCT side) <> 1)), NULL
  UNION ALL SELECT 'DQ18b', 'fact side matches dimension', (SELECT count(*) FROM fact JOIN supplier ON entity = s_suppkey WHERE side <> s_nationkey), NULL
""" + "".join(f"  UNION ALL SELECT '{i}', '{name}', (SELECT count(*) FROM fact WHERE {sql}), NULL\n" for i, (name, _, sql) in ROW_RULES.items()) + """)
SELECT rule_id, name, CAST(violations AS BIGINT) AS violations, CAST(detail AS VARCHAR) AS detail, violations = 0 AS passed FROM checks""",
                    FACT_CTE, ORDERS_CTE)
_DQ_SQL = _DQ_SQL.replace("od AS (", "od AS (", 1).replace(")\nlatest AS", "),\nlatest AS", 1)


@register("dq_run_checks", _DQ_SQL, ids=("DQ0", "DQ1", "DQ2", "DQ3", "DQ4", "DQ5", "DQ6", "DQ7", "DQ8", "DQ9",
                                        "DQ10", "DQ14", "DQ15", "DQ17", "DQ18"))
def q_dq(spark, sf):
    rows = Q.row_rules(B.fact(spark, sf), {i: (name, cond()) for i, (name, cond, _) in ROW_RULES.items()})
    return Q.run_checks(_rules(spark, sf), more=[rows])


@register("dq_outlier_summary", with_ctes("""
SELECT segment, avg(points) AS mean, stddev_samp(points) AS std, min(points) AS min, max(points) AS max,
       count(points) AS n,
       count(*) FILTER (WHERE abs(points - m) > 3.0 * s) AS n_outliers
FROM fact JOIN (SELECT segment AS sg, avg(points) AS m, stddev_samp(points) AS s FROM fact GROUP BY 1) t
  ON segment = sg GROUP BY segment""", FACT_CTE), ids=("DQ11",))
def q_dq11(spark, sf):
    return Q.outlier_summary(B.fact(spark, sf), ["segment"], "points", 3.0)


@register("dq_worst_offenders", with_ctes("""
SELECT entity, epoch, a AS line_total, b AS fact_total, a - coalesce(b, 0) AS diff FROM
  (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS epoch, sum(l_quantity) AS a FROM lineitem GROUP BY ALL) x
  LEFT JOIN (SELECT entity, epoch, CAST(sum(points) AS BIGINT) AS b FROM fact GROUP BY ALL) y USING (entity, epoch)
ORDER BY abs(a - coalesce(b, 0)) DESC, entity, epoch LIMIT 5""", FACT_CTE), ids=("DQ12",))
def q_dq12(spark, sf):
    from stepwise.operators.relational import reconcile, top_k
    li = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"),
                                               F.year("l_shipdate").alias("epoch"), "l_quantity")
    r = reconcile(li, B.fact(spark, sf), ["entity", "epoch"], "l_quantity", "points", -1.0,
                  "line_total", "fact_total")
    return top_k(r, [F.abs(F.col("diff")).desc(), "entity", "epoch"], 5)


@register("dq_coverage_by_epoch", with_ctes("""
SELECT epoch, avg(CASE WHEN nullif(red, 0) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS red_cov,
       avg(CASE WHEN nullif(saves, 0) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS saves_cov
FROM fact GROUP BY epoch""", FACT_CTE), ids=("DQ16", "E23"))
def q_dq16(spark, sf):
    from stepwise.operators.aggregates import null_coverage
    f = B.fact(spark, sf).select("epoch", F.nullif("red", F.lit(0)).alias("red"),
                                 F.nullif("saves", F.lit(0)).alias("saves"))
    return null_coverage(f, ["epoch"], ["red", "saves"])

"""Sources and loaders bound to the driver tables."""

from pyspark.sql import functions as F

from stepwise.catalog import EVENTS_CTE, FACT_CTE, MATCHES_CTE, register, with_ctes
from stepwise.catalog.rel_q import STANDINGS_SQL as _STANDINGS
from stepwise.plans import bindings as B
from stepwise.plans import starschema as L
from stepwise.session import scratch_path
from stepwise.sources.files import browse, read_only_sql


@register("src_nested_json_props", with_ctes("""
SELECT segment, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k_bucket, count(*) AS n,
       avg(CAST(json_extract(props, '$.k') AS INTEGER)) AS mean_k
FROM ev GROUP BY ALL""", EVENTS_CTE), ids=("SRC6",))
def q_src6(spark, sf):
    ev = B.events(spark, sf).withColumn("p", F.from_json("props", "k INT"))
    return ev.groupBy("segment", (F.col("p.k") % 10).alias("k_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p.k").alias("mean_k"))


@register("src_adhoc_sql", """
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
WHERE l_quantity > 25 AND l_discount <= 0.05 GROUP BY l_returnflag, l_linestatus""", ids=("SRC8",))
def q_src8(spark, sf):
    B.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_v")
    return read_only_sql(spark, """
        SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem_v
        WHERE l_quantity > :q AND l_discount <= :d GROUP BY l_returnflag, l_linestatus""", {"q": 25, "d": 0.05})


@register("src_table_browser", """
SELECT * FROM customer WHERE contains(lower(c_name), '000') AND contains(lower(c_mktsegment), 'build')
ORDER BY c_custkey LIMIT 50""", ids=("SRC9", "FLT4"))
def q_src9(spark, sf):
    return browse(B.table(spark, sf, "customer"), {"c_name": "000", "c_mktsegment": "BUILD"}, 50,
                  order=["c_custkey"])


@register("ld_dim_entity", with_ctes("""
SELECT l.entity, l.side, l.segment, l.price, d.debut_epoch FROM (
  SELECT entity, side, segment, price, row_number() OVER (PARTITION BY entity ORDER BY epoch DESC, step DESC, fixture DESC) AS rn FROM fact) l
JOIN (SELECT entity, min(epoch) AS debut_epoch FROM fact GROUP BY entity) d USING (entity) WHERE rn = 1""",
    FACT_CTE), ids=("LD2", "AGG9", "AGG11"))
def q_ld2(spark, sf):
    return L.dim_entity(B.fact(spark, sf), "entity", ["epoch", "step", "fixture"], ["side", "segment", "price"]).select(
        "entity", "side", "segment", "price", "debut_epoch")


@register("ld_dim_side", with_ctes("""
m AS (SELECT epoch, side, n_name AS name FROM (
  SELECT epoch, side, n_name, row_number() OVER (PARTITION BY epoch, side ORDER BY count(*) DESC, n_name) AS rn
  FROM fact JOIN nation ON other_side = n_nationkey GROUP BY epoch, side, n_name) t WHERE rn = 1)
SELECT epoch, side, name, CAST(row_number() OVER (ORDER BY epoch, side) AS BIGINT) AS side_sk FROM m""",
    FACT_CTE).replace("\nm AS (", "\n, m AS (", 1), ids=("LD3", "AGG7", "PRJ7"))
def q_ld3(spark, sf):
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("other_side"), F.col("n_name").alias("name"))
    obs = B.fact(spark, sf).join(F.broadcast(n), "other_side")
    return L.dim_side(None, obs, "epoch", "side", "name")


@register("ld_history_latest_copy", """
SELECT entity, epoch, total FROM (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS epoch, source, total,
         row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY source DESC, source_file) AS rn
  FROM (SELECT l_suppkey, l_shipdate, l_linestatus AS source, 'f' || l_linestatus AS source_file,
               sum(l_quantity) OVER (PARTITION BY l_suppkey, year(l_shipdate), l_linestatus) AS total FROM lineitem) c
) t WHERE rn = 1 AND entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""", ids=("LD5", "AGG9", "JN7"))
def q_ld5(spark, sf):
    li = B.table(spark, sf, "lineitem")
    copies = (li.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("epoch"),
                         F.col("l_linestatus").alias("source"))
              .agg(F.sum("l_quantity").alias("total"))
              .withColumn("source_file", F.concat(F.lit("f"), F.col("source"))))
    known = B.table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("entity"))
    return L.history(copies, "entity", "epoch", "source", known).select("entity", "epoch", "total")


@register("src_csv_eras_roundtrip", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, count(*) AS n, sum(o_totalprice) AS total,
       count(*) FILTER (WHERE year(o_orderdate) < 1999) AS n_with_priority
FROM orders GROUP BY 1""", ids=("SRC2", "SRC3", "SRC4"))
def q_src_roundtrip(spark, sf):
    """Orders exported as per-year CSV extracts (two schema eras: the
    priority column is absent from 1999 on), then read back with encoding
    routing, path labels and the era union."""
    from stepwise.sources.files import read_labelled
    df, _missing = read_labelled(spark, _order_extracts(spark, sf), "*.csv", r"y=(\d{4})", "label")
    return (df.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col("o_totalprice").try_cast("double")).alias("total"),
                                    F.count("o_orderpriority").alias("n_with_priority")))


def _order_extracts(spark, sf):
    """A folder of CSV files, one per year, in two eras."""
    root = scratch_path(spark, "extracts")
    o = B.table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    old = o.where("y < 1999").select("o_orderkey", "o_totalprice", "o_orderpriority", "y")
    new = o.where("y >= 1999").select("o_orderkey", "o_totalprice", "y")
    for part in (old, new):
        part.repartition("y").write.partitionBy("y").option("header", True).mode("append").csv(root)
    return root


@register("src_bad_files", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, 'read' AS status, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1997 GROUP BY 1
UNION ALL SELECT '1997', 'lacks o_totalprice', 1 UNION ALL SELECT '1000', 'no header line', 1
UNION ALL SELECT '2050', 'no file', 1""", ids=("SRC2", "SRC3"))
def q_src3_bad(spark, sf):
    """Yearly extracts of which one lacks a required column, one is empty and one that is expected is not there."""
    from stepwise.sources.files import bad_files, file_headers, read_labelled
    root = scratch_path(spark, "extracts")
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    for part in (o.where("y <> 1997"), o.where("y = 1997").drop("o_totalprice")):
        part.repartition("y").write.partitionBy("y").mode("append").option("header", True).csv(root)
    spark.createDataFrame([("",)], "x string").coalesce(1).write.text(f"{root}/y=1000")
    headers = file_headers(spark, root, "part-*")
    years = [str(r[0]) for r in o.select("y").distinct().collect()]   # one row per year
    df, missing = read_labelled(spark, root, "part-*", r"y=(\d{4})", "label", [*years, "2050"], ["o_orderkey", "o_totalprice"], headers=headers)
    read = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", F.lit("read").alias("status"), "n")
    bad = bad_files(headers, ["o_orderkey", "o_totalprice"]).groupBy(F.regexp_extract("path", r"y=(\d{4})", 1).alias("label"), F.col("reason").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    gone = spark.createDataFrame([(m, "no file", 1) for m in missing if m != "1997"], "label string, status string, n long")
    return read.union(bad).union(gone)


@register("src_census", """
SELECT 'orders' AS kind, count(DISTINCT year(o_orderdate)) AS files, CAST(min(year(o_orderdate)) AS VARCHAR) AS first_season,
       CAST(max(year(o_orderdate)) AS VARCHAR) AS last_season, count(DISTINCT year(o_orderdate)) AS representatives FROM orders""", ids=("SRC5",))
def q_src5(spark, sf):
    from stepwise.sources.files import census
    summary, reps = census(spark, _order_extracts(spark, sf), {"orders": r"/part-[^/]*\.csv$"}, r"y=(\d{4})")
    named = reps.where("representative LIKE '%.csv'").groupBy("kind").agg(F.count(F.lit(1)).alias("representatives"))
    return summary.where("kind = 'orders'").join(named, "kind").select("kind", "files", "first_season", "last_season", "representatives")


@register("src_any_encoding", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '%H%') AS accented
FROM orders GROUP BY 1""", ids=("SRC1",))
def q_src1(spark, sf):
    """Extracts of odd years are in UTF-8, those of even years in Latin-1; accents must survive either."""
    from stepwise.sources.files import read_csv_any_encoding
    root = scratch_path(spark, "encodings")
    o = B.table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderkey", F.replace("o_orderpriority", F.lit("H"), F.lit("é")).alias("priority"))
    for odd, encoding in ((1, "UTF-8"), (0, "ISO-8859-1")):
        (o.where(F.col("y") % 2 == odd).withColumn("year", F.col("y")).repartition("year").write.partitionBy("y").mode("append")
          .option("header", True).option("encoding", encoding).csv(root))
    df = read_csv_any_encoding(spark, root, "*.csv")
    return df.groupBy(F.col("year").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority").contains("é")).alias("accented"))


@register("src_list_slices", with_ctes("""
SELECT DISTINCT epoch, step FROM fact""", FACT_CTE), ids=("SRC10",))
def q_src10(spark, sf):
    from stepwise.sources.files import list_slices
    root = scratch_path(spark, "predictions")
    f = B.fact(spark, sf).select("epoch", "step", "entity", "points")
    f.repartition("epoch", "step").write.partitionBy("epoch", "step").parquet(root)
    return list_slices(spark, root, r"epoch=(\d+)/step=(\d+)/")


@register("src_live_snapshot", with_ctes("""
l AS (SELECT max(epoch * 100 + step) AS m FROM mt),
fx AS (SELECT mt.*, home_score >= 2 AS finished FROM mt, l WHERE epoch * 100 + step = m),
fx2 AS (SELECT * FROM fx WHERE finished OR NOT (SELECT bool_or(finished) FROM fx)),
sd AS (SELECT home_side AS team, away_side AS opponent_team, true AS was_home, home_side * 100 + away_side AS fixture, home_score, away_score FROM fx2
       UNION ALL SELECT away_side, home_side, false, home_side * 100 + away_side, home_score, away_score FROM fx2),
li AS (SELECT entity, side, sum(points) AS total_points, sum(minutes) AS minutes FROM fact, l WHERE epoch * 100 + step = m GROUP BY ALL)
SELECT entity AS element, team, n_name AS team_name, fixture, opponent_team, was_home, home_score AS team_h_score, away_score AS team_a_score,
       CAST(minutes AS BIGINT) AS minutes, CAST(CASE WHEN entity % 3 = 0 THEN 0 ELSE total_points END AS BIGINT) AS total_points, CAST(0 AS BIGINT) AS saves
FROM li JOIN sd ON li.side = sd.team JOIN nation ON n_nationkey = team""", FACT_CTE, MATCHES_CTE).replace("\nl AS (", "\n, l AS (", 1), ids=("SRC6", "JN3"))
def q_src6_live(spark, sf):
    """The newest step as nested JSON snapshots (one element list per side), flattened to entity x fixture rows.
    Every third element lacks its points, and no element has saves."""
    from stepwise.sources.api import flatten_live
    root = scratch_path(spark, "snapshot")
    f, m = B.fact(spark, sf), B.matches(spark, sf)
    last = m.agg(F.max(F.struct("epoch", "step")).alias("l")).first()["l"]   # one row
    now = (F.col("epoch") == last["epoch"]) & (F.col("step") == last["step"])
    stats = f.where(now).groupBy("entity", "side").agg(F.sum("points").alias("p"), F.sum("minutes").alias("m"))
    names = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("side"), "n_name")
    boot = f.select("entity", "side").distinct().groupBy("side").agg(F.collect_list(F.struct(F.col("entity").alias("id"), F.col("side").alias("team"))).alias("elements"))
    boot = boot.join(F.broadcast(names), "side").select("elements", F.array(F.struct(F.col("side").alias("id"), F.col("n_name").alias("name"))).alias("teams"))
    live = stats.groupBy("side").agg(F.collect_list(F.struct(F.col("entity").alias("id"), F.struct(
        F.col("m").alias("minutes"), F.when(F.col("entity") % 3 != 0, F.col("p")).alias("total_points")).alias("stats"))).alias("elements"))
    fx = m.where("epoch = {} ".format(last["epoch"])).select(
        (F.col("home_side") * 100 + F.col("away_side")).alias("id"), F.col("step").alias("event"), (F.col("home_score") >= 2).alias("finished"),
        F.col("home_side").alias("team_h"), F.col("away_side").alias("team_a"), F.col("home_score").alias("team_h_score"),
        F.col("away_score").alias("team_a_score"), F.lit(None).cast("string").alias("kickoff_time"))
    for name, df in (("bootstrap", boot), ("live", live.drop("side")), ("fixtures", fx)):
        df.write.json(f"{root}/{name}")

    def back(name, df):
        return spark.read.schema(df.schema).json(f"{root}/{name}")
    out = flatten_live(back("bootstrap", boot), back("fixtures", fx), back("live", live.drop("side")), last["step"], ["minutes", "total_points", "saves"])
    return out.select("element", "team", "team_name", "fixture", "opponent_team", "was_home", "team_h_score", "team_a_score",
                      *[F.col(c).cast("bigint").alias(c) for c in ("minutes", "total_points", "saves")])


@register("snk_snapshot_export", with_ctes("""
SELECT 'snapshot' AS copy, epoch, side, rank FROM st UNION ALL SELECT 'csv', epoch, side, rank FROM st""", MATCHES_CTE, _STANDINGS), ids=("SNK3", "SNK5"))
def q_snk_copies(spark, sf):
    """Standings written as a snapshot and as CSV, and read back."""
    from stepwise.catalog.rel_q import standings_rank
    from stepwise.sources.sinks import export_csv, snapshot
    t = standings_rank(spark, sf)
    a, b = scratch_path(spark, "snapshot"), scratch_path(spark, "export")
    snapshot(t, a)
    export_csv(t, b)
    csv = spark.read.option("header", True).schema(t.schema).csv(b)
    return spark.read.parquet(a).withColumn("copy", F.lit("snapshot")).unionByName(csv.withColumn("copy", F.lit("csv")))


@register("snk_monitor_log", with_ctes("""
SELECT segment, epoch, step, count(*) AS n, avg(abs(xg * 10.0 - points)) AS mae FROM fact GROUP BY ALL""", FACT_CTE), ids=("SNK6",))
def q_snk6(spark, sf):
    """A log of slice metrics: the first delivery is cut short, the second replaces the slices it repeats."""
    from stepwise.sources.sinks import append_log
    f = B.fact(spark, sf)

    def metrics(rows):
        return rows.groupBy("segment", "epoch", "step").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("xg") * 10.0 - F.col("points"))).alias("mae"))
    log, keys = scratch_path(spark, "log"), ["segment", "epoch", "step"]
    append_log(metrics(f.where("epoch < 1999 OR epoch = 1999 AND entity % 2 = 0")), log, keys, "epoch")
    return append_log(metrics(f.where("epoch >= 1999")), log, keys, "epoch")


@register("ld_dim_entity_epoch", with_ctes("""
pr AS (SELECT entity, epoch, side, arg_max(price, struct_pack(a := step, b := fixture)) AS last_price, arg_min(price, struct_pack(a := step, b := fixture)) AS first_price,
         sum(points) AS points, sum(xg) AS xg FROM fact GROUP BY ALL),
sk AS (SELECT epoch, side, row_number() OVER (ORDER BY epoch, side) AS side_sk FROM (SELECT DISTINCT epoch, side FROM fact) d)
SELECT pr.epoch, pr.entity, CAST(sk.side_sk AS BIGINT) AS side_sk,
       CASE WHEN s_acctbal > 0 AND pr.entity % 5 <> 0 THEN first_price + 2 WHEN pr.entity % 7 = 0 THEN NULL ELSE first_price END AS start_cost,
       CASE WHEN s_acctbal > 0 THEN last_price + 2 END AS end_cost,
       CAST(points AS DOUBLE) AS total_points, CASE WHEN pr.epoch >= 1998 THEN xg END AS expected_goals
FROM pr JOIN sk ON sk.epoch = pr.epoch AND sk.side = pr.side JOIN supplier ON s_suppkey = pr.entity""", FACT_CTE).replace("\npr AS (", "\n, pr AS (", 1),
    ids=("LD4", "LD5", "JN2", "PRJ8", "PRJ1"))
def q_ld4(spark, sf):
    """Season extracts of two eras (no expected goals before 1998, some changes unreadable), with costs from
    overlapping history copies, of which the newest counts and whose start cost is 0 for some."""
    f = B.fact(spark, sf)
    at = F.struct("step", "fixture")
    season = f.groupBy("entity", "epoch", "side").agg(F.max_by("price", at).alias("last"), F.min_by("price", at).alias("first"),
                                                      F.sum("points").alias("points"), F.sum("xg").alias("xg"))
    raw = season.select("epoch", F.col("entity").alias("code"), F.col("side").alias("team"), F.col("last").cast("string").alias("now_cost"),
                        F.when(F.col("entity") % 7 == 0, "n/a").otherwise((F.col("last") - F.col("first")).cast("string")).alias("cost_change_start"),
                        F.col("points").cast("string").alias("total_points"), F.col("xg").cast("string").alias("expected_goals"))
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("side"), F.col("n_name").alias("name"))
    sides = L.dim_side(None, f.join(F.broadcast(n), "side"), "epoch", "side", "name")
    copies = season.select("entity", F.concat(F.col("epoch").cast("string"), F.lit("/"), F.lpad(((F.col("epoch") + 1) % 100).cast("string"), 2, "0")).alias("season_name"),
                           F.explode(F.array(F.lit(1), F.lit(2))).alias("age"), "epoch", "first", "last")
    copies = copies.select("entity", "season_name", (F.col("epoch") + F.col("age")).alias("source"), F.lit("history.csv").alias("source_file"),
                           F.when(F.col("entity") % 5 == 0, "0").otherwise((F.col("first") + F.col("age")).cast("string")).alias("start_cost"),
                           (F.col("last") + F.col("age")).cast("string").alias("end_cost"))
    known = B.table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("entity"))
    epochs = f.select("epoch").distinct().withColumn("name", F.concat(F.col("epoch").cast("string"), F.lit("/"), F.lpad(((F.col("epoch") + 1) % 100).cast("string"), 2, "0")))
    costs = L.cost_index(L.history(copies, "entity", "season_name", "source", known), "entity", "season_name", epochs, "start_cost", "end_cost")
    parts = [L.dim_entity_epoch(era, sides, "epoch", "code", "team", "now_cost", "cost_change_start", costs, ["total_points", "expected_goals"])
             for era in (raw.where("epoch < 1998").drop("expected_goals"), raw.where("epoch >= 1998"))]
    return parts[0].unionByName(parts[1])


@register("src_current_next_step", with_ctes("""
s AS (SELECT epoch * 100 + step AS id, bool_and(o_orderstatus = 'F') AS finished FROM od GROUP BY 1)
SELECT max(id) FILTER (WHERE finished) AS current_step, min(id) FILTER (WHERE NOT finished) AS next_step FROM s""",
    __import__("stepwise.catalog", fromlist=["ORDERS_CTE"]).ORDERS_CTE).replace("\ns AS (", "\n, s AS (", 1),
    ids=("SRC7",))
def q_src7(spark, sf):
    from stepwise.plans.slices import current_and_next
    s = (B.orders(spark, sf).groupBy((F.col("epoch") * 100 + F.col("step")).alias("id"))
         .agg(F.bool_and(F.col("o_orderstatus") == "F").alias("finished"))
         .withColumn("is_current", F.lit(False)))
    return current_and_next(s, "id", "finished", "is_current")


@register("ld_fact_rows", """
WITH r AS (SELECT l_suppkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS epoch, month(o_orderdate) AS step, l_orderkey AS fixture,
  l_linestatus = 'O' AS home, c_nationkey AS opp, CAST(floor(l_quantity) AS BIGINT) AS pts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey),
s AS (SELECT *, CASE WHEN home THEN min(opp) FILTER (WHERE NOT home) OVER m ELSE min(opp) FILTER (WHERE home) OVER m END AS side
      FROM r WINDOW m AS (PARTITION BY epoch, step, fixture)),
k AS (SELECT *, row_number() OVER (PARTITION BY epoch, step, fixture, entity ORDER BY home, pts) AS rn FROM s)
SELECT epoch, count(*) AS rows, CAST(sum(pts) AS BIGINT) AS points, count(DISTINCT side) AS sides FROM k WHERE rn = 1 GROUP BY epoch""", ids=("LD6", "JN1", "JN2", "JN3", "PRJ2", "PRJ3", "PRJ5", "PRJ6", "AGG10"))
def q_ld6(spark, sf):
    """Raw entity x fixture extract (strings, local ids) -> cleaned fact rows."""
    li = B.table(spark, sf, "lineitem")
    o = B.table(spark, sf, "orders")
    c = B.table(spark, sf, "customer")
    raw = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .select(F.col("l_suppkey").cast("string").alias("element"),
                     F.year("o_orderdate").alias("epoch"), F.month("o_orderdate").alias("step"),
                     F.col("l_orderkey").alias("fixture"),
                     F.when(F.col("l_linestatus") == "O", "True").otherwise("False").alias("was_home"),
                     F.col("c_nationkey").alias("opponent_team"),
                     F.col("l_quantity").cast("string").alias("total_points"),
                     F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_tax").cast("string")).alias("bonus"),
                     F.lit("1").alias("mng_win"), F.lit("0").alias("mng_draw"), F.lit("0").alias("mng_loss"),
                     F.col("l_discount").cast("string").alias("mng_goals")))
    bridge = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("element"),
                                                    F.col("s_suppkey").alias("entity"))
    rows, _obs = L.fact_rows(raw, bridge, "element", "entity", ["total_points", "bonus"],
                             ["mng_win", "mng_draw", "mng_loss", "mng_goals"],
                             ["epoch", "step", "fixture", "entity"])
    return rows.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_points").alias("points"),
                                     F.count_distinct("side").alias("sides"))

"""Joins, aggregates, grouping sets, set operations and ranking over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import sketches
from spanloom.plans.report import RunReport
from spanloom.sources.tables import read


def star_join_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation and segment; Spark broadcasts the small sides by their own sizes."""
    t = lambda name: read(spark, folder, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,4)")).cast("double").alias("revenue")
    return joined.groupBy("n_name", "c_mktsegment").agg(revenue, F.count("*").alias("n")).orderBy(F.desc("revenue"), "n_name", "c_mktsegment").limit(20)


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def cube_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.sum("l_quantity").alias("qty"), F.grouping_id().cast("long").alias("level"))


def rollup_levels(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem")
    return rows.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")]], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


def set_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders of both statuses, without those of urgent orders."""
    o = read(spark, folder, "orders")
    keys = lambda c: o.where(c).select("o_custkey")
    return keys("o_orderstatus = 'F'").intersect(keys("o_orderstatus = 'O'")).subtract(keys("o_orderpriority = '1-URGENT' AND o_totalprice > 300000"))


def bag_union(spark: SparkSession, folder: str) -> DataFrame:
    both = read(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")).unionByName(read(spark, folder, "customer").select(F.col("c_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count("*").alias("n"))


def window_rank(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1).cast("long")).alias("following"))
    return ranked.where("rank <= 5")


def semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    big = read(spark, folder, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    gone = read(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("g"))
    c = read(spark, folder, "customer")
    return c.join(big, c.c_custkey == big.k, "left_semi").join(gone, F.col("c_custkey") == F.col("g"), "left_anti").select("c_custkey", "c_name")


def packing_size(spark: SparkSession, folder: str) -> DataFrame:
    """Count and padded size when a length is cut into cores of 60 to 118 units, at a resolution of 1000."""
    low, high = 60_000, 118_000
    size = F.floor(F.col("l_extendedprice") * 10).cast("long")
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", size.alias("size")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "size", F.greatest(F.lit(1).cast("long"), F.floor((F.col("size") + high - 1) / high)).alias("cores")).withColumn("padded", F.greatest("size", F.col("cores") * low))


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


def agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Groups whose variants all agree: one distinct value, and it isn't blank."""
    rows = read(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.collect_set("o_orderstatus").alias("v"), F.count("*").alias("n"))
    return rows.select("o_custkey", "o_orderpriority", ((F.size("v") == 1) & (F.trim(F.element_at("v", 1)) != "")).alias("agrees"), "n")


def quantifiers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_quantity") >= 50).alias("any_full"), F.bool_and(F.col("l_discount") <= 0.1).alias("all_low"), F.count_if(F.col("l_tax") > 0.04).alias("n_taxed"))


def distinct_within(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct orders of each return flag, exactly, and whether the united sketches of its shipping years are as near as they say."""
    rows = read(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    found = sketches.distinct_counts(sketches.distinct_sketches(rows, ["l_returnflag", "year"], "l_orderkey"), ["l_returnflag"])
    exact = rows.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("n"))
    return exact.join(found, "l_returnflag", "left").select("l_returnflag", "n", (F.abs(F.col("estimate") - F.col("n")) <= sketches.DISTINCT_ERROR * F.col("n")).alias("within"))


def quantiles_within(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of prices by priority from the united sketches of order years: how many orders there are, and whether as many lie below as should."""
    rows = read(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    found = sketches.quantiles(sketches.quantile_sketches(rows, ["o_orderpriority", "year"], "o_totalprice"), ["o_orderpriority"], (0.1, 0.5, 0.9))
    below = rows.select("o_orderpriority", "o_totalprice").join(found, "o_orderpriority").groupBy("o_orderpriority", "rank", "n").agg((F.count_if(F.col("o_totalprice") <= F.col("value")) / F.count("*")).alias("share"))
    return below.select("o_orderpriority", "rank", "n", (F.abs(F.col("share") - F.col("rank")) <= sketches.RANK_ERROR).alias("within"))


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """A run of two stages over line items, by its report: rows and quantity that passed each."""
    report = RunReport(spark)
    with report.stage("returned") as stage:
        kept = stage.kept(read(spark, folder, "lineitem").where("l_returnflag = 'R'"), quantity=F.sum("l_quantity"))
    with report.stage("by_order") as stage:
        stage.kept(kept.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")), quantity=F.sum("q"))
    return report.table().where("seconds > 0 AND bytes > 0 AND error IS NULL").select("position", "stage", "rows", F.col("measures")["quantity"].alias("quantity"))


QUERIES = {f.__name__: f for f in (star_join_topk, pricing_summary, cube_rollup, rollup_levels, grouping_sets, set_ops, bag_union, window_rank, semi_anti, packing_size, distinct_values, agreement, quantifiers, distinct_within, quantiles_within, run_report)}

ORACLE_SQL = {
    "run_report": "SELECT 0::INTEGER AS position, 'returned' AS stage, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 1, 'by_order', count(DISTINCT l_orderkey), sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R'",
    "distinct_within": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, true AS within FROM lineitem GROUP BY l_returnflag",
    "quantiles_within": "SELECT o_orderpriority, r AS rank, count(*) AS n, true AS within FROM orders, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS q(r) GROUP BY o_orderpriority, r",
    "star_join_topk": """SELECT n_name, c_mktsegment, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,4))) AS DOUBLE) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment ORDER BY revenue DESC, n_name, c_mktsegment LIMIT 20""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "cube_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_levels": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping_id(o_orderpriority, o_orderstatus) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))",
    "set_ops": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000",
    "bag_union": "SELECT nation, count(*) AS n FROM (SELECT s_nationkey AS nation FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY nation",
    "window_rank": "SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER w AS rank, dense_rank() OVER w AS dense, coalesce(lead(o_orderkey) OVER w, -1) AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 5",
    "semi_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "packing_size": "WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 10) AS BIGINT) AS size FROM lineitem), c AS (SELECT *, greatest(1, (size + 117999) // 118000) AS cores FROM s) SELECT l_orderkey, l_linenumber, size, cores, greatest(size, cores * 60000) AS padded FROM c",
    "distinct_values": "SELECT p_brand, count(DISTINCT p_type) AS types, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY p_brand",
    "agreement": "SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) = 1 AND trim(min(o_orderstatus)) <> '' AS agrees, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority",
    "quantifiers": "SELECT l_suppkey, bool_or(l_quantity >= 50) AS any_full, bool_and(l_discount <= 0.1) AS all_low, CAST(count_if(l_tax > 0.04) AS BIGINT) AS n_taxed FROM lineitem GROUP BY l_suppkey",
}

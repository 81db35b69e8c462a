"""The relational workload: the statements the question-to-SQL system is trained to write,
bound to the input tables (customers = customer + nation, products = part with the brand as
category, order items = lineitem).

Written with the DataFrame API so Catalyst prunes columns, pushes filters into the parquet
scans and chooses join strategies (broadcast for the small dimension sides at runtime via
AQE, sort-merge otherwise). Money columns are rounded to cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

NATION = "NATION_7"      # country filter literal
STATUS_DONE = "F"        # "completed"
STATUS_OPEN = "O"        # "pending"
BRAND = "Brand#13"       # category filter literal
YEAR = 1998


def _customers(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_name", F.col("n_name").alias("country"))


def wl_customer_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customer_count"))


def wl_customers_in_nation(spark: SparkSession, d: str) -> DataFrame:
    return (_customers(spark, d).filter(F.col("country") == NATION)
            .agg(F.count(F.lit(1)).alias("customer_count")))


def wl_customer_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("name"))


def wl_distinct_nations(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("country").distinct().orderBy("country")


def wl_order_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("order_count"))


def wl_order_totals(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders").agg(
        F.round(F.sum(p), 2).alias("total_revenue"), F.round(F.avg(p), 2).alias("avg_order_value"),
        F.round(F.max(p), 2).alias("max_order_value"), F.round(F.min(p), 2).alias("min_order_value"))


def wl_orders_by_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(
        F.count_if(s == STATUS_DONE).cast("long").alias("completed_count"),
        F.count_if(s == STATUS_OPEN).cast("long").alias("pending_count"))


def wl_part_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("product_count"),
                                       F.round(F.avg("p_retailprice"), 2).alias("avg_price"))


def wl_parts_in_brand(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "part").filter(F.col("p_brand") == BRAND)
            .agg(F.count(F.lit(1)).alias("product_count")))


def wl_revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    # Orders are summed per customer before the join: a customer holding a large share of
    # the orders then reaches the join as one row, not as a hot key.
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return (_customers(spark, d).join(per, F.col("c_custkey") == per.o_custkey)
            .groupBy("country").agg(F.round(F.sum("s"), 2).alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc()))


def _orders_per_customer(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    # Aggregate orders by customer first (partial aggregation before the shuffle), then
    # join the much smaller per-customer counts to the customer table.
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("order_count"))
    return c.join(per, c.c_custkey == per.o_custkey).select(
        "c_custkey", F.col("c_name").alias("name"), "order_count")


def wl_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return (_orders_per_customer(spark, d).select("name", "order_count")
            .orderBy(F.col("order_count").desc()))


def wl_frequent_customers(spark: SparkSession, d: str) -> DataFrame:
    return (_orders_per_customer(spark, d).filter(F.col("order_count") > 2)
            .select("name", "order_count"))


def wl_qty_per_part(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("total_qty"))
    return (p.join(per, p.p_partkey == per.l_partkey)
            .select(F.col("p_name").alias("name"), F.round("total_qty", 2).alias("total_qty"))
            .orderBy(F.col("total_qty").desc()))


def wl_revenue_by_brand(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    li = table(spark, d, "lineitem")
    # Quantity times unit price is the extended price, also for a quantity of 0.
    # Pre-aggregate line revenue per part before joining to the (smaller) part table.
    per = li.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("rev"))
    return (p.join(per, p.p_partkey == per.l_partkey).groupBy(F.col("p_brand").alias("category"))
            .agg(F.round(F.sum("rev"), 2).alias("revenue")).orderBy(F.col("revenue").desc()))


def wl_distinct_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("distinct_products"))


def wl_large_orders(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.sum("l_quantity").alias("total_items"))
            .filter(F.col("total_items") > 3)
            .select("order_id", F.round("total_items", 2).alias("total_items")))


def wl_completed_revenue(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "orders").filter(F.col("o_orderstatus") == STATUS_DONE)
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total_revenue")))


def wl_spend_per_customer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return (c.join(per, c.c_custkey == per.o_custkey)
            .select(F.col("c_name").alias("name"), F.round("s", 2).alias("total_spent"))
            .orderBy(F.col("total_spent").desc()))


def wl_orders_in_year(spark: SparkSession, d: str) -> DataFrame:
    # YEAR(d) = y written as a half-open range so the predicate reaches the parquet scan.
    lo = F.lit(f"{YEAR}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{YEAR + 1}-01-01 00:00:00").cast("timestamp_ntz")
    dt = F.col("o_orderdate")
    return (table(spark, d, "orders").filter((dt >= lo) & (dt < hi))
            .agg(F.count(F.lit(1)).alias("order_count")))


def wl_top_price_per_brand(spark: SparkSession, d: str) -> DataFrame:
    """Correlated scalar subquery (max price per category), decorrelated as join to the
    grouped maximum; the grouped side has one row per brand."""
    p = table(spark, d, "part")
    mx = p.groupBy(F.col("p_brand").alias("b")).agg(F.max("p_retailprice").alias("mp"))
    return (p.join(mx, (p.p_brand == mx.b) & (p.p_retailprice == mx.mp))
            .select(F.col("p_brand").alias("category"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("price"))
            .orderBy("category"))


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    """YEAR, DATE_TRUNC('month'), INTERVAL '1 month' and date_diff('day', a, b) per month."""
    o = table(spark, d, "orders")
    month = F.date_trunc("month", "o_orderdate")
    per = o.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n_orders"),
                                          F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    nxt = F.col("m") + F.expr("INTERVAL 1 MONTH")
    return per.select(F.to_date("m").alias("month"), F.year("m").cast("long").alias("order_year"),
                      F.to_date(nxt).alias("next_month"),
                      F.datediff(F.to_date(nxt), F.to_date("m")).cast("long").alias("days_in_month"),
                      "n_orders", "revenue")


QUERIES = {f.__name__: f for f in (
    wl_customer_count, wl_customers_in_nation, wl_customer_names, wl_distinct_nations,
    wl_order_count, wl_order_totals, wl_orders_by_status, wl_part_stats, wl_parts_in_brand,
    wl_revenue_by_nation, wl_orders_per_customer, wl_frequent_customers, wl_qty_per_part,
    wl_revenue_by_brand, wl_distinct_parts, wl_large_orders, wl_completed_revenue,
    wl_spend_per_customer, wl_orders_in_year, wl_top_price_per_brand, date_functions)}

"""Invoice pages: a view of the star-schema tables as the text that a scan of each order's invoice would have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.invoices import table

SUPPLIERS = ["Blue Harbour Ltd", "Northwind Foods", "Casa Imports Ltd", "Zeta Services"]


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and page_text. Every fifth page opens with the customer's block; items are in order of line and text."""
    money = lambda x: x.cast("decimal(14,2)")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), "p_name", "p_brand", money(F.col("l_extendedprice")).cast("string"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", line.alias("line")).alias("line"), money(F.col("l_extendedprice")).alias("price"))
    sums = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("price").alias("net"))
    pages = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("vat", money(F.col("net") * F.lit("0.18").cast("decimal(3,2)")))
    key = F.col("o_orderkey")
    buyer = F.when(key % 5 == 0, F.array(*map(F.lit, ["Bill to:", "Orchard Catering Ltd", "12 Main Street", "Valletta", "Malta"]))).otherwise(F.array().cast("array<string>"))
    label = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    head = F.array(
        F.get(F.array(*map(F.lit, SUPPLIERS)), (F.col("o_custkey") % 4).cast("int")), F.lit("Triq il-Kbira 12"), label("Tel: +35621", F.lpad((key % 10000).cast("string"), 4, "0")), label("Invoice No.: A", F.concat(key.cast("string"), F.lit("-26"))),
        label("Invoice Date: ", F.date_format("o_orderdate", "dd/MM/yyyy")), F.lit("Qty Description Price"),
    )
    foot = F.array(label("Subtotal: EUR ", F.col("net").cast("decimal(14,2)")), label("VAT @ 18%: EUR ", F.col("vat")), label("Grand Total: EUR ", money(F.col("net") + F.col("vat"))))
    return pages.select("o_orderkey", F.array_join(F.concat(buyer, head, F.transform("lines", lambda x: x["line"]), foot), "\n").alias("page_text"))


#: What stands on the pages, as SQL: `items`, a row for each item, and `page`, a row for each page.
SQL = f"""
items AS (SELECT l_orderkey, l_linenumber, l_linenumber || ' ' || p_name || ' ' || p_brand || ' ' || CAST(l_extendedprice AS DECIMAL(14,2)) AS line, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber || ' ' || p_name || ' ' || p_brand || ' ' || CAST(l_extendedprice AS DECIMAL(14,2))) AS line_no FROM lineitem JOIN part ON l_partkey = p_partkey),
sums AS (SELECT l_orderkey, sum(price) AS net, string_agg(line, chr(10) ORDER BY line_no) AS item_text FROM items GROUP BY 1),
page AS (SELECT o_orderkey, {SUPPLIERS}[1 + o_custkey % 4] AS supplier_name, 'A' || o_orderkey || '-26' AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date, net AS net_amount, CAST(net * CAST(0.18 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS vat_amount, item_text
  FROM orders JOIN sums ON o_orderkey = l_orderkey)
"""

"""Invoice tables: the canonical row schema, and a view of the star-schema tables in its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
SHARE = T.DecimalType(5, 2)

#: The columns of the row fact that every operator knows. Facts are laid out by tenant and company.
ROW = T.StructType(
    [
        T.StructField("tenant", T.StringType()), T.StructField("company", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("page_no", T.IntegerType()),
        T.StructField("supplier_id", T.LongType()), T.StructField("supplier_name", T.StringType()), T.StructField("nominal_account_code", T.StringType()), T.StructField("description", T.StringType()), T.StructField("invoice_date", T.DateType()),
        T.StructField("net_amount", MONEY), T.StructField("vat_amount", MONEY), T.StructField("total_amount", MONEY), T.StructField("confidence_score", SHARE), T.StructField("review_required", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decimal(name: str, kind: str) -> Column:
    return F.col(name).cast(kind)


def invoice_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One invoice row for each line item. A file is an order, a batch the orders of a customer. Line 7 has no supplier,
    line 6 no total and line 5 no confidence, so that every query meets nulls.

    columns: those that are needed, all if none is named. A table that none of them comes from is not joined: every line has
    one order, part, supplier, nation and region.
    """
    wanted = list(columns) or ROW.names
    needs = lambda *names: any(c in wanted for c in names)
    read = lambda name: table(spark, sf_dir, name)
    net = (_decimal("l_extendedprice", "decimal(14,2)") * (F.lit(1).cast("decimal(4,2)") - _decimal("l_discount", "decimal(4,2)"))).cast(MONEY)
    rows = read("lineitem").withColumn("net_amount", net).withColumn("vat_amount", (F.col("net_amount") * _decimal("l_tax", "decimal(4,2)")).cast(MONEY))
    sure = (F.col("l_quantity").cast("int") * 2).cast("decimal(5,2)")
    if needs("tenant", "company", "supplier_name"):
        rows = rows.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if needs("tenant", "company"):
        places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        rows = rows.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    if needs("nominal_account_code", "description"):
        rows = rows.join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    if needs("batch_id"):
        rows = rows.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    unless = lambda line, value: F.when(F.col("l_linenumber") != line, value)
    made = {
        "tenant": lambda: F.col("r_name"), "company": lambda: F.col("n_name"), "batch_id": lambda: F.col("o_custkey"), "file_id": lambda: F.col("l_orderkey"), "page_no": lambda: F.col("l_linenumber"),
        "supplier_id": lambda: F.col("l_suppkey"), "supplier_name": lambda: unless(7, F.col("s_name")), "nominal_account_code": lambda: F.col("p_type"), "description": lambda: F.concat_ws(" ", "p_brand", "p_name"), "invoice_date": lambda: F.col("l_shipdate").cast("date"),
        "net_amount": lambda: F.col("net_amount"), "vat_amount": lambda: F.col("vat_amount"), "total_amount": lambda: unless(6, F.col("net_amount") + F.col("vat_amount")).cast(MONEY), "confidence_score": lambda: unless(5, (sure * F.lit(0.01).cast("decimal(3,2)")).cast(SHARE)), "review_required": lambda: F.col("l_returnflag") == "R",
    }
    return rows.select(*[made[c]().alias(c) for c in wanted])


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier_id, supplier_name, tenant, company): what a row's supplier tells of it."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), F.col("r_name").alias("tenant"), F.col("n_name").alias("company"))


#: The same view as SQL.
SQL = """
lines AS (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(14,2)) AS net FROM lineitem),
taxed AS (SELECT *, CAST(net * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(14,2)) AS vat FROM lines),
inv AS (SELECT r_name AS tenant, n_name AS company, o_custkey AS batch_id, l_orderkey AS file_id, l_linenumber AS page_no, s_suppkey AS supplier_id,
  CASE WHEN l_linenumber <> 7 THEN s_name END AS supplier_name, p_type AS nominal_account_code, p_brand || ' ' || p_name AS description, CAST(l_shipdate AS DATE) AS invoice_date,
  net AS net_amount, vat AS vat_amount, CASE WHEN l_linenumber <> 6 THEN CAST(net + vat AS DECIMAL(14,2)) END AS total_amount,
  CASE WHEN l_linenumber <> 5 THEN CAST(CAST(CAST(l_quantity AS INTEGER) * 2 AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) END AS confidence_score, l_returnflag = 'R' AS review_required
  FROM taxed JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""

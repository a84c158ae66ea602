"""The queries over invoice pages by name, and SQL that gives the same rows from the tables the pages were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import fields
from ledgerloom.operators import deposits, pages, review
from ledgerloom.plans.catalogue import Query
from ledgerloom.sources import exports
from ledgerloom.sources.invoices import SQL as INV
from ledgerloom.sources.invoices import invoice_rows, table
from ledgerloom.sources.pages import SQL as PAGES
from ledgerloom.sources.pages import invoice_pages

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(item_text), '{'|'.join(words)}') THEN '{label}'" for label, words in pages.TOPICS.items()) + " ELSE string_split(item_text, chr(10))[1] END"


@query(f"""WITH {PAGES} SELECT o_orderkey, supplier_name, invoice_number, invoice_date, CAST(net_amount AS DOUBLE) AS net_amount, CAST(vat_amount AS DOUBLE) AS vat_amount, CAST(net_amount + vat_amount AS DOUBLE) AS total_amount, 'EUR' AS currency, {_TOPIC} AS description, item_text AS items FROM page""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    found = pages.extract(invoice_pages(spark, d))
    sums = [F.col(c).cast("double").alias(c) for c in fields.AMOUNTS]
    return found.select("o_orderkey", "supplier_name", "invoice_number", "invoice_date", *sums, "currency", "description", F.array_join("items", "\n").alias("items"))


@query(f"""WITH {PAGES} SELECT o_orderkey, line_no, line AS description, CAST(price AS DOUBLE) AS net_amount, 0.0::DOUBLE AS vat_amount, CAST(price AS DOUBLE) AS total_amount, abs(net_amount - (net_amount + vat_amount)) > 0.05 AS mismatch
FROM items JOIN (SELECT o_orderkey, net_amount, vat_amount FROM page) ON o_orderkey = l_orderkey""")
def page_line_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.line_rows(pages.extract(invoice_pages(spark, d)))
    return rows.select("o_orderkey", "line_no", "description", *[F.col(c).cast("double").alias(c) for c in fields.AMOUNTS], "mismatch")


@query(f"""WITH {PAGES} SELECT o_orderkey, CASE WHEN k < 2 THEN CAST(net_amount AS DOUBLE) END AS net_amount, CASE WHEN k < 2 THEN CAST(vat_amount AS DOUBLE) END AS vat_amount, CASE WHEN k < 2 THEN CAST(net_amount + vat_amount + (CASE k WHEN 1 THEN 7.20 ELSE 0 END) AS DOUBLE) END AS total_amount, CASE k WHEN 1 THEN 7.2::DOUBLE END AS deposit
FROM (SELECT *, o_orderkey % 4 AS k FROM page)""")
def structured_totals(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the pages each: totals that add up, with a deposit, that do not add up, and no blocks at all."""
    kind = F.col("o_orderkey") % 4
    got = pages.extract(invoice_pages(spark, d)).select("o_orderkey", "net_amount", "vat_amount")
    extra = F.when(kind == 1, "7.20").when(kind == 2, "900.00").otherwise("0").cast("decimal(14,2)")
    total = F.col("net_amount") + F.col("vat_amount")
    write = lambda name, x: F.concat(F.lit(name), x.cast("decimal(14,2)").cast("string"))
    block = F.concat_ws("\n", F.lit("Tax Analysis"), write("VAT 18%   ", F.col("vat_amount")), write("Total   ", total), F.lit("Invoice Summary"), write("Gross Value   ", total), write("Invoice Total: ", total + extra), F.when(kind == 1, "Deposit Summary\nBCRS deposit 7.20"))
    texts = got.select("o_orderkey", F.when(kind < 3, block).otherwise(F.lit("Thank you for your order")).alias("page_text"))
    s = F.col("structured")
    return pages.with_structured_totals(texts).select("o_orderkey", *[s[c].cast("double").alias(c) for c in fields.AMOUNTS], s["deposit_candidate"].cast("double").alias("deposit"))


_VALUE = "CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN 'INV' || p_partkey WHEN 2 THEN upper(p_type) || ' Ltd' WHEN 3 THEN 'Total due' WHEN 4 THEN '12' WHEN 5 THEN '' END"


@query(f"""SELECT p_partkey, v, coalesce(lower(trim(v)) IN ('total due', '12', '') AND lower(trim(v)) <> 'total due' OR length(v) < 3 OR regexp_matches(lower(trim(v)), '^[a-z\\s]+$'), true) AS bad_number, coalesce(v IN ('Total due', '12', '') OR v LIKE 'INV%' AND length(v) - 3 >= 3, true) AS bad_supplier,
coalesce(v <> '' AND NOT (v LIKE 'INV%' OR v = '12'), false) AS fits_supplier, coalesce(v = '' OR length(v) < 3, false) AS suspect FROM (SELECT p_partkey, {_VALUE} AS v FROM part)""")
def field_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    rows = table(spark, d, "part").select("p_partkey", F.expr(_VALUE).alias("v"))
    return rows.select("p_partkey", "v", fields.suspicious_number(v).alias("bad_number"), fields.suspicious_supplier(v).alias("bad_supplier"), fields.appropriate("supplier_name", v).alias("fits_supplier"), fields.suspect("supplier_name", v).alias("suspect"))


@query(f"""WITH {PAGES} SELECT o_orderkey, k, k IN ('net', 'vat', 'total') AS summary, k = 'vat' AS vat, k = 'total' AS total, k = 'head' AS item FROM page, (SELECT unnest(['net', 'vat', 'total', 'head', 'tel']) AS k)""")
def line_contexts(spark: SparkSession, d: str) -> DataFrame:
    lines = invoice_pages(spark, d).select("o_orderkey", F.explode(F.split(F.replace("page_text", F.lit("@ "), F.lit("")), "\n")).alias("line"))
    kind = F.when(F.startswith("line", F.lit("Subtotal")), "net").when(F.startswith("line", F.lit("VAT")), "vat").when(F.startswith("line", F.lit("Grand")), "total").when(F.startswith("line", F.lit("Qty")), "head").when(F.startswith("line", F.lit("Tel")), "tel")
    x = F.col("line")
    return lines.withColumn("k", kind).where("k is not null").select("o_orderkey", "k", fields.is_summary(x).alias("summary"), fields.is_vat(x).alias("vat"), fields.is_total(x).alias("total"), fields.is_item(x).alias("item"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Customer And ' || c_mktsegment2 || ' Ltd' WHEN 1 THEN 'Customer of ' || c_mktsegment2 || ' B.V.' ELSE 'iPart ' || c_mktsegment END AS name
FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment2 FROM customer)""".replace("'Customer And '", "'Customer and '"))
def company_case(spark: SparkSession, d: str) -> DataFrame:
    kind, segment = F.col("c_custkey") % 3, F.col("c_mktsegment")
    raw = F.when(kind == 0, F.upper(F.concat(F.lit("customer and "), segment, F.lit(" ltd.")))).when(kind == 1, F.lower(F.concat(F.lit("customer of "), segment, F.lit(" bv")))).otherwise(F.concat(F.lit("iPart "), segment))
    return table(spark, d, "customer").select("c_custkey", fields.company_case(raw).alias("name"))


_KIND = "o_orderkey % 5"


@query(f"""WITH {PAGES} SELECT o_orderkey, CASE {_KIND} WHEN 0 THEN 14.4 WHEN 1 THEN 7.2 WHEN 2 THEN 9.6 END::DOUBLE AS deposit FROM page""")
def deposit_detect(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the pages each: a deposit line, one beside a total that names it, a deposit block, none, and a label that
    bears the VAT amount."""
    got = pages.extract(invoice_pages(spark, d)).select("o_orderkey", "net_amount", "vat_amount")
    kind, net, vat = F.col("o_orderkey") % 5, F.col("net_amount"), F.col("vat_amount")
    extra = F.when(kind == 0, "14.40").when(kind == 1, "7.20").when(kind == 2, "9.60").otherwise("0").cast("decimal(14,2)")
    total = (net + vat + extra).cast("decimal(14,2)")
    write = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    lines = F.array_compact(
        F.array(
            write("Total Net ", net), write("VAT ", vat), F.when(kind == 0, "BCRS Refundable Deposit 14.40").when(kind == 1, "BCRS 7.20").when(kind == 2, "Deposit Summary\nDeposit 9.60").when(kind == 4, write("BCRS ", vat)),
            F.when(kind == 1, write("Total incl VAT & BCRS ", total)).otherwise(write("Invoice Total ", total)),
        )
    )
    rows = got.select("o_orderkey", "net_amount", "vat_amount", total.alias("total_amount"), F.array_join(lines, "\n").alias("totals_raw"), F.lit(None).cast("string").alias("page_text_raw"))
    return deposits.with_deposit(rows).select("o_orderkey", F.col("deposit").cast("double").alias("deposit"))


def _sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    return invoice_rows(spark, d).withColumn("source_filename", F.concat(F.lit("batch"), (F.col("file_id") % 20).cast("string"), F.lit(".pdf"))).withColumn("validation_status", F.when(F.col("review_required"), "review").otherwise("ok"))


_SHEET = f"WITH {INV.strip()}, rows AS (SELECT *, 'batch' || (file_id % 20) || '.pdf' AS source_filename, CASE WHEN review_required THEN 'review' ELSE 'ok' END AS validation_status FROM inv)"


@query(f"""{_SHEET} SELECT source_filename, page_no, supplier_name, nominal_account_code, 'Account ' || nominal_account_code AS nominal_account_name, invoice_date, description, CAST(net_amount AS DOUBLE) AS net_amount, CAST(vat_amount AS DOUBLE) AS vat_amount, CAST(total_amount AS DOUBLE) AS total_amount,
CAST(confidence_score AS DOUBLE) AS confidence_score, validation_status, 'ACTION REQUIRED: Verify all extracted fields against original invoice' AS recommended_action, review_required, tenant, company, file_id, supplier_id FROM rows WHERE review_required""")
def export_review_sheet(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "part").select(F.col("p_type").alias("code"), F.concat(F.lit("Account "), "p_type").alias("account_name")).distinct()
    sheet = exports.invoices(_sheet_rows(spark, d).where("review_required"), accounts)
    return sheet.withColumns({c: F.col(c).cast("double") for c in [*fields.AMOUNTS, "confidence_score"]})


@query(f"""WITH {INV.strip()} SELECT batch_id, string_agg(DISTINCT 'f' || file_id || '.pdf', ', ' ORDER BY 'f' || file_id || '.pdf') AS uploaded_files, count(*) AS total_rows, count(*) FILTER (review_required) AS needs_review, CAST(sum(net_amount) AS DOUBLE) AS sum_net_amount, CAST(sum(vat_amount) AS DOUBLE) AS sum_vat_amount,
CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS sum_total_amount, CAST(coalesce(sum(confidence_score), 0) AS DOUBLE) / count(*) AS avg_confidence, count(DISTINCT file_id) AS distinct_source_files FROM inv GROUP BY 1""")
def export_summary_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d).withColumn("source_filename", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit(".pdf")))
    return exports.summary(rows, "batch_id")


@query("""SELECT s_suppkey, field, old_value, new_value FROM (SELECT s_suppkey, 's_name' AS field, s_name AS old_value, upper(s_name) AS new_value FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR), '7' FROM supplier WHERE s_suppkey % 3 = 0) WHERE old_value <> new_value""")
def audit_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    fixes = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(7).alias("s_nationkey"))
    return exports.audit_changes(rows, fixes, ["s_suppkey"], ["s_name", "s_nationkey"])

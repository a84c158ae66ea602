"""The invoice queries by name, over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import analytics, resolution, review, state, validation
from ledgerloom.sources import facts
from ledgerloom.sources.invoices import SQL as INV
from ledgerloom.sources.invoices import invoice_rows, suppliers, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {INV.strip()} {sql}" if " inv" in sql else sql
        return f

    return add


def _d(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS DOUBLE)"


_SUMS = f"{_d('net_amount')} AS net_total, {_d('vat_amount')} AS vat_total, {_d('total_amount')} AS grand_total"
_FLAG = "(coalesce(confidence_score < 0.55, false) OR review_required)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d, "supplier_id", "page_no", "net_amount", "vat_amount", "total_amount", "confidence_score", "review_required")
    return analytics.supplier_parts(rows.withColumn("named", F.col("page_no") != 7))


@query(f"SELECT tenant, company, count(*) AS row_count, count(*) FILTER (review_required) AS review_count, {_SUMS}, coalesce(CAST(sum(confidence_score) AS DOUBLE) / count(confidence_score), 0) AS avg_confidence, count(DISTINCT supplier_name) AS supplier_count FROM inv GROUP BY 1, 2")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return analytics.summary_of_parts(_parts(spark, d).join(suppliers(spark, d), "supplier_id"), "tenant", "company")


@query("SELECT company, count(*) AS row_count, count(DISTINCT batch_id) AS batches, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS grand_total FROM inv WHERE company IN (SELECT n_name FROM nation WHERE n_regionkey = 3) GROUP BY company")
def partitioned_company_spend(spark: SparkSession, d: str) -> DataFrame:
    """Over the fact laid out by tenant and company: only the folders of one region's nations are read."""
    fact = facts.store(invoice_rows(spark, d, "tenant", "company", "batch_id", "total_amount"))
    nations = table(spark, d, "nation").where("n_regionkey = 3").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = facts.scoped(spark, fact, nations.select(F.col("r_name").alias("tenant"), F.col("n_name").alias("company")))
    return rows.groupBy("company").agg(F.count("*").alias("row_count"), F.count_distinct("batch_id").alias("batches"), analytics.money("total_amount").alias("grand_total"))


@query(f"SELECT strftime(invoice_date, '%Y-%m') AS month, {_SUMS}, count(*) AS row_count FROM inv WHERE invoice_date IS NOT NULL GROUP BY 1")
def monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    return analytics.monthly(invoice_rows(spark, d, "invoice_date", "net_amount", "vat_amount", "total_amount"))


@query(f"SELECT strftime(invoice_date, '%Y-%m') AS month, {_SUMS}, count(*) AS row_count FROM inv WHERE invoice_date >= DATE '1998-06-01' - 372 AND tenant = 'EUROPE' GROUP BY 1")
def monthly_spend_last_year(spark: SparkSession, d: str) -> DataFrame:
    return analytics.monthly(analytics.scoped(invoice_rows(spark, d, "tenant", "invoice_date", "net_amount", "vat_amount", "total_amount"), "EUROPE"), "1998-06-15", 12)


@query(f"SELECT supplier_name, {_d('total_amount')} AS grand_total, count(*) AS row_count FROM inv WHERE supplier_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_of_parts(_parts(spark, d).join(suppliers(spark, d), "supplier_id"), 10)


@query("""SELECT r_name AS tenant, coalesce(c.n, 0) AS companies, coalesce(b.n, 0) AS batches, coalesce(f.n, 0) AS files, coalesce(w.n, 0) AS rows, round(coalesce(f.bytes, 0) / (1024 * 1024), 2) AS storage_mb FROM region
LEFT JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) c ON c.k = r_regionkey LEFT JOIN (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b ON b.k = r_regionkey
LEFT JOIN (SELECT n_regionkey AS k, count(*) AS n, sum(CAST(o_totalprice AS BIGINT)) AS bytes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) f ON f.k = r_regionkey
LEFT JOIN (SELECT n_regionkey AS k, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) w ON w.k = r_regionkey""")
def tenant_capacity(spark: SparkSession, d: str) -> DataFrame:
    read = lambda name: table(spark, d, name)
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("tenant"))
    batches = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("tenant", "c_custkey")
    files = read("orders").join(batches, F.col("o_custkey") == F.col("c_custkey")).select("tenant", F.col("o_totalprice").cast("long").alias("file_size_bytes"))
    lines = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("tenant")
    return analytics.capacity(read("region").select(F.col("r_name").alias("tenant")), companies=places, batches=batches, files=files, rows=lines)


@query("SELECT tenant, company, supplier_name, nominal_account_code, uses FROM (SELECT tenant, company, supplier_name, nominal_account_code, count(*) AS uses, row_number() OVER (PARTITION BY tenant, company, supplier_name ORDER BY count(*) DESC, nominal_account_code) AS k FROM inv WHERE supplier_name IS NOT NULL AND page_no <> 3 GROUP BY 1, 2, 3, 4) WHERE k = 1 AND uses >= 2")
def historical_nominal(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d, "tenant", "company", "supplier_name", "nominal_account_code", "page_no")
    return analytics.modal_nominal(rows.withColumn("nominal_account_code", F.when(F.col("page_no") != 3, F.col("nominal_account_code"))))


@query(f""", x AS (SELECT *, {_FLAG} AS flag FROM inv), y AS (SELECT file_id, count(*) AS row_count, count(*) FILTER (flag) AS flagged_count, count(*) FILTER (flag AND page_no % 2 = 0) AS outstanding, bool_or(flag AND page_no = 6) AS t, bool_or(flag AND page_no = 7) AS s, bool_or(flag AND page_no IN (1, 6)) AS n FROM x GROUP BY 1)
SELECT file_id, row_count, flagged_count, outstanding, concat_ws(',', CASE WHEN n THEN 'net_amount' END, CASE WHEN s THEN 'supplier_name' END, CASE WHEN t THEN 'total_amount' END) AS flagged_fields, CASE WHEN flagged_count = 0 THEN 'clean' WHEN outstanding > 0 THEN 'needs_review' ELSE 'reviewed' END AS state FROM y""")
def file_review_state(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_no")
    rows = invoice_rows(spark, d, "file_id", "page_no", "confidence_score", "review_required").withColumn("review_fields", F.when(page == 6, "total_amount, net_amount").when(page == 7, "supplier_name").when(page == 1, "net_amount,"))
    return analytics.file_review_state(rows, rows.where("page_no % 2 = 1").select("file_id", "page_no"), "review_fields")


@query(f"SELECT company, count(*) AS row_count, count(*) FILTER (review_required) AS needs_review, {_SUMS}, CAST(coalesce(sum(confidence_score), 0) AS DOUBLE) / count(*) AS avg_confidence, count(DISTINCT file_id) AS files FROM inv GROUP BY 1")
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    return analytics.export_summary(invoice_rows(spark, d, "company", "file_id", "net_amount", "vat_amount", "total_amount", "confidence_score", "review_required"), "company")


@query(f"SELECT file_id, page_no, supplier_name, CAST(confidence_score AS DOUBLE) AS confidence FROM inv WHERE {_FLAG} AND tenant = 'ASIA'")
def needs_review_rows(spark: SparkSession, d: str) -> DataFrame:
    return analytics.scoped(invoice_rows(spark, d), "ASIA").where(analytics.flagged()).select("file_id", "page_no", "supplier_name", F.col("confidence_score").cast("double").alias("confidence"))


@query("""SELECT page_no, count(*) FILTER (review_required) AS needs_review, count(*) FILTER (confidence_score < 0.7) AS low_confidence, count(*) FILTER (confidence_score IS NULL) AS unknown FROM inv GROUP BY 1""")
def review_list_filters(spark: SparkSession, d: str) -> DataFrame:
    return invoice_rows(spark, d, "page_no", "confidence_score", "review_required").groupBy("page_no").agg(F.count_if("review_required").alias("needs_review"), F.count_if(F.col("confidence_score") < 0.7).alias("low_confidence"), F.count_if(F.col("confidence_score").isNull()).alias("unknown"))


@query("SELECT p_partkey AS rule_id, p_name AS source_pattern FROM part WHERE p_size % 3 <> 0 AND (p_brand = 'Brand#13' OR p_size < 10) AND contains(lower(p_name), 'widget')")
def rule_search(spark: SparkSession, d: str) -> DataFrame:
    company = F.when(F.col("p_size") >= 10, F.col("p_brand"))
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("source_pattern"), company.alias("company"), (F.col("p_size") % 3 != 0).alias("active"))
    return state.scoped_rules(rules, "Brand#13").where(F.contains(F.lower("source_pattern"), F.lit("widget"))).select("rule_id", "source_pattern")


@query("""SELECT i.file_id, i.page_no, i.description, CASE WHEN i.page_no = 1 AND s_acctbal > 0 THEN 'Fixed ' || s_name ELSE i.supplier_name END AS supplier_name, coalesce(i.page_no = 1 AND s_acctbal > 0, false) AS corrected
FROM inv i LEFT JOIN supplier ON i.supplier_id = s_suppkey""")
def correction_overlay(spark: SparkSession, d: str) -> DataFrame:
    fixes = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier_id"), F.lit(1).alias("page_no"), F.concat(F.lit("Fixed "), "s_name").alias("supplier_name"))
    return state.overlay(invoice_rows(spark, d, "supplier_id", "file_id", "page_no", "description", "supplier_name"), fixes, ["supplier_id", "page_no"], ["supplier_name"]).select("file_id", "page_no", "description", "supplier_name", "corrected")


@query("SELECT tenant, coalesce(n_comment, '') AS account_name, count(*) AS row_count FROM inv LEFT JOIN (SELECT DISTINCT CASE WHEN p_type < 'M' THEN p_type ELSE 'X' || p_type END AS code, 'Account ' || p_type AS n_comment FROM part) ON trim(nominal_account_code) = code GROUP BY 1, 2")
def nominal_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.when(F.col("p_type") < "M", F.col("p_type")).otherwise(F.concat(F.lit("X"), "p_type")).alias("code"), F.concat(F.lit("Account "), "p_type").alias("account_name")).distinct()
    return invoice_rows(spark, d).join(names, F.trim("nominal_account_code") == F.col("code"), "left").groupBy("tenant", F.coalesce("account_name", F.lit("")).alias("account_name")).agg(F.count("*").alias("row_count"))


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'mt ' || (c_custkey % 150) END AS vat, coalesce(v.s_name, n.s_name) AS canonical, CASE WHEN v.s_name IS NOT NULL THEN 0 WHEN n.s_name IS NOT NULL THEN 1 END AS tier
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN upper('Supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0')) ELSE c_name END AS c_name FROM customer) AS c
LEFT JOIN supplier v ON c.c_custkey % 2 = 0 AND v.s_suppkey = c.c_custkey % 150 LEFT JOIN supplier n ON lower(n.s_name) = lower(c.c_name)""".replace("SELECT *, CASE", "SELECT c_custkey, CASE").replace("SELECT c_name AS name", "SELECT DISTINCT c_name AS name"))
def supplier_exact_match(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.upper(F.concat(F.lit("Supplier#"), F.lpad((key % 200).cast("string"), 9, "0")))).otherwise(F.col("c_name"))
    names = table(spark, d, "customer").select(name.alias("name"), F.when(key % 2 == 0, F.concat(F.lit("mt "), (key % 150).cast("string"))).alias("vat"))
    masters = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("canonical"), F.concat(F.lit("MT"), F.col("s_suppkey").cast("string")).alias("vat"))
    return resolution.exact_match(names, masters)


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\b(ltd|limited|plc|llc|inc|corp|co|group|trading|holdings|services|solutions)\\b', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH names AS (SELECT DISTINCT p_name || ' Trading Ltd' AS name FROM part), masters AS (SELECT min(p_partkey) AS ord, CASE WHEN p_name < 'm' THEN p_name ELSE p_type || ' ' || p_brand END || ' Holdings' AS canonical FROM part GROUP BY 2),
a AS (SELECT name, list_distinct(list_filter(string_split({_KEY.format(x='name')}, ' '), lambda w: w <> '')) AS a FROM names), b AS (SELECT ord, canonical, list_distinct(list_filter(string_split({_KEY.format(x='canonical')}, ' '), lambda w: w <> '')) AS b FROM masters),
s AS (SELECT name, ord, canonical, len(list_intersect(a, b)) / greatest(len(a), len(b)) AS score FROM a, b WHERE len(list_intersect(a, b)) > 0)
SELECT name, canonical, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, ord) AS k FROM s WHERE score >= 0.5) WHERE k = 1""")
def supplier_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    masters = part.groupBy(F.concat(F.when(F.col("p_name") < "m", F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", "p_brand")), F.lit(" Holdings")).alias("canonical")).agg(F.min("p_partkey").alias("ord"))
    return resolution.overlap_match(part.select(F.concat("p_name", F.lit(" Trading Ltd")).alias("name")), masters)


@query("""WITH w AS (SELECT DISTINCT p_brand AS s, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{4,}')) AS w FROM part), k AS (SELECT s, w, row_number() OVER (PARTITION BY s ORDER BY w) AS n FROM w),
g AS (SELECT s, string_agg(w, '|' ORDER BY w) AS keywords FROM k WHERE n <= 60 GROUP BY 1) SELECT p_brand AS supplier_name, count(*) AS hit_count, any_value(keywords) AS keywords FROM part LEFT JOIN g ON s = p_brand GROUP BY 1""")
def pattern_learning(spark: SparkSession, d: str) -> DataFrame:
    headers = table(spark, d, "part").select(F.col("p_brand").alias("supplier_name"), F.concat_ws(" ", "p_name", "p_type").alias("header"))
    return resolution.learn_patterns(headers).withColumn("keywords", F.array_join("keywords", "|"))


_TAXONOMY = [("Fasteners", ["bolt", "blue bolt", "ring"]), ("Devices", ["gizmo", "red widget", "widget"]), ("Sizes", ["small", "large", "economy"])]


@query("""SELECT CASE WHEN contains(x, 'bolt') OR contains(x, 'ring') THEN 'Fasteners' WHEN contains(x, 'gizmo') OR contains(x, 'widget') THEN 'Devices'
WHEN contains(x, 'small') OR contains(x, 'large') OR contains(x, 'economy') THEN 'Sizes' END AS category, count(*) AS row_count FROM (SELECT lower(p_type || ' ' || p_name) AS x FROM part) GROUP BY 1""")
def taxonomy_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("description"))
    return resolution.taxonomy(rows, _TAXONOMY).groupBy("category").agg(F.count("*").alias("row_count"))


# Totals that are off by a deposit, a discount or by more, so that every branch is met.
_OFF = "CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 0.05 WHEN 3 THEN 7.2 WHEN 4 THEN -12.34 WHEN 5 THEN 250.13 ELSE -900 END"
_CHECKED = f"""checked AS (SELECT l_orderkey, l_linenumber, l_partkey, net AS net_amount, CASE WHEN l_quantity > 45 THEN NULL ELSE vat END AS vat_amount, CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(net + vat + CAST({_OFF} AS DECIMAL(14,2)) AS DECIMAL(14,2)) END AS total_amount FROM taxed),
diffed AS (SELECT *, CAST(total_amount - (net_amount + coalesce(vat_amount, 0)) AS DECIMAL(14,2)) AS diff FROM checked),
judged AS (SELECT *, coalesce(net_amount > 0 AND (vat_amount > net_amount * 0.35 OR (vat_amount > 0 AND vat_amount < net_amount * 0.015)), false) AS odd, coalesce(net_amount > 0 AND vat_amount IS NULL AND total_amount > net_amount * 1.02, false) AS untaxed,
 coalesce(diff > 0.10 AND diff <= 200 AND CAST(diff % 1 AS DECIMAL(4,2)) IN (0.00, 0.10, 0.20, 0.25, 0.40, 0.50, 0.60, 0.75, 0.80), false) AS deposit FROM diffed),
valid AS (SELECT *, CASE WHEN deposit THEN 'ok_with_deposit' WHEN diff < -0.10 AND diff >= -500 THEN 'ok_with_discount' WHEN abs(diff) > 0.10 THEN 'totals_mismatch' WHEN odd THEN 'vat_anomaly' WHEN untaxed THEN 'vat_missing' ELSE 'ok' END AS status FROM judged),
reasoned AS (SELECT *, concat_ws('|', CASE WHEN odd THEN 'vat_anomaly' END, CASE WHEN untaxed THEN 'vat_missing' END, CASE WHEN deposit THEN 'deposit_component_detected:' || diff END, CASE WHEN deposit THEN 'totals_mismatch_advisory' END, CASE WHEN status = 'totals_mismatch' THEN status END) AS reasons FROM valid)"""
_LINES = INV[: INV.index("inv AS")].strip()


def _checked(spark: SparkSession, d: str) -> DataFrame:
    net = (F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(14,2)")
    vat = (net * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(14,2)")
    total = (net + vat + F.expr(_OFF).cast("decimal(14,2)")).cast("decimal(14,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", net.alias("net_amount"), F.when(F.col("l_quantity") <= 45, vat).alias("vat_amount"), F.when(F.col("l_quantity") != 1, total).alias("total_amount"))


@query(f"WITH {_LINES} {_CHECKED} SELECT l_orderkey, l_linenumber, l_partkey, CAST(diff AS DOUBLE) AS diff, status, reasons FROM reasoned")
def validate_totals(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate(_checked(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", F.col("diff").cast("double").alias("diff"), "status", F.array_join("reasons", "|").alias("reasons"))


@query("""SELECT file_id, page_no, description, CAST(least((CASE WHEN supplier_name IS NULL THEN 0 ELSE 20 END) + 20 + 20 + (CASE WHEN total_amount IS NULL THEN 0 ELSE 20 END) + 10 + 10 + (CASE WHEN total_amount = net_amount + vat_amount THEN 5 ELSE 0 END), 100) AS DOUBLE) / 100 AS confidence FROM inv""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d).withColumn("invoice_number", F.col("file_id"))
    return rows.select("file_id", "page_no", "description", validation.confidence(rows).cast("double").alias("confidence"))


@query(f"""WITH {_LINES} {_CHECKED}, ids AS (SELECT *, row_number() OVER () AS rid FROM reasoned), bands(reason, weight, band) AS (VALUES ('totals_mismatch', 80, 2), ('vat_anomaly', 70, 2), ('vat_missing', 50, 1), ('totals_mismatch_advisory', 35, 1), ('deposit_component_detected', 10, 0)),
parts AS (SELECT rid, unnest(string_split(reasons, '|')) AS r, generate_subscripts(string_split(reasons, '|'), 1) AS i FROM ids WHERE reasons <> ''),
one AS (SELECT rid, string_agg(r, '|' ORDER BY weight DESC, i) AS review_reasons, max(band) AS top FROM parts JOIN bands ON string_split(r, ':')[1] = reason GROUP BY rid)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(review_reasons, '') AS review_reasons, CASE top WHEN 2 THEN 'high' WHEN 1 THEN 'medium' WHEN 0 THEN 'low' END AS review_priority, coalesce(top = 2, false) AS review_required, CASE top WHEN 2 THEN 'review_validation_failed' WHEN 1 THEN 'ok_warned' ELSE 'ok' END AS validation_status FROM ids LEFT JOIN one ON ids.rid = one.rid""")
def review_decision(spark: SparkSession, d: str) -> DataFrame:
    decided = review.decide(validation.validate(_checked(spark, d)))
    return decided.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("review_reasons", "|").alias("review_reasons"), "review_priority", "review_required", "validation_status")


@query(""", x AS (SELECT *, description = 'Brand#13 blue bolt' AS failed, CASE WHEN page_no = 6 AND file_id % 2 = 0 THEN NULL ELSE net_amount END AS net FROM inv)
SELECT file_id, page_no, description, problems, left('Page ' || page_no || ': ' || split_part(problems, '|', 1), 255) AS title, CASE WHEN coalesce(supplier_name, '') = '' OR failed THEN 'high' ELSE 'normal' END AS priority FROM (SELECT *, concat_ws('|', CASE WHEN coalesce(supplier_name, '') = '' THEN 'Supplier name could not be identified' END, CASE WHEN total_amount IS NULL AND net IS NULL THEN 'No amounts extracted (total and net both missing)' END,
 CASE WHEN failed THEN 'Page processing error: Brand#13 blue bolt' WHEN confidence_score < 0.60 THEN 'Low extraction confidence (' || CAST(confidence_score * 100 AS INTEGER) || '%)' END) AS problems FROM x) WHERE problems <> ''""")
def issue_log(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d).withColumn("method_used", F.when(F.col("description") == "Brand#13 blue bolt", "page_error").otherwise("text"))
    rows = rows.withColumn("net_amount", F.when(~((F.col("page_no") == 6) & (F.col("file_id") % 2 == 0)), F.col("net_amount")))
    return review.issues(rows).select("file_id", "page_no", "description", F.array_join("problems", "|").alias("problems"), "title", "priority")


@query("SELECT tenant, company, batch_id, file_id, page_no, 'Page processing error: ' || left(description, 180) AS description, 'page_error' AS method_used, 'PAGE_ERROR=' || description AS page_text_raw, CAST(0 AS DOUBLE) AS confidence FROM inv")
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    failed = invoice_rows(spark, d).withColumnRenamed("description", "error")
    return review.error_rows(failed).select("tenant", "company", "batch_id", "file_id", "page_no", "description", "method_used", "page_text_raw", F.col("confidence_score").cast("double").alias("confidence"))


@query("""SELECT o_orderkey, CAST(s AS DOUBLE) AS line_sum, CAST(o_totalprice AS DOUBLE) AS page_total, n AS line_count, abs(s - CAST(o_totalprice AS DECIMAL(14,2))) > 0.05 AS mismatch FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""".replace("CAST(o_totalprice AS DOUBLE)", "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE)"))
def line_sum_reconcile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("l_extendedprice").cast("decimal(14,2)").alias("line_total"), F.col("o_totalprice").cast("decimal(14,2)").alias("page_total"))
    return validation.line_sums(lines, ["o_orderkey"]).select("o_orderkey", F.col("line_sum").cast("double").alias("line_sum"), F.col("page_total").cast("double").alias("page_total"), "line_count", "mismatch")


@query("""SELECT row_kind, count(*) AS row_count, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(vat) AS DOUBLE) AS vat, CAST(sum(total) AS DOUBLE) AS total FROM (
SELECT 'original' AS row_kind, net_amount AS net, vat_amount AS vat, CASE WHEN page_no = 2 THEN greatest(total_amount - 7.20, net_amount + vat_amount) ELSE total_amount END AS total FROM inv
UNION ALL SELECT 'deposit', 7.20, 0, 7.20 FROM inv WHERE page_no = 2) GROUP BY 1""")
def deposit_split_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d).withColumn("deposit", F.when(F.col("page_no") == 2, F.lit("7.20").cast("decimal(14,2)")))
    return state.deposit_split(rows).groupBy("row_kind").agg(F.count("*").alias("row_count"), F.sum("net_amount").cast("double").alias("net"), F.sum("vat_amount").cast("double").alias("vat"), F.sum("total_amount").cast("double").alias("total"))


_PRICE = "CASE p_size % 5 WHEN 0 THEN '€ ' || CAST(p_retailprice AS DECIMAL(14,2)) WHEN 1 THEN replace(CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR), '.', ',') WHEN 2 THEN '1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',50' WHEN 3 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.75 EUR' ELSE 'n/a' END"


@query(f"""SELECT p_partkey, raw, CAST(CASE p_size % 5 WHEN 0 THEN CAST(p_retailprice AS DECIMAL(14,2)) WHEN 1 THEN CAST(p_retailprice AS DECIMAL(14,2)) WHEN 2 THEN 1000 + p_size + 0.50 WHEN 3 THEN 1000 + p_size + 0.75 END AS DOUBLE) AS amount FROM (SELECT *, {_PRICE} AS raw FROM part)""")
def parse_amount(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumn("raw", F.expr(_PRICE.replace("VARCHAR", "STRING")))
    return rows.select("p_partkey", "raw", money.parse_amount(F.col("raw")).cast("double").alias("amount"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d.%m.%y') END AS raw, CAST(o_orderdate AS DATE) AS invoice_date,
o_orderkey % 3 <> 0 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders""")
def parse_date_dmy(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yy"))
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("p", dates.parse_date(F.col("raw")))
    return rows.select("o_orderkey", "raw", F.col("p.normalized").alias("invoice_date"), F.col("p.ambiguous").alias("ambiguous"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean, CAST(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS INTEGER) AS meaningful FROM documents""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"), text.meaningful_chars(F.col("text")).alias("meaningful"))


@query(f"SELECT p_partkey, {_KEY.format(x='name')} AS key FROM (SELECT p_partkey, p_name || ' & Sons (' || p_brand || ') Co. Ltd' AS name FROM part)")
def supplier_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.supplier_key(F.concat("p_name", F.lit(" & Sons ("), "p_brand", F.lit(") Co. Ltd"))).alias("key"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:20], ' ') AS words FROM documents")
def limit_20_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN contains(text, '£') OR contains(lower(text), 'gbp') THEN 'GBP' WHEN contains(text, '€') OR contains(lower(text), 'eur') THEN 'EUR' WHEN contains(text, '$') OR contains(lower(text), 'usd') THEN 'USD' END AS currency FROM documents")
def currency_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.currency(F.col("text")).alias("currency"))


_TEMPLATE = [
    {"column_order": 2, "column_heading": "supplier", "column_type": "mapped", "source_field": "supplier_name", "transform_rule": "uppercase"},
    {"column_order": 1, "column_heading": "file", "column_type": "mapped", "source_field": "file_id"},
    {"column_order": 3, "column_heading": "dated", "column_type": "mapped", "source_field": "invoice_date", "transform_rule": "date_format:%d/%m/%Y"},
    {"column_order": 4, "column_heading": "kind", "column_type": "static", "static_value": "PI"},
    {"column_order": 5, "column_heading": "size", "column_type": "conditional", "condition_rules": [{"if_field": "total_amount", "operator": "is_null", "output": "unknown"}, {"if_field": "total_amount", "operator": "gte", "value": "40000", "output": "large"}, {"if_field": "total_amount", "operator": "lt", "value": "5000", "output": "small"}]},
    {"column_order": 6, "column_heading": "unused", "column_type": "static", "static_value": "x", "is_active": False},
]


@query("SELECT CAST(file_id AS VARCHAR) AS file, coalesce(upper(supplier_name), '') AS supplier, strftime(invoice_date, '%d/%m/%Y') AS dated, 'PI' AS kind, CASE WHEN total_amount IS NULL THEN 'unknown' WHEN total_amount >= 40000 THEN 'large' WHEN total_amount < 5000 THEN 'small' ELSE '' END AS size FROM inv")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    return state.render(invoice_rows(spark, d, "file_id", "supplier_name", "invoice_date", "total_amount"), _TEMPLATE)


_STATUSES = "['scanned', 'created', 'in_review', 'approved', 'exported', '', NULL]"


@query(f"""SELECT status, target, (CASE WHEN coalesce(status, '') IN ('', 'created') THEN 'scanned' ELSE status END || '>' || target) IN ('scanned>in_review', 'in_review>approved', 'in_review>in_review', 'approved>exported', 'approved>in_review') AS allowed, coalesce(status <> 'exported', true) AS editable, coalesce(status = 'exported', false) AS reopens, count(*) AS changes
FROM (SELECT {_STATUSES}[1 + o_custkey % 7] AS status, {_STATUSES}[1 + o_orderkey % 5] AS target FROM orders) GROUP BY ALL""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["scanned", "created", "in_review", "approved", "exported", "", None]))
    pick = lambda c, n: F.get(names, (F.col(c) % n).cast("int"))
    asked = table(spark, d, "orders").select(pick("o_custkey", 7).alias("status"), pick("o_orderkey", 5).alias("target"))
    return state.allowed(asked).groupBy("status", "target", "allowed", "editable", "reopens").agg(F.count("*").alias("changes"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def audit_latest(spark: SparkSession, d: str) -> DataFrame:
    return analytics.newest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH s AS (SELECT * FROM (SELECT lower(trim(code)) AS k, code, name, row_number() OVER (PARTITION BY lower(trim(code)) ORDER BY ord) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'SUPPLIER#' ELSE 'supplier#' END || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS code, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS name, c_custkey AS ord FROM customer) WHERE trim(name) <> '') WHERE n = 1)
SELECT coalesce(s_name, code) AS code, coalesce(name, s_name) AS name, CASE WHEN s_name IS NULL THEN 'imported' WHEN k IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM supplier FULL JOIN s ON lower(s_name) = k""")
def import_dedupe_upsert(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    code = F.concat(F.when(key % 2 == 0, "SUPPLIER#").otherwise("supplier#"), F.lpad((key % 150).cast("string"), 9, "0"))
    staged = table(spark, d, "customer").select(code.alias("code"), F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"), key.alias("ord"))
    return state.upsert(table(spark, d, "supplier").select(F.col("s_name").alias("code"), F.col("s_name").alias("name")), staged, "code", "ord")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Review — odd' WHEN 2 THEN 'Spot-check recommended — extraction confidence below optimal' ELSE 'ACTION REQUIRED: Total amount missing — enter value from original invoice' END AS recommended_action FROM orders""")
def recommended_action(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    status = F.when(k == 1, "odd").when(k == 2, "ok_warned").when(k == 3, "review_no_amount")
    return table(spark, d, "orders").select("o_orderkey", review.action(status).alias("recommended_action"))


@query("SELECT s_nationkey AS company, s_name AS code, s_suppkey = m AS is_default FROM supplier JOIN (SELECT s_nationkey AS n, min(s_suppkey) AS m FROM supplier GROUP BY 1) ON n = s_nationkey")
def default_nominal_exclusive(spark: SparkSession, d: str) -> DataFrame:
    accounts = table(spark, d, "supplier").select(F.col("s_nationkey").alias("company"), F.col("s_name").alias("code"), "s_suppkey")
    chosen = accounts.groupBy("company").agg(F.min_by("code", "s_suppkey").alias("code"))
    return state.exclusive_default(accounts.drop("s_suppkey"), chosen)


@query("""WITH a AS (SELECT s_suppkey AS id, n_regionkey AS tenant, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS company, s_name AS template FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
SELECT n_regionkey AS tenant, n_nationkey AS company, coalesce((SELECT arg_min(template, id) FROM a WHERE a.tenant = n_regionkey AND a.company = n_nationkey), (SELECT arg_min(template, id) FROM a WHERE a.tenant = n_regionkey AND a.company IS NULL)) AS template FROM nation""")
def effective_template(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    given = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("tenant"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("company"), F.col("s_name").alias("template"), (F.col("s_acctbal") > 5000).alias("active"))
    return state.effective_template(nation.select(F.col("n_regionkey").alias("tenant"), F.col("n_nationkey").alias("company")), given)

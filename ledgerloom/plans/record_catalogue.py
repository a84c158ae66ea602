"""Queries over suppliers, accounts, rules and edits, and SQL that gives the same rows by comparing everything.

The inputs are SQL over the star-schema tables, the same for both sides; what is done with them is not.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, fields, text
from ledgerloom.operators import accounts, analytics, deposits, edit_log, edits, issues, listing, master_data, merging, pages, patterns, regions, resolution, review, rules, state
from ledgerloom.shared import observed, stored
from ledgerloom.sources.invoices import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = re.sub(r"\{(\w+)\}", r"\1", sql)
        return f

    return add


def made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, d, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\b(ltd|limited|plc|llc|inc|corp|co|group|trading|holdings|services|solutions)\b', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _key(x: str) -> str:
    return _KEY.replace("{x}", x)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_key(x)}, ' '), lambda w: w NOT IN ('', 'the', 'and', 'of', 'for', 'in', 'a', 'an', 'de', 'la', 'le', 'el')))"


_SCOPE = "'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company"
_CANONICAL = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' Holdings' WHEN 1 THEN p_name || ' Limited' WHEN 2 THEN p_type || ' ' || p_name || ' Group' ELSE lower(p_type) END"
_ROWS = f"""SELECT {_SCOPE}, p_partkey AS row_id,
CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN upper(p_name) || ' LTD' WHEN p_partkey % 5 = 1 THEN p_name || ' ' || lower(p_type) WHEN p_partkey % 5 = 2 THEN substring(p_name, 1, 6) || ' Co' WHEN p_partkey % 5 = 3 THEN ' The ' || p_name || ' of ' || p_type || ' and ' || p_brand ELSE p_type || ' trading' END AS supplier_name,
CASE WHEN p_partkey % 7 = 0 THEN 'mt ' || CAST(p_partkey % 50 AS STRING) END AS supplier_vat, CASE WHEN p_size % 5 = 0 THEN '' END AS supplier_posting_account, CASE WHEN p_size % 9 = 0 THEN 'N' || p_type END AS nominal_account_code,
CASE WHEN p_size % 4 <> 0 THEN p_name || ' ' || p_type END AS description, CASE WHEN p_size % 6 = 0 THEN 'see A' || p_type END AS line_items_raw FROM {{part}}"""
_MASTERS = f"SELECT {_SCOPE}, p_partkey AS ord, {_CANONICAL} AS canonical, CASE WHEN p_size % 2 = 0 THEN 'MT' || CAST(p_partkey % 50 AS STRING) END AS vat_number, p_size <> 1 AS is_active, CASE WHEN p_size % 3 = 0 THEN 'P' || CAST(p_size AS STRING) END AS account_code, 'Q' || CAST(p_size AS STRING) AS posting_account, CASE WHEN p_size % 7 = 0 THEN 'D' || p_type END AS default_nominal FROM {{part}}"
_ACCOUNTS = f"SELECT tenant, company, min(p_partkey) AS ord, 'A' || p_type AS code, min(p_name) AS name, p_type = 'LARGE' AS is_default, true AS is_active FROM (SELECT {_SCOPE}, * FROM {{part}}) GROUP BY tenant, company, p_type"
_HISTORY = f"SELECT {_SCOPE}, {_CANONICAL} AS supplier_name, CASE WHEN p_size % 4 <> 0 THEN p_type END AS nominal_account_code FROM {{part}}"
_OWN_HISTORY = f"{_HISTORY} UNION ALL SELECT {_SCOPE}, p_name || ' ' || lower(p_type), 'H' || p_type FROM {{part}} UNION ALL SELECT {_SCOPE}, p_name || ' ' || lower(p_type), 'H' || p_type FROM {{part}} WHERE p_size % 3 <> 0 UNION ALL SELECT {_SCOPE}, upper(p_name) || ' LTD', 'O' || p_type FROM {{part}} UNION ALL SELECT {_SCOPE}, upper(p_name) || ' LTD', 'O' || p_type FROM {{part}}"
# Few masters, so that many rows have none.
_FEW_MASTERS = f"SELECT * FROM ({_MASTERS}) WHERE ord % 16 = 1"
_TAXONOMY = [("gear", ["hot gear", "cold gear", "gear"]), ("bolt", ["blue bolt", "small"])]

_MATCH = f"""n AS (SELECT DISTINCT tenant, company, supplier_name, supplier_vat FROM ({_ROWS})),
nn AS (SELECT *, {_key('supplier_name')} AS nk, {_words('supplier_name')} AS nw FROM n), mm AS (SELECT *, {_key('canonical')} AS mk, {_words('canonical')} AS mw FROM ({_MASTERS}) WHERE is_active),
c AS (SELECT nn.tenant, nn.company, supplier_name, supplier_vat, ord, CASE WHEN upper(regexp_replace(supplier_vat, '\\s', '', 'g')) = vat_number THEN 0 WHEN lower(trim(supplier_name)) = lower(canonical) THEN 1 ELSE 2 END AS tier,
  CASE WHEN nk <> '' AND mk <> '' AND (contains(mk, nk) OR contains(nk, mk)) THEN 0.85 WHEN len(nw) > 0 AND len(mw) > 0 THEN len(list_intersect(nw, mw)) / greatest(len(nw), len(mw)) ELSE 0 END::DOUBLE AS s FROM nn JOIN mm ON nn.tenant = mm.tenant AND nn.company = mm.company),
matched AS (SELECT tenant, company, supplier_name, supplier_vat, ord, tier, CASE WHEN tier < 2 THEN 1.0 ELSE s END::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY tenant, company, supplier_name, supplier_vat ORDER BY tier, CASE WHEN tier < 2 THEN 1 ELSE s END DESC, ord) AS k FROM c WHERE tier < 2 OR s >= 0.5) WHERE k = 1)"""


@query(f"WITH {_MATCH} SELECT * FROM matched")
def supplier_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return accounts.match_suppliers(made(spark, d, _ROWS), made(spark, d, _MASTERS))


_CHART = f"""chart AS ({_ACCOUNTS}), used AS (SELECT * FROM (SELECT tenant, company, supplier_name, nominal_account_code AS used, row_number() OVER (PARTITION BY tenant, company, supplier_name ORDER BY count(*) DESC, nominal_account_code) AS k, count(*) AS uses FROM ({_HISTORY}) WHERE nominal_account_code IS NOT NULL GROUP BY 1, 2, 3, 4) WHERE k = 1 AND uses >= 2)"""


def _codes(history: str) -> str:
    """SQL for the account of x.txt, by the rules one after another."""
    topic = "CASE WHEN contains(lower(txt), 'gear') THEN 'gear' WHEN contains(lower(txt), 'blue bolt') OR contains(lower(txt), 'small') THEN 'bolt' END"
    pick = lambda test: f"(SELECT arg_min(code, ord) FROM chart a WHERE a.tenant = x.tenant AND a.company = x.company AND ({test}))"
    return f"{pick(f'contains(lower(a.name), ({topic}))')} AS by_topic, {history} AS by_history, CASE WHEN txt <> '' THEN {pick('contains(lower(txt), lower(a.name)) OR contains(lower(txt), lower(a.code))')} END AS by_word, {pick('a.is_default')} AS by_default"


@query(f"""WITH {_CHART}, x AS (SELECT *, concat_ws(' ', description, line_items_raw) AS txt FROM ({_ROWS})), y AS (SELECT *, CASE WHEN row_id % 3 = 0 THEN (SELECT arg_min(code, ord) FROM chart a WHERE a.tenant = x.tenant AND a.company = x.company AND contains(lower(a.name), 'ring')) END AS by_hint, {_codes("CASE WHEN row_id % 5 = 0 THEN 'H1' END")} FROM x)
SELECT row_id, coalesce(by_hint, by_topic, by_history, by_word, by_default) AS code, CASE WHEN by_hint IS NOT NULL THEN 'supplier_rule' WHEN by_topic IS NOT NULL THEN 'taxonomy_match' WHEN by_history IS NOT NULL THEN 'historical_similarity' WHEN by_word IS NOT NULL THEN 'keyword_match' WHEN by_default IS NOT NULL THEN 'default' ELSE 'unresolved' END AS method,
 CASE WHEN by_hint IS NOT NULL THEN 0.95 WHEN by_topic IS NOT NULL THEN 0.9 WHEN by_history IS NOT NULL THEN 0.8 WHEN by_word IS NOT NULL THEN 0.7 WHEN by_default IS NOT NULL THEN 0.4 ELSE 0 END::DOUBLE AS confidence FROM y""")
def classify_accounts(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, _ROWS).withColumns({"nominal_hint": F.when(F.col("row_id") % 3 == 0, "ring"), "history_code": F.when(F.col("row_id") % 5 == 0, "H1")})
    return accounts.classified(rows, made(spark, d, _ACCOUNTS), _TAXONOMY).select("row_id", "code", "method", F.col("confidence").cast("double").alias("confidence"))


_READ = "SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN '12 ' || p_name || ' |' WHEN 1 THEN '|' || upper(p_name) || ' Ltd.' WHEN 2 THEN p_name || '  ' || p_type || ' 7' WHEN 3 THEN p_type || ' gizmos' WHEN 4 THEN '-- 3 --' ELSE p_type || ' ' || p_name || ' ' || replace(p_brand, '#', '') || ' Company' END AS raw, CASE WHEN p_partkey % 9 = 0 THEN 'mt' || CAST(p_size AS STRING) END AS vat FROM {part}"
_LIST = "SELECT min(p_partkey) AS ord, p_name || ' ' || lower(p_type) AS canonical, max(CASE WHEN p_size % 10 = 0 THEN 'MT ' || CAST(p_size AS STRING) END) AS vat_number, array_agg(DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type || ' works' END) AS aliases FROM {part} GROUP BY 2"
_CORE = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '\b(ltd|limited|plc|llc|llp|inc|co|company|group|holdings|malta|mt|gmbh|sarl|bv|nv|ag|spa|srl)\b', '', 'g'), '\s+'), lambda w: len(w) > 2 AND w NOT IN ('the', 'a', 'of', 'and', '&', 'for')))"




def _listed(names: str, master_list: str) -> str:
    """SQL that meets names (raw, vat) with a list of suppliers, comparing all with all; the last of its tables is `named`."""
    part = lambda x: x.replace("{part}", "part")
    core = lambda x: _CORE.replace("{x}", x)
    return f"""nr AS (SELECT *, {core('clean')} AS nw FROM (SELECT raw, vat, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(raw, '[|]|(^| )[0-9]{{1,2}}( |$)', ' ', 'g'), '\\s+', ' ', 'g')), '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') AS clean FROM ({part(names)}))),
nl AS ({part(master_list)}), nf AS (SELECT *, {core('form')} AS fw FROM (SELECT ord, canonical, vat_number, unnest(list_append(aliases, canonical)) AS form FROM nl)),
np AS (SELECT nr.raw, nr.vat, ord, CASE WHEN upper(regexp_replace(vat, '\\s', '', 'g')) = regexp_replace(vat_number, '\\s', '', 'g') THEN 0 WHEN clean = '' THEN 9 WHEN lower(clean) = lower(form) THEN 1 WHEN contains(lower(clean), lower(form)) OR contains(lower(form), lower(clean)) THEN 2 ELSE 3 END AS tier,
 CASE WHEN len(nw) > 0 AND len(fw) > 0 THEN len(list_intersect(nw, fw)) / greatest(len(nw), len(fw)) ELSE 0 END::DOUBLE AS s FROM nr, nf),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw, vat ORDER BY tier, CASE WHEN tier < 3 THEN 0 ELSE s END DESC, ord) AS k FROM np) WHERE k = 1),
named AS (SELECT nr.raw, nr.vat, nr.clean, CASE WHEN tier < 3 OR tier = 3 AND s >= 0.6 THEN nl.canonical ELSE clean END AS canonical, CASE WHEN tier = 0 THEN 'vat_match' WHEN tier < 3 THEN 'alias_match' WHEN tier = 3 AND s >= 0.6 THEN 'fuzzy_match' ELSE 'unmatched' END AS match_method,
 round(CASE tier WHEN 0 THEN 1 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN s ELSE 0 END::DOUBLE, 2) AS match_confidence, CASE WHEN tier = 0 THEN NULL WHEN clean = '' THEN 'supplier_unknown' WHEN tier = 3 AND s < 0.75 THEN 'supplier_low_confidence' END AS review_reason, nb.ord
 FROM nr JOIN nb ON nr.raw = nb.raw AND nr.vat IS NOT DISTINCT FROM nb.vat JOIN nl ON nb.ord = nl.ord)"""


def _spark_list(sql: str) -> str:
    return sql.replace("array_agg", "collect_set").replace("DISTINCT CASE", "CASE")


@query(f"WITH {_listed(_READ, _LIST)} SELECT * EXCLUDE (ord) FROM named")
def supplier_normalise(spark: SparkSession, d: str) -> DataFrame:
    return accounts.normalised_suppliers(made(spark, d, _READ), made(spark, d, _spark_list(_LIST))).drop("ord")


_BRAND_SQL = "(VALUES (0, 'rothmans', 'Tobacco'), (1, 'pall mall', 'Tobacco'), (2, 'du maurier', 'Tobacco'), (3, 'lucky strike', 'Tobacco'), (4, 'benson & hedges', 'Tobacco'), (5, 'benson and hedges', 'Tobacco'), (6, 'marlboro', 'Tobacco'), (7, 'dunhill', 'Tobacco'), (8, 'parliament', 'Tobacco'), (9, 'chesterfield', 'Tobacco'), (10, 'winston cigarette', 'Tobacco'), (11, 'camel cigarette', 'Tobacco'), (12, 'royals cigarette', 'Tobacco'), (13, 'heineken', 'Alcohol'), (14, 'carlsberg', 'Alcohol'), (15, 'amstel', 'Alcohol'), (16, 'corona beer', 'Alcohol'), (17, 'guinness', 'Alcohol'), (18, 'peroni', 'Alcohol'), (19, 'cisk', 'Alcohol'), (20, 'hopleaf', 'Alcohol'), (21, 'jack daniel', 'Alcohol'), (22, 'johnnie walker', 'Alcohol'), (23, 'absolut vodka', 'Alcohol'), (24, 'baileys', 'Alcohol'), (25, 'coca cola', 'Beverages'), (26, 'coke zero', 'Beverages'), (27, 'pepsi cola', 'Beverages'), (28, 'fanta', 'Beverages'), (29, 'sprite', 'Beverages'), (30, 'ribena', 'Beverages'), (31, 'monster energy', 'Beverages'), (32, 'red bull', 'Beverages'), (33, 'lucozade', 'Beverages'), (34, '7up', 'Beverages'), (35, 'kinnie', 'Beverages'), (36, 'san pellegrino', 'Beverages'), (37, 'acqua panna', 'Beverages'), (38, 'evian', 'Beverages'), (39, 'bigilla', 'Food'), (40, 'baguette', 'Food'), (41, 'ftira', 'Food'), (42, 'olive oil', 'Food'), (43, 'catering supplies', 'Food'), (44, 'fresh seafood', 'Food'), (45, 'fresh produce', 'Food')) AS b(ord, alias, label)"
# Each part's text names up to two brands, or half of one.
_BRANDED = f"SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size % 4 <> 0 THEN upper(x.alias) END, p_type, CASE WHEN p_size % 3 = 0 THEN y.alias WHEN p_size % 3 = 1 THEN substring(y.alias, 2, 20) END) AS words FROM {{part}} JOIN {_BRAND_SQL.replace(' b(', ' x(')} ON x.ord = p_partkey * 7 % 46 JOIN {_BRAND_SQL.replace(' b(', ' y(')} ON y.ord = p_partkey % 46"


@query(f"WITH t AS ({_BRANDED}) SELECT p_partkey, (SELECT arg_min(label, ord) FROM {_BRAND_SQL} WHERE contains(lower(words), alias)) AS brand FROM t")
def brand_hints(spark: SparkSession, d: str) -> DataFrame:
    return patterns.labelled(made(spark, d, _BRANDED), F.col("words"), patterns.brands(spark), "brand").select("p_partkey", "brand")


# As many aliases as there are parts, some of them within others.
_ALIASES = "SELECT p_partkey * 3 AS ord, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN upper(p_name) WHEN 2 THEN substring(p_name, 2, 7) ELSE p_type || ' ' || CAST(p_partkey AS STRING) END AS alias, p_brand AS label FROM {part}"
_SAID = "SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN concat_ws(' ', p_brand, p_name, p_type, CAST(p_partkey + p_size % 2 AS STRING)) END AS words FROM {part}"


@query(f"WITH a AS ({_ALIASES}), t AS ({_SAID}) SELECT p_partkey, (SELECT arg_min(label, ord) FROM a WHERE alias <> '' AND contains(lower(words), lower(alias))) AS label FROM t")
def alias_labels(spark: SparkSession, d: str) -> DataFrame:
    return patterns.labelled(made(spark, d, _SAID), F.col("words"), made(spark, d, _ALIASES)).select("p_partkey", "label")


@query(f"WITH chart AS ({_ACCOUNTS}), x AS (SELECT row_id, tenant, company, concat_ws(' ', description, line_items_raw) AS txt FROM ({_ROWS})) SELECT row_id, (SELECT arg_min(code, ord) FROM chart a WHERE a.tenant = x.tenant AND a.company = x.company AND (contains(lower(txt), lower(a.name)) OR contains(lower(txt), lower(a.code)))) AS mentioned FROM x")
def account_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, f"SELECT row_id, tenant, company, concat_ws(' ', description, line_items_raw) AS txt FROM ({_ROWS})")
    return accounts.mentions(rows, made(spark, d, _ACCOUNTS), "txt").select("row_id", "mentioned")


# The list knows a third of the names, and gives a hint for some.
_HINTED_LIST = f"SELECT *, CASE WHEN ord % 4 = 0 THEN 'ring' WHEN ord % 4 = 1 THEN '' END AS nominal_hint FROM ({_LIST}) WHERE ord % 3 = 0"


@query(f"""WITH {_MATCH.replace(f'({_MASTERS})', f'({_FEW_MASTERS})')}, {_CHART.replace(_HISTORY, _OWN_HISTORY)},
k AS (SELECT r.*, m.canonical, coalesce(m.account_code, m.posting_account) AS posting, m.default_nominal, coalesce(m.canonical, r.supplier_name) AS name1 FROM ({_ROWS}) r LEFT JOIN matched t ON r.tenant = t.tenant AND r.company = t.company AND r.supplier_name IS NOT DISTINCT FROM t.supplier_name AND r.supplier_vat IS NOT DISTINCT FROM t.supplier_vat
 LEFT JOIN ({_FEW_MASTERS}) m ON m.tenant = t.tenant AND m.company = t.company AND m.ord = t.ord),
{_listed('SELECT DISTINCT name1 AS raw, CAST(NULL AS VARCHAR) AS vat FROM k WHERE name1 <> ' + "''", _HINTED_LIST)},
x AS (SELECT k.*, concat_ws(' ', description, line_items_raw) AS txt, CASE WHEN n.match_method <> 'unmatched' THEN nl.nominal_hint END AS hint, CASE WHEN n.match_method <> 'unmatched' AND n.match_confidence >= 0.7 THEN n.canonical ELSE name1 END AS name2 FROM k LEFT JOIN named n ON n.raw = k.name1 LEFT JOIN nl ON nl.ord = n.ord),
z AS (SELECT x.*, u.used, v.used AS own_used FROM x LEFT JOIN used u ON u.tenant = x.tenant AND u.company = x.company AND u.supplier_name = x.canonical LEFT JOIN used v ON v.tenant = x.tenant AND v.company = x.company AND v.supplier_name = coalesce(x.canonical, x.name2)),
y AS (SELECT *, CASE WHEN hint <> '' THEN (SELECT arg_min(code, ord) FROM chart a WHERE a.tenant = x.tenant AND a.company = x.company AND contains(lower(a.name), lower(x.hint))) END AS by_hint, {_codes('own_used')} FROM z x)
SELECT row_id, CASE WHEN nominal_account_code IS NULL AND default_nominal IS NULL AND used IS NULL THEN name2 ELSE name1 END AS supplier_name, coalesce(nullif(supplier_posting_account, ''), posting) AS supplier_posting_account, coalesce(nominal_account_code, default_nominal, used, by_hint, by_topic, by_history, by_word, by_default) AS nominal_account_code,
 CASE WHEN nominal_account_code IS NOT NULL THEN 'given' WHEN default_nominal IS NOT NULL THEN 'supplier_default' WHEN used IS NOT NULL THEN 'historical' WHEN by_hint IS NOT NULL THEN 'supplier_rule' WHEN by_topic IS NOT NULL THEN 'taxonomy_match' WHEN by_history IS NOT NULL THEN 'historical_similarity' WHEN by_word IS NOT NULL THEN 'keyword_match' WHEN by_default IS NOT NULL THEN 'default' ELSE 'unresolved' END AS method FROM y""")
def account_suggestion(spark: SparkSession, d: str) -> DataFrame:
    made_ = [made(spark, d, x) for x in (_ROWS, _FEW_MASTERS, _ACCOUNTS, _OWN_HISTORY)]
    return accounts.suggest(*made_, _TAXONOMY, made(spark, d, _spark_list(_HINTED_LIST))).select("row_id", "supplier_name", "supplier_posting_account", "nominal_account_code", "method")


# --- rules ------------------------------------------------------------------------------------------------------------

# Rules rename one name to the next one's, so that chains are met; some are global, some off, some for fields.
_RULES = """SELECT p_partkey AS id, 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS company, CASE p_partkey % 5 WHEN 0 THEN 'nominal_remap' WHEN 1 THEN 'text_correction' WHEN 2 THEN 'remap_field_value' ELSE 'supplier_alias' END AS rule_type,
CASE p_partkey % 5 WHEN 0 THEN 'nominal_account_code' WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN 'description' WHEN 1 THEN 'supplier_name' ELSE 'nominal_account_code' END WHEN 2 THEN 'invoice_number' ELSE 'supplier_name' END AS field_name,
CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name || ' Ltd' END AS source_pattern, CASE WHEN p_partkey % 5 = 0 THEN CASE p_size % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'LARGE' ELSE 'N' || CAST(p_size AS STRING) END WHEN p_partkey % 5 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'AB123' ELSE 'Fixed ' || p_brand END ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS target_value,
p_size % 4 <> 3 AS active, CAST(NULL AS BIGINT) AS origin_row_id FROM {part}"""
_RULED = """SELECT p_partkey AS row_id, 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company, CASE WHEN p_size % 8 = 0 THEN NULL WHEN p_size % 8 = 1 THEN upper(p_name) ELSE p_name || ' LIMITED' END AS supplier_name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN p_name ELSE p_type END AS nominal_account_code,
CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS description, CASE WHEN p_size % 2 = 0 THEN 'description|nominal_account_code|supplier_name' END AS review_fields, p_size % 5 = 2 AS review_required, CAST(CASE WHEN p_size % 4 <> 0 THEN p_size * 0.01 END AS DECIMAL(5,2)) AS confidence_score FROM {part}"""


def _chain(field: str, rule_type: str, rows: str, n: str) -> str:
    """SQL that follows the rules of one type over a field, one rule at a time."""
    return f"""rl{n} AS (SELECT id, tenant, company, {_key('source_pattern')} AS src, target_value, {_key('target_value')} AS nxt FROM rules WHERE active AND rule_type = '{rule_type}' AND {_key('source_pattern')} <> ''),
ch{n}(row_id, tenant, company, val, now, last) AS (SELECT row_id, tenant, company, {field}, {_key(field)}, -1::BIGINT FROM {rows} UNION ALL
 SELECT row_id, tenant, company, val, now, last FROM (SELECT c.row_id, c.tenant, c.company, r.target_value AS val, r.nxt AS now, r.id AS last, row_number() OVER (PARTITION BY c.row_id ORDER BY r.id) AS k FROM ch{n} c JOIN rl{n} r ON r.tenant = c.tenant AND (r.company = c.company OR r.company IS NULL) AND r.src = c.now AND r.id > c.last) WHERE k = 1),
en{n} AS (SELECT row_id, arg_max(val, last) AS val FROM ch{n} WHERE last >= 0 GROUP BY 1), r{n} AS (SELECT * EXCLUDE (rid, val) REPLACE (coalesce(val, {field}) AS {field}) FROM {rows} LEFT JOIN (SELECT row_id AS rid, val FROM en{n}) e ON rid = row_id)"""


def _fixed(field: str) -> str:
    fit = "NOT (NOT contains(trim(target_value), ' ') AND regexp_matches(trim(target_value), '^[A-Za-z0-9/-]{2,15}$'))" if field == "supplier_name" else "true"
    text_ = f"trim({field})"
    may = f"coalesce({text_} = '', true) OR list_contains(string_split(coalesce(review_fields, ''), '|'), '{field}') OR coalesce(review_required AND (confidence_score IS NULL OR confidence_score < 0.55), false)" + (f" OR len({text_}) < 3" if field == "supplier_name" else "")
    best = f"(SELECT arg_max(trim(target_value), id) FROM rules f WHERE f.active AND f.rule_type = 'text_correction' AND f.field_name = '{field}' AND f.tenant = r2.tenant AND (f.company = r2.company OR f.company IS NULL) AND {_key('f.source_pattern')} = {_key('r2.supplier_name')} AND {fit})"
    return f"CASE WHEN {_key('supplier_name')} <> '' AND {_key(text_)} = {_key('supplier_name')} AND ({may}) THEN coalesce({best}, {field}) ELSE {field} END AS {field}"


@query(f"WITH RECURSIVE rules AS ({_RULES}), r0 AS ({_RULED}), {_chain('supplier_name', 'supplier_alias', 'r0', '1')}, {_chain('nominal_account_code', 'nominal_remap', 'r1', '2')} SELECT row_id, {_fixed('supplier_name')}, {_fixed('nominal_account_code')}, {_fixed('description')} FROM r2")
def rule_replay(spark: SparkSession, d: str) -> DataFrame:
    return rules.replay(made(spark, d, _RULED), made(spark, d, _RULES), ("supplier_name", "nominal_account_code", "description")).select("row_id", "supplier_name", "nominal_account_code", "description")


_WANTED = "SELECT 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company, 'supplier_alias' AS rule_type, 'supplier_name' AS field_name, p_name || CASE WHEN p_size % 2 = 0 THEN ' Ltd' ELSE '' END AS source_pattern, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS target_value, p_partkey AS origin_row_id FROM {part}"
_ID = "tenant, rule_type, field_name, source_pattern, target_value"


@query(f"""WITH rules AS ({_RULES}), w AS (SELECT {_ID}, min(company) AS company, max(origin_row_id) AS o FROM ({_WANTED}) GROUP BY {_ID})
SELECT {_ID}, r.company, active OR w.o IS NOT NULL AS active, w.o AS origin_row_id, id AS old_id FROM rules r LEFT JOIN w USING ({_ID}) UNION ALL SELECT {_ID}, company, true, o, NULL FROM w ANTI JOIN rules USING ({_ID})""")
def saved_rules(spark: SparkSession, d: str) -> DataFrame:
    held = made(spark, d, _RULES)
    last = held.agg(F.max("id").alias("last"))
    return rules.saved(held, made(spark, d, _WANTED)).join(F.broadcast(last), F.lit(True)).select(*_ID.split(", "), "company", "active", "origin_row_id", F.when(F.col("id") <= F.col("last"), F.col("id")).alias("old_id"))


@query(f"""WITH rules AS ({_RULES}), u AS (SELECT id, tenant, rule_type, field_name, source_pattern, CASE WHEN id % 3 = 0 THEN 'SMALL' ELSE target_value END AS target_value FROM rules)
SELECT u.*, EXISTS (SELECT 1 FROM rules r WHERE r.id <> u.id AND r.tenant = u.tenant AND r.rule_type = u.rule_type AND r.field_name = u.field_name AND r.source_pattern = u.source_pattern AND r.target_value = u.target_value) AS clashes FROM u""")
def rule_clashes(spark: SparkSession, d: str) -> DataFrame:
    held = made(spark, d, _RULES)
    return rules.clashes(held, held.select("id", F.lit(None).cast("string").alias("source_pattern"), F.when(F.col("id") % 3 == 0, "SMALL").alias("target_value")))


# --- edits ------------------------------------------------------------------------------------------------------------

_EDITED = """SELECT l_orderkey * 8 + l_linenumber AS row_id, l_orderkey AS batch_id, s_name AS supplier_name, 'N' || CAST(l_partkey % 9 AS STRING) AS nominal_account_code, CAST(l_extendedprice AS DECIMAL(14,2)) AS net_amount, CAST(NULL AS DECIMAL(14,2)) AS vat_amount, CAST(l_extendedprice AS DECIMAL(14,2)) AS total_amount, CAST(l_shipdate AS DATE) AS invoice_date, CASE WHEN l_linenumber > 2 THEN 'line' END AS description, 'T' || CAST(s_nationkey % 3 AS STRING) AS tenant, 'C' || CAST(s_nationkey AS STRING) AS company,
CASE l_orderkey % 5 WHEN 0 THEN 'exported' WHEN 1 THEN 'created' WHEN 2 THEN NULL ELSE 'in_review' END AS status, true AS review_required FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"""
_UNIQUE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY net_amount, supplier_name, nominal_account_code, invoice_date) AS k FROM ({_EDITED})) WHERE k = 1"
# Corrections of odd rows name rows that there are none of, so that half of the rows have none.
_FIXES = f"SELECT CASE WHEN row_id % 2 = 0 THEN row_id ELSE -row_id END AS row_id, CASE WHEN row_id % 3 = 0 THEN 'Old name' END AS supplier_name, CAST(NULL AS STRING) AS nominal_account_code, CASE WHEN row_id % 4 = 0 THEN CAST(5.5 AS DECIMAL(14,2)) END AS net_amount, CAST(NULL AS DECIMAL(14,2)) AS vat_amount, CAST(NULL AS DECIMAL(14,2)) AS total_amount, CAST(NULL AS DATE) AS invoice_date, CASE WHEN row_id % 5 = 0 THEN 'Old text' END AS description, CASE WHEN row_id % 6 = 0 THEN 'net_amount,description' END AS reviewed_fields FROM ({_UNIQUE}) u"
_CHANGES = f"""SELECT row_id, CASE row_id % 7 WHEN 0 THEN 'supplier_name' WHEN 1 THEN 'nominal_account_code' WHEN 2 THEN 'net_amount' WHEN 3 THEN 'invoice_date' WHEN 4 THEN 'description' WHEN 5 THEN 'secret' ELSE 'total_amount' END AS field,
CASE row_id % 7 WHEN 0 THEN CASE WHEN row_id % 2 = 0 THEN supplier_name ELSE 'Nobody' END WHEN 1 THEN 'N' || CAST(row_id % 12 AS STRING) WHEN 2 THEN CASE row_id % 4 WHEN 0 THEN '5.50' WHEN 1 THEN 'much' WHEN 2 THEN '' ELSE '7.1' END WHEN 3 THEN CASE row_id % 3 WHEN 0 THEN '1999-02-30' WHEN 1 THEN '1999-02-03' ELSE CAST(invoice_date AS STRING) END WHEN 4 THEN CASE row_id % 3 WHEN 0 THEN 'line' WHEN 1 THEN '' ELSE 'new text' END ELSE '12' END AS value FROM ({_UNIQUE}) u"""
_SUPPLIERS = "SELECT 'T' || CAST(s_nationkey % 3 AS STRING) AS tenant, CASE WHEN s_nationkey % 2 = 0 THEN 'C' ELSE 'D' END || CAST(s_nationkey AS STRING) AS company, s_name AS supplier_name FROM {supplier}"
_CODES = "SELECT 'T' || CAST(s_nationkey % 3 AS STRING) AS tenant, CASE WHEN s_nationkey % 3 <> 0 THEN 'C' ELSE 'D' END || CAST(s_nationkey AS STRING) AS company, 'N' || CAST(s_suppkey % 9 AS STRING) AS account_code FROM {supplier}"
_DONE = f"""rows AS ({_UNIQUE}), fixes AS ({_FIXES}), now AS (SELECT r.row_id, r.tenant, r.company, r.status, coalesce(c.supplier_name, r.supplier_name) AS supplier_name, r.nominal_account_code, coalesce(c.net_amount, r.net_amount) AS net_amount, r.total_amount, r.invoice_date, coalesce(c.description, r.description) AS description FROM rows r LEFT JOIN fixes c ON r.row_id = c.row_id),
asked AS (SELECT x.row_id, field, value, n.tenant, n.company, status, CASE field WHEN 'supplier_name' THEN supplier_name WHEN 'nominal_account_code' THEN nominal_account_code WHEN 'net_amount' THEN CAST(net_amount AS VARCHAR) WHEN 'total_amount' THEN CAST(total_amount AS VARCHAR) WHEN 'invoice_date' THEN CAST(invoice_date AS VARCHAR) WHEN 'description' THEN description END AS old_value,
 CASE WHEN field IN ('net_amount', 'total_amount') THEN CAST(TRY_CAST(nullif(value, '') AS DECIMAL(14,2)) AS VARCHAR) WHEN field = 'invoice_date' THEN CAST(TRY_CAST(nullif(value, '') AS DATE) AS VARCHAR) ELSE nullif(value, '') END AS new_value FROM ({_CHANGES}) x JOIN now n ON x.row_id = n.row_id),
sup AS ({_SUPPLIERS}), acc AS ({_CODES}), done AS (SELECT row_id, field, value, old_value, new_value, CASE WHEN field = 'secret' THEN 'ignored' WHEN status = 'exported' THEN 'rejected: exported' WHEN value <> '' AND new_value IS NULL THEN 'rejected: no value of this field' WHEN old_value IS NOT DISTINCT FROM new_value THEN 'unchanged'
 WHEN new_value IS NOT NULL AND field = 'supplier_name' AND EXISTS (SELECT 1 FROM sup s WHERE s.tenant = a.tenant AND s.company = a.company) AND NOT EXISTS (SELECT 1 FROM sup s WHERE s.tenant = a.tenant AND s.company = a.company AND s.supplier_name = new_value) THEN 'rejected: not in the master list'
 WHEN new_value IS NOT NULL AND field = 'nominal_account_code' AND EXISTS (SELECT 1 FROM acc s WHERE s.tenant = a.tenant AND s.company = a.company) AND NOT EXISTS (SELECT 1 FROM acc s WHERE s.tenant = a.tenant AND s.company = a.company AND s.account_code = new_value) THEN 'rejected: not in the master list' ELSE 'applied' END AS outcome FROM asked a)"""


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = made(spark, d, _UNIQUE).drop("k")
    return rows, made(spark, d, _FIXES)


def _done(spark: SparkSession, d: str) -> DataFrame:
    rows, fixes = _inputs(spark, d)
    return edits.checked(rows, fixes, made(spark, d, _CHANGES), made(spark, d, _SUPPLIERS), made(spark, d, _CODES))


@query(f"WITH {_DONE} SELECT * FROM done")
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d)


@query(f"""WITH {_DONE}, a AS (SELECT * FROM done WHERE outcome = 'applied'), k AS (SELECT row_id FROM fixes UNION SELECT row_id FROM a)
SELECT k.row_id, CASE WHEN a.field = 'supplier_name' THEN new_value ELSE f.supplier_name END AS supplier_name, CAST(CASE WHEN a.field = 'net_amount' THEN CAST(new_value AS DECIMAL(14,2)) ELSE f.net_amount END AS DOUBLE) AS net_amount, CASE WHEN a.field = 'description' THEN new_value ELSE f.description END AS description, CASE WHEN a.field = 'invoice_date' THEN CAST(new_value AS DATE) ELSE f.invoice_date END AS invoice_date
FROM k LEFT JOIN fixes f ON f.row_id = k.row_id LEFT JOIN a ON a.row_id = k.row_id""")
def corrections_after_changes(spark: SparkSession, d: str) -> DataFrame:
    return edits.corrected(_inputs(spark, d)[1], _done(spark, d)).select("row_id", "supplier_name", F.col("net_amount").cast("double").alias("net_amount"), "description", "invoice_date")


@query(f"""WITH rows AS ({_UNIQUE}), f AS ({_FIXES}) SELECT r.row_id, r.supplier_name AS was, coalesce(f.supplier_name, r.supplier_name) AS supplier_name, CAST(coalesce(f.net_amount, r.net_amount) AS DOUBLE) AS net_amount, coalesce(f.description, r.description) AS description, f.supplier_name IS NOT NULL OR f.net_amount IS NOT NULL OR f.description IS NOT NULL AS is_corrected FROM rows r LEFT JOIN f ON r.row_id = f.row_id""")
def effective_rows(spark: SparkSession, d: str) -> DataFrame:
    return edits.effective(*_inputs(spark, d)).select("row_id", F.col("original.supplier_name").alias("was"), "current.supplier_name", F.col("current.net_amount").cast("double").alias("net_amount"), "current.description", "is_corrected")


@query(f"""WITH f AS ({_FIXES}), x AS (SELECT row_id, 'supplier_name' AS field_name, supplier_name AS old_value FROM f WHERE row_id % 4 = 0 UNION ALL SELECT row_id, 'net_amount', CAST(net_amount AS VARCHAR) FROM f WHERE row_id % 3 = 0)
SELECT row_id, field_name, old_value, NULL::VARCHAR AS new_value, 'revert' AS action FROM x WHERE old_value IS NOT NULL""")
def revert_changes(spark: SparkSession, d: str) -> DataFrame:
    fixes = _inputs(spark, d)[1]
    asked = fixes.where("row_id % 4 = 0").select("row_id", F.lit("supplier_name").alias("field")).unionByName(fixes.where("row_id % 3 = 0").select("row_id", F.lit("net_amount").alias("field")))
    return edits.reverted(fixes, asked)[1]


@query(f"WITH f AS ({_FIXES}), m AS (SELECT row_id FROM ({_UNIQUE}) u WHERE row_id % 5 < 2) SELECT coalesce(f.row_id, m.row_id) AS row_id, CASE WHEN m.row_id IS NULL THEN reviewed_fields WHEN reviewed_fields IS NULL THEN 'currency,net_amount' ELSE 'currency,description,net_amount' END AS reviewed_fields FROM f FULL JOIN m ON f.row_id = m.row_id")
def reviewed_fields(spark: SparkSession, d: str) -> DataFrame:
    rows, fixes = _inputs(spark, d)
    marks = rows.where("row_id % 5 < 2").select("row_id", F.explode(F.array(F.lit("net_amount"), F.lit("currency"))).alias("field"))
    return edits.marked_reviewed(fixes, marks).select("row_id", "reviewed_fields")


@query(f"SELECT row_id, CASE WHEN description IS NULL THEN 'BCRS/Deposit (manual)' ELSE description || ' - BCRS/Deposit (manual)' END AS description, CAST(0 AS DOUBLE) AS total_amount, 'high' AS review_priority, supplier_name FROM ({_UNIQUE}) u WHERE row_id % 3 = 1")
def manual_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = _inputs(spark, d)[0]
    return edits.duplicates(rows, rows.where("row_id % 3 = 1")).select("row_id", "description", F.col("total_amount").cast("double").alias("total_amount"), "review_priority", "supplier_name")


@query(f"""SELECT row_id, amount, outcome, CASE WHEN outcome = 'applied' THEN CAST(greatest(total_amount - amount, net_amount) AS DOUBLE) END AS new_total FROM (SELECT *, CASE WHEN amount <= 0 THEN 'rejected: not positive' WHEN total_amount > 0 AND amount >= total_amount THEN 'rejected: not below the total' ELSE 'applied' END AS outcome FROM (SELECT row_id, total_amount, net_amount, CASE row_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 12.5 ELSE 60000 END::DOUBLE AS amount FROM ({_UNIQUE}) u))""")
def manual_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _inputs(spark, d)[0]
    key = F.col("row_id") % 3
    asked = rows.select("row_id", F.when(key == 0, 0.0).when(key == 1, 12.5).otherwise(60000.0).alias("amount"))
    return edits.deposits_split(rows, asked)[0].select("row_id", F.col("amount").cast("double").alias("amount"), "outcome", F.col("new_total").cast("double").alias("new_total"))


@query(f"WITH {_DONE}, b AS (SELECT DISTINCT batch_id, status FROM rows), h AS (SELECT DISTINCT batch_id FROM rows r JOIN done USING (row_id) WHERE outcome = 'applied') SELECT b.batch_id, CASE WHEN coalesce(status, '') IN ('', 'created', 'scanned') AND h.batch_id IS NOT NULL THEN 'in_review' ELSE status END AS status FROM b LEFT JOIN h ON b.batch_id = h.batch_id")
def touched_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _inputs(spark, d)[0].select("row_id", "batch_id", "status")
    return edits.touched(rows.select("batch_id", "status").distinct(), _done(spark, d).join(rows.select("row_id", "batch_id"), "row_id"))


# --- pages and fields -------------------------------------------------------------------------------------------------

_HEADS = """SELECT o_orderkey AS page, CASE o_orderkey % 8 WHEN 0 THEN concat('ACME Ltd', chr(10), 'Invoice No.: INV-', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('Invoice number', chr(10), CAST(1000 + o_orderkey AS STRING)) WHEN 2 THEN concat('VAT Number MT12345678', chr(10), 'Ref no: ', CAST(o_custkey AS STRING), '/26') WHEN 3 THEN concat('Doc No', chr(10), 'Date 12/03/2024', chr(10), 'A77') WHEN 4 THEN concat('Reference', chr(10), chr(10), 'AB-', CAST(o_orderkey AS STRING), ' x') WHEN 5 THEN 'Invoice no 2024' WHEN 6 THEN NULL ELSE concat('Invoice #: 01/02/2024 B', CAST(o_orderkey AS STRING)) END AS page_text FROM {orders}"""


@query(f"""SELECT page, CASE page % 8 WHEN 0 THEN 'INV-' || page WHEN 1 THEN CASE WHEN 1000 + page BETWEEN 1900 AND 2099 THEN NULL ELSE CAST(1000 + page AS VARCHAR) END WHEN 2 THEN split_part(split_part(page_text, 'Ref no: ', 2), chr(10), 1) WHEN 4 THEN 'AB-' || page WHEN 7 THEN 'B' || page END AS invoice_number FROM ({_HEADS})""")
def invoice_number_fallback(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, _HEADS).select("page", merging.invoice_number(F.col("page_text")).alias("invoice_number"))


_ITEMS = "SELECT o_orderkey AS page, CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount, CAST(NULL AS DECIMAL(14,2)) AS net_amount, CAST(NULL AS DECIMAL(14,2)) AS vat_amount, CASE WHEN o_orderkey % 3 = 0 THEN 'page' END AS description, 'raw' AS line_items_raw FROM {orders}"
_LINED = "SELECT l_orderkey AS page, CASE WHEN l_linenumber % 3 <> 0 THEN 'part ' || CAST(l_partkey AS STRING) ELSE ' ' END AS title, CAST(CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS INT) AS quantity, CAST(CASE WHEN l_linenumber <> 5 THEN l_extendedprice END AS DECIMAL(14,2)) AS net, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 100 END AS DECIMAL(14,2)) AS tax FROM {lineitem}"


@query(f"""WITH l AS ({_LINED}), p AS ({_ITEMS}), s AS (SELECT page, sum(coalesce(net, 0)) AS s FROM l GROUP BY 1), r AS (SELECT p.page, p.description AS d, p.total_amount, l.page AS item, l.*, CASE WHEN trim(title) <> '' THEN title WHEN p.description IS NOT NULL THEN p.description ELSE 'Invoice line' END AS name, coalesce(abs(s - p.total_amount) > 0.10, false) AS mismatch FROM p LEFT JOIN l ON l.page = p.page LEFT JOIN s ON s.page = p.page)
SELECT page, CASE WHEN item IS NULL THEN d ELSE name END AS description, CASE WHEN item IS NULL THEN 'raw' ELSE concat_ws('  ', name, 'Qty: ' || quantity, '= ' || net) END AS line_items_raw, CAST(CASE WHEN net IS NULL THEN total_amount ELSE net + coalesce(tax, 0) END AS DOUBLE) AS total_amount, mismatch FROM r""")
def structured_line_rows(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.col("title").alias("description"), "quantity", F.lit(None).cast("decimal(14,2)").alias("unit_price"), F.col("net").alias("net_amount"), F.col("tax").alias("tax_amount"))
    items = made(spark, d, _LINED).groupBy("page").agg(F.collect_list(entry).alias("structured"))
    rows = pages.structured_rows(made(spark, d, _ITEMS).join(items, "page", "left"))
    return rows.select("page", "description", "line_items_raw", F.col("total_amount").cast("double").alias("total_amount"), "mismatch")


_LABELS = "SELECT o_orderkey AS page, CAST(o_totalprice AS DECIMAL(14,2)) AS net_amount, CAST(18.00 AS DECIMAL(14,2)) AS vat_amount, CAST(CAST(o_totalprice AS DECIMAL(14,2)) + 18.00 + CASE WHEN o_orderkey % 3 = 0 THEN 14.40 ELSE 0 END AS DECIMAL(14,2)) AS total_amount, CASE o_orderkey % 4 WHEN 0 THEN 'Bottles' WHEN 1 THEN 'BCRS bottles' END AS description, CASE WHEN o_orderkey % 3 = 0 THEN 'BCRS 14.40' ELSE 'No more' END AS label FROM {orders}"


@query(f"""WITH p AS ({_LABELS}) SELECT page, 'original' AS row_kind, description, CAST(net_amount + 18 AS DOUBLE) AS total_amount FROM p UNION ALL SELECT page, 'deposit', CASE WHEN description IS NULL THEN 'BCRS surcharge' WHEN page % 4 = 1 THEN description ELSE description || ' - BCRS' END, 14.4 FROM p WHERE page % 3 = 0""")
def deposit_auto_split(spark: SparkSession, d: str) -> DataFrame:
    line = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    totals = F.concat_ws("\n", line("Net ", "net_amount"), line("VAT ", "vat_amount"), "label", line("Total ", "total_amount"))
    rows = made(spark, d, _LABELS).withColumns({"totals_raw": totals, "page_text_raw": F.lit(None).cast("string")})
    return deposits.split_found(rows).select("page", "row_kind", "description", F.col("total_amount").cast("double").alias("total_amount"))


_TAXED = "SELECT o_orderkey AS page, CAST(o_totalprice AS DECIMAL(14,2)) AS net, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 3.21 END AS DECIMAL(14,2)) AS vat, CAST(CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) + o_orderkey % 97 * 100 END AS DECIMAL(14,2)) AS total, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1.25 WHEN o_orderkey % 5 = 1 THEN -2 END AS DECIMAL(14,2)) AS tax, CAST(o_custkey % 10 AS DOUBLE) / 10 AS sure FROM {orders}"


@query(f"""SELECT page, CAST(CASE WHEN vat IS NOT NULL THEN vat WHEN tax > 0 THEN 2 * tax WHEN total - net > 0.01 AND (total - net) / net BETWEEN 0.01 AND 0.40 AND sure >= 0.5 THEN total - net END AS DOUBLE) AS vat FROM ({_TAXED})""")
def vat_recovery(spark: SparkSession, d: str) -> DataFrame:
    taxes = F.array("tax", "tax", F.lit(None).cast("decimal(14,2)"))
    return made(spark, d, _TAXED).select("page", merging.recovered_vat(F.col("net"), F.col("vat"), F.col("total"), taxes, F.col("sure"), F.lit(0.9)).cast("double").alias("vat"))


_TWO = """SELECT c_custkey AS page, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Invoice' WHEN 2 THEN concat('5', chr(10), 'Acme Trading') WHEN 3 THEN 'Borg Supply Co. Borg Supply Co' WHEN 4 THEN 'N NCalleja Foods' ELSE 'HARBOUR FOODS LTD' END AS s, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Gamma Market' WHEN 2 THEN 'Buyer Harbour' ELSE 'Delta Wines' END AS m,
CASE WHEN c_custkey % 7 = 0 THEN 'azure_di' WHEN c_custkey % 7 = 1 THEN NULL ELSE 'text' END AS source, CAST(c_custkey % 10 AS DOUBLE) / 10 AS sure, CASE WHEN c_custkey % 4 = 0 THEN 'invoice' ELSE 'INV' || CAST(c_custkey AS STRING) END AS n1, 'M' || CAST(c_custkey AS STRING) AS n2, CAST(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS DECIMAL(14,2)) AS t1, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS DECIMAL(14,2)) AS t2 FROM {customer}"""


@query(f"""WITH x AS (SELECT *, CASE page % 6 WHEN 5 THEN NULL ELSE s END AS ours, CASE page % 5 WHEN 2 THEN NULL ELSE m END AS theirs, coalesce(source = 'azure_di', false) AS dedicated, page % 6 IN (2, 3, 4) AS fine FROM ({_TWO}))
SELECT page, CASE WHEN source IS NULL THEN s WHEN theirs IS NOT NULL AND (dedicated OR NOT fine OR sure >= 0.85) THEN theirs WHEN page % 6 = 2 THEN 'Acme Trading' WHEN page % 6 = 3 THEN 'Borg Supply Co' WHEN page % 6 = 4 THEN 'NCalleja Foods' ELSE ours END AS supplier_name,
 CASE WHEN source IS NOT NULL AND page % 4 = 0 THEN n2 ELSE n1 END AS invoice_number, CAST(CASE WHEN source IS NULL THEN t1 WHEN dedicated THEN coalesce(t2, t1) ELSE coalesce(t1, t2) END AS DOUBLE) AS total_amount FROM x""")
def merge_fields(spark: SparkSession, d: str) -> DataFrame:
    none, nought = F.lit(None).cast("string"), F.lit(None).cast("decimal(14,2)")
    fields_ = lambda s, n, t: [F.col(s).alias("supplier_name"), F.col(n).alias("invoice_number"), F.lit(None).cast("date").alias("invoice_date"), nought.alias("net_amount"), nought.alias("vat_amount"), F.col(t).alias("total_amount"), *[none.alias(c) for c in ("currency", "tax_code", "description")]]
    model = F.struct(*fields_("m", "n2", "t2"), F.col("sure").alias("supplier_confidence"), *[none.alias(c) if c != "extraction_source" else F.col("source").alias(c) for c in merging.EXTRA])
    rows = made(spark, d, _TWO).select("page", F.struct(*fields_("s", "n1", "t1")).alias("rule"), F.when(F.col("source").isNotNull(), model).alias("model"), F.lit("Harbour Company Ltd").alias("buyer"))
    return merging.merged(rows).select("page", "merged.supplier_name", "merged.invoice_number", F.col("merged.total_amount").cast("double").alias("total_amount"))


_FOUND = """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'S' END AS supplier_name, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS total_amount, CASE WHEN o_orderkey % 5 <> 0 THEN 'N1' END AS invoice_number, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date,
CASE o_custkey % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'default' WHEN 2 THEN 'keyword_match' END AS classification_method, CAST(o_custkey % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_custkey % 7 AS DOUBLE) / 7 END AS page_quality, CASE o_custkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed_with_warnings' WHEN 2 THEN 'passed' END AS ai_status, o_custkey % 3 AS given FROM {orders}"""
_WEIGHTS = "('no_supplier',100,'high'),('no_amount',100,'high'),('ai_validation_failed',90,'high'),('totals_mismatch',80,'high'),('invoice_number_missing',60,'medium'),('invoice_date_missing',55,'medium'),('supplier_low_confidence',40,'medium'),('line_classification_unresolved',35,'medium'),('totals_mismatch_advisory',35,'medium'),('nominal_mapping_uncertain',30,'medium'),('ai_validation_warned',25,'medium'),('low_confidence',20,'medium'),('page_quality_low',15,'low'),('deposit_component_detected',10,'low'),('odd',0,'low')"


@query(f"""WITH f AS ({_FOUND}), w(reason, weight, band) AS (VALUES {_WEIGHTS}), g AS (SELECT *, list_filter(list_concat(CASE given WHEN 1 THEN ['supplier_low_confidence', 'odd'] WHEN 2 THEN ['totals_mismatch_advisory', 'deposit_component_detected:1.00', 'deposit_component_detected:2.00'] ELSE [] END,
 [CASE WHEN classification_method = 'unresolved' THEN 'line_classification_unresolved' END, CASE WHEN classification_method = 'default' THEN 'nominal_mapping_uncertain' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END, CASE WHEN page_quality < 0.35 THEN 'page_quality_low' END, CASE WHEN coalesce(supplier_name, '') = '' THEN 'no_supplier' END, CASE WHEN total_amount IS NULL THEN 'no_amount' END, CASE WHEN invoice_number IS NULL THEN 'invoice_number_missing' END, CASE WHEN invoice_date IS NULL THEN 'invoice_date_missing' END, CASE WHEN ai_status = 'failed' THEN 'ai_validation_failed' END, CASE WHEN ai_status = 'passed_with_warnings' THEN 'ai_validation_warned' END]), lambda r: r IS NOT NULL) AS rs FROM f),
e AS (SELECT page, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM g), k AS (SELECT page, r, i, split_part(r, ':', 1) AS reason, row_number() OVER (PARTITION BY page, split_part(r, ':', 1) ORDER BY i) AS n FROM e),
a AS (SELECT page, string_agg(r, '|' ORDER BY weight DESC, i) AS review_reasons, bool_or(band = 'high') AS high, bool_or(band = 'medium') AS medium, bool_or(reason = 'no_supplier') AS ns, bool_or(reason = 'no_amount') AS na, bool_and(reason = 'page_quality_low') AS ok FROM k JOIN w USING (reason) WHERE n = 1 GROUP BY page)
SELECT f.page, coalesce(review_reasons, '') AS review_reasons, CASE WHEN high THEN 'high' WHEN medium THEN 'medium' WHEN review_reasons IS NOT NULL THEN 'low' END AS review_priority, coalesce(high, false) AS review_required, coalesce(ok, false) AS auto_approved, CASE WHEN high AND ns AND na THEN 'review_incomplete' WHEN high AND ns THEN 'review_no_supplier' WHEN high AND na THEN 'review_no_amount' WHEN high THEN 'review_validation_failed' WHEN medium THEN 'ok_warned' ELSE 'ok' END AS validation_status FROM f LEFT JOIN a ON f.page = a.page""")
def review_gather(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, _FOUND)
    array = lambda *x: F.array(*map(F.lit, x))
    given = rows.withColumns({"supplier_reasons": F.when(F.col("given") == 1, array("supplier_low_confidence", "odd")), "validation_reasons": F.when(F.col("given") == 2, array("totals_mismatch_advisory", "deposit_component_detected:1.00", "deposit_component_detected:2.00"))})
    return review.decide(review.gather(given)).select("page", F.array_join("review_reasons", "|").alias("review_reasons"), "review_priority", "review_required", "auto_approved", "validation_status")


@query("SELECT doc_id, regexp_replace(substring(text, 1, 40), '[^\\w\\-. à-öø-ÿÀ-ÖØ-ß]', '_', 'g') AS name FROM documents".replace("à-öø-ÿÀ-ÖØ-ß", "\\p{L}\\p{N}"))
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.file_name(F.substring("text", 1, 40)).alias("name"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN position('{' IN props) > 0 THEN props ELSE 'x' || coalesce(props, '') END AS block FROM events")
def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    said = F.when((F.col("event_id") % 3 == 0) | F.contains("props", F.lit("{")), F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("Here you are:\n"), "props", F.lit("\nDone."))))
    return table(spark, d, "events").select("event_id", text.json_block(F.coalesce(said, F.concat(F.lit("x"), F.coalesce("props", F.lit(""))))).alias("block"))


_PAGES = f"SELECT p_partkey AS row_id, 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company, p_size % 3 AS page_no, CASE WHEN p_size % 8 <> 0 THEN p_name || ' Ltd' END AS supplier_name, CASE WHEN p_size % 2 = 0 THEN 'description|total_amount' END AS review_fields, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'INV7' END AS invoice_number, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE 'fine text' END AS description, 'N1' AS nominal_account_code, CASE WHEN p_size % 7 <> 0 THEN DATE '2026-01-05' END AS invoice_date, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DECIMAL(14,2)) ELSE CAST(p_size AS DECIMAL(14,2)) END AS net_amount, CASE WHEN p_size % 5 <> 1 THEN CAST(1 AS DECIMAL(14,2)) END AS vat_amount, CAST(7 AS DECIMAL(14,2)) AS total_amount FROM {{part}}"
_HINTS = "SELECT p_partkey AS id, 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, CASE p_partkey % 8 WHEN 0 THEN 'supplier_name' WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'description' WHEN 3 THEN 'total_amount' WHEN 4 THEN 'net_amount' WHEN 5 THEN 'vat_amount' WHEN 6 THEN 'invoice_date' ELSE 'nominal_account_code' END AS field_name, p_size % 3 AS page_no, CASE WHEN p_size % 2 = 0 THEN p_partkey % 40 END AS supplier_id, CASE WHEN p_size % 7 <> 0 THEN upper(p_name) END AS supplier_name_snapshot, p_size % 9 <> 0 AS active FROM {part}"
_KNOWN = "SELECT p_partkey % 40 AS id, 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company, p_name || ' Ltd' AS supplier_name FROM {part}"


_MET = f"""r AS (SELECT *, {_key('supplier_name')} AS norm, list_filter([CASE WHEN coalesce(invoice_number, '') = '' THEN 'invoice_number' END, CASE WHEN review_fields IS NOT NULL OR length(description) < 3 THEN 'description' END, CASE WHEN invoice_date IS NULL THEN 'invoice_date' END, CASE WHEN coalesce(net_amount, 0) = 0 THEN 'net_amount' END, CASE WHEN vat_amount IS NULL THEN 'vat_amount' END, CASE WHEN review_fields IS NOT NULL THEN 'total_amount' END], lambda f: f IS NOT NULL) AS wanted FROM ({_PAGES})),
i AS (SELECT tenant, company, supplier_name, min(id) AS sid FROM ({_KNOWN}) GROUP BY 1, 2, 3), h AS (SELECT *, {_key('supplier_name_snapshot')} AS norm FROM ({_HINTS}) WHERE active), a AS (SELECT r.*, sid FROM r LEFT JOIN i USING (tenant, company, supplier_name) WHERE norm <> ''),
x AS (SELECT a.row_id, a.wanted, h.field_name, h.id FROM a JOIN h ON h.tenant = a.tenant AND h.page_no = a.page_no AND h.supplier_id = sid), y AS (SELECT a.row_id, a.wanted, h.field_name, h.id FROM a JOIN h ON h.tenant = a.tenant AND h.page_no = a.page_no AND h.norm = a.norm WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.row_id = a.row_id))"""


@query(f"WITH {_MET} SELECT row_id, field_name AS field, max(id) AS hint_id FROM (SELECT * FROM x UNION ALL SELECT * FROM y) WHERE list_contains(wanted, field_name) GROUP BY 1, 2")
def remap_hints(spark: SparkSession, d: str) -> DataFrame:
    return accounts.hints_for(made(spark, d, _PAGES), made(spark, d, _HINTS), made(spark, d, _KNOWN))


# Words of one page for each part, and regions over one kind of them, all, or none.
_box = lambda line, word, x0, y0, x1: f"SELECT p_partkey AS file_id, p_size % 3 AS page_no, {line} AS line_no, {word} AS word, CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, CAST({x1} AS DOUBLE) AS x1, CAST({y0} AS DOUBLE) + CAST(0.02 AS DOUBLE) AS y1 FROM {{part}}"
_BOXES = " UNION ALL ".join([_box(1, "'INV-' || CAST(p_partkey AS STRING)", 0.6, 0.1, 0.7), _box(2, "CAST(p_size AS STRING) || CASE WHEN p_size % 4 = 0 THEN ',50' ELSE '.5' END", 0.7, 0.3, 0.8), _box(3, "split_part(p_name, ' ', 2)", 0.2, 0.5, 0.3), _box(3, "split_part(p_name, ' ', 1)", 0.05, 0.5, 0.15), _box(4, "'0' || CAST(p_size % 9 + 1 AS STRING) || '/02/2026'", 0.5, 0.9, 0.6)])
_at = lambda k, *places: ", ".join(f"CAST(CASE {k} {' '.join(f'WHEN {n} THEN {p[j]}' for n, p in enumerate(places))} END AS DOUBLE) AS {c}" for j, c in enumerate("xywh"))
_SPOTS = [(0.58, 0.08, 0.2, 0.06), (0.68, 0.28, 0.2, 0.06), (0, 0.45, 0.4, 0.1), (0.45, 0.85, 0.2, 0.1), (0.9, 0.9, 0.05, 0.05), (0, 0, 1, 1)]
_PLACED = f"SELECT h.*, {_at('(id + floor(id / 8)) % 6', *_SPOTS)} FROM ({_HINTS}) h"
_said = lambda keys, regions: f"(SELECT {keys.replace('g.', '')}, CASE WHEN length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) >= 2 THEN t END AS t FROM (SELECT {keys}, string_agg(b.word, ' ' ORDER BY line_no, x0) AS t FROM {regions} g JOIN ({_BOXES}) b ON b.file_id = g.file_id AND b.page_no = g.page_no AND (b.x0 + b.x1) / 2 BETWEEN g.x AND g.x + g.w AND (b.y0 + b.y1) / 2 BETWEEN g.y AND g.y + g.h GROUP BY ALL))"
_worth = lambda f, t: f"CASE WHEN {f} IN ('net_amount', 'vat_amount', 'total_amount') THEN CAST(TRY_CAST(CASE WHEN regexp_matches({t}, '^[0-9]+,[0-9][0-9]$') THEN replace({t}, ',', '.') ELSE replace(replace({t}, ' ', ''), ',', '') END AS DECIMAL(14,2)) AS VARCHAR) WHEN {f} = 'invoice_date' THEN CASE WHEN regexp_matches({t}, '^[0-9][0-9]/[0-9][0-9]/[0-9]+$') THEN strftime(strptime({t}, '%d/%m/%Y'), '%Y-%m-%d') END ELSE {t} END"
_FILLED = ("supplier_name", "invoice_number", "invoice_date", "net_amount", "vat_amount", "total_amount", "description")


@query(f"""WITH {_MET}, g AS (SELECT z.row_id, z.row_id AS file_id, p.page_no, z.field_name, z.id, p.x, p.y, p.w, p.h FROM (SELECT * FROM x UNION ALL SELECT * FROM y) z JOIN ({_PLACED}) p ON p.id = z.id WHERE list_contains(wanted, z.field_name)),
t AS (SELECT row_id, field_name, id, t, {_worth('field_name', 't')} AS v FROM {_said('g.row_id, g.field_name, g.id', 'g')}),
best AS (SELECT row_id, field_name, arg_max(v, id) AS v FROM t WHERE v IS NOT NULL AND (field_name <> 'supplier_name' OR contains(t, ' ')) GROUP BY 1, 2)
SELECT r.row_id, {', '.join(f"CAST(coalesce((SELECT v FROM best b WHERE b.row_id = r.row_id AND b.field_name = '{f}'), CAST(r.{f} AS VARCHAR)) AS VARCHAR) AS {f}" for f in _FILLED)} FROM ({_PAGES}) r""")
def remap_values(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, _PAGES).withColumn("file_id", F.col("row_id"))
    found = regions.replayed(rows, made(spark, d, _PLACED), made(spark, d, _KNOWN), made(spark, d, _BOXES))
    return found.select("row_id", *[F.col(f).cast("string").alias(f) for f in _FILLED])


# Commands over the same pages: some without a row, some twice for a field, some with a text that was selected.
_FIELD = "CASE p_partkey % 6 WHEN 0 THEN 'supplier_name' WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'total_amount' WHEN 3 THEN 'invoice_date' WHEN 4 THEN 'description' ELSE 'secret' END"
_command = lambda seq, spot, selected: f"SELECT CAST({seq} AS BIGINT) AS seq, CASE WHEN p_size % 17 = 0 THEN -p_partkey ELSE p_partkey END AS row_id, {_FIELD} AS field, p_size % 3 AS page_no, {_at(spot, *_SPOTS)}, {selected} AS selected_text, p_size % 5 <> 0 AS apply FROM {{part}}"
_COMMANDS = f"{_command(1, '(p_partkey + p_size) % 6', 'CAST(NULL AS STRING)')} UNION ALL {_command(2, '(p_partkey * 5 + p_size) % 6', chr(39) + ' ' + chr(39) + ' || p_brand')} WHERE p_size % 4 = 0"
_OVERLAID = "SELECT p_partkey AS row_id, 'Old ' || p_brand AS supplier_name, CAST(NULL AS STRING) AS invoice_number, CAST(NULL AS STRING) AS description, CASE WHEN p_size % 2 = 0 THEN CAST(p_size + 0.5 AS DECIMAL(14,2)) END AS total_amount, CAST(NULL AS DATE) AS invoice_date, CAST(NULL AS STRING) AS nominal_account_code, CAST(NULL AS DECIMAL(14,2)) AS net_amount, CAST(NULL AS DECIMAL(14,2)) AS vat_amount FROM {part} WHERE p_size % 3 = 0"
_REMAPPED = f"""r AS ({_PAGES}), o AS ({_OVERLAID}), c AS (SELECT c.*, c.row_id AS file_id, max(seq) OVER (PARTITION BY c.row_id, field) AS last FROM ({_COMMANDS}) c),
said AS {_said('g.seq, g.row_id, g.field', 'c')},
e AS (SELECT c.*, coalesce(nullif(trim(selected_text), ''), CASE WHEN apply THEN said.t END) AS read_text, r.row_id IS NOT NULL AS there, r.tenant, r.company, r.supplier_name AS name,
 CASE c.field WHEN 'supplier_name' THEN coalesce(o.supplier_name, r.supplier_name) WHEN 'invoice_number' THEN nullif(coalesce(o.invoice_number, r.invoice_number), '') WHEN 'total_amount' THEN CAST(coalesce(o.total_amount, r.total_amount) AS VARCHAR) WHEN 'invoice_date' THEN CAST(coalesce(o.invoice_date, r.invoice_date) AS VARCHAR) WHEN 'description' THEN coalesce(o.description, r.description) END AS old_value
 FROM c LEFT JOIN r ON r.row_id = c.row_id LEFT JOIN o ON o.row_id = c.row_id LEFT JOIN said ON said.seq = c.seq AND said.row_id = c.row_id AND said.field = c.field),
f AS (SELECT *, {_worth('field', 'read_text')} AS v FROM e),
done AS (SELECT *, CASE WHEN NOT there OR field = 'secret' THEN 'ignored' WHEN seq < last THEN 'superseded' WHEN NOT apply THEN 'saved' WHEN read_text IS NULL THEN 'no text' WHEN v IS NULL THEN 'no value of this field' WHEN v IS NOT DISTINCT FROM old_value THEN 'unchanged' ELSE 'applied' END AS outcome FROM f)"""


def _remaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = made(spark, d, _PAGES).withColumn("file_id", F.col("row_id"))
    return rows, regions.remapped(rows, made(spark, d, _OVERLAID), made(spark, d, _COMMANDS), made(spark, d, _BOXES))


@query(f"WITH {_REMAPPED} SELECT seq, row_id, field, read_text, CASE WHEN there THEN old_value END AS old_value, CASE WHEN apply THEN v END AS new_value, outcome FROM done")
def remap_saved(spark: SparkSession, d: str) -> DataFrame:
    return _remaps(spark, d)[1].select("seq", "row_id", "field", "read_text", "old_value", "new_value", "outcome")


@query(f"""WITH {_REMAPPED}, held AS ({_PLACED}), k AS (SELECT tenant, supplier_name, company, min(id) AS sid FROM ({_KNOWN}) GROUP BY ALL),
n AS (SELECT d.tenant, d.field AS field_name, d.name AS snapshot, d.page_no, arg_max({{'x': d.x, 'y': d.y, 'w': d.w, 'h': d.h, 'sid': k.sid}}, d.seq * 1000000 + d.row_id) AS a FROM done d LEFT JOIN k ON k.tenant = d.tenant AND k.company = d.company AND k.supplier_name = d.name WHERE outcome <> 'ignored' GROUP BY ALL),
m AS (SELECT n.*, (SELECT min(id) FROM held WHERE held.tenant = n.tenant AND held.field_name = n.field_name AND held.supplier_name_snapshot IS NOT DISTINCT FROM n.snapshot AND held.page_no = n.page_no) AS id FROM n)
SELECT held.id, held.field_name, coalesce(m.a.x, held.x) AS x, coalesce(m.a.h, held.h) AS h, coalesce(m.a.sid, held.supplier_id) AS supplier_id, held.active OR m.id IS NOT NULL AS active FROM held LEFT JOIN m ON m.id = held.id
UNION ALL SELECT NULL, field_name, a.x, a.h, a.sid, true FROM m WHERE id IS NULL""")
def remap_hints_saved(spark: SparkSession, d: str) -> DataFrame:
    rows, done = _remaps(spark, d)
    held = made(spark, d, _PLACED)
    # A hint's last command is the one with the greatest seq, and of those the greatest row.
    ordered = done.withColumn("seq", F.col("seq") * 1000000 + F.col("row_id"))
    after = regions.saved_hints(held.withColumn("company", F.lit(None).cast("string")), rows, ordered, made(spark, d, _KNOWN))
    known = held.select("id", F.lit(True).alias("__old"))
    return after.join(known, "id", "left").select(F.when(F.col("__old"), F.col("id")).alias("id"), "field_name", "x", "h", "supplier_id", "active")


# --- small functions and the manual split -------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 1000 + 0.5 END AS DOUBLE) AS said, CAST(CASE WHEN p_retailprice - 1000 > 0 THEN round(CAST(p_retailprice - 1000 AS DECIMAL(14,2)), 2) END AS DOUBLE) AS number FROM part")
def first_amounts(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("p_size") % 3 == 0, F.lit("no sum")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("pay "), F.format_number(F.col("p_size") * 1000 + 0.5, 2), F.lit(" or 7.00"))).otherwise(F.concat(F.lit("Total EUR "), (F.col("p_size") * 1000).cast("string"), F.lit(".50")))
    number = fields.first_amount((F.col("p_retailprice") - 1000).cast("decimal(14,2)"), number=True)
    return table(spark, d, "part").select("p_partkey", fields.first_amount(said).cast("double").alias("said"), number.cast("double").alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS printed FROM orders")
def printed_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.format_date(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))).alias("printed"))


@query(r"SELECT doc_id, CASE WHEN t = '' THEN 'Export' ELSE t END AS sheet FROM (SELECT doc_id, trim(substring(regexp_replace(s, '[\\/*?:\[\]]', '_', 'g'), 1, 31)) AS t FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE 'a:b/c[' || replace(coalesce(text, ''), chr(10), '?') END AS s FROM documents))")
def sheet_names(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit("a:b/c["), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("?"))))
    return table(spark, d, "documents").select("doc_id", fields.sheet_name(said).alias("sheet"))


_PART_ROWS = "SELECT p_partkey AS row_id, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DECIMAL(14,2)) END AS net_amount, CASE WHEN p_size % 3 = 0 THEN CAST(1 AS DECIMAL(14,2)) END AS vat_amount, CASE WHEN p_size % 5 = 0 THEN CAST(9 AS DECIMAL(14,2)) END AS total_amount, CAST(p_size * 0.02 AS DECIMAL(5,2)) AS confidence FROM {part}"


@query(f"SELECT row_id, CAST(CASE WHEN total_amount IS NULL AND vat_amount IS NULL THEN net_amount ELSE total_amount END AS DOUBLE) AS total_amount, CASE WHEN confidence >= 0.8 THEN 'complete' WHEN confidence >= 0.5 THEN 'partial' ELSE 'review_required' END AS status FROM ({_PART_ROWS})")
def extraction_states(spark: SparkSession, d: str) -> DataFrame:
    return pages.total_from_net(made(spark, d, _PART_ROWS)).select("row_id", F.col("total_amount").cast("double").alias("total_amount"), fields.extraction_status(F.col("confidence")).alias("status"))


@query("SELECT doc_id, array_to_string(l[1:12], chr(10)) AS header_raw, array_to_string(l[-10:], chr(10)) AS totals_raw, substring(text, 1, 20000) AS page_text_raw FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    return pages.evidence(table(spark, d, "documents").select("doc_id", F.col("text").alias("page_text"))).select("doc_id", "header_raw", "totals_raw", "page_text_raw")


_SAVED = f"""ch AS (SELECT row_id, field, value, row_id % 2 = 0 AS save FROM ({_CHANGES})), kept AS (SELECT c.row_id, c.field, c.value, u.tenant, u.company, lower(trim(CASE WHEN c.field = 'supplier_name' THEN u.supplier_name ELSE u.nominal_account_code END)) AS src FROM ch c JOIN u ON u.row_id = c.row_id WHERE save AND c.field IN ('supplier_name', 'nominal_account_code'))"""


@query(f"WITH u AS ({_UNIQUE}), {_SAVED} SELECT tenant, company, CASE WHEN field = 'supplier_name' THEN 'supplier_alias' ELSE 'nominal_remap' END AS rule_type, field AS field_name, src AS source_pattern, trim(value) AS target_value, row_id AS origin_row_id FROM kept WHERE value <> '' AND src <> '' AND src <> lower(trim(value))")
def rules_from_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every change counts as applied here; field_changes tells which are."""
    done = made(spark, d, _CHANGES).select("row_id", "field", F.nullif("value", F.lit("")).alias("new_value"), (F.col("row_id") % 2 == 0).alias("save"), F.lit("applied").alias("outcome"))
    return edits.wanted_rules(made(spark, d, _UNIQUE), done)


_SPLIT = f"""u AS ({_UNIQUE}), c AS ({_FIXES}), a AS (SELECT row_id, CAST(CASE row_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 12.5 ELSE 60000 END AS DECIMAL(14,2)) AS amount FROM u),
s AS (SELECT u.*, a.amount, greatest(total_amount - amount, net_amount) AS new_total, row_number() OVER (ORDER BY u.row_id) + (SELECT max(row_id) FROM u) AS new_id FROM u JOIN a ON a.row_id = u.row_id WHERE amount > 0 AND NOT (total_amount > 0 AND amount >= total_amount))"""


def _split(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows, fixes = made(spark, d, _UNIQUE), made(spark, d, _FIXES)
    key = F.col("row_id") % 3
    return edits.split_applied(rows, fixes, rows.select("row_id", F.when(key == 0, 0.0).when(key == 1, 12.5).otherwise(60000.0).alias("amount")))


@query(f"WITH {_SPLIT} SELECT row_id, CAST(total_amount AS DOUBLE) AS total_amount, review_required, 'source' AS kind FROM (SELECT u.row_id, coalesce(s.new_total, u.total_amount) AS total_amount, CASE WHEN s.row_id IS NOT NULL THEN false ELSE u.review_required END AS review_required FROM u LEFT JOIN s ON s.row_id = u.row_id) UNION ALL SELECT new_id, CAST(amount AS DOUBLE), false, 'manual+bcrs_manual' FROM s")
def rows_after_splits(spark: SparkSession, d: str) -> DataFrame:
    done = _split(spark, d)
    shown = lambda df, kind: df.select("row_id", F.col("total_amount").cast("double").alias("total_amount"), "review_required", kind.alias("kind"))
    return shown(done["rows"], F.lit("source")).unionByName(shown(done["made"], F.concat("validation_status", "method_used")))


@query(f"WITH {_SPLIT} SELECT row_id, 'total_amount' AS field_name, CAST(total_amount AS VARCHAR) AS old_value, CAST(new_total AS VARCHAR) AS new_value, 'bcrs_split_source' AS action FROM s UNION ALL SELECT new_id, '_action', NULL, 'bcrs_split from row ' || row_id || ' (amount=' || amount || ')', 'bcrs_split_created' FROM s")
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)["audit"]


@query(f"WITH {_SPLIT} SELECT coalesce(c.row_id, s.row_id) AS row_id, CAST(coalesce(s.new_total, c.total_amount) AS DOUBLE) AS total_amount, CASE WHEN s.row_id IS NULL THEN c.reviewed_fields ELSE array_to_string(list_sort(list_distinct(list_append(list_filter(string_split(coalesce(c.reviewed_fields, ''), ','), lambda x: x <> ''), 'total_amount'))), ',') END AS reviewed_fields FROM c FULL JOIN s ON s.row_id = c.row_id")
def corrections_after_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)["corrections"].select("row_id", F.col("total_amount").cast("double").alias("total_amount"), "reviewed_fields")


# --- listings and upkeep -------------------------------------------------------------------------------------------------

_LISTED = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM {orders}"


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY day DESC NULLS LAST, priority ASC NULLS FIRST, o_orderkey DESC) - 1) // 50 AS BIGINT) AS page FROM ({_LISTED})")
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    return listing.numbered(made(spark, d, _LISTED), [("day", "desc"), ("priority", "asc"), ("o_orderkey", "desc")]).select("o_orderkey", "page")


_UPDATES = """SELECT p_partkey AS id, CASE WHEN p_size % 11 = 0 THEN 'T9' WHEN p_size % 4 <> 0 THEN 'T' || CAST(p_partkey % 2 AS STRING) END AS tenant, CASE p_size % 6 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'delete' ELSE 'update' END AS action,
CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN upper(p_name) || '  LTD ' WHEN 2 THEN '  ' WHEN 3 THEN p_brand END AS source_pattern, CASE p_size % 7 WHEN 0 THEN 'small' WHEN 1 THEN p_brand WHEN 2 THEN '' END AS target_value, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END AS active, CASE p_partkey % 5 WHEN 0 THEN 'all_companies' WHEN 1 THEN 'this_company' WHEN 2 THEN 'some' WHEN 3 THEN 'this_company' END AS applies_to, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS company FROM {part} WHERE p_partkey % 3 <> 1 UNION ALL SELECT -p_partkey, 'T1', 'delete', NULL, NULL, NULL, NULL, NULL FROM {part} WHERE p_size = 3"""
_OWNED = "SELECT DISTINCT 'T' || CAST(p_partkey % 2 AS STRING) AS tenant, p_brand AS company FROM {part} WHERE p_size % 2 = 0"
_UPDATED = f"""rules AS ({_RULES}), u AS ({_UPDATES}), own AS ({_OWNED}), j AS (SELECT u.*, r.id IS NOT NULL AS there, r.tenant AS rt, r.rule_type AS rr, r.field_name AS rf, lower(trim(regexp_replace(coalesce(nullif(u.source_pattern, ''), r.source_pattern), '\\s+', ' ', 'g'))) AS src, trim(coalesce(nullif(u.target_value, ''), r.target_value, '')) AS tgt FROM u LEFT JOIN rules r ON r.id = u.id),
o AS (SELECT *, CASE WHEN NOT there OR tenant IS NOT NULL AND tenant <> rt THEN 'not found' WHEN action <> 'update' THEN 'done' WHEN src = '' THEN 'rejected: blank pattern' WHEN tgt = '' THEN 'rejected: blank target' WHEN src = lower(tgt) THEN 'rejected: no effect' WHEN EXISTS (SELECT 1 FROM rules x WHERE x.id <> j.id AND x.tenant = rt AND x.rule_type = rr AND x.field_name = rf AND x.source_pattern = src AND x.target_value = tgt) THEN 'clash'
 WHEN applies_to NOT IN ('this_company', 'all_companies') THEN 'rejected: no such scope' WHEN applies_to = 'this_company' AND company IS NULL THEN 'rejected: no company' WHEN applies_to = 'this_company' AND tenant IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.tenant = rt AND own.company = j.company) THEN 'rejected: not a company of the tenant' ELSE 'done' END AS outcome FROM j)"""


def _upkeep(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return rules.updated(made(spark, d, _RULES), made(spark, d, _UPDATES), made(spark, d, _OWNED))


@query(f"WITH {_UPDATED} SELECT id, action, outcome FROM o")
def rule_updates(spark: SparkSession, d: str) -> DataFrame:
    return _upkeep(spark, d)[0].select("id", "action", "outcome")


@query(f"""WITH {_UPDATED}, k AS (SELECT * FROM o WHERE outcome = 'done') SELECT r.id, CASE WHEN k.action = 'update' THEN k.src ELSE r.source_pattern END AS source_pattern, CASE WHEN k.action = 'update' THEN k.tgt ELSE r.target_value END AS target_value, CASE k.action WHEN 'enable' THEN true WHEN 'disable' THEN false WHEN 'update' THEN coalesce(k.active, r.active) ELSE r.active END AS active,
CASE WHEN k.action = 'update' AND k.applies_to = 'all_companies' THEN NULL WHEN k.action = 'update' AND k.applies_to = 'this_company' THEN k.company ELSE r.company END AS company FROM rules r LEFT JOIN k ON k.id = r.id WHERE k.action IS NULL OR k.action <> 'delete'""")
def rules_after_updates(spark: SparkSession, d: str) -> DataFrame:
    return _upkeep(spark, d)[1].select("id", "source_pattern", "target_value", "active", "company")


# New suppliers: of a name or a code that others of the batch want too, in chains where one that is rejected frees the next.
_NEW_SUPPLIERS = "SELECT p_partkey AS seq, p_brand AS company, CASE WHEN p_size % 19 <> 0 THEN split_part(p_name, ' ', 1) || CAST(p_partkey % 60 AS STRING) ELSE ' ' END AS supplier_name, CASE WHEN p_size % 6 <> 0 THEN 'A' || CAST((p_partkey + p_size) % 45 AS STRING) END AS account_code, CASE p_size % 10 WHEN 0 THEN 'odd' WHEN 1 THEN 'inactive' ELSE 'active' END AS status FROM {part}"
_OLD_SUPPLIERS = "SELECT p_brand AS company, upper(split_part(p_name, ' ', 1)) || CAST(p_partkey % 60 AS STRING) AS supplier_name, 'B' || CAST(p_partkey AS STRING) AS account_code, 'active' AS status FROM {part} WHERE p_size = 7 UNION ALL SELECT p_brand, 'x' || CAST(p_partkey AS STRING), 'a' || CAST(p_size AS STRING), 'active' FROM {part} WHERE p_partkey % 50 = 0"


@query(f"""WITH RECURSIVE old AS ({_OLD_SUPPLIERS}), new AS (SELECT *, CASE WHEN trim(supplier_name) = '' THEN 'rejected: supplier_name is blank' WHEN status NOT IN ('active', 'inactive') THEN 'rejected: status has no such value' END AS bar, lower(trim(supplier_name)) AS n, lower(account_code) AS c FROM ({_NEW_SUPPLIERS})),
fit AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) AS k FROM (SELECT *, EXISTS (SELECT 1 FROM old WHERE old.company = new.company AND (lower(old.supplier_name) = n OR lower(old.account_code) = c)) AS taken FROM new WHERE bar IS NULL) WHERE NOT taken),
go(company, k, seq, ok, keys) AS (SELECT DISTINCT company, 0::BIGINT, -1::BIGINT, false, CAST([] AS VARCHAR[]) FROM fit UNION ALL SELECT company, k, seq, ok, CASE WHEN ok THEN list_concat(keys, mine) ELSE keys END FROM (SELECT f.company, f.k, f.seq, g.keys, list_filter(['n' || f.n, 'c' || f.c], lambda x: x IS NOT NULL) AS mine, NOT list_has_any(g.keys, list_filter(['n' || f.n, 'c' || f.c], lambda x: x IS NOT NULL)) AS ok FROM go g JOIN fit f ON f.company = g.company AND f.k = g.k + 1))
SELECT new.seq, coalesce(bar, CASE WHEN go.seq IS NULL THEN 'taken' WHEN go.ok THEN 'admitted' ELSE 'taken in the batch' END) AS outcome FROM new LEFT JOIN go ON go.seq = new.seq""")
def new_suppliers(spark: SparkSession, d: str) -> DataFrame:
    key = master_data.key_of
    told, _ = master_data.created(made(spark, d, _OLD_SUPPLIERS), made(spark, d, _NEW_SUPPLIERS), [key("company", "supplier_name"), key("company", "account_code")], ("supplier_name",), {"status": ["active", "inactive"]})
    return told.select("seq", "outcome")


# --- edits in order -----------------------------------------------------------------------------------------------------

_SEQ = " UNION ALL ".join(
    f"""SELECT row_id, CAST({k} AS BIGINT) AS seq, CASE (row_id + {k % 2}) % 4 WHEN 0 THEN 'supplier_name' WHEN 1 THEN 'net_amount' WHEN 2 THEN 'description' ELSE 'invoice_date' END AS field,
CASE (row_id * 7 + {k * 5}) % 9 WHEN 0 THEN '' WHEN 1 THEN '5.50' WHEN 2 THEN 'Supplier#00000000' || CAST((row_id + {k}) % 9 AS STRING) WHEN 3 THEN '1999-02-03' WHEN 4 THEN NULL WHEN 5 THEN 'line'
 ELSE CASE (row_id + {k % 2}) % 4 WHEN 0 THEN supplier_name WHEN 1 THEN CAST(net_amount AS STRING) WHEN 2 THEN description ELSE CAST(invoice_date AS STRING) END END AS value, CASE WHEN (row_id + {k}) % 5 = 4 THEN 'revert' ELSE 'edit' END AS action FROM u"""
    for k in range(8)
)
# The same log from one reading of u.
_LOG = """SELECT row_id, seq, CASE at % 4 WHEN 0 THEN 'supplier_name' WHEN 1 THEN 'net_amount' WHEN 2 THEN 'description' ELSE 'invoice_date' END AS field,
CASE (row_id * 7 + seq * 5) % 9 WHEN 0 THEN '' WHEN 1 THEN '5.50' WHEN 2 THEN 'Supplier#00000000' || CAST((row_id + seq) % 9 AS STRING) WHEN 3 THEN '1999-02-03' WHEN 4 THEN NULL WHEN 5 THEN 'line'
 ELSE CASE at % 4 WHEN 0 THEN supplier_name WHEN 1 THEN CAST(net_amount AS STRING) WHEN 2 THEN description ELSE CAST(invoice_date AS STRING) END END AS value, CASE WHEN (row_id + seq) % 5 = 4 THEN 'revert' ELSE 'edit' END AS action
FROM (SELECT *, row_id + seq % 2 AS at FROM (SELECT *, explode(sequence(0L, 7L)) AS seq FROM {u}))"""


def _fold(edited: str, fixes: str, suppliers: str) -> str:
    """SQL that goes through the edits of each field one after another; the last of its tables is `done`."""
    shown = lambda p: f"CASE e.field WHEN 'supplier_name' THEN {p}.supplier_name WHEN 'net_amount' THEN CAST({p}.net_amount AS VARCHAR) WHEN 'description' THEN {p}.description ELSE CAST({p}.invoice_date AS VARCHAR) END"
    return f"""u AS ({edited}), c AS ({fixes}), m AS ({suppliers}), raw AS (SELECT row_id, seq, field, nullif(value, '') AS value, action FROM ({_SEQ})),
e AS (SELECT e.*, row_number() OVER (PARTITION BY e.row_id, e.field ORDER BY e.seq) AS n, {shown('u')} AS own, {shown('c')} AS start,
  CASE WHEN action = 'revert' THEN NULL WHEN e.field = 'net_amount' THEN CAST(TRY_CAST(e.value AS DECIMAL(14,2)) AS VARCHAR) WHEN e.field = 'invoice_date' THEN CAST(TRY_CAST(e.value AS DATE) AS VARCHAR) ELSE e.value END AS nv,
  action = 'edit' AND coalesce(u.status, '') = 'exported' AS shut, e.field = 'supplier_name' AND EXISTS (SELECT 1 FROM m WHERE m.tenant = u.tenant AND m.company = u.company) AND NOT EXISTS (SELECT 1 FROM m WHERE m.tenant = u.tenant AND m.company = u.company AND m.supplier_name = e.value) AS unlisted
 FROM raw e JOIN u ON u.row_id = e.row_id LEFT JOIN c ON c.row_id = e.row_id),
f(row_id, field, n, seq, action, cell, old, nv, outcome) AS (SELECT DISTINCT row_id, field, 0::BIGINT, -1::BIGINT, '', start, NULL::VARCHAR, NULL::VARCHAR, '' FROM e UNION ALL
 SELECT row_id, field, n, seq, action, CASE WHEN outcome = 'applied' THEN nv ELSE cell END, old, nv, outcome FROM (SELECT e.row_id, e.field, e.n, e.seq, e.action, f.cell, CASE WHEN e.action = 'edit' THEN coalesce(f.cell, e.own) ELSE f.cell END AS old, e.nv,
  CASE WHEN shut THEN 'rejected: exported' WHEN e.action = 'edit' AND e.value IS NOT NULL AND e.nv IS NULL THEN 'rejected: no value of this field' WHEN e.action = 'edit' AND coalesce(f.cell, e.own) IS NOT DISTINCT FROM e.nv OR e.action = 'revert' AND f.cell IS NULL THEN 'unchanged' WHEN e.nv IS NOT NULL AND unlisted THEN 'rejected: not in the master list' ELSE 'applied' END AS outcome
 FROM f JOIN e ON e.row_id = f.row_id AND e.field = f.field AND e.n = f.n + 1)), done AS (SELECT * FROM f WHERE n > 0)"""


def _logged(spark: SparkSession, d: str, upto: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, corrections and the folded log; an edit is judged by those before it, so those after `upto` need no fold. The
    rows are made once and read once for the log."""
    rows, seen = observed(made(spark, d, _UNIQUE), "rows", n=F.count(F.lit(1)))
    fixes = spark.sql(_FIXES.replace(f"({_UNIQUE})", "{u}"), u=rows)
    log = spark.sql(_LOG, u=edit_log.spread(rows, seen["n"]))  # rows are moved to their tasks, not the edits made of them
    log = log if upto is None else log.where(F.col("seq") <= upto)
    done = edit_log.folded(rows, fixes, log, made(spark, d, _SUPPLIERS), made(spark, d, _CODES), seen["n"])
    return rows, fixes, done


@query(f"WITH RECURSIVE {_fold(_UNIQUE, _FIXES, _SUPPLIERS)} SELECT row_id, field, seq, action, old AS old_value, nv AS new_value, cell, outcome FROM done")
def edit_history(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d)[2].select("row_id", "field", "seq", "action", "old_value", "new_value", "cell", "outcome")


@query(f"""WITH RECURSIVE {_fold(_UNIQUE, _FIXES, _SUPPLIERS)}, l AS (SELECT row_id, field, arg_max(CASE WHEN cell IS NULL THEN [] ELSE [cell] END, seq) AS cell FROM done WHERE seq <= 4 AND outcome IN ('applied', 'unchanged') GROUP BY 1, 2),
now AS (SELECT u.row_id, {', '.join(f"(SELECT cell FROM l WHERE l.row_id = u.row_id AND l.field = '{f}') AS l_{f}, c.{f} AS c_{f}, u.{f}" for f in ('supplier_name', 'net_amount', 'description'))} FROM u LEFT JOIN c ON c.row_id = u.row_id)
SELECT row_id, {', '.join(f"coalesce(CASE WHEN l_{f} IS NOT NULL THEN l_{f}[1] ELSE CAST(c_{f} AS VARCHAR) END, CAST({f} AS VARCHAR)) AS {f}" for f in ('supplier_name', 'net_amount', 'description'))} FROM now""")
def rows_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows, fixes, done = _logged(spark, d, 4)
    shown = edits.effective(rows, edit_log.as_of(fixes, done, 4))
    return shown.select("row_id", *[F.col("current")[f].cast("string").alias(f) for f in ("supplier_name", "net_amount", "description")])


_STAGED = "SELECT c_custkey AS ord, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN upper('supplier#') || CAST(c_custkey % 70 AS STRING) ELSE 'Supplier#' || CAST(c_custkey % 70 AS STRING) END AS code, CASE WHEN c_custkey % 9 < 2 THEN '' WHEN c_custkey % 5 = 0 THEN upper(c_mktsegment) ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'N1' ELSE '' END AS default_nominal FROM {customer}"
_MASTER = "SELECT 'Supplier#' || CAST(s_suppkey AS STRING) AS code, CASE s_suppkey WHEN 3 THEN 'Building' WHEN 5 THEN 'Machinery' WHEN 7 THEN 'Machinery' ELSE s_name END AS name, 'old' AS default_nominal FROM {supplier}"
_IMPORT = f"""s AS (SELECT * FROM ({_STAGED}) WHERE code <> '' OR name <> '' OR default_nominal <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY lower(code) ORDER BY ord) AS n FROM s WHERE code <> '' AND name <> ''), m AS ({_MASTER}),
a AS (SELECT g.*, coalesce((SELECT code FROM m WHERE m.code = g.code), (SELECT min(code) FROM m WHERE lower(m.name) = lower(g.name) HAVING count(*) = 1)) AS target FROM g WHERE n = 1)"""


@query(f"WITH {_IMPORT} SELECT ord, CASE WHEN target IS NULL THEN 'imported' ELSE 'updated' END AS outcome FROM a UNION ALL SELECT ord, 'rejected: code stands twice' FROM g WHERE n > 1 UNION ALL SELECT ord, 'rejected: code and name are required' FROM s WHERE code = '' OR name = ''")
def supplier_import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return state.import_suppliers(made(spark, d, _MASTER), made(spark, d, _STAGED))[1]


@query(f"WITH {_IMPORT} SELECT code, name, nullif(default_nominal, '') AS default_nominal FROM a WHERE target IS NULL UNION ALL SELECT coalesce(x.code, m.code), coalesce(x.name, m.name), CASE WHEN x.code IS NULL THEN m.default_nominal ELSE nullif(x.default_nominal, '') END FROM m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord DESC) AS k FROM a WHERE target IS NOT NULL) WHERE k = 1) x ON x.target = m.code")
def supplier_import(spark: SparkSession, d: str) -> DataFrame:
    return state.import_suppliers(made(spark, d, _MASTER), made(spark, d, _STAGED))[0]


_NOMINALS = "SELECT c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'n' || CAST(c_custkey % 90 AS STRING) ELSE 'N' || CAST(c_custkey % 90 AS STRING) END AS code, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 22 = 0 THEN '' ELSE c_name END AS name FROM {customer}"
_HELD = "SELECT 'N' || CAST(s_suppkey AS STRING) AS code, s_name AS name, s_suppkey % 3 = 0 AS is_active FROM {supplier}"
_TAKEN = f"s AS (SELECT * FROM ({_NOMINALS}) WHERE code <> '' OR name <> ''), h AS ({_HELD}), g AS (SELECT *, row_number() OVER (PARTITION BY lower(code) ORDER BY ord) AS n FROM s WHERE code <> '' AND name <> ''), o AS (SELECT ord, CASE WHEN n = 1 THEN 'imported' ELSE 'rejected: code stands twice' END AS outcome FROM g UNION ALL SELECT ord, 'rejected: code and name are required' FROM s WHERE code = '' OR name = '')"


@query(f"WITH {_TAKEN} SELECT ord, outcome FROM o")
def nominal_import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return state.import_nominals(made(spark, d, _HELD), made(spark, d, _NOMINALS))[1]


@query(f"WITH {_TAKEN} SELECT h.code, coalesce(g.name, h.name) AS name, is_active OR g.code IS NOT NULL AS is_active FROM h LEFT JOIN (SELECT * FROM g WHERE n = 1) g ON g.code = h.code UNION ALL SELECT code, name, true FROM g WHERE n = 1 AND code NOT IN (SELECT code FROM h)")
def nominal_import(spark: SparkSession, d: str) -> DataFrame:
    return state.import_nominals(made(spark, d, _HELD), made(spark, d, _NOMINALS))[0]


@query(f"WITH {_TAKEN} SELECT count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome LIKE 'rejected%') AS skipped, (SELECT string_agg('Row ' || ord || ': ' || substring(outcome, 11), '|' ORDER BY ord) FROM (SELECT * FROM o WHERE outcome LIKE 'rejected%' ORDER BY ord LIMIT 20)) AS errors FROM o")
def nominal_import_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.import_counts(state.import_nominals(made(spark, d, _HELD), made(spark, d, _NOMINALS))[1]).withColumn("errors", F.array_join("errors", "|"))


_ISSUES = "SELECT s_suppkey AS id, 'T' || CAST(s_nationkey % 3 AS STRING) AS tenant, s_name AS title, 'old issue' AS description, 'pending' AS status, 'normal' AS priority, CASE WHEN s_suppkey % 2 = 0 THEN 'noted' END AS resolution_notes, '2025-01-01' AS updated_at FROM {supplier}"
_ASKED = "SELECT c_custkey AS seq, 'T' || CAST(c_nationkey % 3 AS STRING) AS tenant, CASE c_custkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN NULL ELSE c_name END AS title, CASE WHEN c_custkey % 7 = 0 THEN 'abcd' ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 3 = 0 THEN 'high' END AS priority FROM {customer}"
_WORKED = "SELECT c_custkey AS seq, c_custkey % 14 AS id, CASE c_custkey % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'resolution_notes' WHEN 2 THEN 'priority' ELSE 'title' END AS field, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS value FROM {customer}"


@query(f"WITH i AS ({_ISSUES}), a AS ({_ASKED}) SELECT id, tenant, title, description, status, priority, resolution_notes, updated_at FROM i UNION ALL SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY seq), tenant, title, description, 'pending', coalesce(priority, 'normal'), NULL, '2026-01-01' FROM a WHERE length(title) BETWEEN 3 AND 255 AND length(description) >= 5")
def issues_opened(spark: SparkSession, d: str) -> DataFrame:
    return issues.opened(made(spark, d, _ISSUES), made(spark, d, _ASKED), "2026-01-01")[0]


@query(f"""WITH i AS ({_ISSUES}), w AS ({_WORKED}), n AS (SELECT id, field, arg_max(CASE WHEN value IS NULL THEN [] ELSE [value] END, seq) AS v FROM w WHERE field <> 'title' GROUP BY 1, 2)
SELECT id, title, {', '.join(f"CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = i.id AND n.field = '{f}') THEN (SELECT v[1] FROM n WHERE n.id = i.id AND n.field = '{f}') ELSE {f} END AS {f}" for f in ('status', 'resolution_notes', 'priority'))}, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.id = i.id) THEN '2026-02-02' ELSE updated_at END AS updated_at FROM i""")
def issues_updated(spark: SparkSession, d: str) -> DataFrame:
    return issues.updated(made(spark, d, _ISSUES), made(spark, d, _WORKED), "2026-02-02")[0].drop("tenant", "description")


@query(f"WITH i AS ({_ISSUES}), w AS ({_WORKED}) SELECT seq, CASE WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.id = w.id) THEN 'not found' WHEN field = 'title' THEN 'ignored' ELSE 'done' END AS outcome FROM w")
def issue_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return issues.updated(made(spark, d, _ISSUES), made(spark, d, _WORKED), "2026-02-02")[1]


_OLD = "SELECT p_brand AS supplier_name, array_sort(collect_set(p_type || lower(p_type))) AS keywords, count(*) AS hit_count, DATE '2020-01-01' AS last_seen FROM {part} GROUP BY 1"
_NEW = "SELECT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'New' || p_type END AS supplier_name, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' invoice ' || lower(p_type) || ' from account north' END AS header FROM {part}"


@query(f"""WITH o AS (SELECT p_brand AS supplier_name, list_sort(list_distinct(list(p_type || lower(p_type)))) AS keywords, count(*) AS hit_count FROM part GROUP BY 1), n AS ({_NEW}),
w AS (SELECT supplier_name, list_filter(list_distinct(regexp_extract_all(lower(header), '[a-z]{{4,}}')), lambda x: x NOT IN ('invoice', 'from', 'account', 'unit', 'name')) AS w FROM n), h AS (SELECT supplier_name, count(*) AS hits, flatten(list(w)) AS ws FROM w WHERE len(w) >= 3 GROUP BY 1)
SELECT coalesce(o.supplier_name, h.supplier_name) AS supplier_name, array_to_string(CASE WHEN hits IS NULL THEN keywords ELSE list_sort(list_distinct(list_concat(coalesce(keywords, []), ws)))[1:5] END, ' ') AS keywords, coalesce(hit_count, 0) + coalesce(hits, 0) AS hit_count, CASE WHEN hits IS NULL THEN DATE '2020-01-01' ELSE DATE '2024-06-01' END AS last_seen FROM o FULL JOIN h ON o.supplier_name = h.supplier_name""")
def pattern_merge(spark: SparkSession, d: str) -> DataFrame:
    found = resolution.merged_patterns(made(spark, d, _OLD), made(spark, d, _NEW), "2024-06-01", 5)
    return found.withColumn("keywords", F.array_join("keywords", " "))


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 8 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS read_date FROM orders""")
def read_dates(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 9
    raw = F.lit(" 31/02/2024")
    for k, form in enumerate(["dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yy", "d MMMM yyyy", "MMMM d, yyyy", "MMM dd yyyy"]):
        raw = F.when(key == k, F.date_format(day, form)).otherwise(raw)
    return table(spark, d, "orders").select("o_orderkey", dates.read_date(raw).alias("read_date"))


# --- batches, listings, upkeep ----------------------------------------------------------------------------------------

_FILES = "SELECT o_custkey AS batch_id, o_orderkey AS file_id, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'pending' END END AS status, coalesce(n, 0) AS page_count, coalesce(n, 0) % 5 AS rows, o_orderkey % 2 AS failed_pages, o_orderdate AS uploaded_at FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY 1) ON o_orderkey = l_orderkey"
_BATCHES = "SELECT c_custkey AS batch_id, c_nationkey AS tenant, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 60 END AS page_count, CASE c_custkey % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'processed' ELSE 'exported' END AS status FROM {customer}"


@query(f"""WITH f AS (SELECT batch_id, count(*) FILTER (status IN ('processed', 'partial')) AS processed_files, count(*) FILTER (status = 'failed') AS failed_files, count(*) AS total_files, CAST(sum(page_count) AS BIGINT) AS total_pages FROM ({_FILES}) GROUP BY 1)
SELECT b.batch_id, CAST(coalesce(page_count, 0) AS BIGINT) AS processed_pages, coalesce(processed_files, 0) AS processed_files, coalesce(failed_files, 0) AS failed_files, coalesce(total_files, 0) AS total_files, coalesce(total_pages, 0) AS total_pages, CASE WHEN total_pages > 0 THEN least(100, CAST(round_even(coalesce(page_count, 0) / total_pages * 100, 0) AS BIGINT)) ELSE 0 END AS percent FROM ({_BATCHES}) b LEFT JOIN f ON b.batch_id = f.batch_id""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return analytics.batch_progress(made(spark, d, _BATCHES), made(spark, d, _FILES)).withColumn("processed_pages", F.col("processed_pages").cast("long"))


@query(f"""SELECT batch_id, processed, partial, failed, CASE WHEN failed = 0 AND partial = 0 THEN 'processed' WHEN processed + partial > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT batch_id, count(*) FILTER (rows > 0 AND failed_pages = 0) AS processed, count(*) FILTER (rows > 0 AND failed_pages > 0) AS partial, count(*) FILTER (rows = 0) AS failed FROM ({_FILES}) GROUP BY 1)""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return analytics.status_rollup(made(spark, d, _FILES))


@query(f"""SELECT b.batch_id, b.status, count(f.batch_id) FILTER (f.status IN ('processed', 'partial')) AS processed_files, count(f.batch_id) FILTER (f.status = 'failed') AS failed_files, count(f.batch_id) AS total_files, CAST(coalesce(sum(f.page_count), 0) AS BIGINT) AS row_count FROM ({_BATCHES}) b LEFT JOIN ({_FILES}) f ON b.batch_id = f.batch_id GROUP BY 1, 2""")
def batch_detail(spark: SparkSession, d: str) -> DataFrame:
    files = made(spark, d, _FILES)
    rows = table(spark, d, "lineitem").join(files.select("file_id", "batch_id"), F.col("l_orderkey") == F.col("file_id"))
    return analytics.batch_detail(made(spark, d, _BATCHES).select("batch_id", "status"), files, rows)


@query(f"SELECT batch_id, count(*) AS row_count, count(*) FILTER (row_id % 2 = 0 AND (row_id % 3 = 0 OR row_id % 4 = 0 OR row_id % 5 = 0)) AS corrected_count, count(*) AS flagged_count FROM ({_UNIQUE}) u GROUP BY 1")
def workspace_counts(spark: SparkSession, d: str) -> DataFrame:
    shown = edits.effective(*_inputs(spark, d)).withColumnRenamed("is_corrected", "corrected")
    return analytics.workspace(shown, "batch_id")


@query(f"SELECT b.batch_id, coalesce(max(o_orderkey % 17), 0) + 1 AS version FROM ({_BATCHES}) b LEFT JOIN orders ON o_custkey = b.batch_id GROUP BY 1")
def next_export_version(spark: SparkSession, d: str) -> DataFrame:
    exports = table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), (F.col("o_orderkey") % 17).alias("version"))
    return analytics.next_version(made(spark, d, _BATCHES).select("batch_id"), exports)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error') ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return listing.audit_log(events.withColumnRenamed("event_type", "kind"), ["click", "error"], ["ts", "event_id"], 100).select("event_id", "user_id", F.col("kind").alias("event_type"))


@query("SELECT n_regionkey AS user_id, n_nationkey AS tenant FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 4 = 0 DESC, n_nationkey) AS k FROM nation) WHERE k = 1")
def default_tenant(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "nation").select(F.col("n_regionkey").alias("user_id"), F.col("n_nationkey").alias("tenant"), (F.col("n_nationkey") % 4 == 0).alias("is_default"))
    return listing.first_tenant(links)


@query(f"SELECT batch_id, CASE WHEN status = 'processing' THEN 'partial' ELSE status END AS status FROM ({_BATCHES})")
def recovered_batches(spark: SparkSession, d: str) -> DataFrame:
    return listing.recovered(made(spark, d, _BATCHES).select("batch_id", "status"))


@query(f"SELECT f.batch_id, count(*) AS files FROM ({_FILES}) f WHERE NOT EXISTS (SELECT 1 FROM ({_BATCHES}) b WHERE b.batch_id = f.batch_id AND b.batch_id % 4 = 1 AND b.status <> 'processing') GROUP BY 1")
def batch_delete(spark: SparkSession, d: str) -> DataFrame:
    batches = made(spark, d, _BATCHES)
    left = listing.deleted(batches, batches.where("batch_id % 4 = 1").select("batch_id"), files=made(spark, d, _FILES))
    return left["files"].groupBy("batch_id").agg(F.count("*").alias("files"))


@query("SELECT p_partkey AS rule_id, p_brand AS pattern FROM part WHERE p_size % 2 = 0 AND (contains(lower(p_brand), 'd#1') OR contains(lower(p_type), 'd#1') OR contains(lower(p_name), 'd#1'))")
def rule_list_filter(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("source_pattern"), F.col("p_type").alias("target_value"), F.col("p_name").alias("field_name"), (F.col("p_size") % 2 == 0).alias("active"))
    return listing.rule_list(held, True, "D#1").select("rule_id", F.col("source_pattern").alias("pattern"))


@query(f"SELECT row_id, batch_id FROM (SELECT *, CASE WHEN row_id % 4 <> 3 THEN row_id % 10 / 10.0 END AS c FROM ({_UNIQUE}) u) WHERE c < 0.7")
def low_confidence_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, _UNIQUE).withColumn("confidence_score", F.when(F.col("row_id") % 4 != 3, F.col("row_id") % 10 / 10)).withColumn("corrected", F.lit(False))
    return listing.review_list(rows, "low_conf").select("row_id", "batch_id")


@query("""WITH h AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand || ' products' AS header FROM part), p AS (SELECT p_brand AS supplier_name, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{4,}')))))[1:6] AS kw FROM part GROUP BY 1),
s AS (SELECT id, supplier_name, len(list_intersect(list_distinct(regexp_extract_all(lower(header), '[a-z]{4,}')), kw)) AS n, len(kw) AS size FROM h, p)
SELECT id, supplier_name, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n / size DESC, supplier_name) AS k FROM s WHERE n >= 3 AND n >= size * 0.5) WHERE k = 1""")
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    headers = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("products")).alias("header"))
    patterns = resolution.learn_patterns(part.select(F.col("p_brand").alias("supplier_name"), F.concat_ws(" ", "p_name", "p_type").alias("header")), 6)
    return resolution.match_patterns(headers, patterns)

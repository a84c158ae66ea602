"""Which supplier and which account an invoice row belongs to: the chain that every processed row passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fields, text
from ledgerloom.operators import analytics, matching, patterns
from ledgerloom.shared import stored

SCOPE = ["tenant", "company"]
#: The fields that a saved region may fill.
HINTED = ("supplier_name", "invoice_number", "invoice_date", "net_amount", "vat_amount", "total_amount", "nominal_account_code", "description")


def match_suppliers(rows: DataFrame, masters: DataFrame) -> DataFrame:
    """(tenant, company, supplier_name, supplier_vat, ord, tier, score) for the distinct suppliers of rows that a master has.

    masters: tenant, company, ord, canonical, vat_number, is_active. Tiers: 0 the VAT number, 1 the name in any case, 2 the
    best of containment and shared words, from half of them on. Ties go to the smaller ord. Null names or numbers match
    nothing; inactive masters take no part.
    """
    known = masters.where("is_active").select(*SCOPE, "ord", "canonical", text.vat_key(F.col("vat_number")).alias("vk"), F.lower("canonical").alias("low"), text.supplier_key(F.col("canonical")).alias("key"), text.key_words(F.col("canonical")).alias("words"))
    own = rows.select(*SCOPE, "supplier_name", "supplier_vat").distinct().withColumns({"vk": text.vat_key(F.col("supplier_vat")), "name": F.trim("supplier_name")})
    own = own.withColumns({"low": F.lower("name"), "key": text.supplier_key(F.col("name")), "words": text.key_words(F.col("name"))})
    names = [*SCOPE, "supplier_name", "supplier_vat"]
    hit = lambda tier, score: F.struct(F.lit(tier).alias("tier"), (-score).alias("less"), "ord").alias("m")
    # Of the masters of one number, or of one name, the first in order is the only one that can win.
    first = lambda by: known.groupBy(*SCOPE, by).agg(F.min("ord").alias("ord"))
    by_vat = own.where("vk <> ''").join(first("vk"), [*SCOPE, "vk"]).select(*names, hit(0, F.lit(1.0)))
    by_name = own.where("low <> ''").join(first("low"), [*SCOPE, "low"]).select(*names, hit(1, F.lit(1.0)))
    loose = matching.best_match(own.where("name <> ''").select(*SCOPE, "name", "key", "words").distinct(), known, SCOPE, "key", "words")
    by_words = own.join(loose, [*SCOPE, "name"]).select(*names, hit(2, F.col("score")))
    best = by_vat.unionByName(by_name).unionByName(by_words).groupBy(*names).agg(F.min("m").alias("m"))
    return stored(best.select(*names, "m.ord", "m.tier", (-F.col("m.less")).alias("score")), "matched")


def charts(accounts: DataFrame) -> DataFrame:
    """The active accounts of each company as one list in their order. accounts: tenant, company, ord, code, name, is_default,
    is_active. A chart of accounts is short, so it goes to the rows of its company as a whole."""
    one = F.struct("ord", "code", F.lower("name").alias("low_name"), F.lower("code").alias("low_code"), "is_default")
    return accounts.where("is_active").groupBy(*SCOPE).agg(F.array_sort(F.collect_list(one)).alias("accounts"))


def _first(fits) -> Column:  # noqa: ANN001
    return F.get(F.filter("accounts", fits), 0)["code"]


def named(hint: Column) -> Column:
    """The first account whose name holds the hint."""
    return F.when(F.coalesce(hint, F.lit("")) != "", _first(lambda a: F.contains(a["low_name"], F.lower(hint))))


def mentioned(words: Column) -> Column:
    """The first account whose name or code the text holds."""
    low = F.lower(words)
    holds = lambda x: (x != "") & F.contains(low, x)
    return _first(lambda a: F.coalesce(holds(a["low_name"]), F.lit(False)) | F.coalesce(holds(a["low_code"]), F.lit(False)))


def mentions(rows: DataFrame, accounts: DataFrame, words: str) -> DataFrame:
    """rows (tenant, company, ...) with `mentioned`, the first active account of their company whose name or code the column
    `words` holds: `mentioned` for charts of any length."""
    known = accounts.where("is_active")
    each = lambda c, k: known.select(*SCOPE, (F.col("ord") * 2 + k).alias("ord"), F.col(c).alias("alias"), F.col("code").alias("label"))
    return patterns.labelled_within(rows, words, each("name", 0).unionByName(each("code", 1)), SCOPE, "mentioned")


def default() -> Column:
    return _first(lambda a: F.coalesce(a["is_default"], F.lit(False)))


def classified(rows: DataFrame, accounts: DataFrame, taxonomy: DataFrame | list[tuple[str, list[str]]]) -> DataFrame:
    """rows (tenant, company, description, line_items_raw, nominal_hint, history_code) with code, method and confidence: of
    hint, taxonomy, history, keyword and default the first that names an account.

    taxonomy: a table (ord, alias, label) of any size, or a short list of (hint, aliases) in order, compiled into the plan;
    within an entry of the list longer aliases come first.
    """
    joined = rows.join(charts(accounts), SCOPE, "left").withColumn("__text", F.concat_ws(" ", F.nullif("description", F.lit("")), F.nullif("line_items_raw", F.lit(""))))
    if isinstance(taxonomy, DataFrame):
        joined = patterns.labelled(joined, F.col("__text"), taxonomy, "__topic")
    else:
        low, topic = F.lower("__text"), F.when(F.lit(False), F.lit(None).cast("string"))
        for hint, aliases in taxonomy:
            for alias in sorted(aliases, key=len, reverse=True):
                topic = topic.when(F.contains(low, F.lit(alias)), hint)
        joined = joined.withColumn("__topic", topic)
    tiers = [("supplier_rule", "0.95", named(F.col("nominal_hint"))), ("taxonomy_match", "0.90", named(F.col("__topic"))), ("historical_similarity", "0.80", F.nullif("history_code", F.lit(""))), ("keyword_match", "0.70", F.when(F.col("__text") != "", mentioned(F.col("__text")))), ("default", "0.40", default())]
    found = F.coalesce(*[F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(name).alias("method"), F.lit(sure).cast("decimal(3,2)").alias("confidence"))) for name, sure, code in tiers])
    made = joined.withColumn("__c", found)
    return made.select(*rows.columns, "__c.code", F.coalesce("__c.method", F.lit("unresolved")).alias("method"), F.coalesce("__c.confidence", F.lit(0).cast("decimal(3,2)")).alias("confidence"))


def suggest(rows: DataFrame, masters: DataFrame, accounts: DataFrame, history: DataFrame, taxonomy: list[tuple[str, list[str]]], listed: DataFrame | None = None, sure: float = 0.70) -> DataFrame:
    """rows with supplier_name as the master has it, supplier_posting_account, nominal_account_code and how it was found.

    rows: tenant, company, supplier_name, supplier_vat, supplier_posting_account, nominal_account_code, description,
    line_items_raw. A matched supplier gives its name, and its accounts where the row has none; then its most used account
    in history counts (rows of earlier jobs). Rows that are still without an account are classified: their name meets the
    list of known suppliers (`normalised_suppliers`; listed may have a nominal_hint), which renames them from a confidence
    of `sure` on and gives the hint; a supplier that no master has takes its history under its own name, or the one that
    the list gives it. What a row has already stays.
    """
    matched = match_suppliers(rows, masters).join(masters.select(*SCOPE, "ord", F.col("canonical").alias("__name"), F.coalesce(F.nullif("account_code", F.lit("")), "posting_account").alias("__posting"), F.nullif("default_nominal", F.lit("")).alias("__own")), [*SCOPE, "ord"])
    pick = matched.select(*SCOPE, F.col("supplier_name").alias("__n"), F.col("supplier_vat").alias("__v"), "__name", "__posting", "__own")
    used = analytics.modal_nominal(history).select(*SCOPE, F.col("supplier_name").alias("__key"), F.col("nominal_account_code").alias("__used"))
    names = rows.select(*SCOPE, "supplier_name", "supplier_vat").distinct().alias("r")
    same = [F.col("r.tenant") == F.col("p.tenant"), F.col("r.company") == F.col("p.company"), F.col("r.supplier_name").eqNullSafe(F.col("p.__n")), F.col("r.supplier_vat").eqNullSafe(F.col("p.__v"))]
    known = names.join(pick.alias("p"), same, "left").select("r.*", "p.__name", "p.__posting", "p.__own").withColumn("__raw", F.coalesce("__name", "supplier_name"))
    if listed is None:
        known = known.withColumns({"__renamed": F.col("__raw"), "__hint": F.lit(None).cast("string")})
    else:
        told = normalised_suppliers(known.select(F.col("__raw").alias("raw"), F.lit(None).cast("string").alias("vat")).where("raw <> ''"), listed)
        hint = listed.select("ord", F.col("nominal_hint").alias("__hint")) if "nominal_hint" in listed.columns else listed.select("ord", F.lit(None).cast("string").alias("__hint"))
        met = told.where("match_method <> 'unmatched'").join(hint, "ord").select(F.col("raw").alias("__raw"), F.when(F.col("match_confidence") >= sure, F.col("canonical")).alias("__listed"), "__hint")
        known = known.join(met, "__raw", "left").withColumn("__renamed", F.coalesce("__listed", "__raw")).drop("__listed")
    known = known.withColumn("__key", F.coalesce("__name", "__renamed")).join(used, [*SCOPE, "__key"], "left")
    parts = known.select(F.col("tenant").alias("__t"), F.col("company").alias("__c"), F.col("supplier_name").alias("__n"), F.col("supplier_vat").alias("__v"), "__name", "__posting", "__own", "__raw", "__renamed", "__hint", "__used")
    joined = rows.join(parts, (F.col("tenant") == F.col("__t")) & (F.col("company") == F.col("__c")) & F.col("supplier_name").eqNullSafe(F.col("__n")) & F.col("supplier_vat").eqNullSafe(F.col("__v")), "left")
    has = F.nullif(F.col("nominal_account_code"), F.lit(""))
    own = F.when(F.col("__name").isNotNull(), F.coalesce("__own", "__used"))
    ready = joined.withColumns({"nominal_hint": F.col("__hint"), "history_code": F.when(F.col("__name").isNull(), F.col("__used"))})
    found = classified(ready, accounts, taxonomy)
    method = F.when(has.isNotNull(), "given").when(F.col("__name").isNotNull() & F.col("__own").isNotNull(), "supplier_default").when(own.isNotNull(), "historical").otherwise(F.col("method"))
    name = F.when(has.isNull() & own.isNull(), F.coalesce("__renamed", "supplier_name")).otherwise(F.coalesce("__raw", "supplier_name"))
    out = found.withColumns({"supplier_name": name, "supplier_posting_account": F.coalesce(F.nullif("supplier_posting_account", F.lit("")), "__posting"), "nominal_account_code": F.coalesce(has, own, "code"), "method": method})
    return out.select(*rows.columns, "method")


def normalised_suppliers(names: DataFrame, masters: DataFrame) -> DataFrame:
    """names (raw, vat) with clean, canonical, match_method, match_confidence, review_reason and the ord of the master met, by a
    list of masters (ord, canonical, vat_number, aliases): the VAT number, then a name or alias, then containment either way, then shared words
    from 0.60 on, unsure below 0.75. Ties go to the smaller ord."""
    own = names.select("raw", "vat").distinct().withColumn("clean", text.clean_supplier(F.col("raw"))).withColumns({"name": F.lower("clean"), "key": F.lower("clean"), "words": text.core_words(F.col("clean")), "vk": text.vat_key(F.col("vat"))})
    forms = masters.select("ord", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).select("ord", F.lower("form").alias("key"), text.core_words(F.col("form")).alias("words")).where("key <> ''").distinct()
    hit = lambda tier, less: F.struct(F.lit(tier).alias("tier"), less.alias("less"), "ord").alias("m")
    by_vat = own.where("vk <> ''").join(masters.select("ord", text.vat_key(F.col("vat_number")).alias("vk")), "vk").select("raw", "vat", hit(0, F.lit(-1.0)))
    by_name = own.join(forms, "key").select("raw", "vat", hit(1, F.lit(-0.95)))
    loose = own.join(matching.best_match(own.where("name <> ''").select("name", "key", "words").distinct(), forms, [], "key", "words", 0.0001, 2.0), "name")
    held = loose.where("score = 2.0").select("raw", "vat", hit(2, F.lit(-0.80)))
    shared = loose.where("score < 2.0").select("raw", "vat", hit(3, -F.col("score")))
    best = by_vat.unionByName(by_name).unionByName(held).unionByName(shared).groupBy("raw", "vat").agg(F.min("m").alias("m"))
    found = own.alias("o").join(best.alias("b"), F.col("o.raw").eqNullSafe(F.col("b.raw")) & F.col("o.vat").eqNullSafe(F.col("b.vat")), "left").select("o.raw", "o.vat", "o.clean", F.col("b.m.tier").alias("tier"), (-F.col("b.m.less")).alias("score"), F.col("b.m.ord").alias("ord")).join(masters.select("ord", "canonical"), "ord", "left")
    sure = F.coalesce((F.col("tier") < 3) | (F.col("score") >= 0.60), F.lit(False))
    method = F.when(~sure, "unmatched").when(F.col("tier") == 0, "vat_match").when(F.col("tier") < 3, "alias_match").otherwise("fuzzy_match")
    reason = F.when((F.col("clean") == "") & ~F.coalesce(F.col("tier") == 0, F.lit(False)), "supplier_unknown").when(~sure | ((F.col("tier") == 3) & (F.col("score") < 0.75)), "supplier_low_confidence")
    return found.select("raw", "vat", "clean", F.when(sure, F.col("canonical")).otherwise(F.col("clean")).alias("canonical"), method.alias("match_method"), F.coalesce(F.round("score", 2), F.lit(0.0)).alias("match_confidence"), reason.alias("review_reason"), F.when(sure, F.col("ord")).alias("ord"))


def prefilled(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """rows (row_id, supplier_name) with the supplier that their header's pattern names, where it names one. headers: id and
    supplier_name, as `resolution.match_patterns` gives them."""
    named = headers.select(F.col("id").alias("row_id"), F.col("supplier_name").alias("__named"))
    return rows.join(named, "row_id", "left").withColumn("supplier_name", F.coalesce("__named", "supplier_name")).select(*rows.columns)


def hints_met(rows: DataFrame, hints: DataFrame, suppliers: DataFrame, fields_: tuple[str, ...] = HINTED, place: list[str] | None = None) -> DataFrame:
    """(row_id, field_name, place, hint_id): for each field of a row that may be filled, the saved regions that are its
    supplier's on that page; regions kept under the supplier's id come before those kept under its name. Of regions in the
    same place (columns of hints; none: all are) the newest stands for all, before any row meets them.

    rows: row_id, tenant, company, page_no, supplier_name, review_fields and the fields; hints: id, tenant, field_name, page_no,
    supplier_id, supplier_name_snapshot, active; suppliers: id, tenant, company, supplier_name. A field may be filled if it is
    blank, named for review, or plainly wrong.
    """
    blank = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) == "" if f not in fields.AMOUNTS else F.coalesce(F.col(f).cast("string").try_cast("double") == 0, F.col(f).isNull())
    wanted = F.array_compact(F.array(*[F.when(blank(f) | F.coalesce(F.array_contains(text.split_fields(F.col("review_fields")), f), F.lit(False)) | fields.suspect(f, F.col(f).cast("string")), f) for f in fields_]))
    own = rows.withColumns({"norm": text.supplier_key(F.col("supplier_name")), "wanted": wanted}).where("norm <> '' and size(wanted) > 0")
    ids = suppliers.groupBy("tenant", "company", "supplier_name").agg(F.min("id").alias("supplier_id"))
    asked = own.join(ids, ["tenant", "company", "supplier_name"], "left").select("row_id", "tenant", "page_no", "norm", "supplier_id", "wanted")
    place = place or []
    live = hints.where("active").select("tenant", "page_no", F.col("id").alias("hint_id"), "field_name", "supplier_id", text.supplier_key(F.col("supplier_name_snapshot")).alias("norm"), *place)
    newest = lambda by: live.groupBy("tenant", "page_no", by, "field_name", *place).agg(F.max("hint_id").alias("hint_id"))
    held = [*place, "hint_id"]
    # Whether a row has regions under its id is asked of all of them, whatever field they are for.
    kept = live.select("tenant", "page_no", "supplier_id", F.lit(True).alias("__kept")).where("supplier_id is not null").distinct()
    told = asked.join(kept, ["tenant", "page_no", "supplier_id"], "left")
    by_id = told.where("__kept").join(newest("supplier_id"), ["tenant", "page_no", "supplier_id"]).select("row_id", "wanted", "field_name", *held)
    by_name = told.where("__kept is null").join(newest("norm").where("norm <> ''"), ["tenant", "page_no", "norm"]).select("row_id", "wanted", "field_name", *held)
    return by_id.unionByName(by_name).where(F.array_contains("wanted", F.col("field_name"))).select("row_id", "field_name", *held)


def hints_for(rows: DataFrame, hints: DataFrame, suppliers: DataFrame, fields_: tuple[str, ...] = HINTED) -> DataFrame:
    """(row_id, field, hint_id): the newest of `hints_met` for each field of a row."""
    return hints_met(rows, hints, suppliers, fields_).groupBy("row_id", F.col("field_name").alias("field")).agg(F.max("hint_id").alias("hint_id"))

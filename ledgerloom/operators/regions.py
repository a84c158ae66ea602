"""Saved regions of pages: the words that lie in a rectangle, their replay over later invoices, and saving new ones.

Rectangles and words meet in a join on the cells of a grid over the page: a word lies in the cell of its centre, a
rectangle covers some cells, and only words in those are compared with it. So a page of many words, or a rectangle that
many pages share, makes no more pairs than words near rectangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, fields, money, text
from ledgerloom.operators import accounts, edits

#: Cells of the grid along each side of a page, and the letters and digits that a text must have to count as read.
GRID, LEAST = 16, 2
#: Words up to which a page is one cell: a rectangle over all of it would be 256 cells for a few words.
FEW = 64
PLACE = ["x", "y", "w", "h"]
#: What makes two hints the same.
HINT = ["tenant", "field_name", "supplier_name_snapshot", "page_no"]


def _cell(at: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(at * GRID))).cast("int")


def region_text(regions: DataFrame, words: DataFrame) -> DataFrame:
    """regions with `read_text`: the words whose centres lie in the rectangle, by line and then from left to right, joined by
    spaces; null where they have fewer than `LEAST` letters and digits between them.

    regions: region_id (unique), file_id, page_no, x, y, w, h, as shares of the page; words: file_id, page_no, line_no, word,
    x0, y0, x1, y1. Null coordinates hold nothing; words that repeat stay.
    """
    keys = ["file_id", "page_no"]
    few = words.groupBy(*keys).agg((F.count("*") <= FEW).alias("few"))
    span = lambda low, size: F.when(F.col("few"), F.array(F.lit(0))).otherwise(F.sequence(_cell(F.col(low)), _cell(F.col(low) + F.col(size))))
    cells = regions.where("x is not null and y is not null and w >= 0 and h >= 0").join(few, keys).select("region_id", *keys, *PLACE, F.explode(span("x", "w")).alias("gx"), "few").select("*", F.explode(span("y", "h")).alias("gy")).drop("few")
    centred = words.select(*keys, "line_no", "word", "x0", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    placed = centred.join(few, keys).withColumns({g: F.when(F.col("few"), 0).otherwise(_cell(F.col(c))) for g, c in (("gx", "cx"), ("gy", "cy"))}).drop("few")
    inside = F.col("cx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("cy").between(F.col("y"), F.col("y") + F.col("h"))
    met = cells.join(placed, [*keys, "gx", "gy"]).where(inside)
    read = met.groupBy("region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x0", "word"))), lambda s: s["word"]), " ").alias("__read"))  # of one page
    clean = F.trim(F.regexp_replace("__read", r"\s+", " "))
    return regions.join(read, "region_id", "left").select(*regions.columns, F.when(text.meaningful_chars(clean) >= LEAST, clean).alias("read_text"))


def value_of(field: Column, said: Column) -> Column:
    """What a text is worth in a field: an amount with two decimals, a date in ISO form, else the text; null if it is none."""
    return F.when(field.isin(fields.AMOUNTS), money.parse_amount(said).cast(edits.MONEY).cast("string")).when(field == "invoice_date", dates.read_date(said).cast("string")).otherwise(said)


def replayed(rows: DataFrame, hints: DataFrame, suppliers: DataFrame, words: DataFrame, fields_: tuple[str, ...] = accounts.HINTED) -> DataFrame:
    """rows with the fields that saved regions fill: of the regions that are a row's for a field (`accounts.hints_met`) the newest
    one that can be read on its page, whose text is a value of the field, and no invoice reference where a supplier is due.
    rows as for `accounts.hints_for`, with file_id; hints with x, y, w, h; words as for `region_text`."""
    met = accounts.hints_met(rows, hints, suppliers, fields_, PLACE)
    asked = met.join(rows.select("row_id", "file_id", "page_no"), "row_id").withColumn("region_id", F.struct("row_id", "field_name", "hint_id"))
    read = region_text(asked, words).withColumn("value", value_of(F.col("field_name"), F.col("read_text")))
    fit = F.when(F.col("field_name") == "supplier_name", fields.appropriate("supplier_name", F.col("read_text"))).otherwise(True)
    newest = read.where(F.col("value").isNotNull() & fit).groupBy("row_id", "field_name").agg(F.max_by("value", "hint_id").alias("value"))
    have = [f for f in fields_ if f in rows.columns]
    wide = newest.groupBy("row_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f"__{f}") for f in have])
    kinds = dict(rows.dtypes)
    return rows.join(wide, "row_id", "left").select(*[F.coalesce(F.col(f"__{c}").cast(kinds[c]), F.col(c)).alias(c) if c in have else F.col(c) for c in rows.columns])


def remapped(rows: DataFrame, corrections: DataFrame, commands: DataFrame, words: DataFrame) -> DataFrame:
    """commands (seq, row_id, field, page_no, x, y, w, h, selected_text, apply) with read_text, old_value, new_value and outcome:
    applied; unchanged; saved (only the region is kept); no text; no value of this field; ignored (no such row, or a field
    that is not to be corrected). A text that was selected counts before the words in the rectangle. Of several commands
    for a field of a row the last one counts, earlier ones are superseded."""
    have = [f for f in edits.CORRECTABLE if f in rows.columns]
    shown = edits.effective(rows, corrections).select("row_id", "file_id", "current", F.lit(True).alias("__there"))
    joined = commands.join(shown, "row_id", "left").withColumn("region_id", F.struct("seq", "row_id", "field"))
    read = region_text(joined, words)
    selected = F.nullif(F.trim(F.regexp_replace(F.coalesce("selected_text", F.lit("")), r"\s+", " ")), F.lit(""))
    said = F.coalesce(selected, F.when(F.col("apply"), F.col("read_text")))
    current = F.lit(None).cast("string")
    for f in have:
        current = F.when(F.col("field") == f, edits.text_of(f, F.col("current")[f])).otherwise(current)
    last = F.max("seq").over(Window.partitionBy("row_id", "field"))
    told = read.withColumns({"read_text": said, "old_value": current, "new_value": value_of(F.col("field"), said), "__last": last})
    outcome = (
        F.when(F.col("__there").isNull() | ~F.col("field").isin(have), "ignored").when(F.col("seq") < F.col("__last"), "superseded").when(~F.col("apply"), "saved").when(F.col("read_text").isNull(), "no text").when(F.col("new_value").isNull(), "no value of this field")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("applied")
    )
    return told.select(*commands.columns, "read_text", "old_value", F.when(F.col("apply"), F.col("new_value")).alias("new_value"), outcome.alias("outcome"))


def audit(done: DataFrame) -> DataFrame:
    """The audit rows of the applied commands of `remapped`."""
    return done.where("outcome = 'applied'").select("row_id", F.col("field").alias("field_name"), "old_value", "new_value", F.lit("remap").alias("action"))


def saved_hints(hints: DataFrame, rows: DataFrame, done: DataFrame, suppliers: DataFrame) -> DataFrame:
    """hints after the commands of `remapped`, whether their text could be read or not: a hint of the same supplier, field and page
    takes the new place and becomes active; others are added with ids after the last. Of several commands for one hint
    the last counts. hints: id, tenant, company, field_name, page_no, supplier_id, supplier_name_snapshot, x, y, w, h, active;
    suppliers: id, tenant, company, supplier_name."""
    ids = suppliers.groupBy("tenant", "company", "supplier_name").agg(F.min("id").alias("__supplier"))
    own = rows.select("row_id", "tenant", "company", "supplier_name").join(ids, ["tenant", "company", "supplier_name"], "left").withColumnRenamed("supplier_name", "supplier_name_snapshot")
    asked = done.where("outcome <> 'ignored'").select("seq", "row_id", F.col("field").alias("field_name"), "page_no", *PLACE).join(own, "row_id")
    newest = asked.groupBy(*HINT).agg(F.max_by(F.struct("company", "__supplier", *PLACE), "seq").alias("n"))
    held = hints.groupBy(*HINT).agg(F.min("id").alias("__id"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in HINT]
    met = newest.alias("a").join(held.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in HINT], "n", "__id")
    changed = met.where("__id is not null").select(F.col("__id").alias("id"), "n")
    moved = lambda c: F.when(F.col("n").isNotNull(), F.col("n")[c]).otherwise(F.col(c)).alias(c)
    kept = hints.join(changed, "id", "left").select(*[moved(c) if c in PLACE else (F.coalesce("n.__supplier", c).alias(c) if c == "supplier_id" else (F.col("active") | F.col("n").isNotNull()).alias(c) if c == "active" else F.col(c)) for c in hints.columns])
    last = hints.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    added = met.where("__id is null").join(F.broadcast(last), F.lit(True))
    made = {"id": F.col("__last") + 1 + F.monotonically_increasing_id(), "company": F.col("n.company"), "supplier_id": F.col("n.__supplier"), "active": F.lit(True)} | {c: F.col("n")[c] for c in PLACE}
    kinds = dict(hints.dtypes)
    return kept.unionByName(added.select(*[(made[c].cast(kinds[c]) if c in made else F.col(c)).alias(c) for c in hints.columns]))


def wanted_rules(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rules, as `rules.saved` takes them, by which later invoices of the same supplier read the region again."""
    kept = done.where("outcome in ('applied', 'unchanged')").select("row_id", F.col("field").alias("field_name"), F.col("read_text").alias("target_value"))
    own = rows.select("row_id", "tenant", "company", text.supplier_key(F.col("supplier_name")).alias("source_pattern"))
    made = kept.join(own, "row_id").where("source_pattern <> ''")
    return made.select("tenant", "company", F.lit("remap_field_value").alias("rule_type"), "field_name", "source_pattern", "target_value", F.col("row_id").alias("origin_row_id"))

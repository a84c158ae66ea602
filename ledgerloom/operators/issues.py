"""Issues that people open and that admins work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import listing

#: What an admin may change, and the shortest and longest title and the shortest description.
CHANGED = ("status", "resolution_notes", "priority")
TITLE, DESCRIPTION = (3, 255), 5


def opened(issues: DataFrame, asked: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(issues, outcomes) after asked (seq, tenant, title, description, priority): each whose title and description are long enough
    is added as pending, with normal priority where none is named, under ids after the last in the order of seq. issues: id,
    tenant, title, description, status, priority, resolution_notes, updated_at; at: the time as text. outcomes: seq, outcome."""
    fine = F.length("title").between(*TITLE) & (F.length("description") >= DESCRIPTION)
    told = asked.select("seq", F.when(F.coalesce(fine, F.lit(False)), "opened").otherwise("rejected: title or description").alias("outcome"))
    last = issues.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))  # one row
    fresh = listing.numbered(asked.where(fine), [("seq", "asc")], 1).join(F.broadcast(last), F.lit(True))
    new = {"id": F.col("__last") + 1 + F.col("page"), "status": F.lit("pending"), "priority": F.coalesce("priority", F.lit("normal")), "resolution_notes": F.lit(None), "updated_at": F.lit(at)}
    return issues.unionByName(fresh.select(*[(new[c] if c in new else F.col(c)).cast(t).alias(c) for c, t in issues.dtypes])), told


def updated(issues: DataFrame, changes: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(issues, outcomes) after changes (seq, id, field, value): of several to one field the last counts, null empties it, and
    fields that no change names stay. outcomes: seq, outcome (done, not found, or ignored: no field that may be changed)."""
    there = issues.select("id", F.lit(True).alias("__there"))
    told = changes.join(there, "id", "left").select("seq", F.when(F.col("__there").isNull(), "not found").when(F.col("field").isin(*CHANGED), "done").otherwise("ignored").alias("outcome"))
    newest = changes.where(F.col("field").isin(*CHANGED)).groupBy("id").agg(*[F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"__{f}") for f in CHANGED], F.lit(True).alias("__hit"))
    kinds = dict(issues.dtypes)
    value = {f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}")["value"].cast(kinds[f])).otherwise(F.col(f)).alias(f) for f in CHANGED}
    value["updated_at"] = F.when(F.col("__hit"), F.lit(at).cast(kinds["updated_at"])).otherwise(F.col("updated_at")).alias("updated_at")
    return issues.join(newest, "id", "left").select(*[value.get(c, F.col(c)) for c in issues.columns]), told

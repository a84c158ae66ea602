"""Master data from CSV files: headers in any usual wording, upserted through `operators.state.upsert`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the columns of an import may be called.
SUPPLIER = {
    "supplier account code": ["supplier code", "account code", "supplier account", "supplier account number", "account number", "supplier posting account", "posting account", "customer code"],
    "supplier name": ["name", "supplier", "vendor", "vendor name", "supplier description"],
    "default nominal": ["nominal", "nominal code", "default nominal code", "default account", "default gl", "gl code"],
}


def header_key(name: str) -> str:
    """Lower case, with blanks for underscores, hyphens and slashes, and no byte-order mark."""
    return re.sub(r"\s+", " ", re.sub(r"[_/-]", " ", name.lstrip("﻿"))).strip().lower()


def column_map(header: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """For each canonical name the first header column that has it or one of its aliases."""
    found: dict[str, str] = {}
    for name in header:
        canonical = next((c for c, others in aliases.items() if c not in found and header_key(name) in (c, *others)), None)
        if canonical:
            found[canonical] = name
    return found


def read_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """The canonical columns of a CSV file or folder of them, trimmed, with '' for what is missing, and `ord`, which rises
    from row to row. Headers must be the same in all files; names that no alias knows are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    named = column_map(raw.columns, aliases)
    value = lambda c: F.coalesce(F.trim(F.col(f"`{named[c]}`")), F.lit("")) if c in named else F.lit("")
    return raw.select(*[value(c).alias(c.replace(" ", "_")) for c in aliases], F.monotonically_increasing_id().alias("ord"))

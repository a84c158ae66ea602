"""Reference data that people keep in YAML files: the list of known suppliers, and the taxonomy of goods.

A file is read by Spark, so that it may lie wherever Spark reads, parsed once for each version of its text, and becomes a
table. Such files are written by hand; a missing one is an empty list.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SUPPLIER = "ord long, canonical string, vat_number string, aliases array<string>, date_locale string, nominal_hint string, product_families array<string>"
ALIAS = "ord long, alias string, label string, category string, brand string, product_family string, subcategory string"


@lru_cache(16)
def _parsed(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def _read(spark: SparkSession, path: str) -> dict:
    try:
        found = spark.read.text(path, wholetext=True).collect()  # one small file
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    return _parsed("\n".join(r[0] for r in found))


def _texts(values: object) -> list[str]:
    return [str(x) for x in values or []]


def suppliers(spark: SparkSession, path: str) -> DataFrame:
    """The known suppliers in the order of the file, as `accounts.normalised_suppliers` and `accounts.suggest` take them. Entries
    without a canonical name are left out; dates are day first unless an entry says otherwise."""
    listed = [x for x in _read(spark, path).get("suppliers") or [] if x.get("canonical")]
    rows = [(k, str(x["canonical"]), str(x.get("vat_number") or ""), _texts(x.get("aliases")), x.get("date_locale") or "dmy", x.get("nominal_hint") or "", _texts(x.get("product_families"))) for k, x in enumerate(listed)]
    return spark.createDataFrame(rows, SUPPLIER)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The aliases of the taxonomy in the order in which they count: categories and entries as in the file, and of an entry the
    longer aliases first. label is the category's nominal hint, or its name; the table is what `patterns.labelled` takes."""
    rows = []
    for category, held in (_read(spark, path).get("categories") or {}).items():
        for entry in held.get("entries") or []:
            for alias in sorted(_texts(entry.get("aliases")), key=len, reverse=True):
                rows.append((len(rows), alias, held.get("nominal_hint", category), category, entry.get("brand"), entry.get("product_family"), entry.get("subcategory")))
    return spark.createDataFrame(rows, ALIAS)

"""Money functions. Amounts are exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import bound

MONEY = "decimal(14,2)"


def parse_amount(text: Column) -> Column:
    """An amount as written in print: currency signs and blanks go; 1.234,56 and 12,50 have a decimal comma; else commas
    group. Null where no number is left."""

    def read(raw: Column) -> Column:
        comma = F.when(raw.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]{2}$"), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        plain = comma.when(raw.rlike(r"^[0-9]+,[0-9]{2}$"), F.replace(raw, F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
        return plain.try_cast(MONEY)

    return bound(F.regexp_replace(text, "€|£|EUR|GBP|USD|\\$| ", ""), read)


"""Dates as written on invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this two-digit year on, the century is the last one.
PIVOT = 70
#: Month names, whole or by their first three letters.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
NAMES = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)


def _year(digits: Column) -> Column:
    """A year of two digits or of four, as text."""
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 2, F.when(n < PIVOT, n + 2000).otherwise(n + 1900)).otherwise(n).cast("string")


def parse_date(raw: Column, month_first: bool | Column = False) -> Column:
    """struct(normalized, strategy, ambiguous, dmy, mdy) of an ISO date, a day, month's name and year, or a numeric date.
    Numeric dates put the day first unless month_first; where both readings are dates and differ, the date is ambiguous."""
    text = F.trim(raw)
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
    shape = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})$"
    part = lambda k: F.regexp_extract(text, shape, k)
    of = lambda day, month: F.when(text.rlike(shape), F.try_to_date(F.concat_ws("-", _year(part(3)), month, day), "yyyy-M-d"))
    written = rf"(?i)^([0-9]{{1,2}})[\s./-]+({NAMES})[\s./-]+([0-9]{{4}}|[0-9]{{2}})$"
    word = lambda k: F.regexp_extract(text, written, k)
    month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.lower(F.substring(word(2), 1, 3))).cast("string")
    named = F.when(text.rlike(written), F.try_to_date(F.concat_ws("-", _year(word(3)), month, word(1)), "yyyy-M-d"))
    dmy, mdy = of(part(1), part(2)), of(part(2), part(1))
    first = F.lit(month_first) if isinstance(month_first, bool) else month_first
    numeric = F.when(first, F.coalesce(mdy, dmy)).otherwise(F.coalesce(dmy, mdy))
    strategy = F.when(iso.isNotNull(), "iso").when(named.isNotNull(), "text_month").when(numeric.isNull(), "none").when(F.when(first, mdy).otherwise(dmy).isNotNull(), F.when(first, "numeric_mdy").otherwise("numeric_dmy")).otherwise(F.when(first, "numeric_dmy").otherwise("numeric_mdy"))
    ambiguous = iso.isNull() & dmy.isNotNull() & mdy.isNotNull() & (dmy != mdy)
    return F.struct(F.coalesce(iso, named, numeric).alias("normalized"), strategy.alias("strategy"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"), dmy.alias("dmy"), mdy.alias("mdy"))


#: The ways in which a date may be written, tried in this order: what the text must look like, and its format.
WRITTEN = [
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"), (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "d/M/yy"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$", "d-M-yy"), (r"^[0-9]{1,2} +[A-Za-z]+ +[0-9]{4}$", "d MMM yyyy"), (r"^[A-Za-z]+ +[0-9]{1,2},? +[0-9]{4}$", "MMM d yyyy"),
]


def read_date(raw: Column) -> Column:
    """The date that a text is in one of twelve forms: days before months in numbers, months by name or its first three
    letters on either side of the day. Null where it is none. Years of two digits from 69 on are of the last century."""
    text = F.trim(raw)
    known = text.rlike(rf"(?i)^([0-9]{{1,2}} +({NAMES}) +[0-9]{{4}}|({NAMES}) +[0-9]{{1,2}},? +[0-9]{{4}})$")
    short = F.initcap(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "([A-Za-z]{3})[A-Za-z]*", "$1"), ",", ""), " +", " "))
    found = []
    for shape, form in WRITTEN:
        if "MMM" in form:
            found.append(F.try_to_date(F.when(known & text.rlike(shape), short), form))
        elif form.endswith("/yy") or form.endswith("-yy"):
            year = F.regexp_extract(text, "([0-9]{2})$", 1).try_cast("int")
            full = F.concat(F.regexp_extract(text, "^(.*)[0-9]{2}$", 1), F.when(year >= 69, year + 1900).otherwise(year + 2000).cast("string"))
            found.append(F.try_to_date(F.when(text.rlike(shape), full), form + "yy"))
        else:
            found.append(F.try_to_date(F.when(text.rlike(shape), text), form))
    return F.coalesce(*found)


def format_date(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "dd/MM/yyyy"), F.lit(""))

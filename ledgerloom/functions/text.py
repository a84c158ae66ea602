"""Text functions: columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say what kind of company a supplier is, and words too common to tell suppliers apart.
LEGAL = "ltd|limited|plc|llc|inc|corp|co|group|trading|holdings|services|solutions"
COMMON = ["the", "and", "of", "for", "in", "a", "an", "de", "la", "le", "el"]


def clean_text(text: Column) -> Column:
    """NULs to spaces, runs of blanks to one, three line ends or more to two, trimmed."""
    blanks = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(blanks, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def meaningful_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def supplier_key(name: Column) -> Column:
    """A supplier's name for loose comparison: lower case without company words and punctuation."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b({LEGAL})\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " "))


def key_words(name: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(supplier_key(name), " "), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, COMMON)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words of two word arrays, as a share of the longer one; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def first_words(text: Column, n: int = 20) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def keywords(text: Column, stop: list[str] | None = None) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def currency(text: Column) -> Column:
    """The first currency that a text names, pounds before euros before dollars."""
    low = F.lower(text)
    named = lambda sign, code: F.contains(text, F.lit(sign)) | F.contains(low, F.lit(code))
    return F.when(named("£", "gbp"), "GBP").when(named("€", "eur"), "EUR").when(named("$", "usd"), "USD")


def vat_key(vat: Column) -> Column:
    return F.upper(F.regexp_replace(vat, r"\s", ""))


def split_fields(fields: Column) -> Column:
    """Field names joined by pipes, or by commas where there is no pipe."""
    parts = F.when(F.contains(fields, F.lit("|")), F.split(fields, r"\|")).otherwise(F.split(fields, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


#: What reading a page puts into names, and words that do not tell suppliers apart.
NOISE = r"(?U)[|\\#@~`^]|(?<!\w)[0-9]{1,2}(?!\w)"
SUFFIXES = "ltd|limited|plc|llc|llp|inc|co|company|group|holdings|malta|mt|gmbh|sarl|bv|nv|ag|spa|srl"
FILLERS = ["the", "a", "of", "and", "&", "for"]


def clean_supplier(name: Column) -> Column:
    """A name as read, without line ends, stray signs, lone numbers of one or two digits, and signs at its ends."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[\n\r]", " "), NOISE, " ")
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), r"(?U)^[\W_]+", ""), r"(?U)[\W_]+$", "")


def core_words(name: Column) -> Column:
    """The distinct words of a name, of three letters or more, without company forms and fillers."""
    words = F.split(F.regexp_replace(F.lower(name), rf"(?U)\b({SUFFIXES})\b", ""), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(FILLERS)))


def file_name(name: Column) -> Column:
    """A name that a file may bear."""
    return F.regexp_replace(name, r"(?U)[^\w\-. ]", "_")


def cell(value: Column, kind: str) -> Column:
    """A value as a sheet shows it: Yes and No, numbers as doubles, else text."""
    if kind == "boolean":
        return F.when(value, "Yes").when(~value, "No")
    return value.cast("double") if kind.startswith("decimal") else value.cast("string")


def json_block(text: Column) -> Column:
    """What lies between the first opening and the last closing brace of a text; the text itself where there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(text)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)

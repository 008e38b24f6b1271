"""Check keys and small text functions, as columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return (F.length(digits) >= 2) & F.call_function("luhn_check", digits)


def iban_valid(value: Column) -> Column:
    """Modulus 97 over the rearranged number, letters counting from 10; only ASCII spaces are dropped."""
    s = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + (code - 48)).otherwise(rest * 100 + (code - 55)) % 97

    return s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\z") & (F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1)


@lru_cache(maxsize=1)
def country_codes() -> tuple[str, ...]:
    """ISO 3166-1 alpha-2 codes, as the platform knows them."""
    spark = SparkSession.active()
    return tuple(sorted(spark._jvm.java.util.Locale.getISOCountries()))


def bic_plausible(value: Column) -> Column:
    s = F.upper(F.trim(value))
    return s.rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\z") & F.substring(s, 5, 2).isin(*country_codes())


def nir_valid(value: Column) -> Column:
    """The last two digits are 97 less the remainder of the others; 2A counts as 19 and 2B as 18. Months 13 to 19 don't exist."""
    s = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    body = F.replace(F.replace(F.substring(s, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    shape = s.rlike(r"^[12][0-9]{2}(?:0[1-9]|1[0-2]|[02-9][0-9])(?:[0-9]{2}|2[AB])[0-9]{8}\z")
    return shape & (97 - body.try_cast("bigint") % 97 == F.substring(s, 14, 2).try_cast("bigint"))


def postal_code_plausible(value: Column) -> Column:
    return value.rlike(r"^[0-9]{5}\z") & F.substring(value, 1, 2).try_cast("int").between(1, 98)


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents up to U+024F, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.category(chr(c)) == "Ll"]
    pairs = [(x, y) for x, y in pairs if y.isascii()]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def normalize(value: Column) -> Column:
    """Lower case without accents, runs of white space as one space, trimmed."""
    bare = F.regexp_replace(F.translate(F.lower(value), *_accents()), r"\p{M}+", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def looks_structured(value: Column) -> Column:
    """No letter at all; empty counts."""
    return ~F.coalesce(value, F.lit("")).rlike(r"\p{L}")


def propagatable(value: Column) -> Column:
    """Not empty, not all digits, not a single word of under three characters, once normalised."""
    n = normalize(value)
    return (F.length(n) > 0) & ~n.rlike(r"^[0-9 ]+\z") & (n.contains(" ") | (F.length(n) >= 3))


def column_label(header: Column, index: Column) -> Column:
    """header[index], or col<index> where it is missing."""
    return F.coalesce(F.get(header, index), F.concat(F.lit("col"), index.cast("string")))


def output_name(path: Column, at: Column) -> Column:
    """<stem>_ano_<yyyyMMddHHmmss><suffix>; the suffix starts at the last dot of the file name."""
    stem, suffix = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("_ano_"), F.date_format(at, "yyyyMMddHHmmss"), suffix)


def grouped_digits(n: Column) -> Column:
    """A whole number with a space before each three digits."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def page_rect(x0: Column, y0: Column, x1: Column, y1: Column, zoom: Column) -> Column:
    """A drawn rectangle in page points with its corners in order; null if under one point wide or high."""
    left, right, top, low = F.least(x0, x1) / zoom, F.greatest(x0, x1) / zoom, F.least(y0, y1) / zoom, F.greatest(y0, y1) / zoom
    return F.when((right - left >= 1) & (low - top >= 1), F.struct(left.alias("x0"), top.alias("y0"), right.alias("x1"), low.alias("y1")))

"""Text cleaning and header-label functions, all as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month words and the month they stand for (Finnish, Estonian-style, English,
# Swedish, German spellings, as the layouts in the wild use them).
MONTH_WORDS = {
    "tammikuu": "jan",
    "helmikuu": "feb",
    "maaliskuu": "mar",
    "huhtikuu": "apr",
    "toukokuu": "may",
    "kesäkuu": "jun",
    "heinäkuu": "jul",
    "elokuu": "aug",
    "syyskuu": "sep",
    "lokakuu": "oct",
    "marraskuu": "nov",
    "joulukuu": "dec",
    "januaari": "jan",
    "january": "jan",
    "february": "feb",
    "march": "mar",
    "april": "apr",
    "may": "may",
    "june": "jun",
    "july": "jul",
    "august": "aug",
    "september": "sep",
    "october": "oct",
    "november": "nov",
    "december": "dec",
    "januari": "jan",
    "februari": "feb",
    "mars": "mar",
    "maj": "may",
    "juni": "jun",
    "juli": "jul",
    "augusti": "aug",
    "oktober": "oct",
    "maerz": "mar",
    "märz": "mar",
    "mai": "may",
    "dezember": "dec",
}

# English month abbreviations in calendar order (the fallback test is "contains").
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


# Whitespace as Python's str.strip/isspace defines it (rule: every code point with isspace()).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip whitespace at both ends (character set, no regex); null stays null."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def strip_thousands(c: Column | str) -> Column:
    """Remove commas and every whitespace character (thousands separators)."""
    return F.translate(_col(c), "," + WHITESPACE, "")


def snake_case(c: Column | str) -> Column:
    """Non-alphanumerics to ``_``, runs squeezed, ends stripped, lower case."""
    x = F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "_")
    x = F.regexp_replace(x, "_{2,}", "_")
    return F.lower(F.regexp_replace(x, "^_+|_+$", ""))


def header_norm(c: Column | str) -> Column:
    """Header normal form: lower case, non ``[a-z0-9]`` runs to one blank, trimmed."""
    x = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(x)


def _month_map() -> Column:
    pairs = []
    for word, month in MONTH_WORDS.items():
        pairs += [F.lit(word), F.lit(month)]
    return F.create_map(*pairs)


def month_token(c: Column | str) -> Column:
    """``jan``..``dec`` for a month word, else the first abbreviation the token contains."""
    low = F.lower(_col(c))
    fallback = None
    for abbr in MONTH_ABBREVIATIONS:
        cond = low.contains(abbr)
        fallback = F.when(cond, F.lit(abbr)) if fallback is None else fallback.when(cond, F.lit(abbr))
    return F.coalesce(F.try_element_at(_month_map(), low), fallback)


def year_month_label(c: Column | str) -> Column:
    """``YYYY-mon`` when the label holds a 4-digit token and a month token, else the label."""
    label = _col(c).cast("string")
    found = F.filter(F.split(F.translate(label, "/-", "  "), r"\s+"), lambda p: p != "")

    def read(parts):  # the parts are bound once; those of digits alone hold no month
        year = F.try_element_at(F.filter(parts, lambda p: p.rlike("^[0-9]{4}$")), F.lit(1))
        words = F.filter(parts, lambda p: ~p.rlike("^[0-9]+$"))
        month = F.try_element_at(F.filter(F.transform(words, month_token), lambda m: m.isNotNull()), F.lit(1))
        return F.concat(year, F.lit("-"), month)

    return F.coalesce(F.transform(F.array(found), read)[0], label)

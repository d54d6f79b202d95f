"""String column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what accent stripping makes of them.
ACCENTED = "éóèñüçäöêíáúàâîôûëïÉÓÈÑÜÇÄÖÊÍÁÚÀÂÎÔÛËÏ"
PLAIN = "eoenucaoeiauaaiouei" + "EOENUCAOEIAUAAIOUEI"


def title_case(x: Column) -> Column:
    """Each run of letters with its first in upper case, also after hyphens."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))), "")


def squeezed(x: Column) -> Column:
    """White space runs become one space; ends are trimmed; lower case; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))


def folded(x: Column) -> Column:
    return F.lower(F.translate(x, ACCENTED, PLAIN))


def word_tokens(x: Column) -> Column:
    """Accent-folded lower-case tokens of two or more letters, digits or underscores."""
    return F.regexp_extract_all(folded(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9_]{2,})"), F.lit(1))


def parse_languages(x: Column) -> Column:
    """'Greek/English (dialect)' to the set [greek, english]; null to an empty set."""
    parts = F.split(F.substring_index(F.coalesce(x, F.lit("")), "(", 1), "/")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: p != ""))


def lookup(mapping: dict[str, str], x: Column, default: Column) -> Column:
    """The mapped value of x where there is one, else default."""
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, x), default)

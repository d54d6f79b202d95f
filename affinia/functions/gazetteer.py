"""A gazetteer of countries: names and aliases, display names, and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinia.functions.text import lookup

# Key, display name, further names, and the two-letter code of the flag.
COUNTRIES = {
    "albania": ("Albania", [], "AL"),
    "andorra": ("Andorra", [], "AD"),
    "armenia": ("Armenia", [], "AM"),
    "australia": ("Australia", [], "AU"),
    "austria": ("Austria", [], "AT"),
    "azerbaijan": ("Azerbaijan", [], "AZ"),
    "belarus": ("Belarus", [], "BY"),
    "belgium": ("Belgium", [], "BE"),
    "bosnia_herzegovina": ("Bosnia and Herzegovina", ["Bosnia & Herzegovina", "Bosnia"], "BA"),
    "bulgaria": ("Bulgaria", [], "BG"),
    "croatia": ("Croatia", [], "HR"),
    "cyprus": ("Cyprus", [], "CY"),
    "czech_republic": ("Czech Republic", ["Czechia"], "CZ"),
    "denmark": ("Denmark", [], "DK"),
    "estonia": ("Estonia", [], "EE"),
    "finland": ("Finland", [], "FI"),
    "france": ("France", [], "FR"),
    "georgia": ("Georgia", [], "GE"),
    "germany": ("Germany", [], "DE"),
    "greece": ("Greece", [], "GR"),
    "hungary": ("Hungary", [], "HU"),
    "iceland": ("Iceland", [], "IS"),
    "ireland": ("Ireland", [], "IE"),
    "israel": ("Israel", [], "IL"),
    "italy": ("Italy", [], "IT"),
    "latvia": ("Latvia", [], "LV"),
    "lithuania": ("Lithuania", [], "LT"),
    "luxembourg": ("Luxembourg", [], "LU"),
    "macedonia": ("North Macedonia", ["Macedonia", "FYR Macedonia"], "MK"),
    "malta": ("Malta", [], "MT"),
    "moldova": ("Moldova", [], "MD"),
    "monaco": ("Monaco", [], "MC"),
    "montenegro": ("Montenegro", [], "ME"),
    "morocco": ("Morocco", [], "MA"),
    "netherlands": ("Netherlands", ["The Netherlands"], "NL"),
    "norway": ("Norway", [], "NO"),
    "poland": ("Poland", [], "PL"),
    "portugal": ("Portugal", [], "PT"),
    "romania": ("Romania", [], "RO"),
    "russia": ("Russia", [], "RU"),
    "san_marino": ("San Marino", [], "SM"),
    "serbia": ("Serbia", [], "RS"),
    "slovakia": ("Slovakia", [], "SK"),
    "slovenia": ("Slovenia", [], "SI"),
    "spain": ("Spain", [], "ES"),
    "sweden": ("Sweden", [], "SE"),
    "switzerland": ("Switzerland", [], "CH"),
    "turkey": ("Turkey", [], "TR"),
    "ukraine": ("Ukraine", [], "UA"),
    "united_kingdom": ("United Kingdom", ["UK"], "GB"),
}

#: Name in any case to key, flag code to key, and key to display name.
NAME_KEYS = {name.lower(): key for key, (shown, more, _) in COUNTRIES.items() for name in (shown, *more)}
FLAG_KEYS = {code: key for key, (_, _, code) in COUNTRIES.items()}
DISPLAY = {key: shown for key, (shown, _, _) in COUNTRIES.items()}


def display_name(x: Column) -> Column:
    """The display name of a country in any of its spellings; other names as they are."""
    return lookup({name: DISPLAY[key] for name, key in NAME_KEYS.items()}, F.lower(F.trim(x)), x)

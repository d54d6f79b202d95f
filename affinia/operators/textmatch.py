"""Resolution of names in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell no artist apart.
STOPWORDS = ["the", "dj", "and", "feat", "feat.", "de", "van", "el", "of", "for"]


def gazetteer_pattern(names: list[str]) -> str:
    """One pattern of all names, the longest first, not inside a longer word of any script."""
    escaped = [re.sub(r"([^A-Za-z0-9 ])", r"\\\1", n) for n in sorted(set(names), key=lambda x: (-len(x), x))]
    return r"(?<![\p{L}\p{N}_])(" + "|".join(escaped).lower() + r")(?![\p{L}\p{N}_])"


def flag_codes(x: Column) -> Column:
    """Two-letter codes of the flag signs in a text."""
    pairs = F.regexp_extract_all(x, F.lit(r"([\x{1F1E6}-\x{1F1FF}]{2})"), F.lit(1))
    letter = lambda f, k: F.char(F.conv(F.hex(F.encode(F.substring(f, k, 1), "UTF-32")), 16, 10).cast("long") - 0x1F1E6 + 65)
    return F.transform(pairs, lambda f: F.concat(letter(f, 1), letter(f, 2)))


def names_in(x: Column, aliases: dict[str, str], flags: dict[str, str] | None = None) -> Column:
    """Sorted distinct keys of the gazetteer names (and flags) in a text. aliases: name to key."""
    known = {k.lower(): v for k, v in aliases.items()}
    table = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(gazetteer_pattern(list(known))), F.lit(1))
    keys = F.transform(found, lambda n: F.try_element_at(table, n))
    if flags:
        codes = F.create_map(*[F.lit(v) for kv in flags.items() for v in kv])
        keys = F.concat(keys, F.filter(F.transform(flag_codes(F.coalesce(x, F.lit(""))), lambda c: F.try_element_at(codes, c)), lambda k: k.isNotNull()))
    return F.array_sort(F.array_distinct(keys))


def artist_index(entries: DataFrame) -> DataFrame:
    """(year, full_name, tokens, country) of entries (year, artist, country)."""
    full = F.trim(F.regexp_replace("artist", r"\s*\(\d+\)\s*$", ""))
    tokens = F.filter(F.split(full, r"[\s'’\-]+"), lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOPWORDS))
    return entries.select("year", full.alias("full_name"), F.transform(tokens, F.lower).alias("tokens"), "country")


def artist_matches(posts: DataFrame, index: DataFrame) -> DataFrame:
    """(slug, artist_names): countries by full artist name in the title, else by a token that only one
    country has that year. posts: slug, year, title. An equi-join on the year, then the text condition; small
    indexes are broadcast by their statistics."""
    title = F.lower("title")
    full = posts.join(index, "year").filter((F.col("full_name") != "") & title.contains(F.lower("full_name")))
    full = full.groupBy("slug").agg(F.array_sort(F.collect_set("country")).alias("full"))
    tokens = index.select("year", "country", F.explode("tokens").alias("token")).groupBy("year", "token")
    tokens = tokens.agg(F.count_distinct("country").alias("k"), F.min("country").alias("country")).filter("k = 1")
    words = posts.select("slug", "year", F.explode(F.array_distinct(F.split(title, r"[^\p{L}\p{N}_]+"))).alias("token"))
    part = words.join(tokens, ["year", "token"]).groupBy("slug").agg(F.array_sort(F.collect_set("country")).alias("part"))
    return full.join(part, "slug", "full").select("slug", F.coalesce("full", "part").alias("artist_names"))


def resolve(posts: DataFrame, index: DataFrame, aliases: dict[str, str], flags: dict[str, str] | None = None, opening: int = 800) -> DataFrame:
    """(slug, country, source): each post by its title's names, else its artists, else its opening's names;
    a row for each country found, one null row where none is. posts: slug, year, title, text."""
    own = posts.withColumn("t1", names_in(F.col("title"), aliases, flags)).withColumn("t3", names_in(F.substring("text", 1, opening), aliases, flags))
    own = own.join(artist_matches(posts, index), "slug", "left")
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    source = F.when(some("t1"), "title_country").when(some("artist_names"), "title_artist").when(some("t3"), "text_fallback").otherwise("none")
    names = F.when(some("t1"), F.col("t1")).when(some("artist_names"), F.col("artist_names")).when(some("t3"), F.col("t3"))
    return own.select("slug", F.explode_outer(names).alias("country"), source.alias("source"))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """(posts, rows, unmatched, multi): counts of a resolution."""
    per = resolved.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("country").isNull().cast("int")).alias("none"))
    return per.agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("rows"), F.sum("none").cast("long").alias("unmatched"), F.count_if(F.col("n") > 1).alias("multi"))

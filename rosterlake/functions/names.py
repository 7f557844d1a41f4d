"""Keys of names, clubs and tournaments, and deterministic ids, as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake import vocab


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


_ASCII = r"[^\x00-\x7f]"


def squeezed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def unaccented(c: Column) -> Column:
    """Without accents; only names with other than ASCII letters leave the JVM."""
    return F.when(c.rlike(_ASCII), _decomposed(c)).otherwise(c)


def folded(c: Column) -> Column:
    """Without accents and without case."""
    return F.when(c.rlike(_ASCII), _folded(c)).otherwise(F.lower(c))


def norm_name(c: Column) -> Column:
    """Accents, dots and apostrophes dropped, white space squeezed, lower case. Null stays null."""
    return squeezed(F.regexp_replace(unaccented(c), r"[.’']", ""))


def canonical_club(full: Column, display: Column) -> Column:
    """A club's name without a trailing number in brackets, aliases replaced; ``?`` where both names are missing."""
    given = F.coalesce(F.when(full != "", full), F.when(display != "", display), F.lit("?"))
    name = F.trim(F.regexp_replace(F.regexp_replace(given, r"\s*\(\d+\)\s*$", ""), r"\s+", " "))
    out = name
    for alias, shown in vocab.CLUB_ALIASES.items():
        out = F.when(F.lower(name) == alias, F.lit(shown)).otherwise(out)
    return out


def norm_club(full: Column, display: Column) -> Column:
    """Lower-case form of the club's name."""
    return F.lower(canonical_club(full, display))


def club_key(full: Column, display: Column, division: Column) -> Column:
    suffix = F.lit("")
    for d, s in vocab.CLUB_SUFFIX.items():
        suffix = F.when(division == d, F.lit(s)).otherwise(suffix)
    return F.concat(norm_club(full, display), suffix)


def team_name_key(c: Column) -> Column:
    """Letters and digits of a team's name without accents, other characters as single spaces; null as empty."""
    return F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def compact_name_key(c: Column) -> Column:
    """All letters and digits without accents and case."""
    return F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def exact_name_key(c: Column) -> Column:
    """Compatibility forms composed, white space squeezed, no case; accents stay."""
    plain = F.when(c.rlike(_ASCII), _composed(c)).otherwise(F.lower(c))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def folded_name_key(c: Column) -> Column:
    """As ``norm_name``, with full case folding."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(c), r"[.’']", ""), r"\s+", " "))


def norm_team(c: Column) -> Column:
    """ASCII letters and digits alone, a trailing remark in brackets dropped."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*\([^)]*\)\s*$", "")), r"[^a-z0-9]+", "")


def first_name(c: Column) -> Column:
    return F.get(F.split(norm_name(c), " "), 0)


def division_gender(division: Column) -> Column:
    """m or w, null for mixed and unknown divisions."""
    return F.when(division.isin(vocab.MEN), "m").when(division.isin(vocab.WOMEN), "w")


def pronoun_gender(c: Column) -> Column:
    """m or w if exactly one of H and S is among the initials joined by slashes, else null."""
    tokens = F.transform(F.split(F.upper(c), "/"), lambda t: F.trim(t))
    he, she = F.array_contains(tokens, "H"), F.array_contains(tokens, "S")
    return F.when(he & ~she, "m").when(she & ~he, "w")


def city_token(c: Column) -> Column:
    """The part of a place before the first comma, lower case."""
    return F.lower(F.trim(F.get(F.split(F.coalesce(c, F.lit("")), ","), 0)))


def jersey(c: Column) -> Column:
    """A jersey number without leading zeros; only zeros are '0', nothing is null."""
    plain = F.regexp_replace(F.trim(c), "^0+", "")
    return F.when(F.coalesce(c, F.lit("")) != "", F.when(plain == "", "0").otherwise(plain))


def stable_id(namespace: str, key: Column) -> Column:
    """A negative id from the first 13 hex digits of the SHA-256 of namespace, NUL and key."""
    digest = F.sha2(F.concat(F.lit(namespace + "\0"), key), 256)
    return -F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def stable_key(*parts: Column) -> Column:
    """24 hex digits of the SHA-256 of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24)


def team_key(event: Column, team: Column) -> Column:
    """Key of a team at an event from both ids of a provider: 32 hex digits of a SHA-1."""
    return F.concat(F.lit("gq:"), F.substring(F.sha1(F.concat(event, F.lit("\0"), team)), 1, 32))


def series_key(name: Column, editions: int = 4) -> Column:
    """The series a tournament belongs to: its name without year, division, sponsor and edition.

    Up to ``editions`` edition marks at the end are taken off. A name that
    nothing is left of stays as it is, in lower case.
    """
    c = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    for pattern in vocab.SERIES_NOISE:
        c = F.regexp_replace(c, "(?iU)" + pattern, " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s]+", " ")
    c = F.regexp_replace(c, r"\bchampionships\b", "championship")
    c = F.regexp_replace(c, r"\binternational\b", " ")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    for _ in range(editions):
        c = F.trim(F.regexp_replace(c, "(?i)" + vocab.SERIES_EDITION, ""))
    return F.when(c == "", F.lower(F.trim(name))).otherwise(c)


def tier(name: Column) -> Column:
    """0 to 4 by the name; the highest tier that fits counts."""
    return F.coalesce(*[F.when(name.rlike("(?iU)" + pattern), n) for n, pattern in vocab.TIERS], F.lit(0))


def division_code(division: Column) -> Column:
    """The number of a division; unknown ones count as the first."""
    return F.coalesce(*[F.when(division == d, n) for d, n in vocab.DIVISION_CODES.items()], F.lit(0))


def state_of(place: Column) -> Column:
    """The two letters of a state at the end of a place, else empty."""
    return F.regexp_extract(F.coalesce(place, F.lit("")), r"(?:^|,\s*)([A-Z]{2})$", 1)


def region_of(division: Column, place: Column) -> Column:
    """Region of a venue on the map of its division, college or club."""

    def on(regions: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(state_of(place).isin(states.split()), region) for region, states in regions.items()], F.lit("Unknown region"))

    return F.when(division.startswith("college"), on(vocab.COLLEGE_REGIONS)).otherwise(on(vocab.CLUB_REGIONS))


def european_division(name: Column) -> Column:
    """euf- and the slug of a division's printed name."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(slug.isin("men", "mens"), "open").when(slug == "women-s", "women").when(slug == "", "unknown").otherwise(slug)
    return F.concat(F.lit("euf-"), slug)


def stage_division(stage: Column, divisions: dict[str, str]) -> Column:
    """The division whose printed name begins a stage's label, the longest of several; null for none."""
    known = sorted(divisions, key=len, reverse=True)
    return F.coalesce(*[F.when((stage == d) | stage.startswith(d + " "), divisions[d]) for d in known], F.lit(None).cast("string"))


def podium_place(text: Column) -> Column:
    """1 to 3 for medals, else the first number of a text, null without one."""
    out = F.regexp_extract(text, r"\d+", 0).try_cast("int")
    for medal, n in vocab.PODIUM.items():
        out = F.when(F.trim(text) == medal, n).otherwise(out)
    return out


def combined_hash(urls_and_hashes: Column) -> Column:
    """Order-free hash of collected strings."""
    return F.sha2(F.array_join(F.array_sort(urls_and_hashes), "\n"), 256)

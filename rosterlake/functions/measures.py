"""Times, heights, stage labels, scores and rating formulas as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake import vocab


def clock(c: Column) -> Column:
    """'1:05 PM' as '13:05'; anything else as '23:59'."""
    t = F.regexp_extract(F.trim(c), r"^(1[0-2]|0?[1-9]):([0-5]\d)\s+([AaPp])[Mm]$", 0)
    hour = F.regexp_extract(t, r"^(\d+)", 1).cast("int") % 12 + F.when(F.lower(t).endswith("pm"), 12).otherwise(0)
    return F.when(F.coalesce(t, F.lit("")) == "", "23:59").otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(t, r":(\d\d)", 1)))


def minutes_of_day(c: Column) -> Column:
    """Minutes since midnight of a time on a 12-hour clock, by its hour, minute and the p of a pm if there is one; 10000 where there is no time (F8).

    Nothing else is looked at: '1:05pm' and '8:15 P' are afternoon times, and
    '13:00' counts as '1:00'.
    """
    part = lambda k: F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])?", k)
    later = F.when(F.lower(part(3)) == "p", 12).otherwise(0)
    return F.coalesce((part(1).try_cast("int") % 12 + later) * 60 + part(2).try_cast("int"), F.lit(10000))


def slot_number(c: Column) -> Column:
    """All digits of a slot's label as one number, those of 'A1-B12' as 112; 1000000000 without any (F8)."""
    return F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("long"), F.lit(10**9))


def inches(c: Column) -> Column:
    """Feet and inches like 5'11\" in inches, null if malformed."""
    part = lambda k: F.regexp_extract(c, r"^\s*(\d)'\s*(\d{1,2})", k).try_cast("int")
    return part(1) * 12 + part(2)


def stat(c: Column) -> Column:
    """A recorded count; anything that is not an integer counts 0."""
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def restore_meridiem(c: Column) -> Column:
    """AM or PM added to a bare hour and minute: 8 to 11 are morning hours, all others afternoon; anything else as it is."""
    t = F.trim(c)
    hour = F.regexp_extract(t, r"^(\d+):\d", 1).try_cast("int")
    bare = hour.between(1, 12) & t.rlike(r"^\d+:\d{1,2}") & ~t.rlike("(?i)(am|pm)$")
    return F.when(bare, F.concat(t, F.when(hour.between(8, 11), F.lit(" AM")).otherwise(F.lit(" PM")))).when(t == "", c).otherwise(t)


def digits_or_null(c: Column) -> Column:
    """A score that is all digits; marks like W and L are null."""
    return F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("int"))


def stage_of(round_name: Column, pool: Column, bracket: Column, description: Column) -> Column:
    """The first label that is not empty: round, pool, bracket, description without its closing words."""
    closing = F.regexp_replace(F.trim(description), r"(?i)\s+Schedule\s*&\s*Scores$", "")
    return F.coalesce(*[F.when(c != "", c) for c in (round_name, pool, bracket, closing)])


def parse_dates(c: Column) -> tuple[Column, Column]:
    """First and second date of a text like 'Jul 13, 2024 - Jul 14, 2024'; missing and impossible ones are null."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]{2} \d{1,2}, \d{4})"), F.lit(1))
    one = lambda i: F.try_to_timestamp(F.get(found, i), F.lit("MMM d, yyyy")).cast("date")
    return one(0), one(1)


def game_state(home_score: Column, away_score: Column, forfeit: Column, placeholder: Column | None = None, is_played: Column | None = None, published: Column | None = None) -> Column:
    """The state of a game as one provider or another tells it.

    A provider of schedules knows ``placeholder`` teams: forfeit, placeholder,
    played, scheduled. A provider of results knows ``is_played`` and a
    ``published`` state: forfeit, has_outcome, incomplete or its own word. One
    that knows neither puts the score before the forfeit: played, forfeit,
    scheduled.
    """
    scored = home_score.isNotNull() & away_score.isNotNull()
    if placeholder is not None:
        return F.when(forfeit, "forfeit").when(placeholder, "placeholder").when(scored, "played").otherwise("scheduled")
    if is_played is not None:
        word = F.coalesce(F.when(published != "", published) if published is not None else F.lit(None), F.lit("scheduled"))
        own = F.when(word == "has_outcome", "incomplete").otherwise(word)
        return F.when(forfeit, "forfeit").when(scored, "has_outcome").when(is_played, "incomplete").otherwise(own)
    return F.when(scored, "played").when(forfeit, "forfeit").otherwise("scheduled")


def _fits(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def round_rank(stage: Column) -> Column:
    """Wins from the final of the bracket that a label names, the outermost round that fits; null for anything but knockout games."""
    named = [F.when(_fits(stage, pattern), rank) for rank, pattern in reversed(vocab.ROUNDS)]
    return F.coalesce(*named, F.when(_fits(stage, vocab.PLACE_ONLY) | _fits(stage, vocab.GAME_TO_GO), 0))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th and so on."""
    one = F.when((n % 100).between(11, 13), 0).otherwise(n % 10)
    return F.concat(n.cast("string"), F.coalesce(F.get(F.array(F.lit("th"), F.lit("st"), F.lit("nd"), F.lit("rd")), one), F.lit("th")))


def bracket_key(words: Column) -> Column:
    """One spelling for each place: 'third', '3rd' and 'T-third' are '3rd'; other words as they are."""
    plain = F.regexp_replace(words, r"^t[-\s]\s*", "")
    known = F.create_map(*[F.lit(x) for word, n in vocab.ORDINAL_WORDS.items() for x in (word, n)])
    n = F.coalesce(F.regexp_extract(plain, r"^(\d+)(?:st|nd|rd|th)$", 1).try_cast("int"), F.try_element_at(known, plain))
    return F.coalesce(ordinal(n), plain)


def bracket_kind(stage: Column) -> Column:
    """champ, gtg for games to go, else the key of the place or losers' route that a label names; null for anything but knockout games."""
    words = F.lower(F.regexp_extract(stage, "(?iU)" + vocab.PLACEMENT, 1))
    kind = F.when(_fits(stage, vocab.GAME_TO_GO), "gtg").when(words != "", bracket_key(words)).otherwise("champ")
    return F.when(round_rank(stage).isNotNull(), kind)


def poolish(stage: Column) -> Column:
    """Whether a label says that the game is of a pool."""
    return _fits(stage, vocab.POOL)


def loo_code(loo: Column) -> Column:
    """2 supported, 1 not to be told, 0 not carrying, -1 not measured."""
    return F.when(loo.isNull(), -1).when(loo <= -0.002, 0).when(loo >= 0.003, 2).otherwise(1)


def winner(home_score: Column, away_score: Column, home: Column, away: Column) -> Column:
    return F.when(home_score > away_score, home).when(away_score > home_score, away)


def outcome(home_score: Column, away_score: Column) -> Column:
    return F.when(home_score > away_score, 1.0).when(home_score < away_score, 0.0).otherwise(0.5)


def game_x(w: Column, l: Column) -> Column:
    """Rating difference that a score suggests: none for a draw, 125 for the closest win, 600 at most (F16)."""
    share = F.least(F.lit(1.0), 2 * (1 - l / F.greatest(w - 1, F.lit(1))))
    return F.when(w == l, 0.0).otherwise(125 + 475 * F.sin(share * 0.4 * F.pi()) / F.sin(0.4 * F.pi()))


def score_weight(w: Column, l: Column) -> Column:
    """Weight of a score: 1 from 19 points in all, where the loser counts for at least half (F16)."""
    return F.sqrt(F.least(F.lit(1.0), (w + F.greatest(l, F.floor((w - 1) / 2))) / 19))


def date_weight(week: Column, last_week: Column) -> Column:
    """0.5 in the first week of a season, 1 in its last (F16)."""
    return F.pow(F.lit(2.0), week / F.greatest(last_week, F.lit(1))) / 2


def half_life(days: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), days / half)


def expect(ra: Column, rb: Column, scale: Column | float) -> Column:
    """Chance that the first of two ratings wins."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return 1 / (1 + F.pow(F.lit(10.0), (rb - ra) / scale))


def margin_multiplier(margin: Column, norm: float = 7.0) -> Column:
    return F.when(margin > 0, F.log1p(margin) / F.log1p(F.lit(norm))).otherwise(1.0)


def provisional(games: Column, most: float = 6.0, n: int = 10, shape: str = "hyperbolic") -> Column:
    """Multiplier for a player with few games; 1 in the long run."""
    if shape == "cliff":
        return F.when(games < n, most).otherwise(1.0)
    if shape == "linear":
        return F.greatest(F.lit(1.0), most - (most - 1) * games / n)
    if shape == "exponential":
        return 1 + (most - 1) * F.exp(-games / n)
    if shape == "hyperbolic":
        return 1 + (most - 1) * n / (n + games)
    raise ValueError(f"unknown shape {shape!r}")


def rating_sigma(games: Column) -> Column:
    return F.sqrt(F.lit(470.0**2) / games + 49.0**2)


def glicko_g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / (F.pi() * F.pi()))

"""Fixed values that results depend on: divisions, aliases, name and stage patterns, regions and the published configuration.

Every table here is a fixed value: codes are positions that published tables
store, patterns and word lists decide how names and labels are read.
"""

#: Division codes, append-only.
DIVISION_CODES = {
    "club-men": 0, "college": 1, "college-d3": 2, "club-mixed": 3, "club-women": 4, "college-women": 5, "college-women-d3": 6,
    "masters-men": 7, "masters-women": 8, "masters-mixed": 9, "grandmasters-men": 10, "grandmasters-women": 11, "grandmasters-mixed": 12,
    "greatgrandmasters-men": 13, "greatgrandmasters-women": 14, "greatgrandmasters-mixed": 15, "euf-open": 16, "euf-mixed": 17, "euf-women": 18,
}

#: Divisions of the team tables in order of display.
TEAM_DIVISIONS = [
    "club-men", "club-mixed", "club-women", "college", "college-d3", "college-women", "college-women-d3", "masters-men", "masters-women", "masters-mixed",
    "grandmasters-men", "grandmasters-women", "grandmasters-mixed", "greatgrandmasters-men", "greatgrandmasters-women", "greatgrandmasters-mixed",
    "euf-open", "euf-mixed", "euf-women",
]

#: Divisions of which a player belongs to one at a time.
CLUB_DIVISIONS = ["club-men", "club-mixed", "club-women"]

MEN = ["club-men", "college", "college-d3", "masters-men", "grandmasters-men", "greatgrandmasters-men"]
WOMEN = ["club-women", "college-women", "college-women-d3", "masters-women", "grandmasters-women", "greatgrandmasters-women"]
MIXED = ["club-mixed", "masters-mixed", "grandmasters-mixed", "greatgrandmasters-mixed"]

#: Suffix of a club's key in divisions other than the men's.
CLUB_SUFFIX = {"club-mixed": " (mixed)", "club-women": " (women's)"}

#: Lower-case spellings of clubs -> the name they are shown by.
CLUB_ALIASES = {"rhino": "Rhino Slam!", "dark star-d": "Dark Star"}

#: Published scale and base of each division.
DIVISION_SCALE = {
    "club-men": 260.0, "college": 260.0, "college-d3": 260.0, "club-mixed": 220.0, "club-women": 160.0, "euf-open": 260.0, "euf-mixed": 220.0, "euf-women": 160.0,
    "college-women": 200.0, "college-women-d3": 200.0, "masters-men": 260.0, "grandmasters-men": 260.0, "greatgrandmasters-men": 260.0, "masters-women": 200.0,
    "grandmasters-women": 200.0, "greatgrandmasters-women": 200.0, "masters-mixed": 220.0, "grandmasters-mixed": 220.0, "greatgrandmasters-mixed": 220.0,
}
DIVISION_BASES = {
    "club-men": 1500.0, "college": 1250.0, "college-d3": 1250.0, "ufa": 1550.0, "club-mixed": 1500.0, "club-women": 1600.0, "euf-open": 1500.0, "euf-mixed": 1500.0,
    "euf-women": 1600.0, "college-women": 1250.0, "college-women-d3": 1200.0, "masters-men": 1500.0, "grandmasters-men": 1500.0, "greatgrandmasters-men": 1500.0,
    "masters-women": 1600.0, "grandmasters-women": 1600.0, "greatgrandmasters-women": 1600.0, "masters-mixed": 1500.0, "grandmasters-mixed": 1500.0,
    "greatgrandmasters-mixed": 1500.0,
}

#: Rounds of a knockout from the final outwards: number of wins from the final and how labels name it. The outermost that fits counts.
ROUNDS = [
    (0, r"\b(finals?|championships?|champs?|title|ship)\b"),
    (1, r"\b(semi[\s\-]?finals?|semis?|final\s*(four|4)|s\.?f\.?s?)\b"),
    (2, r"\b(quarter[\s\-]?finals?|quarters?|qtrs?|q\.?f\.?s?|elite\s*8)\b"),
    (3, r"\b(pre[\s\-]?quarter[\s\-]?finals?|pre[\s\-]?quarters?|pre[\s\-]?q\w*|round\s*of\s*16|sweet\s*(16|sixteen)|octos?)\b"),
    (4, r"\b(round\s*of\s*32|r32)\b"),
    (5, r"\b(round\s*of\s*64|r64)\b"),
]

ORDINAL_WORDS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "eight": 8, "ninth": 9, "nineth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17, "nineteenth": 19, "twentieth": 20,
}

#: What names a place other than the first, or a losers' route; the words found are the bracket's key.
PLACEMENT = (
    r"(\b(?!1st|first)\d*(?:2nd|3rd|[04-9]th|1[0-9]th|\d+(?:st|nd|rd|th))\b"
    r"|\b(?:" + "|".join(w for w, n in ORDINAL_WORDS.items() if n != 1) + r")\b"
    r"|\bt-\s?\d+|\bknockout\b|\bconsolation\b|\bconsols?\b|\bback\s?door\b|\bbackdoor\b|\bbottom\b|\blower\b|\bchump\w*|\bchimp\w*|\bdump\w*"
    r"|\bsilver\b|\bbronze\b|\bplacement\b|\bloser\w*|\bplay[\s\-]?outs?\b|\bninals?\b|\bnine-?als?\b|\bfivals?\b|\bfive-?nals?\b|\bwampionship\b"
    r"|\bcon [abc]\b|\bmini\b|\bswiss\b|\bnit\b|\bb\s+bracket\b|\bc\s+bracket\b|\bemerge\b|\bstring\b|\bcheddar\b|\bcheese\b|\bapplebee|\bchili)"
)

#: A game for a berth in the next tournament of a series.
GAME_TO_GO = r"\bg(?:ame)?\s*[\-\s]?2?\s*to?\s*[\-\s]?go\b|\bg2g\b|\bgtg\b"

#: A label that is nothing but a place.
PLACE_ONLY = (
    r"^[\W_]*(?:t-?\s*)?(?:\d+(?:st|nd|rd|th)|" + "|".join(ORDINAL_WORDS) + r")\b"
    r"[\s\-/&]*(?:and|&|/|\d+(?:st|nd|rd|th))?\s*(?:place|placement)?\s*(?:game|match)?[\W_]*$"
)

POOL = r"(^|\b)(pool|round robin|rr)\b"

#: Tier of a tournament by its name; the first that fits counts, 0 is the regular season.
TIERS = [
    (4, r"\bnational|college championships?\b|usa ultimate club championships?\b|u\.?s\.? open|world .*championships?|pan american"),
    (3, r"\bregionals?\b"),
    (2, r"\bsectionals?\b"),
    (1, r"\bconference\b|\bcc\b|\bconf\b"),
]

#: What varies between the instances of one tournament, taken out of its lower-case name in this order.
SERIES_NOISE = [
    r"\b(19|20)\d{2}\b", r"\b(men'?s?|women'?s?|mixed|coed|co-ed)\b", r"\b(d-?\s?i{1,3}|d-?\s?1|d-?\s?3|division\s+\d+|di{1,3})\b", r"\bcollege\b", r"\bclub\b",
    r"\bultimate\b", r"\busau?\b", r"\btct\b", r"\b(part|pt\.?)\s*\d+\b", r"#\s*\d+\b", r"\s[-–—]\s.*$", r"\((?:[^)]*)\)",
]
SERIES_EDITION = r"\s+(?:x{0,3}(?:ix|iv|v?i{0,3})|\d{1,3}(?:st|nd|rd|th)?)\s*$"

#: A division's own national championship, and what is none.
CHAMPIONSHIP = r"national championship|club championships|club nationals|college championships?"
NOT_CHAMPIONSHIP = r"u\.?s\.? open"

#: Names of events that belong to another division.
D3_NAME = r"D-?III\b|\bD-?3\b"
DEVELOPMENTAL_NAME = r"\bDev\b|Developmental"
AGE_NAME = r"\bMasters\b|\bGrandmasters?\b|Great Grand"

#: Regions by state; college divisions and club divisions have maps of their own.
COLLEGE_REGIONS = {
    "Atlantic Coast": "DC DE MD NC SC VA", "Great Lakes": "IL IN KY MI", "Metro East": "CT NJ NY", "New England": "MA ME NH RI VT", "North Central": "IA MN ND NE SD WI",
    "Northwest": "AK ID MT OR UT WA", "Ohio Valley": "OH PA WV", "South Central": "AR CO KS MO OK TX WY", "Southeast": "AL FL GA LA MS TN", "Southwest": "AZ CA HI NM NV",
}
CLUB_REGIONS = {
    "Great Lakes": "IL IN KY MI OH", "Mid-Atlantic": "DC DE MD NJ PA VA WV", "North Central": "IA KS MN MO ND NE SD WI", "Northeast": "CT MA ME NH NY RI VT",
    "Northwest": "AK ID MT OR UT WA", "South Central": "AR CO NM OK TX WY", "Southeast": "AL FL GA LA MS NC SC TN", "Southwest": "AZ CA HI NV",
}

#: States of a game that count as played, by any provider.
PLAYED_STATES = ["played", "has_outcome", "forfeit"]

PODIUM = {"Gold": 1, "Silver": 2, "Bronze": 3}

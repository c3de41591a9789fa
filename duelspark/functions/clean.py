"""Cleaning and typed parsing as column functions; each stays in generated JVM code.

Nulls give null unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """(letters, what each stands for, letters that stand for several) of all characters that compatibility decomposition,
    without the combining marks, turns into ASCII letters and digits."""
    one, many = [], []
    for n in [*range(0x80, 0xD800), *range(0xF900, 0x10000)]:
        plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", chr(n)))
        plain = re.sub("[^A-Za-z0-9]+", " ", plain)
        if plain.strip():
            (one if len(plain) == 1 else many).append((chr(n), plain))
    return "".join(c for c, _ in one), "".join(p for _, p in one), [(c, p) for c, p in many if unicodedata.category(c).startswith("L")]


ACCENTED, PLAIN, LIGATURES = _folds()
#: Score words that are no numbers.
NO_SCORE = ("W", "L", "FF", "DQ")
#: Map names by their raw spelling.
MAP_NAMES = {
    "anc": "Ancient", "anb": "Anubis", "d2": "Dust2", "dust ii": "Dust2", "inf": "Inferno", "mrg": "Mirage", "nuke": "Nuke", "ovp": "Overpass", "trn": "Train", "vtg": "Vertigo",
    "de_ancient": "Ancient", "de_anubis": "Anubis", "de_cache": "Cache", "de_cbble": "Cobblestone", "de_dust2": "Dust2", "de_inferno": "Inferno", "de_mirage": "Mirage", "de_nuke": "Nuke",
    "de_overpass": "Overpass", "de_train": "Train", "de_tuscan": "Tuscan", "de_vertigo": "Vertigo", "default": "Default", "tba": "TBA",
}
#: Words that tell a bracket group, and words of a stage's title.
GROUP_WORDS = {"high": ("high", "advancement"), "mid": ("mid",), "low": ("low", "elimination")}
STAGE_WORDS = ("stage", "playoffs", "qualifier", "final", "group", "round")


def blank_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def slug_key(c: Column) -> Column:
    """Lower-case words of a-z0-9 joined by _; `unknown` if nothing is left."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.trim(s, F.lit("_")), F.lit("")), F.lit("unknown"))


def fold_accents(c: Column) -> Column:
    """Letters and digits in any accented, wide or joined form as plain ones; combining marks are dropped."""
    joined = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, c)
    some = F.regexp_like(c, F.lit(f"[{''.join(letter for letter, _ in LIGATURES)}]"))
    return F.regexp_replace(F.translate(F.when(some, joined).otherwise(c), ACCENTED, PLAIN), "[\u0300-\u036f]+", "")


def name_key(c: Column, accents: bool = True) -> Column:
    """Lower-case words of a-z0-9 joined by one space, empty if nothing is left."""
    s = F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(fold_accents(s) if accents else s), "[^a-z0-9]+", " "))


def hyphen_slug(c: Column) -> Column:
    """As slug_key with hyphens, accents folded and one long series name shortened."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)intel extreme masters", "IEM")
    s = F.trim(F.regexp_replace(F.lower(fold_accents(s)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def parse_int_loose(c: Column) -> Column:
    """First signed whole number once commas are gone."""
    return F.expr("try_cast(null as bigint)") if c is None else F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?\d+)", 1), F.lit("")).try_cast("bigint")


def parse_float_loose(c: Column) -> Column:
    s = F.regexp_replace(c, ",", "")
    return F.when(F.trim(c) != "-", F.nullif(F.regexp_extract(s, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"))


def safe_int(c: Column, default=None) -> Column:
    """A whole number as it stands, else the default."""
    value = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))
    return F.coalesce(value, F.lit(default).cast("bigint"))


def safe_float(c: Column, default: float | None = 0.0) -> Column:
    """A finite number, else the default."""
    x = c.try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good, x).otherwise(F.lit(default).cast("double"))


def score_int(c: Column) -> Column:
    """A score; walk-over and forfeit words are null."""
    return F.when(~F.upper(F.trim(c)).isin(*NO_SCORE), parse_int_loose(c))


def score_pair(c: Column) -> Column:
    """struct(a, b) of the first `a-b` or `a:b`."""
    pattern = r"(\d+)\s*[-:]\s*(\d+)"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).cast("int").alias("a"), F.regexp_extract(c, pattern, 2).cast("int").alias("b")))


def half_sum_score(params: Column, side: int) -> Column:
    """A map<string,string> of halves: the direct score, else the sum of regular and overtime halves."""
    direct = score_int(F.element_at(params, F.lit(f"score{side}")))
    halves = F.map_values(F.map_filter(params, lambda k, v: F.lower(k).rlike(rf"^(t{side}c?t|o\d+t{side}c?t)$") & score_int(v).isNotNull()))
    total = F.aggregate(halves, F.lit(0).cast("bigint"), lambda acc, v: acc + score_int(v))
    return F.coalesce(direct, F.when(F.size(halves) > 0, total))


def epoch_seconds(c: Column) -> Column:
    """Seconds from seconds, milliseconds (above 1e10) or ISO text."""
    number = F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
    seconds = F.when(number > 10_000_000_000, F.floor(number / 1000)).otherwise(number)
    return F.coalesce(seconds, F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""))))


def multi_format_date(c: Column) -> Column:
    """ISO text of d/m/Y or Y-m-d, anything else as it is."""
    t = F.trim(c)
    parsed = F.coalesce(F.try_to_timestamp(t, F.lit("d/M/yyyy")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), c)


#: Zone words that say nothing here, and the months.
ZONES = ("CEST", "CET", "EDT", "EST", "UTC", "PDT", "PST", "CDT", "CST")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def fuzzy_date(c: Column) -> Column:
    """struct(date, seconds) of a date inside a text (F10): `March 5th, 2024 - 18:30 CET`, `the 5 of Mar 2024`, `2024-03-05 18:30`.

    Zone words are left out and times are read as they stand; a text without a date, or with an impossible one, comes back
    cleaned, without seconds; blank is the empty text.
    """
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"\b(?:{'|'.join(ZONES)})\b", ""))
    name = rf"({'|'.join(MONTHS)})[a-z]*\.?"
    forms = {  # pattern: which groups are year, month and day
        r"\b(\d{4})-(\d{1,2})-(\d{1,2})": (1, 2, 3),
        rf"(?i)\b{name}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b,?\s+(\d{{4}})\b": (3, 1, 2),
        rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{name},?\s+(\d{{4}})\b": (3, 2, 1),
        r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b": (3, 2, 1),
    }
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, str(i))])
    clock = F.regexp_extract(t, r"\b(\d{1,2}:\d{2})\b", 1)
    found = []
    for pattern, groups in forms.items():
        year, month, day = (F.regexp_extract(t, pattern, g) for g in groups)
        month = F.coalesce(number[F.lower(month)], month)
        found.append(F.try_to_timestamp(F.concat(F.concat_ws("-", year, month, day), F.lit(" "), F.coalesce(F.nullif(clock, F.lit("")), F.lit("0:00"))), F.lit("yyyy-M-d H:mm")))
    at = F.coalesce(*found)
    return F.struct(F.coalesce(F.date_format(at, "yyyy-MM-dd"), t).alias("date"), F.unix_timestamp(at).alias("seconds"))


def join_date(c: Column) -> Column:
    """First YYYY-MM-DD, else the input."""
    s = F.coalesce(c, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")), s)


def best_of(c: Column) -> Column:
    """7, 5, 3, 2 or 1 from `boN` or `best of N`, the largest first; 3 if none."""
    s = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(3)
    for n in (1, 2, 3, 5, 7):
        out = F.when(s.contains(f"bo{n}") | s.contains(f"best of {n}"), n).otherwise(out)
    return out


def feed_best_of(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, "(?i)bo[1-9]", 0)), F.lit("")), F.lit("bo3"))


def map_name(c: Column) -> Column:
    """Canonical map name; blank gives TBA."""
    names = F.create_map(*[F.lit(x) for pair in MAP_NAMES.items() for x in pair])
    return F.coalesce(names[F.lower(F.trim(c))], blank_null(c), F.lit("TBA"))


def clean_wiki(c: Column) -> Column:
    """Text without comments, tags, links, templates and quotes, white space as one space.

    A line break or hard space is a space, a link leaves what it shows, an abbreviation its short form.
    """
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->|<(?!(?i:br)\b)[^>]*>|'{2,}", "")
    s = F.regexp_replace(s, r"(?:&nbsp;|<(?i:br)\b[^>]*>|\s)+", " ")
    s = F.regexp_replace(s, r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]|\{\{Abbr/([^{}|]*)[^{}]*\}\}", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\{\{[^{}]*\}\}", ""), r"\s+", " "))


def _has_word(c: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*map(F.lit, words)))


def bracket_group(c: Column) -> Column:
    """high, mid or low, the first that a text has a word of, else empty (F16)."""
    return F.coalesce(*[F.when(_has_word(c, words), group) for group, words in GROUP_WORDS.items()], F.lit(""))


def infer_phase(*texts: Column) -> Column:
    """The first rule that fits the joined texts (F15). A word `final` counts before `semi`."""
    t = F.lower(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in texts]))
    group = bracket_group(t)
    return (
        F.when(t.contains("showmatch"), "showmatch")
        .when(t.contains("grand final") | t.rlike(r"\bfinal\b"), "grand_final")
        .when(t.contains("semi"), "semifinal")
        .when(t.contains("quarter"), "quarterfinal")
        .when(t.contains("round of 16"), "round_of_16")
        .when(t.contains("round of 32"), "round_of_32")
        .when(t.contains("playoff"), "playoffs")
        .when(t.rlike(r"\bround\s+\d+"), F.when(group != "", F.concat(F.lit("swiss_"), group)).otherwise("swiss_round"))
        .when(t.contains("group"), "group_stage")
        .when(t.contains("qualifier"), "qualifier")
        .when(t != "", "regular")
        .otherwise("unknown")
    )


def status_word(action: Column) -> Column:
    """picked, removed or leftover from any spelling of a veto action."""
    s = F.lower(action)
    return F.when(s.contains("pick"), "picked").when(s.contains("left") | s.contains("decider"), "leftover").when(s.contains("remove") | s.contains("ban"), "removed")


def veto_line(c: Column) -> Column:
    """struct(team, action, map) of `2. Team removed Map` or `Map was left over`."""
    left, act = r"(?i)^\s*(?:\d+\.\s*)?(.+?) was left over", r"(?i)^\s*(?:\d+\.\s*)?(.+?)\s+(removed|picked|banned|pick|ban)\s+(.+?)\s*$"
    empty = F.lit(None).cast("string")
    return F.when(c.rlike(left), F.struct(empty.alias("team"), F.lit("leftover").alias("action"), F.regexp_extract(c, left, 1).alias("map"))).when(
        c.rlike(act), F.struct(F.regexp_extract(c, act, 1).alias("team"), status_word(F.regexp_extract(c, act, 2)).alias("action"), F.regexp_extract(c, act, 3).alias("map"))
    )


def first_non_empty(*cs: Column) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*[blank_null(c.cast("string")) for c in cs])


def synthetic_id(*cs: Column) -> Column:
    """A negative id from the parts' CRC-32."""
    return -F.crc32(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]))


def fallback_identity(own: Column, *cs: Column) -> Column:
    """The id, else event|team1|team2|time (F32)."""
    return F.coalesce(blank_null(own.cast("string")), F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]))


def title_from_href(c: Column) -> Column:
    """Last path part, without fragment, percent-decoded (a plus stays), _ as space."""
    tail = F.regexp_extract(F.regexp_replace(c, "#.*$", ""), "([^/]+)/?$", 1)
    return F.translate(F.try_url_decode(F.regexp_replace(tail, r"\+", "%2B")), "_", " ")


def source_stage(c: Column) -> Column:
    """The last part of a page title if it names a stage."""
    tail = F.translate(F.substring_index(c, "/", -1), "_", " ")
    return F.when(_has_word(tail, STAGE_WORDS), clean_wiki(tail)).otherwise("")


def parent_title(c: Column, has_event_name: Column) -> Column:
    return F.when(has_event_name | ~c.contains("/"), c).otherwise(F.regexp_replace(c, "/[^/]*$", ""))


def format_text(c: Column) -> Column:
    """struct(best_of, venue) of `Best of 3 (LAN)`."""
    n, venue = F.regexp_extract(c, r"(?i)best of (\d)", 1), F.regexp_extract(c, r"\((LAN|Online)\)", 1)
    return F.struct(F.nullif(n, F.lit("")).cast("int").alias("best_of"), F.nullif(venue, F.lit("")).alias("venue"))


def opponent_template(c: Column) -> Column:
    """struct(team, score) of `{{TeamOpponent|name|score=2}}` or plain text."""
    named = F.regexp_extract(c, r"\{\{[^|}]*\|(?:[^{}]*?\|)?team=([^|}]+)", 1)
    first = F.regexp_extract(c, r"\{\{[^|}]*\|([^|}=]+)(?:\||\}\})", 1)
    template = F.trim(c).startswith("{{")
    team = F.when(template, F.when(named != "", F.trim(named)).otherwise(F.trim(first))).otherwise(clean_wiki(c))
    score = F.when(template, score_int(F.regexp_extract(c, r"score=([^|}]*)", 1)))
    return F.struct(F.coalesce(team, F.lit("")).alias("team"), score.alias("score"))


def link_target(c: Column) -> Column:
    """Target of the first markdown or HTML link."""
    md, html = F.regexp_extract(c, r"\[[^\]]*\]\(([^)\s]+)", 1), F.regexp_extract(c, "(?i)href=[\"']([^\"']+)", 1)
    return F.coalesce(F.nullif(md, F.lit("")), F.nullif(html, F.lit("")))


def section_titles(c: Column) -> Column:
    """Distinct `#section:` names in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)#section:([^\s|}]+)"), F.lit(1)))

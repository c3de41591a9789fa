"""Page extraction as Spark jobs: raw pages to typed rows by regular expressions and position windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelspark.operators.prior import carried_heading


def matches_of(pages: DataFrame, pattern: str, groups: list[str], body: str = "html", key: str = "page_id") -> DataFrame:
    """(key, position, groups…): a row for each match of a pattern in each page, in page order.

    Whole matches are listed once; each group is taken from its match.
    """
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(0))).alias("position", "__m"))
    return found.select(key, "position", *[F.regexp_extract("__m", pattern, i + 1).alias(g) for i, g in enumerate(groups)])


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, label) of every link."""
    return matches_of(pages, r"(?s)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", ["href", "label"])


def page_headers(pages: DataFrame) -> DataFrame:
    """(page_id, lang, title, host, path) of each page."""
    one = lambda p, c="html": F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return pages.select("page_id", one(r"<html[^>]*\blang=[\"']([^\"']+)").alias("lang"), one(r"(?s)<title>(.*?)</title>").alias("title"), one(r"^\w+://([^/?#]+)", "url").alias("host"), one(r"^\w+://[^/]+(/[^?#]*)", "url").alias("path"))


def result_cards(pages: DataFrame) -> DataFrame:
    """(page_id, position, date, team1, score1, score2, team2) of result pages: each card takes the last date heading before it."""
    pattern = r"(?s)<h3[^>]*>Results for ([^<]+)</h3>|<div class=\"result\"><b>([^<]+)</b>\s*(\d+)\s*-\s*(\d+)\s*<b>([^<]+)</b></div>"
    rows = matches_of(pages, pattern, ["heading", "team1", "score1", "score2", "team2"])
    rows = carried_heading(rows.withColumn("heading", F.nullif("heading", F.lit(""))), "page_id", "position", "heading")
    return rows.where("team1 <> ''").select("page_id", "position", F.col("carried").alias("date"), "team1", F.col("score1").cast("int").alias("score1"), F.col("score2").cast("int").alias("score2"), "team2")


#: How result pages and team pages of different sites mark what is read: each pattern has a group for each value.
LAYOUTS = {
    "cards": {
        "heading": r"<h3 class=\"day\">([^<]*)</h3>", "block": r"<div class=\"match\"([^>]*)>(.*?)</div><!--match-->", "stamp": r"data-at=\"(\d+)\"", "link": r"href=\"/match/(\d+)/", "team": r"<b class=\"team\">([^<]*)</b>",
        "score": r"<i>(\d+)</i>\s*-\s*<i>(\d+)</i>", "event": r"<em>([^<]*)</em>", "format": r"<small>([^<]*)</small>", "star": r"class=\"star\"", "section": r"<h2>([^<]*)</h2>", "member": r"<li data-player=\"(\d+)\">([^<]*)</li>",
    },
    "rows": {
        "heading": r"<tr><th colspan=\"6\">([^<]*)</th></tr>", "block": r"<tr class=\"result\"([^>]*)>(.*?)</tr>", "stamp": r"data-unix=\"(\d+)\"", "link": r"href=\"[^\"]*[?&]id=(\d+)", "team": r"<td class=\"t\">([^<]*)</td>",
        "score": r"<td>(\d+):(\d+)</td>", "event": r"title=\"([^\"]*)\"", "format": r"<td class=\"f\">([^<]*)</td>", "star": r"&#9733;", "section": r"<caption>([^<]*)</caption>", "member": r"<td id=\"p(\d+)\">([^<]*)</td>",
    },
}


def match_blocks(pages: DataFrame, layout: dict[str, str]) -> DataFrame:
    """Contests of result pages: (page_id, position, match_id, match_ts, day, team1, team2, score1, score2, event, format, stars).

    Headings and blocks are found in one pass and a block takes the last heading before it as its day. Blocks without a
    link are passed over; what a block lacks is null. Of several blocks of a contest on a page the fullest stays, the first
    of equal ones.
    """
    rows = matches_of(pages, f"(?s){layout['heading']}|{layout['block']}", ["heading", "marks", "body"])
    rows = carried_heading(rows.withColumn("heading", F.nullif(F.trim("heading"), F.lit(""))), "page_id", "position", "heading").where("body <> ''")
    one = lambda name, group=1, of="body": F.nullif(F.trim(F.regexp_extract(of, layout[name], group)), F.lit(""))
    team = lambda n: F.nullif(F.trim(F.get(F.regexp_extract_all("body", F.lit(layout["team"]), F.lit(1)), F.lit(n))), F.lit(""))
    read = rows.select(
        "page_id", "position", one("link").cast("long").alias("match_id"), F.timestamp_millis(one("stamp", of="marks").cast("long")).alias("match_ts"), F.col("carried").alias("day"), team(0).alias("team1"), team(1).alias("team2"),
        one("score").cast("int").alias("score1"), one("score", 2).cast("int").alias("score2"), one("event").alias("event"), one("format").alias("format"), F.regexp_count("body", F.lit(layout["star"])).alias("stars"),
    ).where("match_id is not null")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("match_ts", "day", "team1", "team2", "score1", "score2", "event", "format")), F.lit(0))
    best = F.row_number().over(Window.partitionBy("page_id", "match_id").orderBy(known.desc(), "position"))
    return read.withColumn("__k", best).where("__k = 1").drop("__k")


def rosters(pages: DataFrame, layout: dict[str, str]) -> DataFrame:
    """(page_id, section, place, player_id, name) of the members of a team page, each in the section whose heading is above it."""
    rows = matches_of(pages, f"(?s){layout['section']}|{layout['member']}", ["section", "player_id", "name"])
    rows = carried_heading(rows.withColumn("section", F.nullif(F.trim("section"), F.lit(""))), "page_id", "position", "section").where("player_id <> ''")
    place = F.row_number().over(Window.partitionBy("page_id", "carried").orderBy("position"))
    return rows.select("page_id", F.col("carried").alias("section"), place.alias("place"), F.col("player_id").cast("long").alias("player_id"), F.trim("name").alias("name"))


def ranking_rows(pages: DataFrame) -> DataFrame:
    """(page_id, rank, points, team) of markdown ranking tables `| 1 | 2000 | Name |`."""
    rows = matches_of(pages, r"(?m)^\|\s*(\d+)\s*\|\s*([\d,]+)\s*\|\s*([^|\n]+?)\s*\|", ["rank", "points", "team"])
    return rows.select("page_id", F.col("rank").cast("int").alias("rank"), F.regexp_replace("points", ",", "").cast("int").alias("points"), "team")


def wiki_matches(pages: DataFrame) -> DataFrame:
    """(page_id, position, team1, team2, score1, score2) of `{{Match|opponent1=…|opponent2=…|score=a-b}}` templates."""
    rows = matches_of(pages, r"\{\{Match\|opponent1=([^|}]*)\|opponent2=([^|}]*)\|score=(\d+)-(\d+)\}\}", ["team1", "team2", "score1", "score2"])
    return rows.withColumn("score1", F.col("score1").cast("int")).withColumn("score2", F.col("score2").cast("int"))

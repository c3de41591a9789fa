"""Folding by Unicode's decompositions, aliases by index against all pairs, checks in one pass, declared features by hand."""

import random
import re
import unicodedata
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duelspark.functions import clean
from duelspark.operators import declared, expect, joins, prior, select
from duelspark.plans.contests import saved
from duelspark.sources import io, pages

T0 = datetime(2025, 1, 1)


def plain_key(s):
    return re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s)).lower()).strip()


def test_names_fold_like_decomposition(spark):
    names = ["Équipe Ñandú", "Nguyễn Văn Đức", "ＦＡＺＥ　１２", "ﬁnal ﬂag", "été", "Łódź", "Straße", "Ǆ x", "Ⅳ", "①st", "ŀ", "ệ́", "日本 A", "", "½", "Å"]
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    got = {r.n: r.k for r in rows.select("n", clean.name_key(F.col("n")).alias("k")).collect()}
    assert got[None] == "" and got["Nguyễn Văn Đức"] == "nguyen van uc" and got["ＦＡＺＥ　１２"] == "faze 12"
    assert {n: got[n] for n in names if n not in ("Ⅳ", "½")} == {n: plain_key(n) for n in names if n not in ("Ⅳ", "½")}


def slug(s):
    return re.sub("[^a-z0-9]+", "_", (s or "").lower()).strip("_") or "unknown"


def all_pairs(names, teams, trusted):
    found = {}
    for scope, raw in set(names):
        fits = set()
        for s, name in set(teams):
            a, b = slug(raw), slug(name)
            initials = "".join(w[0] for w in plain_key(name).split(" ") if w)
            if s == scope and (a == b or (raw, name) in trusted or (min(len(a), len(b)) >= 4 and (a in b or b in a)) or a.replace("_", "") == initials):
                fits.add(name)
        if len(fits) == 1:
            found[scope, raw] = fits.pop()
    return found


def test_aliases_by_index_equal_all_pairs(spark):
    rng = random.Random(4)
    words = ["nova", "Nova", "team", "liquid", "g2", "esports", "faze", "clan", "na", "vi", "spirit", "ice", "x"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    teams = [(rng.randrange(6), name()) for _ in range(150)]
    names = [(rng.randrange(7), rng.choice([name(), name()[:5], "".join(w[0] for w in name().split()), name() + " academy", "??"])) for _ in range(400)]
    trusted = [(names[i][1], teams[i][1]) for i in range(0, 60, 3)]
    got = joins.resolve_aliases(spark.createDataFrame(names, "s int, raw string"), spark.createDataFrame(teams, "s int, name string"), "s", spark.createDataFrame(trusted, "alias string, name string"))
    want = all_pairs(names, teams, set(trusted))
    assert {(r.s, r.raw): r.resolved for r in got.collect()} == want and len(want) > 40


def test_a_scope_is_not_multiplied_out(spark):
    """Two thousand names and candidates of one scope meet by their pieces only."""
    names = spark.createDataFrame([(0, f"alpha{i:04d}x") for i in range(2000)], "s int, raw string")
    teams = spark.createDataFrame([(0, f"alpha{i:04d}") for i in range(2000)], "s int, name string")
    met = joins._inside(teams.select("s", "name", F.col("name").alias("short")), names.select("s", "raw", F.col("raw").alias("long")), "s")
    assert met.count() == 2000
    found = joins.resolve_aliases(names, teams, "s", spark.createDataFrame([], "alias string, name string"))
    assert found.count() == 2000 and found.where("concat(resolved, 'x') <> raw").count() == 0


def test_checks_of_a_table_take_one_pass(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3, 3]), (None, None)], "n int, a array<int>")
    checks = expect.inspect(rows, {"small": F.col("n") < 2, "once": expect.elements_once("a")}, {"many": 5, "some": 3})
    assert {r.check: (r.failed, r.total) for r in checks.collect()} == {"small": (2, 3), "once": (2, 3), "many": (1, 3), "some": (0, 3)}
    assert checks._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.check: r.failed for r in expect.inspect(rows.where("false"), {"small": F.col("n") < 2}, {"many": 1}).collect()} == {"small": 0, "many": 1}


def test_declared_features_by_hand(spark):
    day = lambda n: T0 + timedelta(days=n)
    lineups = spark.createDataFrame([(1, day(0), 7, [1, 2, 3, 4, 5]), (2, day(40), 7, [1, 2, 3, 8, 9]), (3, day(40), 7, [1, 2, 3, 8, 9]), (4, day(1), 8, [6]), (5, day(90), 7, [])], "match_id long, match_ts timestamp, team_id int, players array<int>")
    assert {r.match_id: r.value for r in declared.continuity(lineups).collect()} == {1: None, 2: 0.6, 3: 1.0, 4: None, 5: None}
    lines = spark.createDataFrame([(1, day(0), 7, 1, 1.0), (1, day(0), 7, 2, 2.0), (2, day(50), 7, 1, 5.0), (3, day(91), 7, 1, 9.0), (3, day(91), 7, 2, 9.0), (3, day(91), 7, 3, 9.0)], "match_id long, match_ts timestamp, team_id int, player_id int, rating double")
    top = {r.match_id: r.value for r in declared.ratings(lines, F.max).collect()}
    mean = {r.match_id: r.value for r in declared.ratings(lines, F.avg).collect()}
    assert top == {1: None, 2: 1.0, 3: 5.0} and mean == {1: None, 2: 1.0, 3: 5.0}  # after ninety-one days the first is out
    with pytest.raises(ValueError):
        declared.declared_features(declared.Inputs(lineups, lineups, lines, lines, lines), ["utility_profile_diff"])
    assert {level for level, _ in declared.REGISTRY.values()} == {"team", "player", "player_style", "map", "context"}


def test_dates_inside_texts(spark):
    texts = {
        "March 5th, 2024 - 18:30 CET": ("2024-03-05", 1709663400), "the 5 of Mar 2024": ("2024-03-05", 1709596800), "2024-03-05 07:05 UTC": ("2024-03-05", 1709622300), "05/03/2024": ("2024-03-05", 1709596800),
        "June 31, 2024": ("June 31, 2024", None), "sometime in May": ("sometime in May", None), "TBA EST": ("TBA", None), "": ("", None), None: ("", None), "SEPT. 1 2023": ("2023-09-01", 1693526400),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: tuple(r.d) for r in rows.select("t", clean.fuzzy_date(F.col("t")).alias("d")).collect()} == texts


def test_result_blocks_and_rosters(spark):
    card = lambda i, a, b, extra="": f'<div class="match" data-at="86400000{extra}"><a href="/match/{i}/x"><b class="team">{a}</b><i>2</i> - <i>0</i><b class="team">{b}</b></a></div><!--match-->'
    html = card(1, "A", "B") + '<h3 class="day">May 1</h3>' + card(2, "C", "D") + '<div class="match"><a href="/match/2/x"></a></div><!--match--><div class="match">no link</div><!--match--><h3 class="day">May 2</h3><div class="match"><a href="/match/3/x"><b class="team">E</b></a></div><!--match-->'
    docs = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.match_id: (r.day, r.team1, r.team2, r.score1, r.event, r.match_ts) for r in pages.match_blocks(docs, pages.LAYOUTS["cards"]).collect()}
    assert got == {1: (None, "A", "B", 2, None, datetime(1970, 1, 2)), 2: ("May 1", "C", "D", 2, None, datetime(1970, 1, 2)), 3: ("May 2", "E", None, None, None, None)}
    team = '<table><tr><td id="p9">X</td></tr><caption>Players</caption><tr><td id="p1">Ann </td><td id="p2">Bo</td></tr><caption>Coach</caption><td id="p3">Cy</td></table>'
    members = pages.rosters(spark.createDataFrame([(1, team)], "page_id long, html string"), pages.LAYOUTS["rows"]).collect()
    assert sorted((r.section or "", r.place, r.player_id, r.name) for r in members) == [("", 1, 9, "X"), ("Coach", 1, 3, "Cy"), ("Players", 1, 1, "Ann"), ("Players", 2, 2, "Bo")]


def test_documents_are_parsed_once(spark):
    texts = ['{"id": 1, "best_of": 3, "maps": [{"name": "A", "s1": 13, "s2": 4}], "vetoes": [{"team": 1, "action": "pick", "map": "A"}], "lineups": [], "stats": null}', '{"id": null}', "cut {", None, '{"id": 2}', '{"id": 3, "maps": "none"}']
    docs = io.variants(spark.createDataFrame([(t,) for t in texts], "text string"), "text", saved)
    tables = io.detail_tables(docs)
    assert sorted((r.match_id, r.best_of, r.score1, r.score2, r.winner) for r in tables["contest"].collect()) == [(1, 3, 1, 0, 1), (2, None, 0, 0, None), (3, None, 0, 0, None)]
    assert [tuple(r) for r in tables["maps"].collect()] == [(1, 1, "A", 13, 4)] and [tuple(r) for r in tables["vetoes"].collect()] == [(1, 1, 1, "pick", "A")] and tables["lineups"].count() == tables["stats"].count() == 0
    assert all("parse_json" not in t._jdf.queryExecution().optimizedPlan().toString() for t in tables.values())


def test_timeline_fallbacks_and_the_tier_gate(spark):
    lines = spark.createDataFrame([(1, m, T0 + timedelta(days=m), 10) for m in range(1, 6)] + [(1, 9, None, 10)], "player_id int, match_id long, match_ts timestamp, team_id int")
    games = spark.createDataFrame([(1, 10, 20, 10, 0, 2), (2, 10, 20, None, 2, 1), (3, 20, 10, None, 2, 1), (4, 10, 20, None, 1, 1), (5, 20, 30, None, 2, 0)], "match_id long, team1_id int, team2_id int, winner_team_id int, team1_score int, team2_score int")
    got = [(r.place, r.match_id, r.opponent_id, r.won) for r in prior.player_timeline(lines, games, 4).orderBy("place").collect()]
    assert got == [(1, 2, 20, True), (2, 3, 20, False), (3, 4, 20, None), (4, 5, 20, False)]
    events = spark.createDataFrame([(1, "Big Cup", "tier_1"), (2, "Small", "tier_3")], "event_id int, name string, tier string")
    contests = spark.createDataFrame([(1, 1, None, None), (2, None, "big cup!", "tier_2"), (3, 2, "Small", "tier_3"), (4, 7, None, "tier_2"), (5, None, None, None)], "match_id long, event_id int, event_name string, event_tier string")
    kept, rows, people = select.tier_gate(events, contests, spark.createDataFrame([(1, 5), (3, 6), (4, 7)], "match_id long, player_id int"))
    assert kept.count() == 1 and {r.match_id: r.product_tier for r in rows.collect()} == {1: "tier_1", 2: "tier_1", 4: "tier_2"} and sorted(r.player_id for r in people.collect()) == [5, 7]

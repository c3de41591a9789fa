"""Declared features that share their work: each whole is made once, and what it shuffled goes when it is written."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from duelspark.operators import declared, prior
from duelspark.plans import contests

T0 = datetime(2025, 1, 1)
NAMES = contests.DECLARED


def inputs(spark, save):
    rng = random.Random(5)
    games = [(i, T0 + timedelta(days=i // 2), *rng.sample(range(4), 2), rng.randrange(2), i % 2) for i in range(80)]
    matches = spark.createDataFrame(games, "match_id long, match_ts timestamp, team1_id int, team2_id int, target_team1_win int, is_lan int")
    lines = [(m, t, team, rng.randrange(9), rng.choice([None, 0.7, 1.3])) for m, t, a, b, *_ in games for team in (a, b) for _ in range(3)]
    maps = [(m, n, rng.choice(["Nuke", "Mirage", "TBA", None])) for m, *_ in games for n in range(3)]
    vetoes = [(m, rng.choice([a, b, None]), rng.choice(["Nuke", "Mirage"]), rng.choice(["picked", "removed", "left over"])) for m, _, a, b, *_ in games for _ in range(3)]
    sides = prior.contest_sides(matches).join(matches.select("match_id", "is_lan"), "match_id")
    return games, lines, maps, vetoes, declared.Inputs(
        matches, sides, spark.createDataFrame(lines, "match_id long, match_ts timestamp, team_id int, player_id int, rating double"),
        spark.createDataFrame(maps, "match_id long, map_index int, map_name string"), spark.createDataFrame(vetoes, "match_id long, team_id int, map_name string, action string"), save,
    )


def test_all_at_once_equal_plain_loops(spark):
    made = []

    def save(df):
        made.append(df.columns)
        return df.localCheckpoint()

    games, lines, maps, vetoes, known = inputs(spark, save)
    got = {r.match_id: r for r in declared.declared_features(known, NAMES).collect()}
    assert len(got) == 80 and len(made) == 5  # line-ups, ratings, venues, choices and the rows of those; twelve computations before
    when = {m: t for m, t, *_ in games}
    sides = sorted((t, m, team) for m, t, a, b, *_ in games for team in (a, b))

    def rating(m, team, value):
        means = []
        for player in {p for n, _, side, p, _ in lines if n == m and side == team}:
            past = [r for _, t, _, p, r in lines if p == player and r is not None and timedelta(0) < when[m] - t <= timedelta(days=90)]
            means += [sum(past) / len(past)] if past else []
        return value(means) if means else None

    def choice(m, team, action):
        before = {n for t, n, side in sides if side == team and (t, n) < (when[m], m)}
        rates = [len([1 for n, side, name, a in vetoes if n in before and side == team and name == own and a == action and (n, own) in {(x, y) for x, _, y in maps}]) / len(before) if before else 0.0 for own in {y for x, _, y in maps if x == m and y not in (None, "TBA")}]
        return sum(rates) / len(rates) if rates else None

    less = lambda a, b: None if a is None or b is None else round(a - b, 9)
    shown = lambda v: None if v is None else round(v, 9)
    for m, _, a, b, *_ in games:
        for name, value in (("avg_player_rating_3m_diff", lambda v: sum(v) / len(v)), ("top_player_rating_3m_diff", max)):
            assert shown(got[m][name]) == less(rating(m, a, value), rating(m, b, value))
        for name, action in (("map_pick_rate_diff", "picked"), ("map_ban_rate_diff", "removed")):
            assert shown(got[m][name]) == less(choice(m, a, action), choice(m, b, action))
    assert {c: sum(r[c] is not None for r in got.values()) > 9 for c in NAMES} == dict.fromkeys(NAMES, True)


def test_a_settled_step_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    rows = spark.range(2000).select((F.col("id") % 50).alias("k"), F.rand(1).alias("v"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    assert contests.settled(rows.repartition(3, "k").groupBy("k").agg(F.sum("v").alias("v"))).count() == 50
    new = lambda: {f for f in files() - before if f.endswith(".data")}
    deadline = time.time() + 20
    while len(new()) > 3 and time.time() < deadline:  # files go in the background; those of count() may stay
        time.sleep(0.2)
    assert len(new()) <= 3
    assert spark.conf.get(key) == was

"""Rules against hand rows with known outcomes, unknown inputs among them."""

import pytest
from pyspark.sql import functions as F

from duelspark.functions import clean, rules
from duelspark.operators import aggregate, joins, merge
from duelspark.sources import io


def values(spark, **columns):
    row = spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()
    return row.asDict()


def explained(spark, **given):
    get = lambda name: F.lit(given.get(name)).cast("boolean" if name == "known" else "double")
    pair = lambda a: (get(f"{a}1"), get(f"{a}2"))
    return values(spark, e=rules.explanation(get("p"), pair("rating"), pair("form"), pair("depth"), pair("rank"), pair("lineup"), get("map_p"), get("evidence"), pair("veto"), get("known")))["e"]


def test_explanations(spark):
    even = {"lineup1": 5, "lineup2": 5}
    first = explained(spark, p=0.7, rating1=1750, rating2=1500, form1=0.7, form2=0.5, depth1=0.45, depth2=0.58, rank1=2, rank2=12, veto1=30, veto2=25, map_p=0.67, evidence=42, **even)
    assert first.supports[0] == "rating" and first.counter == "maps" and first.risk == "Map depth disagrees"
    second = explained(spark, p=0.42, rating1=1450, rating2=1600, form1=0.4, form2=0.6, depth1=0.48, depth2=0.55, lineup1=5, lineup2=3)
    assert second.risk == "Lineup gap" and second.confidence == pytest.approx(0.58)
    assert explained(spark, p=0.52, **even).risk == "Thin edge"
    assert explained(spark, p=0.7, map_p=0.7, veto1=9, veto2=30, evidence=50, **even).risk == "Veto sample"
    assert explained(spark, p=0.7, map_p=0.7, veto1=10, veto2=30, evidence=19, **even).risk == "Map sample"
    assert explained(spark, **even).n_signals == 0


def test_unknown_stays_unknown(spark):
    none = F.lit(None).cast("double")
    out = values(spark, a=rules.probability4(none), b=rules.sigmoid(none), c=rules.logit(none), d=rules.trait(F.lit("n/a")), e=rules.bounded_baseline(none, none, none, none), f=rules.trait(F.lit("140/100")))
    assert out == {"a": None, "b": None, "c": None, "d": None, "e": 0.5, "f": 100.0}
    rows = spark.createDataFrame([(1, 0.8), (0, None), (0, 0.4)], "y int, p double")
    assert rows.agg(*aggregate.metric_columns()).first().log_loss == pytest.approx((-__import__("math").log(0.8) - __import__("math").log(0.6)) / 2)


def test_signal_index(spark):
    index = lambda traits, rating: rules.signal_index(F.array(*[F.lit(t).cast("double") for t in traits]), F.lit(rating).cast("double"))
    assert values(spark, a=index([50, None, 70], 1.35), b=index([None], 1.08), c=index([100], None), d=index([None], None)) == {"a": 78, "b": 36, "c": 88, "d": 33}


def test_names(spark):
    placeholders = ["TBD", "unknown", "Team 1", "Quarterfinal winner", "Europe qualifier", "winner of", " ", None]
    teams = ["Team Spirit", "Winners of war", "Finalists", "tba gaming"]
    rows = spark.createDataFrame([(n,) for n in placeholders + teams], "n string")
    assert [r[0] for r in rows.select(rules.is_placeholder(F.col("n"))).collect()] == [True] * len(placeholders) + [False] * len(teams)
    maps = spark.createDataFrame([("de_mirage",), ("DE_CBBLE",), ("Default",), (None,), ("d2",), ("Cache",)], "n string")
    assert [r[0] for r in maps.select(clean.map_name(F.col("n"))).collect()] == ["Mirage", "Cobblestone", "Default", "TBA", "Dust2", "Cache"]
    assert values(spark, n=clean.name_key(F.lit("Brașov Ţară Í")))["n"].startswith("brasov")


def test_policies_and_feed_states(spark):
    rows = spark.createDataFrame([("T2", "medium", 5, 90), ("T3", "high", 30, 150), ("T3", "high", None, 10), ("T1", "high", 300, 10)], "t string, r string, a int, b int")
    held = {p: [x[0] for x in rows.select(rules.updates_state(p, F.col("t"), F.col("r"), (F.col("a"), F.col("b")))).collect()] for p in rules.POLICIES}
    assert held == {"all": [True] * 4, "no_t3": [True, False, False, True], "clean_only": [True, False, False, False], "ranked_top120": [True, False, False, False], "ranked_top200": [True, True, False, False]}
    now = "2025-01-01 12:00:00"
    feed = spark.createDataFrame([("live", None, None, None), ("x", "2025-01-01 10:00:00", 2, 1), ("Ended early", "2025-01-01 09:59:59", None, 1), (None, "2025-01-01 18:00:00", 1, 0), (None, None, 16, 3)], "s string, t string, a int, b int")
    out = feed.select(rules.wants_detail(F.col("s"), F.col("t").cast("timestamp"), F.lit(now).cast("timestamp")), rules.is_finished(F.col("s"), F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [(True, False), (True, True), (False, True), (True, False), (False, False)]


def test_feed_overlay(spark):
    board = spark.createDataFrame([(1, "a", "b", False), (2, "c", "d", True), (3, "e", "f", False), (4, "g", "h", False)], "id long, a string, b string, locked boolean")
    feed = spark.createDataFrame([("b", "a", "Finished", 2, 1, 1), ("a", "b", "Scheduled", None, None, 0), ("d", "c", "Finished", 2, 0, 1), ("e", "f", "Live", 1, None, 1)], "a string, b string, status string, score_a int, score_b int, seq int")
    out = {r.id: (r.status, r.score_label, r.winner) for r in joins.feed_overlay(board, feed).collect()}
    assert out == {1: ("locked", "1:2", "b"), 2: ("locked", None, None), 3: ("live", "1:0", None), 4: ("open", None, None)}


def test_publication_and_first_of_repeated_keys(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    for version in ("9", "10"):
        assert io.publish(spark.range(int(version)), path, version, lambda df: True)
    assert io.published(spark, path).count() == 10
    assert io.publish(spark.range(11), path, "10", lambda df: True) and io.published(spark, path).count() == 11
    (tmp_path / "p" / "version=10").rename(tmp_path / "p" / "_replaced-10")  # cut between the two renames
    assert io.published(spark, path).count() == 11
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "b"), (2, "a"), (1, "z")], "k int, v string").repartition(3)
    assert sorted(map(tuple, merge.insert_ignore(old, new, ["k"]).collect())) == [(1, "x"), (2, "a")]

"""Hand rows with expected values, order insensitivity and prior-only checks."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duelspark.functions import clean, rules
from duelspark.operators import aggregate, expect, fold, joins, merge, model, prior, select
from duelspark.plans import contests as contest_plans
from duelspark.sources import io, pages
from duelspark.sources.fixtures import Fixtures

T0 = datetime(2025, 1, 1)
MATCH = "match_id long, match_ts timestamp, team1_id int, team2_id int, target_team1_win int, event_id int, event_tier string, match_phase string, is_playoff int, is_elimination int"


def contests(spark, n=60):
    rows = [(i, T0 + timedelta(days=i // 2), i % 5, (i + 1 + i % 3) % 5, (i * 7) % 3 % 2, i % 4, "S-Tier" if i % 2 else "C-Tier", "playoffs" if i % 3 else "group_stage", int(i % 3 > 0), int(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame([r for r in rows if r[2] != r[3]], MATCH)


def cells(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_phase_rules_keep_the_final_trap(spark):
    rows = spark.createDataFrame([("Semi-final",), ("Semifinal",), ("GRAND FINAL",), ("round 3 low",), ("",), (None,), ("Finale",)], "t string")
    assert [r.p for r in rows.select(clean.infer_phase(F.col("t")).alias("p")).collect()] == ["grand_final", "semifinal", "grand_final", "swiss_low", "unknown", "unknown", "regular"]


def test_keys_and_accents(spark):
    rows = spark.createDataFrame([("  Équipe Ñandú ",), ("***",), (None,), ("A.B  C",)], "t string")
    assert cells(rows.select(clean.slug_key(F.col("t")).alias("a"), clean.name_key(F.col("t")).alias("b"), clean.hyphen_slug(F.col("t")).alias("c")), "a", "b", "c") == [("quipe_and", "equipe nandu", "equipe-nandu"), ("unknown", "", "unknown"), ("unknown", "", "unknown"), ("a_b_c", "a b c", "a-b-c")]


def test_numbers(spark):
    rows = spark.createDataFrame([("1,234 pts",), ("-",), ("",), (None,), ("NaN",), ("inf",), ("-7",)], "t string")
    assert cells(rows.select(clean.parse_int_loose(F.col("t")).alias("i"), clean.safe_float(F.col("t"), 9.0).alias("f")), "i", "f") == [(1234, 9.0), (None, 9.0), (None, 9.0), (None, 9.0), (None, 9.0), (None, 9.0), (-7, -7.0)]


def test_asof_ties_and_edges(spark):
    rows = spark.createDataFrame([(1, T0), (1, T0 + timedelta(days=5)), (2, T0), (3, T0)], "k int, at timestamp")
    past = spark.createDataFrame([(1, T0, 5), (1, T0, 7), (1, T0 + timedelta(days=9), 8), (2, T0 + timedelta(days=1), 1)], "k int, since timestamp, v int")
    assert sorted(cells(prior.asof_join(rows, past, ["k"], "at", "since", ["v"]), "k", "at", "v"), key=str) == sorted([(1, T0, 7), (1, T0 + timedelta(days=5), 7), (2, T0, None), (3, T0, None)], key=str)
    assert {r.v for r in prior.asof_join(rows.where("k = 1"), past, ["k"], "at", "since", ["v"], strict=True).collect()} == {None, 7}


def test_features_read_only_the_past(spark):
    m = contests(spark)
    full = {(r.match_id, r.side): r for r in prior.prior_features(prior.contest_sides(m)).collect()}
    cut = {(r.match_id, r.side): r for r in prior.prior_features(prior.contest_sides(m.where("match_id < 31").repartition(7))).collect()}
    assert cut and all(full[k] == v for k, v in cut.items())
    first = min(full)
    assert full[first].prior_win_rate == 0.5 and full[first].days_rest == 14.0


def test_gated_state_equals_plain_state_when_all_count(spark):
    sides = prior.contest_sides(contests(spark).withColumn("updates_state", F.lit(True)))
    a = {(r.match_id, r.side): (r.prior_matches, r.prior_win_rate, r.recent_win_rate_10, r.days_rest) for r in prior.gated_features(sides).collect()}
    b = {(r.match_id, r.side): (r.prior_matches, r.prior_win_rate, r.recent_win_rate_10, r.days_rest) for r in prior.prior_features(sides).collect()}
    assert a == b


def test_elo_folds(spark):
    m = contests(spark)
    got = {r.match_id: (r.elo1, r.elo2) for r in fold.elo_pools(m.withColumn("all", F.lit(0)).repartition(5), "all", F.lit(20.0)).collect()}
    elo = {}
    for r in sorted(m.collect(), key=lambda r: (r.match_ts, r.match_id)):
        a, b = elo.get(r.team1_id, 1500.0), elo.get(r.team2_id, 1500.0)
        assert got[r.match_id] == pytest.approx((a, b))
        d = 20.0 * (r.target_team1_win - 1 / (1 + 10 ** ((b - a) / 400)))
        elo[r.team1_id], elo[r.team2_id] = a + d, b - d
    gated = fold.elo_pools(m, "event_id", F.lit(20.0), F.lit(False)).collect()
    assert all(r.after1 == 1500.0 for r in gated)


def plain_elo(rows, top=lambda r: r.event_tier == "S-Tier"):
    """Ratings before each contest and after all, one a team; contests that are `top` weigh more."""
    elo, before = {}, {}
    for r in sorted(rows, key=lambda r: (r.match_ts, r.match_id)):
        a, b = before[r.match_id] = elo.get(r.team1_id, 1500.0), elo.get(r.team2_id, 1500.0)
        d = (28.0 if top(r) else 20.0) * (r.target_team1_win - 1 / (1 + 10 ** ((b - a) / 400)))
        elo[r.team1_id], elo[r.team2_id] = a + d, b - d
    return before, elo


def test_closed_pools(spark):
    pairs = spark.createDataFrame([(9, 8), (8, 7), (6, 7), (6, 5), (1, 2), (2, 3), (20, 21)], "team1_id int, team2_id int")
    assert dict(cells(fold.closed_pools(pairs, contest_plans.saved), "team_id", "pool")) == {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 1: 1, 2: 1, 3: 1, 20: 20, 21: 20}
    assert {r.team_id for r in fold.open_pools(contests(spark), "event_id").collect()} == set(range(5))


@pytest.mark.parametrize("stretch", [7, 1000])
def test_elo_carries_over_events_and_stretches(spark, stretch):
    m = contests(spark)
    other = m.select(*[(F.col(c) + n).alias(c) if n else c for c, n in zip(m.columns, (100, 0, 10, 10, 0, 0, 0, 0, 0, 0), strict=True)])
    both = m.unionByName(other)
    k = F.when(F.col("event_tier") == "S-Tier", 28.0).otherwise(20.0)
    got = {r.match_id: r for r in fold.elo(both.repartition(5), k, contest_plans.saved, stretch=stretch).collect()}
    before, _ = plain_elo(both.collect())
    assert got.keys() == before.keys() and {r.pool for r in got.values()} == {0, 10}
    assert all((got[i].elo1, got[i].elo2) == pytest.approx(e) for i, e in before.items())
    still = fold.elo(m, k, contest_plans.saved, F.lit(False), stretch).collect()
    assert all(r.after1 == 1500.0 for r in still)


def test_online_elo_carries_over(spark):
    rows = [(i, T0 + timedelta(hours=i // 3), i % 5, (i + 1 + i % 3) % 5, i % 4, (i * 7) % 3) for i in range(60)]
    rows = [r for r in rows if r[2] != r[3]]
    feed = spark.createDataFrame(rows + rows[::10], "event_id long, ts timestamp, team1_id int, team2_id int, score1 int, score2 int")
    elo, want = {2: 1600.0}, {}
    for e, _, a, b, s, t in rows:
        if s != t:
            x, y = elo.get(a, 1500.0), elo.get(b, 1500.0)
            d = 22.0 * min(1.35, 1.0 + 0.12 * abs(s - t)) * ((s > t) - 1 / (1 + 10 ** ((y - x) / 400)))
            want[e] = elo[a], elo[b] = round(x + d, 2), round(y - d, 2)
    got = fold.online(feed.repartition(3), contest_plans.saved, {2: 1600.0}, 7).collect()
    assert len(got) == len(want) and {r.event_id: (r.elo1, r.elo2) for r in got} == want


def test_registered_elo_and_state_keep_one_rating(spark):
    x = Fixtures(spark, "/root/testdata/sf0.001")
    before, last = plain_elo(contest_plans.tiered(x).collect(), lambda r: r.model_tier in ("T1", "T1_5"))
    got = {r.match_id: (r.elo1, r.elo2) for r in contest_plans.QUERIES["r01_elo"](spark, x.sf_dir).collect()}
    assert got.keys() == before.keys() and all(got[i] == pytest.approx(e) for i, e in before.items())
    state = contest_plans.QUERIES["r05_state"](spark, x.sf_dir).collect()
    assert len(state) == len(last) and all(r.elo == pytest.approx(last[r.team_id], abs=0.006) for r in state)


def test_form_is_the_fold(spark):
    sides = prior.contest_sides(contests(spark))
    want = {}
    for r in sorted(sides.collect(), key=lambda r: (r.match_ts, r.match_id)):
        f = want.get(r.team_id, 0.5)
        want[r.team_id] = f + 2 / 11 * (r.won - f)
    assert {r.team_id: r.form for r in fold.form_ewma(sides).collect()} == pytest.approx(want)


def test_reliability_bounds(spark):
    rows = spark.createDataFrame([(1, 0.3), (0, 1.0), (1, 0.0), (1, 0.95)], "y int, p double").withColumn("g", F.lit("x"))
    bins = {r.bin: (round(r.predicted, 6), r.n) for r in aggregate.reliability(rows, ["g"]).collect()}
    assert len(bins) == 10 and bins[2] == (0.3, 1) and bins[3] == (0.35, 0) and bins[9][1] == 2 and bins[0][1] == 1
    metrics = rows.agg(*aggregate.metric_columns()).first()
    assert metrics.rows == 4 and math.isfinite(metrics.log_loss)


def test_purge_and_split(spark):
    rows = spark.createDataFrame([(i, T0 + timedelta(days=i)) for i in range(300)], "id long, ts timestamp")
    folds = model.purged_folds(rows, "ts", "id", 5, 7, 20)
    by = {}
    for r in folds.collect():
        by.setdefault((r.fold, r.role), []).append(r.id)
    assert len(by) == 10 and all(max(by[f, "train"]) < min(by[f, "test"]) - 7 for f in range(5))
    assert sum(r.role == "train" for r in model.chronological_split(rows, "ts", "id").collect()) == 216


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, name string, n int")
    new = spark.createDataFrame([(1, None, 3), (3, "c", None)], "id int, name string, n int")
    out = lambda rules_: sorted(cells(merge.merge_columns(old, new, ["id"], rules_), "id", "name", "n"), key=str)
    assert out({"name": "fill", "n": "min"}) == [(1, "a", None), (2, "b", 5), (3, "c", None)]
    assert out({"name": "new", "n": "enrich"}) == [(1, None, 3), (2, "b", 5), (3, "c", None)]
    assert merge.merge_columns(old.limit(0), new.limit(0), ["id"], {"n": "fill"}).count() == 0
    assert cells(merge.replace_by_key(old, new.select("id", "name"), ["id"], "id").where("id = 1"), "name", "n") == [(None, None)]


def test_alias_rules(spark):
    names = spark.createDataFrame([(1, "NaVi"), (1, "G2 Esports"), (1, "FC"), (2, "xy")], "match_id int, raw string")
    teams = spark.createDataFrame([(1, "Natus Vincere"), (1, "G2"), (1, "Faze Clan"), (2, "A")], "match_id int, name string")
    trusted = spark.createDataFrame([("NaVi", "Natus Vincere")], "alias string, name string")
    found = {r.raw: r.resolved for r in joins.resolve_aliases(names, teams, "match_id", trusted).collect()}
    assert found == {"NaVi": "Natus Vincere", "FC": "Faze Clan"}


def test_bronze_files(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    assert io.read_bronze(spark, path, ["a", "b"]).count() == 0
    io.write_bronze(spark.createDataFrame([("1", 'x "q", y\nz'), ("2", None)], "b string, a string"), path, compression="gzip")
    assert sorted(cells(io.read_bronze(spark, path, ["b", "a", "missing"]), "b", "a", "missing")) == [("1", 'x "q", y\nz', None), ("2", None, None)]
    io.append_log(spark.createDataFrame([(1,)], "x int"), f"{path}-log")
    io.append_log(spark.createDataFrame([(2,)], "x int"), f"{path}-log")
    assert io.read_log(spark, f"{path}-log", "x int").count() == 2


def test_publish_keeps_the_last_good(spark, tmp_path):
    path, rows = f"file://{tmp_path}/p", spark.range(5)
    gate = lambda df: expect.passed(expect.report(expect.at_least(df, 3, "n"), expect.unique(df, ["id"], "id")))
    assert io.published(spark, path) is None
    assert io.publish(rows, path, "1", gate) and not io.publish(spark.range(1), path, "2", gate)
    assert io.published(spark, path).count() == 5


def test_partition_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    merge.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), path, ["d"])
    merge.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, d string"), path, ["d"])
    assert sorted(cells(spark.read.parquet(path), "v", "d")) == [(1, "a"), (9, "b")]


def test_pages(spark):
    html = '<h3>Results for May 1</h3><div class="result"><b>A</b> 2 - 1 <b>B</b></div><div class="result"><b>C</b> 0 - 2 <b>D</b></div><h3>Results for May 2</h3><div class="result"><b>E</b> 1 - 0 <b>F</b></div>'
    rows = spark.createDataFrame([(1, "http://x/y", html), (2, None, None), (3, "u", "| 1 | 1,900 | Alpha |\n| 2 | 800 | Beta | x |\n{{Match|opponent1=A|opponent2=B|score=2-0}}")], "page_id long, url string, html string")
    assert cells(pages.result_cards(rows).orderBy("page_id", "position"), "date", "team1", "score1", "team2") == [("May 1", "A", 2, "B"), ("May 1", "C", 0, "D"), ("May 2", "E", 1, "F")]
    assert cells(pages.ranking_rows(rows), "rank", "points", "team") == [(1, 1900, "Alpha"), (2, 800, "Beta")]
    assert cells(pages.wiki_matches(rows), "team1", "score1") == [("A", 2)]


def test_series_closed_form_is_the_walk(spark):
    def walk(p, need, w=0, l=0):
        return 1.0 if w == need else 0.0 if l == need else p * walk(p, need, w + 1, l) + (1 - p) * walk(p, need, w, l + 1)

    rows = spark.createDataFrame([(p / 10,) for p in range(11)], "p double")
    for n in (1, 3, 5):
        got = [r.s for r in rows.select(rules.series_probability(F.col("p"), n).alias("s")).collect()]
        assert got == pytest.approx([walk(p / 10, n // 2 + 1) for p in range(11)])


def test_gate_and_empty_inputs(spark):
    good = spark.createDataFrame([(400, 5, 0.60, 0.20, 0.65, 0.03)], "rows long, folds int, log_loss double, brier double, accuracy double, ece double")
    base = spark.createDataFrame([(400, 5, 0.63, 0.22, 0.64, 0.02)], good.schema)
    assert model.promotion_gate(good, base).first().promoted and not model.promotion_gate(base, good).first().promoted
    none = contests(spark).limit(0)
    assert prior.prior_features(prior.contest_sides(none)).count() == 0 and fold.form_ewma(prior.contest_sides(none)).count() == 0
    assert select.team_contests(none, F.lit("2025-01-01").cast("timestamp")).count() == 0


def test_boosted_trees_fit(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 7), int(i % 10 > 4)) for i in range(400)], "a double, b double, y int")
    fitted = model.boosted_trees(rows, ["a", "b"], "y", trees=3)
    assert fitted.getNumTrees == 3
    assert model.logistic_model(rows, ["a", "b"], "y").coefficients[0] > 0


def test_live_rows_follow_a_plain_loop(spark):
    """Known ids, draws, repeats and nulls give no row; features are those before the result, in stretches too."""
    import random

    rng = random.Random(5)
    feed = [(i, T0 + timedelta(hours=i // 2), rng.randint(1, 4), rng.randint(5, 7), rng.randint(0, 2), rng.randint(0, 2)) for i in range(60)]
    feed += [feed[10], (None, T0, 1, 5, 2, 0), (90, T0, None, 5, 2, 0), (91, T0, 1, 5, None, 0)]
    known = [(3,), (4,), (None,)]
    elo, want, seen = {9: 1.0}, {}, {3, 4, None}
    for event, ts, a, b, x, y in sorted((r for r in feed if None not in r), key=lambda r: (r[1], r[0])):
        if event in seen or x == y:
            continue
        seen.add(event)
        p, q = elo.get(a, 1500.0), elo.get(b, 1500.0)
        chance = 1 / (1 + 10 ** ((q - p) / 400))
        want[event] = (int(x > y), p - q, chance)
        d = 22 * min(1.35, 1 + 0.12 * abs(x - y)) * ((x > y) - chance)
        elo[a], elo[b] = p + d, q - d
    rows = spark.createDataFrame(feed, "event_id long, ts timestamp, team1_id int, team2_id int, score1 int, score2 int").repartition(3)
    out = fold.live_rows(rows, spark.createDataFrame(known, "event_id long"), lambda df: df.persist(), stretch=20)
    got = {r.event_id: (r.target_team1_win, r.elo_diff, r.elo_prob_team1) for r in out.collect()}
    assert set(got) == set(want) and all(got[e] == pytest.approx(want[e]) for e in want)


def test_live_rows_from_a_published_state(spark):
    """Ratings and form go on from the state, ranks stay; the stage gives the phase."""
    state = spark.createDataFrame([(1, 1600.0, 0.8, 3, 9000.0), (2, 1400.0, 0.4, 50, 1000.0)], "team_id int, elo double, recent_win_rate_10 double, rnk int, points double")
    feed = [(i, T0 + timedelta(hours=i), *pair, i % 3 if i % 2 else 2, 1, stage, bo, lan) for i, (pair, stage, bo, lan) in enumerate([((1, 2), "Grand final", 5, 1), ((2, 1), "Group A", None, None), ((1, 3), None, 0, 0), ((3, 2), "Lower bracket", 3, 1)])]
    elo, form, want = {1: 1600.0, 2: 1400.0}, {1: 0.8, 2: 0.4}, {}
    for event, _, a, b, x, y, *_ in feed:
        if x == y:
            continue
        p, q, f, g = elo.get(a, 1500.0), elo.get(b, 1500.0), form.get(a, 0.5), form.get(b, 0.5)
        want[event] = (p - q, max(-0.5, min(0.5, f - g)))
        d = 22 * min(1.35, 1 + 0.12 * abs(x - y)) * ((x > y) - 1 / (1 + 10 ** ((q - p) / 400)))
        elo[a], elo[b] = p + d, q - d
        form[a], form[b] = f + 2 / 11 * ((x > y) - f), g + 2 / 11 * ((y > x) - g)
    rows = spark.createDataFrame(feed, "event_id long, ts timestamp, team1_id int, team2_id int, score1 int, score2 int, stage string, best_of int, is_lan int")
    got = {r.event_id: r for r in fold.live_rows(rows, spark.createDataFrame([], "event_id long"), contest_plans.saved, stretch=2, state=state).collect()}
    assert set(got) == set(want) and len(want) == 3
    assert all((got[e].elo_diff, got[e].recent_win_rate_10_diff) == pytest.approx(want[e]) for e in want)
    assert (got[0].vrs_rank_advantage, got[0].vrs_points_diff, got[0].phase_order, got[0].best_of, got[0].is_lan) == (40, 8.0, 100, 5, 1)
    assert (got[2].vrs_rank_advantage, got[2].phase_order, got[2].best_of) == (0, 1, 3) and got[3].is_elimination == 1

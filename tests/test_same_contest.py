"""Feed contests of the same pair (J14) against all pairs, and the query against its SQL where ids run into each other."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from duelspark.operators import joins
from duelspark.plans import contests

T0 = datetime(2024, 1, 1)
SHAPE = "contest_id long, a int, b int, ts timestamp"


def rows(n, first, seed, step=1800):
    rng = random.Random(seed)
    out = [(first + i, rng.randrange(3), rng.randrange(3), T0 + timedelta(seconds=step * rng.randrange(200))) for i in range(n)]
    return [(i, a, b, t if i % 17 else None) for i, a, b, t in out if a != b]


@pytest.mark.parametrize("same_ids", [True, False])
def test_closest_of_a_pair_equals_all_pairs(spark, same_ids):
    left, feed = rows(90, 100, 1), rows(60, 150, 2)
    want = {}
    for i, a, b, t in left:
        if same_ids and any(j == i for j, *_ in feed):
            want[i] = (0.0, i)
            continue
        gaps = [(abs((t - u).total_seconds()) / 3600, j) for j, c, d, u in feed if {a, b} == {c, d} and t and u]
        if near := [g for g in gaps if g[0] < 5.0]:
            want[i] = min(near)
    found = joins.same_contest(spark.createDataFrame(left, SHAPE), spark.createDataFrame(feed, SHAPE), 5.0, same_ids)
    assert {r.contest_id: (r.gap, r.feed_id) for r in found.collect()} == want and 0 < len(want) < len(left)


def test_ids_of_a_large_feed_are_not_taken_for_clicks(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["click", "view", "click", "error"]
    events = [(base + i, T0 + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(10**6)), rng.randrange(64), kinds[i % 4], float(rng.randrange(100))) for base in (0, 1_000_000) for i in range(300)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(con.sql(contests.ORACLE["j14_same_contest"]).fetchall())
    assert want and sorted(map(tuple, contests.QUERIES["j14_same_contest"](spark, str(tmp_path)).collect())) == want

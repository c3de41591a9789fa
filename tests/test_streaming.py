"""One batch, many batches and replayed batches end in the same state."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelspark.operators import fold
from duelspark.sources.fixtures import Fixtures
from duelspark.streaming import live

SF = "/root/testdata/sf0.001"


def write_batches(spark, folder, n, replay=False):
    rows = Fixtures(spark, SF).feed.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").toPandas()
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows.iloc[i * size : (i + 1) * size]
        part.assign(ts=part["ts"].astype(str)).to_json(f"{folder}/{i:03d}.json", orient="records", lines=True)
        if replay:
            part.assign(ts=part["ts"].astype(str)).to_json(f"{folder}/{i:03d}-again.json", orient="records", lines=True)
    return rows


def run(spark, stream, name, mode="update"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("n,replay", [(1, False), (4, True)])
def test_rating_fold(spark, tmp_path, n, replay):
    folder = tmp_path / f"in{n}"
    folder.mkdir()
    write_batches(spark, folder, n, replay)
    live.keyed_state(spark)
    stream = live.snapshot_stream(spark, str(folder)).withColumn("pool", F.lit("all"))
    out = run(spark, live.rating_fold(stream, "pool", 100_000), f"ratings{n}").toPandas()
    final = out.groupby("team_id").tail(1).set_index("team_id")
    feed = Fixtures(spark, SF).feed.withColumn("pool", F.lit("all"))
    assert final["matches"].sum() == 2 * feed.select("event_id").distinct().count()
    if n == 1:
        batch = fold.online_elo(feed, "pool").toPandas()
        both = feed.select("event_id", "team1_id", "team2_id").distinct().toPandas().merge(batch, on="event_id")
        last = pd.concat([both[["event_id", "team1_id", "elo1"]].set_axis(["e", "t", "elo"], axis=1), both[["event_id", "team2_id", "elo2"]].set_axis(["e", "t", "elo"], axis=1)])
        assert set(last["t"]) == set(final.index)


def plain_fold(batches, keep):
    """The rule by hand, in order of arrival."""
    elo, n, seen = {}, {}, []
    for batch in batches:
        for event, _, a, b, s1, s2 in sorted((r for r in batch if None not in r), key=lambda r: (r[1], r[0])):
            if event in seen[-keep:] or s1 == s2:
                continue
            seen.append(event)
            x, y = elo.get(a, 1500.0), elo.get(b, 1500.0)
            delta = 22.0 * min(1.35, 1.0 + 0.12 * abs(s1 - s2)) * ((s1 > s2) - 1.0 / (1.0 + 10 ** ((y - x) / 400.0)))
            elo[a], elo[b] = round(x + delta, 2), round(y - delta, 2)
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return {t: (elo[t], n[t]) for t in elo}


@pytest.mark.parametrize("keep", [1500, 5])
def test_fold_survives_replays_late_results_and_a_restart(spark, tmp_path, keep):
    """Each file is a batch; the query stops after two and goes on from its checkpoint. With few ids kept, old ones count again."""
    rng = random.Random(keep)
    rows = [(i, f"2025-01-{1 + i // 6:02d} 00:00:00", rng.randint(1, 5), rng.randint(6, 9), rng.randint(0, 2), rng.randint(0, 2)) for i in range(60)]
    batches = [rows[20:40], rows[25:45] + rows[5:10] + [(99, "2025-02-01 00:00:00", None, 6, 2, 0)], rows[:20] + rows[40:60], rows[50:60] + [rows[0]]]
    live.keyed_state(spark)
    (tmp_path / "in").mkdir()
    final = {}

    def keep_last(df, _):
        final.update({r.team_id: (r.elo, r.matches) for r in df.collect()})

    for part in (batches[:2], batches[2:]):
        for batch in part:
            names = ["event_id", "ts", "team1_id", "team2_id", "score1", "score2"]
            at = len(list((tmp_path / "in").iterdir()))
            (tmp_path / "in" / f"{at:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, r)) | {"event_type": "click"}) for r in batch))
            os.utime(tmp_path / "in" / f"{at:03d}.json", (1e9 + at, 1e9 + at))  # files are read by their time
        stream = live.snapshot_stream(spark, str(tmp_path / "in")).withColumn("pool", F.lit("all"))
        query = live.rating_fold(stream, "pool", keep).writeStream.outputMode("update").foreachBatch(keep_last).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(180)
    assert final == plain_fold(batches, keep)
    assert (final == plain_fold([sum(batches, [])], 1500)) is False  # order of arrival counts


def test_filter_dedupe_and_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = write_batches(spark, folder, 3)
    kept = run(spark, live.product_only(live.snapshot_stream(spark, str(folder)), ["click"]), "kept", "append")
    assert kept.count() == (rows["event_type"] == "click").sum()
    once = run(spark, live.bounded_distinct(live.snapshot_stream(spark, str(folder)), "event_id", "ts", "10 days"), "once", "append")
    assert once.count() == rows["event_id"].nunique()
    counts = run(spark, live.windowed_counts(live.snapshot_stream(spark, str(folder)), "ts", "1 hour", "1 minute"), "counts", "append")
    assert 0 < counts.agg(F.sum("n")).first()[0] <= len(rows)


def test_upsert_is_gated_and_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_batches(spark, folder, 2, replay=True)
    target = {"rows": spark.createDataFrame([], "event_id long, score1 int, score2 int"), "n": 0}

    def write(df):
        target["rows"] = spark.createDataFrame(df.collect(), df.schema)
        target["n"] += 1

    stream = live.snapshot_stream(spark, str(folder))
    query = live.upsert_batches(stream, lambda: target["rows"], write, ["event_id"], {"score1": "enrich", "score2": "enrich"}, lambda df: df.count() > 0, f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    assert target["rows"].count() == Fixtures(spark, SF).feed.select("event_id").distinct().count() and target["n"] >= 2


def test_scored_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_batches(spark, folder, 1)
    ratings = spark.createDataFrame([(i, 1400.0 + 10 * i) for i in range(32)], "team_id int, elo double")
    out = run(spark, live.scored_stream(live.snapshot_stream(spark, str(folder)), ratings), "scored", "append").where("team1_id > team2_id")
    assert out.count() > 0 and out.where("p <= 0.5").count() == 0

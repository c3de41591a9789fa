"""The live feed as Structured Streaming jobs: source, tier filter, idempotent fold, dedupe, scoring and upsert sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duelspark.functions.rules import elo_probability
from duelspark.operators.merge import merge_columns

START = 1500.0
SNAPSHOT = "event_id long, ts timestamp, team1_id int, team2_id int, score1 int, score2 int, event_type string"


def snapshot_stream(spark: SparkSession, folder: str, schema: str = SNAPSHOT, files_per_trigger: int = 1) -> DataFrame:
    """JSON documents as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def product_only(rows: DataFrame, eligible: list[str]) -> DataFrame:
    """Rows of eligible kinds that are decisive."""
    return rows.where(F.col("event_type").isin(*eligible) & (F.col("score1") != F.col("score2")))


def bounded_distinct(rows: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first row of each key inside a time bound, which also bounds the state (T04); in a batch, one row of each key."""
    if not rows.isStreaming:
        return rows.dropDuplicates([key])
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Let streams of this session keep their state in RocksDB, as `rating_fold` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Ratings(StatefulProcessor):
    """A pool's ratings and contests by team, and the ids it has seen, each an entry of its own in the state store.

    Seen ids are numbered as they come; when one more than keep_ids has come, the oldest is forgotten. A batch reads and
    writes the teams and ids it touches and nothing else, so a pool of very many teams is never held or rewritten whole.
    """

    def __init__(self, keep_ids: int):
        self.keep_ids = keep_ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team_id int", "elo double, matches long")
        self.seen = handle.getMapState("seen", "event_id long", "number long")
        self.order = handle.getMapState("order", "number long", "event_id long")
        self.count = handle.getValueState("count", "number long")

    def _is_new(self, event: int, number: int) -> bool:
        if self.seen.containsKey((event,)):
            return False
        self.seen.updateValue((event,), (number,))
        self.order.updateValue((number,), (event,))
        if number >= self.keep_ids:
            oldest = self.order.getValue((number - self.keep_ids,))
            self.seen.removeKey((oldest[0],))
            self.order.removeKey((number - self.keep_ids,))
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        number = self.count.get()[0] if self.count.exists() else 0
        known: dict[int, tuple[float, int]] = {}

        def state(team: int) -> tuple[float, int]:
            if team not in known:
                known[team] = tuple(self.teams.getValue((team,))) if self.teams.containsKey((team,)) else (START, 0)
            return known[team]

        group = pd.concat(list(rows)).dropna(subset=["event_id", "team1_id", "team2_id", "score1", "score2"]).sort_values(["ts", "event_id"])
        for event, a, b, s1, s2 in zip(*[group[c].tolist() for c in ("event_id", "team1_id", "team2_id", "score1", "score2")], strict=True):
            if s1 == s2 or not self._is_new(int(event), number):
                continue
            number += 1
            (x, n), (y, m) = state(int(a)), state(int(b))
            delta = 22.0 * min(1.35, 1.0 + 0.12 * abs(s1 - s2)) * (float(s1 > s2) - 1.0 / (1.0 + 10 ** ((y - x) / 400.0)))
            known[int(a)], known[int(b)] = (round(x + delta, 2), n + 1), (round(y - delta, 2), m + 1)
        for team, value in known.items():
            self.teams.updateValue((team,), value)
        self.count.update((number,))
        order = sorted(known)
        pool = pd.Series([key[0]] * len(order), dtype=object)
        yield pd.DataFrame({"pool": pool, "team_id": order, "elo": [known[t][0] for t in order], "matches": [known[t][1] for t in order]}).astype({"team_id": "int32", "elo": "float64", "matches": "int64"})

    def close(self) -> None:
        pass


def rating_fold(rows: DataFrame, pool: str, keep_ids: int = 1500) -> DataFrame:
    """(pool, team_id, elo, matches) as updates, a row for each team a batch touches.

    A result whose id is among the last keep_ids changes nothing. Results of a batch are applied in (ts, id) order; late
    ones on arrival, the batch fold being their backfill (T05). Draws and rows with nulls are passed over. The session has
    to keep stream state in RocksDB: `keyed_state`.
    """
    kind = rows.schema[pool].dataType.simpleString()
    return rows.groupBy(pool).transformWithStateInPandas(Ratings(keep_ids), f"pool {kind}, team_id int, elo double, matches long", "Update", "None")


def scored_stream(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Stream rows with a probability from static ratings."""
    r = lambda side, out: ratings.select(F.col("team_id").alias(side), F.col("elo").alias(out))
    joined = rows.join(r("team1_id", "e1"), "team1_id", "left").join(r("team2_id", "e2"), "team2_id", "left")
    return joined.withColumn("p", elo_probability(F.coalesce("e1", F.lit(1500.0)) - F.coalesce("e2", F.lit(1500.0))))


def upsert_batches(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str], rules: dict[str, str], gate: Callable[[DataFrame], bool], checkpoint: str):
    """A started query whose batches are merged into a table and written only if the gate passes.

    `rules` are those of merge_columns. A batch that runs again merges the same values, so a retry changes nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        latest = df.groupBy(*key).agg(F.max_by(F.struct(*rules), F.col("ts")).alias("v")).select(*key, "v.*")
        merged = merge_columns(read(), latest, key, rules)
        if gate(merged):
            write(merged)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Results and teams by event-time window, late rows within a bound; append mode emits closed windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score1") > F.col("score2")).cast("int")).alias("first_wins"))

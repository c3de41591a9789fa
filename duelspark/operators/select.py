"""Sorts, limits, top-k, set operations and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelspark.functions.clean import name_key, slug_key

from .merge import insert_ignore
from .prior import contest_sides, latest_per


def priority_queue(rows: DataFrame, high: Column, stars: str, top: int) -> DataFrame:
    """High-profile first, then stars, date and id, all descending (O02); a top-k, no full sort."""
    return rows.withColumn("high_profile", high.cast("int")).orderBy(F.col("high_profile").desc(), F.col(stars).desc(), F.col("match_ts").desc(), F.col("match_id").desc()).limit(top)


def latest_top(rankings: DataFrame, n: int) -> DataFrame:
    """The first n ranks of the latest date."""
    return latest_per(rankings, "ranking_date").where(F.col("rnk") <= n)


def calendar(events: DataFrame, today: Column, n: int = 12) -> DataFrame:
    """Events that haven't ended, by start and name."""
    return events.where(F.col("last_ts") >= today).orderBy("first_ts", "event_id").limit(n)


def signal_ranking(matches: DataFrame, ranks: DataFrame, n: int = 20) -> DataFrame:
    """Contests by the sum of 220 - rank over ranked sides."""
    r = lambda side: ranks.select(F.col("team_id").alias(side), F.col("rnk").alias(f"{side}_rnk"))
    both = matches.select("match_id", "team1_id", "team2_id").join(F.broadcast(r("team1_id")), "team1_id", "left").join(F.broadcast(r("team2_id")), "team2_id", "left")
    score = sum(F.coalesce(220 - F.col(f"{s}_rnk"), F.lit(0)) for s in ("team1_id", "team2_id"))
    return both.select("match_id", score.alias("signal")).orderBy(F.col("signal").desc(), "match_id").limit(n)


def search(rows: DataFrame, kind: str, label: str, text: str, cap: int, order: Column) -> DataFrame:
    """Normalised contains, at most cap of each kind in its own order."""
    hit = rows.where(name_key(F.col(label)).contains(" ".join(text.lower().split())))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order, label))
    return hit.withColumn("place", place).where(F.col("place") <= cap)


def batches(rows: DataFrame, scope: str, order: str, size: int) -> DataFrame:
    """rows with the number of their fixed-size batch in a scope."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(scope).orderBy(order)) - 1) / size))


def team_contests(matches: DataFrame, now: Column, cap: int = 8) -> DataFrame:
    """A team's future contests, the next first, then past ones, the latest first."""
    rows, future = contest_sides(matches), F.col("match_ts") >= now
    seconds = F.unix_timestamp("match_ts")
    place = F.row_number().over(Window.partitionBy("team_id").orderBy(F.when(future, 0).otherwise(1), F.when(future, seconds).otherwise(-seconds), F.when(future, F.col("match_id")).otherwise(-F.col("match_id"))))
    return rows.withColumn("place", place).where(F.col("place") <= cap).select("team_id", "match_id", "place")


def field_cut(field: DataFrame, score: str, size: Column) -> DataFrame:
    """The strongest of an event's field, as many as its playoff takes."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col(score).desc(), "team_id"))
    return field.withColumn("place", place).where(F.col("place") <= size)


# -- work queues


def missing_children(matches: DataFrame, children: DataFrame, key: str = "match_id") -> DataFrame:
    """Contests without child rows."""
    return matches.join(children.select(key).distinct(), key, "left_anti")


def missing_windows(players: DataFrame, have: DataFrame, windows: list[str]) -> DataFrame:
    """(player_id, window) not collected yet."""
    want = players.select("player_id").distinct().withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    return want.join(have, ["player_id", "window"], "left_anti")


def seed_queue(queue: DataFrame, rankings: DataFrame, n: int, kinds: list[str]) -> DataFrame:
    """The queue with a pending row for each kind of work on the latest top n."""
    new = latest_top(rankings, n).select("team_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col("rnk").alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return insert_ignore(queue, new, ["team_id", "kind"])


def mark(queue: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Status of the keys that came back, one attempt more."""
    back = done.select(*key, F.col("status").alias("__status"))
    out = queue.join(back, key, "left")
    return out.withColumn("attempts", F.col("attempts") + F.col("__status").isNotNull().cast("int")).withColumn("status", F.coalesce("__status", "status")).drop("__status")


#: The tiers that leave the warehouse, and the date of what has none.
PRODUCT_TIERS, NO_DATE = ("tier_1", "tier_2"), "9999-12-31"


def tier_gate(events: DataFrame, matches: DataFrame, players: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, matches, players) that may leave the warehouse.

    Events: (event_id, name, tier). A contest is kept if its event is, by id or by name, else by the tier it states itself,
    and takes the event's tier first. Players: (match_id, player_id), those in kept contests.
    """
    kept = events.where(F.col("tier").isin(*PRODUCT_TIERS))
    by_id = kept.select("event_id", F.col("tier").alias("__by_id")).dropDuplicates(["event_id"])
    by_name = kept.groupBy(slug_key(F.col("name")).alias("__slug")).agg(F.min("tier").alias("__by_name"))
    rows = matches.withColumn("__slug", slug_key(F.col("event_name"))).join(by_id, "event_id", "left").join(by_name, "__slug", "left")
    tier = F.coalesce("__by_id", "__by_name", F.when(F.col("event_tier").isin(*PRODUCT_TIERS), F.col("event_tier")))
    games = rows.withColumn("product_tier", tier).where("product_tier is not null").select(*matches.columns, "product_tier")
    return kept, games, players.join(games.select("match_id"), "match_id", "left_semi")


def not_before(date: Column, bound: str) -> Column:
    """Whether a date is at or after a bound; what has no date is (P10)."""
    return F.coalesce(date.cast("date"), F.lit(NO_DATE).cast("date")) >= F.lit(bound).cast("date")


def detail_queue(matches: DataFrame, details: DataFrame, high: Column, stars: str, top: int) -> DataFrame:
    """Contests without details, the most important first."""
    return priority_queue(missing_children(matches, details), high, stars, top)

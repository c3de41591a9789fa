"""Strictly-prior features, as-of joins and side unpivots.

Contest order is (time, id). A feature of a contest reads only contests before it, for which windows end one row short.
Both sides of a contest are exploded from one scan; what a team, a pair or a map has behind it is added up in two levels
(`carry.running`), months first, so that the work of a very popular one spreads over its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import bucket_of, mean, month, running

SECONDS_PER_DAY = 86400.0


def sides(matches: DataFrame, left: dict[str, str], right: dict[str, str], keep: list[str]) -> DataFrame:
    """One row a contest and side (A01): `side` 1 or 2, the mapped columns and those to keep."""
    rows = [F.struct(F.lit(n).alias("side"), *[F.col(c).alias(name) for name, c in spec.items()]) for n, spec in ((1, left), (2, right))]
    return matches.select(*keep, F.inline(F.array(*rows)))


def contest_sides(matches: DataFrame) -> DataFrame:
    base = matches.withColumn("won1", F.col("target_team1_win")).withColumn("won2", 1 - F.col("target_team1_win"))
    keep = [c for c in ("match_id", "match_ts", "event_id", "match_phase", "is_playoff", "is_elimination", "updates_state") if c in matches.columns]
    return sides(base, {"team_id": "team1_id", "opponent_id": "team2_id", "won": "won1"}, {"team_id": "team2_id", "opponent_id": "team1_id", "won": "won2"}, keep)


def _rate(wins: Column, n: Column) -> Column:
    return F.when(n > 0, wins / n).otherwise(0.5)


def _one(known: Column) -> Column:
    return F.when(known, 1).otherwise(0)


def prior_features(side_rows: DataFrame, rest_default: float = 14.0, rest_cap: float = 30.0) -> DataFrame:
    """Adds prior counts and rates (W01), recent-10 (W02), playoff and elimination rates (W03) and days of rest."""
    won, flags = F.col("won"), ("is_playoff", "is_elimination")
    sums = {"prior_matches": _one(won.isNotNull()), "prior_wins": won}
    for flag in flags:
        sums |= {f"__n_{flag}": _one(F.col(flag) == 1), f"__w_{flag}": F.when(F.col(flag) == 1, won)}
    out = running(side_rows, ["team_id"], ["match_ts", "match_id"], month(F.col("match_ts")), sums=sums, tails={"__ten": (won, 10)}, latest={"__since": F.col("match_ts")})
    gap = (F.unix_timestamp("match_ts") - F.unix_timestamp("__since")) / SECONDS_PER_DAY
    return out.select(
        *side_rows.columns,
        "prior_matches",
        "prior_wins",
        _rate(F.col("prior_wins"), F.col("prior_matches")).alias("prior_win_rate"),
        F.coalesce(mean(F.col("__ten")), F.lit(0.5)).alias("recent_win_rate_10"),
        *[_rate(F.col(f"__w_{flag}"), F.col(f"__n_{flag}")).alias(f"prior_{flag.removeprefix('is_')}_win_rate") for flag in flags],
        F.least(F.coalesce(gap, F.lit(rest_default)), F.lit(rest_cap)).alias("days_rest"),
    )


def head_to_head(matches: DataFrame) -> DataFrame:
    """(match_id, h2h_win_rate_team1, h2h_match_count) before each contest."""
    low = F.least("team1_id", "team2_id")
    low_won = F.when(F.col("team1_id") == low, F.col("target_team1_win")).otherwise(1 - F.col("target_team1_win"))
    rows = matches.select("match_id", "match_ts", low.alias("low"), F.greatest("team1_id", "team2_id").alias("high"), (F.col("team1_id") == low).alias("is_low"), low_won.alias("low_won"))
    out = running(rows, ["low", "high"], ["match_ts", "match_id"], month(F.col("match_ts")), sums={"n": _one(F.col("low_won").isNotNull()), "wins": F.col("low_won")})
    own = F.when(F.col("is_low"), F.col("wins")).otherwise(F.col("n") - F.col("wins"))
    return out.select("match_id", _rate(own, F.col("n")).alias("h2h_win_rate_team1"), F.col("n").alias("h2h_match_count"))


def asof_join(rows: DataFrame, history: DataFrame, key: list[str], at: str, since: str, values: list[str], strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """rows with the latest history at or before their time (J04), or strictly before.

    One union and two levels of windows instead of a range join: every row is shuffled once, no pair is made, and a popular
    key spreads over its months, or over what `bucket` makes of `__at`, the time of either side. History that repeats a key
    and time should be reduced first; of such rows the one with the largest values wins.
    """
    tag = F.lit(0 if strict else 1)
    extra = [c for c in rows.columns if c not in key]
    left = rows.select(*key, F.col(at).alias("__at"), tag.alias("__order"), F.struct(*extra).alias("__row"), F.lit(None).cast(_struct(history, values)).alias("__value"))
    right = history.select(*key, F.col(since).alias("__at"), F.lit(1 - (0 if strict else 1)).alias("__order"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__value"))
    both = left.unionByName(right)
    order = ["__at", "__order", F.when(F.col("__row").isNull(), F.col("__value"))]
    seen = running(both, list(key), order, bucket_of(both, "__at") if bucket is None else bucket, known={"__seen": F.col("__value")}).where("__row is not null")
    return seen.select(*key, "__row.*", *[F.col(f"__seen.{v}").alias(v) for v in values])


def _struct(df: DataFrame, names: list[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType


def asof_two_keys(rows: DataFrame, history: DataFrame, keys: tuple[str, str], at: str, since: str, value: str) -> DataFrame:
    """As-of by either of two keys (J05): two as-of joins; the later date wins, a tie goes to the first key."""
    out = rows
    for i, key in enumerate(keys):
        dated = history.where(F.col(key).isNotNull()).select(key, F.col(since).alias(f"__since{i}"), F.col(value).alias(f"__value{i}"))
        out = asof_join(out, dated, [key], at, f"__since{i}", [f"__since{i}", f"__value{i}"])
    first = F.col("__since1").isNull() | (F.col("__since0") >= F.col("__since1"))
    return out.withColumn(value, F.when(first, F.col("__value0")).otherwise(F.col("__value1"))).drop("__since0", "__value0", "__since1", "__value1")


def prior_map_rates(maps: DataFrame, matches: DataFrame, prior: float = 0.0) -> DataFrame:
    """(match_id, team_id, map_name, n, wins, rate) before each contest; maps of the same contest don't count."""
    won = (F.col("rounds") > F.col("other")).cast("int")
    played = maps.where("map_name not in ('TBA', 'Default') and team1_rounds is not null and team2_rounds is not null")
    rows = sides(played, {"team_id": "team1_id", "rounds": "team1_rounds", "other": "team2_rounds"}, {"team_id": "team2_id", "rounds": "team2_rounds", "other": "team1_rounds"}, ["match_id", "map_name"])
    one = rows.groupBy("match_id", "team_id", "map_name").agg(F.count(F.lit(1)).alias("__n"), F.sum(won).alias("__wins"))
    timed = one.join(matches.select("match_id", "match_ts"), "match_id")
    out = running(timed, ["team_id", "map_name"], ["match_ts", "match_id"], month(F.col("match_ts")), sums={"n": F.col("__n"), "wins": F.col("__wins")})
    n, wins = F.col("n"), F.col("wins")
    return out.select("match_id", "team_id", "map_name", "n", "wins", F.when(n > 0, (wins + 0.5 * prior) / (n + prior)).otherwise(0.5).alias("rate"))


def map_advantages(maps: DataFrame, matches: DataFrame, priors: tuple[float, ...]) -> DataFrame:
    """(match_id, map_evidence, map_advantage_0, ...): as `map_advantage`, for several prior strengths from one pass."""
    rates = prior_map_rates(maps, matches)
    played = maps.where("map_name not in ('TBA', 'Default')").select("match_id", "map_index", "map_name", "team1_id", "team2_id")
    one = lambda side: rates.select("match_id", "map_name", F.col("team_id").alias(f"team{side}_id"), F.col("n").alias(f"n{side}"), F.col("wins").alias(f"w{side}"))
    both = played.join(one(1), ["match_id", "map_name", "team1_id"]).join(one(2), ["match_id", "map_name", "team2_id"])
    rate = lambda side, k: F.when(F.col(f"n{side}") > 0, (F.col(f"w{side}") + 0.5 * k) / (F.col(f"n{side}") + k)).otherwise(0.5)
    return both.groupBy("match_id").agg(F.sum(F.col("n1") + F.col("n2")).alias("map_evidence"), *[F.avg(rate(1, k) - rate(2, k)).alias(f"map_advantage_{i}") for i, k in enumerate(priors)])


def map_advantage(maps: DataFrame, matches: DataFrame, prior: float = 0.0) -> DataFrame:
    """(match_id, map_advantage, map_evidence): mean rate difference over a contest's maps, and the maps behind it."""
    rates = prior_map_rates(maps, matches, prior)
    played = maps.where("map_name not in ('TBA', 'Default')").select("match_id", "map_index", "map_name", "team1_id", "team2_id")
    a = rates.select("match_id", "map_name", F.col("team_id").alias("team1_id"), F.col("rate").alias("r1"), F.col("n").alias("n1"))
    b = rates.select("match_id", "map_name", F.col("team_id").alias("team2_id"), F.col("rate").alias("r2"), F.col("n").alias("n2"))
    both = played.join(a, ["match_id", "map_name", "team1_id"]).join(b, ["match_id", "map_name", "team2_id"])
    return both.groupBy("match_id").agg(F.avg(F.col("r1") - F.col("r2")).alias("map_advantage"), F.sum(F.col("n1") + F.col("n2")).alias("map_evidence"))


def gated_features(side_rows: DataFrame, flag: str = "updates_state") -> DataFrame:
    """Prior counts, recent-10 and days of rest where only flagged contests change a team's state, every contest reads.

    Flagged rows carry the state after them; each row takes the latest of those strictly before it in contest order.
    """
    won = F.col("won")
    past = running(side_rows.where(F.col(flag)), ["team_id"], ["match_ts", "match_id"], month(F.col("match_ts")), sums={"__n": _one(won.isNotNull()), "__wins": won}, tails={"__nine": (won, 9)})
    state = past.select(
        "team_id", F.struct("match_ts", "match_id").alias("since"), (F.col("__n") + _one(won.isNotNull())).alias("n"), (F.col("__wins") + F.coalesce(won, F.lit(0))).alias("wins"),
        mean(F.concat("__nine", F.array(F.struct(won.alias("v"))))).alias("recent"), F.col("match_ts").alias("last_ts"),
    )
    rows = side_rows.withColumn("at", F.struct("match_ts", "match_id"))
    out = asof_join(rows, state, ["team_id"], "at", "since", ["n", "wins", "recent", "last_ts"], strict=True)
    gap = (F.unix_timestamp("match_ts") - F.unix_timestamp("last_ts")) / SECONDS_PER_DAY
    n = F.coalesce("n", F.lit(0))
    return out.select("match_id", "team_id", "side", n.alias("prior_matches"), _rate(F.coalesce("wins", F.lit(0)), n).alias("prior_win_rate"), F.coalesce("recent", F.lit(0.5)).alias("recent_win_rate_10"), F.least(F.coalesce(gap, F.lit(14.0)), F.lit(30.0)).alias("days_rest"))


def recent_form(stats: DataFrame, key: str, order: list[str], value: str, n: int = 3) -> DataFrame:
    """(key, recent, previous, delta): mean of the last n known values, of the n before, and their difference."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    ranked = stats.where(F.col(value).isNotNull()).withColumn("__place", place).where(F.col("__place") <= 2 * n)
    recent, previous = (F.avg(F.when(F.col("__place").between(a, b), F.col(value))) for a, b in ((1, n), (n + 1, 2 * n)))
    return ranked.groupBy(key).agg(recent.alias("recent"), previous.alias("previous")).withColumn("delta", F.col("recent") - F.col("previous"))


def player_timeline(lines: DataFrame, matches: DataFrame, most: int = 18) -> DataFrame:
    """(player_id, place, match_id, match_ts, team_id, opponent_id, won): a player's latest contests, the earliest first.

    lines: (player_id, match_id, match_ts, team_id), one a contest. A result is the winner's id if that and the team are
    known, else the scores' if they differ, else unknown. The opponent is the first side unless the player's team is that.
    """
    order = Window.partitionBy("player_id").orderBy(F.col("match_ts").desc(), F.col("match_id").desc(), F.col("team_id").desc())
    recent = lines.where("match_ts is not null").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    rows = recent.join(matches.select("match_id", "team1_id", "team2_id", "winner_team_id", "team1_score", "team2_score"), "match_id")
    team, first = F.col("team_id"), F.col("team1_id")
    mine = ((first == team) & (F.col("team1_score") > F.col("team2_score"))) | ((F.col("team2_id") == team) & (F.col("team2_score") > F.col("team1_score")))
    by_score = F.when(F.col("team1_score") != F.col("team2_score"), F.coalesce(mine, F.lit(False)))
    won = F.coalesce(F.col("winner_team_id") == team, by_score)
    opponent = F.when(first == team, F.col("team2_id")).otherwise(first)
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.col("__n").desc()))
    return rows.select("player_id", place.alias("place"), "match_id", "match_ts", "team_id", opponent.alias("opponent_id"), won.alias("won"))


def latest_per(rows: DataFrame, date: str, region: str | None = None) -> DataFrame:
    """The rows of the latest date, overall or in each region."""
    if region is None:
        return rows.join(F.broadcast(rows.agg(F.max(date).alias(date))), date, "left_semi")
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(region).orderBy(F.col(date).desc()))).where("__r = 1").drop("__r")


def carried_heading(rows: DataFrame, page: str, position: str, heading: str) -> DataFrame:
    """Each row with the last heading before it on its page."""
    before = Window.partitionBy(page).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(heading, ignorenulls=True).over(before))


def heading_stack(rows: DataFrame, page: str, position: str, level: str, heading: str, levels: int = 4) -> DataFrame:
    """Each row with the heading of every level above it; a heading clears the deeper ones."""
    before = Window.partitionBy(page).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda cond: F.max(F.when(cond, F.col(position))).over(before)
    for n in range(1, levels + 1):
        own, shallower = at(F.col(level) == n), at(F.col(level) < n)
        text = F.last(F.when(F.col(level) == n, F.col(heading)), ignorenulls=True).over(before)
        rows = rows.withColumn(f"h{n}", F.when(shallower.isNull() | (own > shallower), text))
    return rows


def playoff_rounds(matches: DataFrame) -> DataFrame:
    """(match_id, round_name) of playoff contests by how many an event plays on a date and whether it is the last."""
    day = Window.partitionBy("event_id", "match_date")
    rows = matches.withColumn("n", F.count(F.lit(1)).over(day)).withColumn("last", F.max("match_date").over(Window.partitionBy("event_id")) == F.col("match_date"))
    long_final = F.max(F.col("best_of") >= 5).over(day)
    name = (
        F.when(F.col("match_phase").contains("quarter"), "Quarterfinals")
        .when(F.col("match_phase").contains("semi"), "Semifinals")
        .when(F.col("match_phase").isin("final", "grand_final"), "Grand final")
        .when(F.col("last") & ((F.col("n") == 1) | (F.col("best_of") >= 5)), "Grand final")
        .when(F.col("last") & long_final, "Third place")
        .when(F.col("n") >= 4, "Quarterfinals")
        .when(F.col("n") == 2, "Semifinals")
        .otherwise(F.when(F.col("last"), "Grand final").otherwise("Playoff round"))
    )
    return rows.select("match_id", name.alias("round_name"))

"""Features that a model may ask for by name, and what computes each.

Every feature of a contest reads what was known before it: its line-ups are announced, all else is of earlier contests.
Line-ups, ratings, venues and map choices of a team are running values in two levels (`carry`), sets among them.

Defined cases: a side without a line-up, or whose team had none before, has no continuity; without rated players in the
three months before it has no rating; such differences are null. A team without contests at a venue has the rate 0.5, one
that never chose a map the rate 0. A feature whose inputs nobody records is registered without a column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import month, running
from .prior import gated_features

Save = Callable[[DataFrame], DataFrame]
DAYS = 90


def continuity(lineups: DataFrame) -> DataFrame:
    """(match_id, team_id, value): the share of a line-up that stood in the team's line-up before.

    lineups: (match_id, match_ts, team_id, players), a set for each contest and team.
    """
    out = running(lineups, ["team_id"], ["match_ts", "match_id"], month(F.col("match_ts")), latest={"before": F.col("players")})
    share = F.size(F.array_intersect("players", "before")) / F.nullif(F.size("players"), F.lit(0))
    return out.select("match_id", "team_id", F.when(F.col("before").isNotNull(), share).alias("value"))


def ratings(lines: DataFrame, value: Callable[[Column], Column], days: int = DAYS) -> DataFrame:
    """(match_id, team_id, value) of a line-up's players by their mean ratings of the days before the contest.

    lines: (match_id, match_ts, team_id, player_id, rating); `value` is an aggregate over the players' means.
    """
    return lineup_ratings(lines, {"value": value}, days)


def lineup_ratings(lines: DataFrame, values: dict[str, Callable[[Column], Column]], days: int = DAYS) -> DataFrame:
    """`ratings` for several aggregates at once.

    A player's lines of one second are added up before the window, which so reads as many rows as the player has times.
    """
    timed = lines.select("match_id", "team_id", "player_id", F.unix_timestamp("match_ts").alias("at"), "rating")
    past = Window.partitionBy("player_id").orderBy("at").rangeBetween(-days * 86_400, -1)
    totals = timed.groupBy("player_id", "at").agg(F.sum("rating").alias("total"), F.count("rating").alias("n"))
    means = totals.select("player_id", "at", (F.sum("total").over(past) / F.nullif(F.sum("n").over(past), F.lit(0))).alias("mean"))
    # one shuffle by contest serves both groupings
    each = timed.select("match_id", "team_id", "player_id", "at").join(means, ["player_id", "at"], "left").select("match_id", "team_id", "player_id", "mean").repartition("match_id")
    each = each.groupBy("match_id", "team_id", "player_id").agg(F.max("mean").alias("mean"))
    return each.groupBy("match_id", "team_id").agg(*[f(F.col("mean")).alias(n) for n, f in values.items()])


def venue_rate(side_rows: DataFrame, flag: str) -> DataFrame:
    """(match_id, team_id, value): the rate of the last ten earlier contests that have the flag."""
    lean = side_rows.select("match_id", "match_ts", "team_id", "side", "won", flag)
    return gated_features(lean.withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False))), flag).select("match_id", "team_id", F.col("recent_win_rate_10").alias("value"))


def choice_rates(side_rows: DataFrame, maps: DataFrame, vetoes: DataFrame, actions: dict[str, str], save: Save = lambda df: df) -> DataFrame:
    """(match_id, team_id, a column for each action): how often the team chose the contest's maps so before, each per earlier contest, on average.

    actions: column and what a veto calls the choice. Maps and choices of a contest are gathered to it, few as they are, so
    that all joins are by contest.
    """
    known = F.when(F.col("won").isNotNull(), 1).otherwise(0)
    earlier = running(side_rows.select("match_id", "match_ts", "team_id", "won"), ["team_id"], ["match_ts", "match_id"], month(F.col("match_ts")), sums={"prior_matches": known}).drop("won")
    played = maps.where("map_name not in ('TBA', 'Default')").groupBy("match_id").agg(F.collect_set("map_name").alias("maps"))
    chosen = vetoes.where(F.col("action").isin(*actions.values())).groupBy("match_id").agg(F.collect_list(F.struct("team_id", "map_name", "action")).alias("chosen"))
    rows = earlier.join(played, "match_id").join(chosen, "match_id", "left").select("match_id", "match_ts", "team_id", "prior_matches", "chosen", F.explode("maps").alias("map_name"))

    def times(action: str) -> Column:
        return F.size(F.filter(F.coalesce("chosen", F.array().cast(chosen.schema["chosen"].dataType)), lambda c: (c["team_id"] == F.col("team_id")) & (c["map_name"] == F.col("map_name")) & (c["action"] == action)))

    rows = save(rows.select("match_id", "match_ts", "team_id", "prior_matches", "map_name", *[times(a).alias(f"__{n}") for n, a in actions.items()]))
    out = running(rows, ["team_id", "map_name"], ["match_ts", "match_id"], month(F.col("match_ts")), sums={n: F.col(f"__{n}") for n in actions})
    rate = lambda n: F.when(F.col("prior_matches") > 0, F.col(n) / F.col("prior_matches")).otherwise(0.0)
    return out.groupBy("match_id", "team_id").agg(*[F.avg(rate(n)).alias(n) for n in actions])


def choice_rate(side_rows: DataFrame, maps: DataFrame, vetoes: DataFrame, action: str) -> DataFrame:
    """(match_id, team_id, value): `choice_rates` of one action."""
    return choice_rates(side_rows, maps, vetoes, {"value": action})


@dataclass(frozen=True)
class Inputs:
    """Tables that declared features read; see the functions for their columns. `save` writes a step and reads it back."""

    matches: DataFrame
    side_rows: DataFrame
    lines: DataFrame
    maps: DataFrame
    vetoes: DataFrame
    save: Save = lambda df: df

    @property
    def lineups(self) -> DataFrame:
        return self.lines.groupBy("match_id", "team_id").agg(F.max("match_ts").alias("match_ts"), F.collect_set("player_id").alias("players"))


@dataclass(frozen=True)
class Part:
    """A column of what several features come from: `whole` gives (match_id, team_id, columns) and is made once for them."""

    whole: Callable[[Inputs], DataFrame]
    column: str = "value"

    def __call__(self, inputs: Inputs) -> DataFrame:
        return self.whole(inputs).select("match_id", "team_id", F.col(self.column).alias("value"))


def _lineup_ratings(x: Inputs) -> DataFrame:
    return lineup_ratings(x.lines, {"mean": F.avg, "top": F.max})


def _choice_rates(x: Inputs) -> DataFrame:
    return choice_rates(x.side_rows, x.maps, x.vetoes, {"picks": "picked", "bans": "removed"}, x.save)


#: Name: (level, what gives (match_id, team_id, value), or the name of a contest feature that holds it, or None).
REGISTRY: dict[str, tuple[str, Callable[[Inputs], DataFrame] | str | None]] = {
    "hltv_rank_diff": ("team", "rank_advantage"),
    "roster_continuity_diff": ("team", lambda x: continuity(x.lineups)),
    "avg_player_rating_3m_diff": ("player", Part(_lineup_ratings, "mean")),
    "top_player_rating_3m_diff": ("player", Part(_lineup_ratings, "top")),
    "recent_lan_win_rate_diff": ("team", lambda x: venue_rate(x.side_rows, "is_lan")),
    "map_pick_rate_diff": ("map", Part(_choice_rates, "picks")),
    "map_ban_rate_diff": ("map", Part(_choice_rates, "bans")),
    "event_tier": ("context", "event_tier"),
    "lan_flag": ("context", "is_lan"),
    "days_rest_diff": ("context", "days_rest_diff"),
    # what nobody records here: a second ranking, styles of play, opponents' ranks a map
    "valve_rank_diff": ("team", None),
    "entrying_balance_diff": ("player_style", None),
    "sniping_dependence_diff": ("player_style", None),
    "utility_profile_diff": ("player_style", None),
    "recent_top20_map_win_rate_diff": ("map", None),
}


def declared_features(inputs: Inputs, names: list[str]) -> DataFrame:
    """(match_id, a column for each name): the named differences, the first side's value less the second's."""
    computed = [n for n in names if callable(REGISTRY[n][1])]
    if other := set(names) - set(computed):
        raise ValueError(f"these features have no function of their own: {sorted(other)}")
    wholes: dict[Callable, dict[str, str]] = {}
    for name in computed:
        part = REGISTRY[name][1] if isinstance(REGISTRY[name][1], Part) else Part(REGISTRY[name][1])
        wholes.setdefault(part.whole, {})[name] = part.column
    out = inputs.matches.select("match_id", "team1_id", "team2_id")
    if not computed:
        return out.select("match_id")
    # each whole is saved, so that its shuffles can go before the next one; all values of a contest's team then meet in one
    # grouping, and both sides take theirs from it
    every = None
    for whole, columns in wholes.items():
        table = inputs.save(whole(inputs).select("match_id", "team_id", *sorted(set(columns.values())))).select("match_id", "team_id", *[(F.col(columns[n]) if n in columns else F.lit(None)).cast("double").alias(n) for n in computed])
        every = table if every is None else every.unionByName(table)
    teams = every.groupBy("match_id", "team_id").agg(*[F.max(n).alias(n) for n in computed])
    for side in (1, 2):
        out = out.join(teams.select("match_id", F.col("team_id").alias(f"team{side}_id"), *[F.col(n).alias(f"__{n}{side}") for n in computed]), ["match_id", f"team{side}_id"], "left")
    return out.select("match_id", *[(F.col(f"__{n}1") - F.col(f"__{n}2")).alias(n) for n in names])

"""Views that give the driver tables the shape of contests, maps, rankings, vetoes, player lines and a result feed."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: View texts run unchanged in Spark and DuckDB; each may read the base tables and views before it.
VIEWS = {
    "v_matches": """SELECT o_orderkey AS match_id, o_orderdate AS match_ts,
  CAST(o_custkey % 64 AS INT) AS team1_id,
  CAST((CAST(FLOOR(o_custkey / 64) AS BIGINT) + o_orderkey) % 64 AS INT) AS team2_id,
  CAST(CASE WHEN h % 2 = 1 THEN 2 ELSE CAST(FLOOR(h / 2) AS BIGINT) % 2 END AS INT) AS team1_score,
  CAST(CASE WHEN h % 2 = 1 THEN CAST(FLOOR(h / 2) AS BIGINT) % 2 ELSE 2 END AS INT) AS team2_score,
  CAST(h % 2 AS INT) AS target_team1_win, CAST(o_custkey % 40 AS INT) AS event_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'S-Tier' WHEN '2-HIGH' THEN 'A-Tier' WHEN '3-MEDIUM' THEN 'B-Tier'
       WHEN '4-NOT SPECIFIED' THEN 'C-Tier' ELSE 'Qualifier' END AS event_tier,
  CASE o_orderstatus WHEN 'F' THEN 'group_stage' WHEN 'O' THEN 'playoffs' ELSE 'quarterfinal' END AS match_phase,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS is_playoff, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_elimination,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 5 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END AS INT) AS best_of,
  CASE WHEN o_custkey % 40 % 3 = 0 THEN 'Offline finals' ELSE 'Online' END AS event_type
FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS h FROM orders) o
WHERE o_custkey % 64 <> (CAST(FLOOR(o_custkey / 64) AS BIGINT) + o_orderkey) % 64""",
    "v_maps": """SELECT match_id, map_index, map_name, team1_id, team2_id, r1 AS team1_rounds, r2 AS team2_rounds,
  CASE WHEN r1 > r2 THEN team1_id WHEN r2 > r1 THEN team2_id END AS winner_team_id
FROM (SELECT m.match_id, m.team1_id, m.team2_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS map_index,
    CASE l_partkey % 8 WHEN 0 THEN 'Ancient' WHEN 1 THEN 'Anubis' WHEN 2 THEN 'Dust2' WHEN 3 THEN 'Inferno' WHEN 4 THEN 'Mirage'
         WHEN 5 THEN 'Nuke' WHEN 6 THEN 'Overpass' ELSE 'TBA' END AS map_name,
    CAST(l_quantity AS INT) AS r1, CAST(l_partkey % 50 + 1 AS INT) AS r2
  FROM lineitem JOIN v_matches m ON m.match_id = l_orderkey) x""",
    "v_rankings": """SELECT ranking_date, team_id, points, CAST(ROW_NUMBER() OVER (PARTITION BY ranking_date ORDER BY points DESC, team_id) AS INT) AS rnk
FROM (SELECT DATE_TRUNC('month', l_shipdate) AS ranking_date, CAST(l_suppkey % 64 AS INT) AS team_id, ROUND(SUM(l_extendedprice), 2) AS points
      FROM lineitem GROUP BY 1, 2) g""",
    "v_vetoes": """SELECT match_id, map_index AS veto_index, CASE WHEN map_index % 2 = 1 THEN team1_id ELSE team2_id END AS team_id, map_name,
  CASE map_index % 3 WHEN 0 THEN 'picked' WHEN 1 THEN 'removed' ELSE 'left over' END AS action FROM v_maps""",
    "v_player_stats": """SELECT l_orderkey AS match_id, l_shipdate AS stat_ts, CAST(l_partkey % 320 AS INT) AS player_id, CAST(l_suppkey % 64 AS INT) AS team_id,
  CAST(l_quantity AS INT) AS kills, CAST(l_partkey % 30 AS INT) AS deaths, l_quantity * 2 AS adr, ROUND(0.5 + l_discount * 10, 2) AS rating,
  l_linenumber AS map_index FROM lineitem""",
    "v_feed": """SELECT event_id, ts, CAST(user_id % 32 AS INT) AS team1_id, CAST((event_id + 1) % 32 AS INT) AS team2_id,
  CASE WHEN value >= 50 THEN 2 ELSE 0 END AS score1, CASE WHEN value >= 50 THEN 1 ELSE 2 END AS score2, event_type FROM events
  WHERE user_id % 32 <> (event_id + 1) % 32
UNION ALL SELECT event_id, ts, CAST(user_id % 32 AS INT), CAST((event_id + 1) % 32 AS INT),
  CASE WHEN value >= 50 THEN 2 ELSE 0 END, CASE WHEN value >= 50 THEN 1 ELSE 2 END, event_type FROM events
  WHERE event_id % 10 = 0 AND user_id % 32 <> (event_id + 1) % 32""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations")
NEEDS = {"v_maps": ("v_matches",), "v_vetoes": ("v_matches", "v_maps")}


def with_views(sql: str, *names: str) -> str:
    """The SQL with the views it reads, and those they read, in front."""
    wanted = [v for v in VIEWS if v in names or any(v in NEEDS.get(n, ()) for n in names)]
    head = "WITH RECURSIVE " if "UNION ALL SELECT i + 1" in sql else "WITH "
    return head + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + ("," if sql.lstrip().startswith(",") else "") + sql.lstrip().removeprefix(",")


class Fixtures:
    """The views over one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A statement over the driver tables and views, as DuckDB would run it too."""
        frames, text = {}, text.replace("{", "{{").replace("}", "}}")
        for name in (*TABLES, *VIEWS):
            text, n = re.subn(rf"(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{{{name}}}", text)
            if n:
                frames[name] = getattr(self, name.removeprefix("v_")) if name in VIEWS else self.table(name)
        return self.spark.sql(text, **frames)

    def _view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    @cached_property
    def matches(self) -> DataFrame:
        return self._view("v_matches")

    @cached_property
    def maps(self) -> DataFrame:
        return self._view("v_maps")

    @cached_property
    def rankings(self) -> DataFrame:
        return self._view("v_rankings")

    @cached_property
    def vetoes(self) -> DataFrame:
        return self._view("v_vetoes")

    @cached_property
    def player_stats(self) -> DataFrame:
        return self._view("v_player_stats")

    @cached_property
    def feed(self) -> DataFrame:
        return self._view("v_feed")

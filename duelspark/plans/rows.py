"""Queries over merges, sources, set operations, expectations and the live feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from duelspark.functions import clean
from duelspark.functions.clean import slug_key
from duelspark.operators import expect, merge
from duelspark.sources import io, pages
from duelspark.sources.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return f

    return add


# -- filters

query("p01_p03_scored", "SELECT match_id, match_phase = 'playoffs' AS playoffs FROM v_matches WHERE team1_score <> team2_score AND match_phase <> 'quarterfinal' AND lower(event_tier) NOT LIKE '%qualifier%' AND match_ts < TIMESTAMP '1998-01-01'", ("v_matches",))(
    lambda x: x.matches.where("team1_score <> team2_score and match_phase <> 'quarterfinal' and not (event_tier ilike '%QUALIFIER%') and match_ts < '1998-01-01'").select("match_id", (F.col("match_phase") == "playoffs").alias("playoffs"))
)
query("p07_p10_predicates", "SELECT match_id, map_index, CASE WHEN map_name <> 'TBA' AND team1_rounds IS NOT NULL THEN 1 ELSE 0 END AS playable FROM v_maps WHERE coalesce(nullif(map_name, 'TBA'), '9999') >= 'D'", ("v_matches", "v_maps"))(
    lambda x: x.maps.where(F.coalesce(F.nullif("map_name", F.lit("TBA")), F.lit("9999")) >= "D").select("match_id", "map_index", ((F.col("map_name") != "TBA") & F.col("team1_rounds").isNotNull()).cast("int").alias("playable"))
)

# -- merges: customers as held rows, suppliers as incoming rows of the same keys

HELD = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS bal, 'held' AS source FROM customer"
COMING = "SELECT s_suppkey * 2 AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('S', CAST(s_nationkey AS STRING)) END AS seg, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS bal, 'coming' AS source FROM supplier"
BOTH = f", h AS ({HELD}), n AS ({COMING})".replace("AS STRING", "AS VARCHAR").removeprefix(", ")
merged = lambda rule: (lambda x: merge.merge_columns(x.sql(HELD), x.sql(COMING), ["id"], rule))

query("m01_replace", f"WITH {BOTH} SELECT id, name, seg, CAST(NULL AS DOUBLE) AS bal, source FROM n UNION ALL SELECT id, name, seg, bal, source FROM h WHERE id NOT IN (SELECT id FROM n)")(lambda x: merge.replace_by_key(x.sql(HELD), x.sql(COMING).drop("bal"), ["id"], "id").select("id", "name", "seg", "bal", "source"))
query("m02_upsert", f"WITH {BOTH} SELECT id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE h.name END AS name, coalesce(n.seg, h.seg) AS seg, coalesce(n.bal, h.bal) AS bal FROM h FULL JOIN n USING (id)")(merged({"name": "new", "seg": "enrich", "bal": "enrich"}))
query("m03_fill", f"WITH {BOTH} SELECT id, coalesce(h.name, n.name) AS name, coalesce(h.seg, n.seg) AS seg, coalesce(h.bal, n.bal) AS bal FROM h FULL JOIN n USING (id)")(merged({"name": "fill", "seg": "fill", "bal": "fill"}))
query("m04_m06_enrich", f"WITH {BOTH} SELECT id, coalesce(n.seg, h.seg) AS seg, CASE WHEN h.id IS NULL THEN n.bal WHEN n.id IS NULL THEN h.bal WHEN h.bal IS NOT NULL AND n.bal IS NOT NULL THEN least(h.bal, n.bal) END AS bal FROM h FULL JOIN n USING (id)".replace("h.id IS NULL", "h.source IS NULL").replace("n.id IS NULL", "n.source IS NULL"))(merged({"seg": "enrich", "bal": "min"}))
ORACLE["m02_upsert"] = ORACLE["m02_upsert"].replace("n.id IS NOT NULL", "n.source IS NOT NULL")
query("m05_tag", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'web;feed' ELSE 'feed' END AS s FROM customer".replace("'web' WHEN", "'web;feed' WHEN"))(
    lambda x: x.table("customer").select("c_custkey", merge.append_tag(F.element_at(F.array(F.lit("web"), F.lit("web;feed"), F.lit(None)), (F.col("c_custkey") % 3 + 1).cast("int")), "feed").alias("s"))
)
query("m07_insert_ignore", f"WITH {BOTH} SELECT * FROM h UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM h)")(lambda x: merge.insert_ignore(x.sql(HELD), x.sql(COMING), ["id"]))
query("m08_children", "SELECT match_id, map_index, map_name FROM v_maps WHERE match_id NOT IN (SELECT match_id FROM v_maps WHERE map_name = 'TBA') UNION ALL SELECT match_id, 1, 'Nuke' FROM (SELECT DISTINCT match_id FROM v_maps WHERE map_name = 'TBA')", ("v_matches", "v_maps"))(
    lambda x: (lambda t: merge.replace_children(x.maps.select("match_id", "map_index", "map_name"), t.select("match_id", F.lit(1).alias("map_index"), F.lit("Nuke").alias("map_name")), ["match_id"], t))(x.maps.where("map_name = 'TBA'").select("match_id").distinct())
)
query("m10_keep_first", "SELECT k, m FROM (SELECT coalesce(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END, '') AS k, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_extendedprice)).a AS m FROM lineitem GROUP BY 1) q")(
    lambda x: merge.keep_first(x.table("lineitem").withColumn("kk", F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey"))), ["kk"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select(F.coalesce(F.col("kk").cast("string"), F.lit("")).alias("k"), F.col("l_orderkey").alias("m"))
)


@query("m11_keep_richest", """WITH t AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS b FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END) DESC, seq) AS p FROM t) SELECT k, seq FROM r WHERE p = 1""")
def _(x):
    rows = x.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("b"))
    return merge.keep_richest(rows, ["k"], ["seq"]).select("k", "seq")


query("m12_ordered_distinct", "SELECT o_custkey, min(o_orderkey) AS first_at FROM orders GROUP BY 1")(lambda x: merge.ordered_distinct(x.table("orders"), "o_custkey", ["o_orderkey"]).select("o_custkey", F.col("first_at.o_orderkey").alias("first_at")))


@query("m13_m17_events", """, a AS (SELECT event_id, min(event_tier) AS tier, list(DISTINCT CAST(team1_id AS VARCHAR)) AS p FROM v_matches WHERE event_id < 30 GROUP BY 1), b AS (SELECT event_id, max(event_tier) AS tier, list(DISTINCT CAST(team2_id AS VARCHAR)) AS p FROM v_matches WHERE event_id >= 10 AND team2_id < 20 GROUP BY 1)
SELECT event_id, coalesce(a.tier, b.tier) AS tier, array_to_string(list_sort(list_distinct(coalesce(a.p, []) || coalesce(b.p, []))), ',') AS p FROM a FULL JOIN b USING (event_id)""", ("v_matches",))
def _(x):
    s = lambda c: F.collect_set(F.col(c).cast("string")).alias("p")
    a = x.matches.where("event_id < 30").groupBy("event_id").agg(F.min("event_tier").alias("tier"), s("team1_id"))
    b = x.matches.where("event_id >= 10 and team2_id < 20").groupBy("event_id").agg(F.max("event_tier").alias("tier"), s("team2_id"))
    return merge.merge_events(a, b, "event_id", ["tier"], ["p"]).select("event_id", "tier", F.array_join("p", ",").alias("p"))


query("m14_m15_coverage", "WITH t AS (SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM orders) SELECT id, v FROM t ORDER BY ts DESC, id LIMIT 180")(
    lambda x: (lambda o: merge.latest_merged(o.withColumn("v", F.lit("old")), o.where("id % 2 = 0").withColumn("v", F.lit("new")), ["id"], "ts", 180).select("id", "v"))(x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")))
)
query("m16_timelines", "WITH t AS (SELECT o_custkey AS who, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) SELECT who, id FROM t WHERE p <= 18")(
    lambda x: (lambda o: merge.latest_merged(o, o.where("id % 5 = 0"), ["id"], "ts", 18, "who").select("who", "id"))(x.table("orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")))
)


@query("m18_m19_overlay", """WITH t AS (SELECT o_orderkey AS id, o_custkey % 3 AS s1, o_orderkey % 3 AS s2, CASE o_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 3 END AS bo, CASE o_orderstatus WHEN 'F' THEN 'live' ELSE 'upcoming' END AS st FROM orders),
u AS (SELECT id, CASE WHEN id % 4 = 0 THEN 2 ELSE s1 END AS s1, CASE WHEN id % 4 = 0 THEN 0 ELSE s2 END AS s2, bo, st FROM t), v AS (SELECT *, greatest(s1, s2) >= CASE bo WHEN 5 THEN 3 WHEN 1 THEN 1 ELSE 2 END AND s1 <> s2 AS done FROM u)
SELECT id, s1 AS score1, s2 AS score2, CASE WHEN done THEN 'finished' ELSE st END AS status, CASE WHEN done THEN CASE WHEN s1 > s2 THEN 1 ELSE 2 END END AS winner FROM v""")
def _(x):
    rows = x.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("score1"), (F.col("o_orderkey") % 3).alias("score2"), F.element_at(F.array(F.lit(5), F.lit(1), F.lit(3), F.lit(3)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("best_of"), F.when(F.col("o_orderstatus") == "F", "live").otherwise("upcoming").alias("status"))
    detail = rows.where("id % 4 = 0").select("id", F.lit(2).cast("long").alias("score1"), F.lit(0).cast("long").alias("score2"))
    return merge.finished_overlay(rows, detail, "id").select("id", "score1", "score2", "status", "winner")


query("m20_lists", "WITH t AS (SELECT o_orderkey AS id, 1 AS l FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 9 = 0) SELECT id, max(l) AS l FROM t GROUP BY 1")(
    lambda x: (lambda o: merge.last_of_lists([o.withColumn("l", F.lit(1)), o.where("id % 3 = 0").withColumn("l", F.lit(2)), o.where("id % 9 = 0").withColumn("l", F.lit(3))], ["id"], "l"))(x.table("orders").select(F.col("o_orderkey").alias("id")))
)

# -- set operations

query("o07_o10_sets", "SELECT s, count(*) AS n FROM (SELECT 'all' AS s, o_custkey AS k FROM orders UNION ALL SELECT 'all', c_custkey FROM customer UNION ALL SELECT 'union', k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)) q GROUP BY 1")(
    lambda x: (lambda o, c: o.unionByName(c).select(F.lit("all").alias("s")).unionByName(o.unionByName(c).distinct().select(F.lit("union").alias("s"))).unionByName(c.join(o, "k", "left_anti").select(F.lit("except").alias("s"))).unionByName(c.intersect(o).select(F.lit("intersect").alias("s"))).groupBy("s").agg(F.count(F.lit(1)).alias("n")))(
        x.table("orders").select(F.col("o_custkey").alias("k")), x.table("customer").select(F.col("c_custkey").alias("k"))
    )
)

# -- sources and pages



@query("s01_s03_bronze", "SELECT c_custkey, c_name, coalesce(nullif(replace(c_name, '#', '\"#,'), ''), NULL) AS odd, CAST(NULL AS VARCHAR) AS missing FROM customer")
def _(x):
    """Written as gzip CSV and read back by names, quotes and commas in a value included."""
    path = io.scratch(x.spark, "bronze")
    io.write_bronze(x.table("customer").select("c_custkey", "c_name", F.replace("c_name", F.lit("#"), F.lit('"#,')).alias("odd")), path, compression="gzip")
    return io.read_bronze(x.spark, path, ["c_custkey", "c_name", "odd", "missing"]).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s04_log", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")
def _(x):
    path, rows = io.scratch(x.spark, "log"), x.table("events").select("event_id", "event_type", "value")
    io.append_log(rows, path)
    io.append_log(rows.where("event_type = 'click'"), path)
    return io.read_log(x.spark, path, "event_id long, event_type string, value double")


@query("s11_published", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def _(x):
    """Three versions: the gate lets 9 and 10 through and stops 11, which has rows out of range."""
    path, rows = io.scratch(x.spark, "published"), x.table("customer").select("c_custkey", "c_acctbal")
    gate = lambda df: df.where("c_acctbal <= 0").isEmpty()
    for version, part in (("9", rows.where("c_acctbal > 100")), ("10", rows.where("c_acctbal > 0")), ("11", rows)):
        io.publish(part, path, version, gate)
    return io.published(x.spark, path).select("c_custkey", "c_acctbal")


@query("s20_labelled", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM customer")
def _(x):
    base, rows = io.scratch(x.spark, "labelled"), x.table("customer").select("c_custkey", "c_mktsegment")
    for label, rest in (("even", 0), ("odd", 1)):
        io.write_bronze(rows.where(F.col("c_custkey") % 2 == rest), f"{base}/{label}", ["c_custkey", "c_mktsegment"])
    return io.labelled_files(x.spark, {label: f"{base}/{label}" for label in ("even", "odd", "absent")}, "c_custkey long, c_mktsegment string")


@query("m09_partitions", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS run, c_mktsegment AS segment FROM customer")
def _(x):
    path, rows = io.scratch(x.spark, "partitions"), x.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    merge.overwrite_partitions(rows.withColumn("run", F.lit(1)), path, ["segment"])
    merge.overwrite_partitions(rows.where("segment = 'BUILDING'").withColumn("run", F.lit(2)), path, ["segment"])
    return x.spark.read.parquet(path).select("c_custkey", "run", "segment")


query("s05_nested", "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 4 <> 3")(
    lambda x: io.nested_items(x.table("events").withColumn("j", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","), F.expr("substring(props, 2)"))).withColumn("d", F.element_at(F.array(F.concat(F.lit("["), F.col("j"), F.lit("]")), F.concat(F.lit('{"items":['), F.col("j"), F.lit("]}")), F.concat(F.lit('{"matches":['), F.col("j"), F.lit("]}")), F.lit('{"other":1}')), (F.col("event_id") % 4 + 1).cast("int"))), "d", "struct<id: bigint, k: bigint>").select(F.col("id").alias("event_id"), "k")
)
query("s06_envelopes", "SELECT event_id AS id FROM events WHERE event_type <> 'error'")(
    lambda x: io.envelopes(x.table("events").withColumn("e", F.concat(F.lit('{"status":"'), F.when(F.col("event_type") == "error", "failed").otherwise("ok"), F.lit('","data":{"id":'), F.col("event_id").cast("string"), F.lit("}}"))), "e", "struct<id: bigint>")[0]
)
def result_pages(x):
    """A result page for each event and month, odd events in rows; every ninth block comes again, cut short."""
    at, day = (F.unix_timestamp("match_ts") * 1000).cast("string"), F.date_format("match_ts", "yyyy-MM-dd")
    team, score = (lambda s: F.concat(F.lit("Team "), F.col(f"team{s}_id").cast("string"))), (lambda s: F.col(f"team{s}_score").cast("string"))
    own, event, form = F.col("match_id").cast("string"), F.concat(F.lit("Event "), F.col("event_id").cast("string")), F.concat(F.lit("bo"), F.col("best_of").cast("string"))
    stars = F.col("event_id") % 4
    card = F.concat(F.lit('<h3 class="day">'), day, F.lit('</h3><div class="match" data-at="'), at, F.lit('"><a href="/match/'), own, F.lit('/x"><b class="team">'), team(1), F.lit('</b> <i>'), score(1), F.lit("</i> - <i>"), score(2), F.lit('</i> <b class="team"> '), team(2), F.lit("</b><em>"), event, F.lit("</em><small>"), form, F.lit("</small></a>"), F.repeat(F.lit('<i class="star"></i>'), stars), F.lit("</div><!--match-->"))
    row = F.concat(F.lit('<tr><th colspan="6">'), day, F.lit('</th></tr><tr class="result" data-unix="'), at, F.lit('"><td class="t">'), team(1), F.lit("</td><td>"), score(1), F.lit(":"), score(2), F.lit('</td><td class="t">'), team(2), F.lit('</td><td><a title="'), event, F.lit('" href="/m?x=1&id='), own, F.lit('">m</a></td><td class="f">'), form, F.lit("</td><td>"), F.repeat(F.lit("&#9733;"), stars), F.lit("</td></tr>"))
    short = F.when(F.col("match_id") % 9 == 0, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<div class="match"><a href="/match/'), own, F.lit('/x"></a></div><!--match-->'))).otherwise(F.concat(F.lit('<tr class="result"><td><a href="?id='), own, F.lit('">m</a></td></tr>')))).otherwise("")
    text = F.concat(F.when(F.col("event_id") % 3 == 0, short).otherwise(""), F.when(F.col("event_id") % 2 == 0, card).otherwise(row), F.when(F.col("event_id") % 3 != 0, short).otherwise(""))
    blocks = x.matches.select("event_id", F.date_format("match_ts", "yyyyMM").cast("long").alias("month"), F.struct("match_ts", "match_id", text.alias("text")).alias("b"))
    return blocks.groupBy("event_id", "month").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["text"]), "\n").alias("html")).select((F.col("month") * 100 + F.col("event_id")).alias("page_id"), "event_id", "html")


query("s07_match_blocks", """SELECT (CAST(strftime(match_ts, '%Y%m') AS BIGINT) * 100 + event_id) AS page_id, match_id, CAST(match_ts AS TIMESTAMP) AS match_ts, strftime(match_ts, '%Y-%m-%d') AS day, 'Team ' || team1_id AS team1, 'Team ' || team2_id AS team2, team1_score AS score1, team2_score AS score2,
  'Event ' || event_id AS event, 'bo' || best_of AS format, event_id % 4 AS stars FROM v_matches""", ("v_matches",))(
    lambda x: (lambda p: pages.match_blocks(p.where("event_id % 2 = 0"), pages.LAYOUTS["cards"]).unionByName(pages.match_blocks(p.where("event_id % 2 = 1"), pages.LAYOUTS["rows"])))(result_pages(x)).drop("position")
)


@query("s07_rosters", ", l AS (SELECT DISTINCT match_id, team_id, player_id FROM v_player_stats), s AS (SELECT match_id * 64 + team_id AS page_id, CASE WHEN player_id % 5 = 0 THEN 'Bench' ELSE 'Players' END AS section, player_id FROM l) SELECT page_id, section, row_number() OVER (PARTITION BY page_id, section ORDER BY player_id) AS place, player_id, 'P' || player_id AS name FROM s", ("v_player_stats",))
def _(x):
    """A team page for each line-up: players, and those on the bench below them."""
    lines = x.player_stats.select("match_id", "team_id", "player_id").distinct()
    member = F.concat(F.lit('<li data-player="'), F.col("player_id").cast("string"), F.lit('"> P'), F.col("player_id").cast("string"), F.lit(" </li>"))
    part = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("player_id", member.alias("m"))))), lambda m: m["m"]), "")
    text = F.concat(F.lit("<h2>Players</h2><ul>"), part(F.col("player_id") % 5 != 0), F.lit("</ul><h2> Bench</h2><ul>"), part(F.col("player_id") % 5 == 0), F.lit("</ul>"))
    docs = lines.groupBy("match_id", "team_id").agg(text.alias("html")).select((F.col("match_id") * 64 + F.col("team_id")).alias("page_id"), "html")
    return pages.rosters(docs, pages.LAYOUTS["cards"])


query("f10_fuzzy_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(epoch(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 4 < 2 THEN 66600 ELSE 0 END AS seconds FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'round ' || o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0""")(
    lambda x: x.table("orders").select("o_orderkey", clean.fuzzy_date(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("round "), F.col("o_orderkey").cast("string"), F.lit(" UTC"))).when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "'starts' MMMM d, yyyy '- 18:30 CET'"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "'EST' d'th of' MMM yyyy 18:30")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "'on' yyyy-MM-dd"))).alias("d")).select("o_orderkey", "d.date", "d.seconds")
)
query("s07_page_links", "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a\\b[^>]*href=\"([^\"]*)\"[^>]*>', 1)) AS href FROM pages")(lambda x: pages.page_links(x.table("pages")).select("page_id", "href"))
query("s07_page_headers", "SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\\blang=[\"'']([^\"'']+)', 1), '') AS lang, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(url, '^\\w+://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(url, '^\\w+://[^/]+(/[^?#]*)', 1), '') AS path FROM pages")(lambda x: pages.page_headers(x.table("pages")))
query("s10_history", ", m AS (SELECT match_id, count(*) AS n, max(CASE WHEN map_index = 1 THEN map_name END) AS first FROM v_maps GROUP BY 1), p AS (SELECT match_id, count(DISTINCT CASE WHEN team_id = team1_id THEN player_id END) AS a, count(DISTINCT CASE WHEN team_id = team2_id THEN player_id END) AS b FROM v_player_stats JOIN v_matches USING (match_id) GROUP BY 1) SELECT v.match_id, n, first, a, b FROM v_matches v LEFT JOIN m USING (match_id) LEFT JOIN p USING (match_id)", ("v_matches", "v_maps", "v_player_stats"))(
    lambda x: io.history_documents(x.matches, x.maps, x.player_stats).select("match_id", F.when(F.col("maps").isNotNull(), F.size("maps")).alias("n"), F.col("maps")[0]["map_name"].alias("first"), F.when(F.col("lineups").isNotNull(), F.size("lineups.team1")).alias("a"), F.when(F.col("lineups").isNotNull(), F.size("lineups.team2")).alias("b"))
)
query("s09_documents", "SELECT n_nationkey, '{\"n_nationkey\":' || CAST(n_nationkey AS VARCHAR) || ',\"n_name\":\"' || n_name || '\"}' AS document FROM nation")(lambda x: io.as_json(x.table("nation").select("n_nationkey", "n_name"), "n_nationkey"))
query("s12_manifest", "SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1")(lambda x: io.manifest(x.table("orders").select("o_custkey", F.col("o_orderkey").alias("last")), "o_custkey", "last"))
query("s13_s14_members", "SELECT c_custkey AS k, u.i, CASE u.i WHEN 1 THEN c_name ELSE 'b' END AS name, CASE u.i WHEN 1 THEN c_custkey ELSE 7 END AS id FROM customer, (VALUES (1), (2)) u(i) WHERE u.i = 1 OR c_custkey % 2 = 0")(
    lambda x: x.table("customer").select(F.col("c_custkey").alias("k"), F.posexplode(io.split_zip(F.concat("c_name", F.lit(" , b")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/p/"), F.col("c_custkey").cast("string"), F.lit("/x, /p/7"))).otherwise(F.concat(F.lit("/p/"), F.col("c_custkey").cast("string"))))).alias("i", "m")).select("k", (F.col("i") + 1).alias("i"), "m.name", "m.id")
)
query("s15_page_runs", "SELECT o_custkey AS page, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_orderdate) <= TIMESTAMP '1995-01-01' AS stop FROM orders GROUP BY 1")(lambda x: io.page_runs(x.table("orders").withColumnRenamed("o_custkey", "page"), "page", "o_orderdate", F.lit("1995-01-01").cast("timestamp")))
query("s16_typed", "SELECT c_custkey, CAST(c_acctbal AS INT) AS bal, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer".replace("CAST(c_acctbal AS INT)", "CAST(trunc(c_acctbal) AS INT)"))(lambda x: io.typed(x.table("customer"), {"c_custkey": F.col("c_custkey"), "bal": F.col("c_acctbal").cast("int"), "slug": slug_key(F.col("c_name"))}))
def detail_documents(x):
    """A JSON document a contest: its maps, vetoes, line-ups and stat lines, as a feed would send them."""
    ordered = lambda order, **fields: F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), *[F.col(c).alias(n) for n, c in fields.items()]))), lambda v: F.struct(*[v[n].alias(n) for n in fields]))
    maps = x.maps.groupBy("match_id").agg(ordered("map_index", name="map_name", s1="team1_rounds", s2="team2_rounds").alias("maps"))
    vetoes = x.vetoes.groupBy("match_id").agg(ordered("veto_index", team="team_id", action="action", map="map_name").alias("vetoes"))
    lines = x.player_stats.select("match_id", "map_index", "team_id", F.col("player_id").cast("string").alias("player"), F.col("rating").cast("double").alias("rating"))
    people = lines.groupBy("match_id").agg(ordered("map_index", team="team_id", player="player").alias("lineups"), ordered("map_index", player="player", rating="rating").alias("stats"))
    rows = x.matches.select("match_id", F.col("match_id").alias("id"), "best_of").join(maps, "match_id", "left").join(vetoes, "match_id", "left").join(people, "match_id", "left")
    return rows.select(F.when(F.col("id") % 97 == 0, "cut short {").otherwise(F.to_json(F.struct("id", "best_of", "maps", "vetoes", "lineups", "stats"))).alias("text"))


def details(x):
    """The five tables of all documents; each text is parsed once."""
    from duelspark.plans.contests import saved, shared

    return io.detail_tables(shared(x, "details", lambda: io.variants(detail_documents(x), "text", saved)))


WHOLE = "match_id % 97 <> 0"
query("s18_detail", f", w AS (SELECT match_id, count(CASE WHEN team1_rounds > team2_rounds THEN 1 END) AS a, count(CASE WHEN team2_rounds > team1_rounds THEN 1 END) AS b FROM v_maps GROUP BY 1) SELECT m.match_id, m.best_of, coalesce(a, 0) AS score1, coalesce(b, 0) AS score2, CASE WHEN a > b THEN 1 WHEN b > a THEN 2 END AS winner FROM v_matches m LEFT JOIN w USING (match_id) WHERE {WHOLE}", ("v_matches", "v_maps"))(lambda x: details(x)["contest"])
query("s18_maps", f"SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY map_index) AS \"index\", map_name AS name, team1_rounds AS s1, team2_rounds AS s2 FROM v_maps WHERE {WHOLE}", ("v_matches", "v_maps"))(lambda x: details(x)["maps"])
query("s18_vetoes", f"SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY veto_index) AS \"index\", team_id AS team, action, map_name AS map FROM v_vetoes WHERE {WHOLE}", ("v_matches", "v_maps", "v_vetoes"))(lambda x: details(x)["vetoes"])
LINES_SQL = f"SELECT x.match_id, row_number() OVER (PARTITION BY x.match_id ORDER BY map_index, {{tie}}) AS \"index\", {{cols}} FROM v_player_stats x JOIN v_matches m ON m.match_id = x.match_id WHERE m.{WHOLE}"
query("s18_lineups", LINES_SQL.format(tie="x.team_id, CAST(player_id AS VARCHAR)", cols="x.team_id AS team, CAST(player_id AS VARCHAR) AS player"), ("v_matches", "v_player_stats"))(lambda x: details(x)["lineups"])
query("s18_stats", LINES_SQL.format(tie="CAST(player_id AS VARCHAR), rating", cols="CAST(player_id AS VARCHAR) AS player, CAST(rating AS DOUBLE) AS rating"), ("v_matches", "v_player_stats"))(lambda x: details(x)["stats"])


@query("s17_wide", """, l AS (SELECT x.match_id, x.player_id, x.kills, x.deaths, CAST(x.rating AS DOUBLE) AS rating, coalesce(m.map_name, 'unknown') AS name, row_number() OVER (PARTITION BY x.match_id, x.player_id ORDER BY x.map_index, coalesce(m.map_name, 'unknown'), kills, deaths, rating) AS map_index
  FROM v_player_stats x LEFT JOIN v_maps m ON m.match_id = x.match_id AND m.map_index = x.map_index) SELECT player_id, 'player ' || CAST(player_id AS VARCHAR) AS player, map_index, name, kills, deaths, rating FROM l""", ("v_matches", "v_maps", "v_player_stats"))
def _(x):
    """A document for each player and contest, of the lines that the player has there."""
    from duelspark.plans.contests import saved

    lines = x.player_stats.join(x.maps.select("match_id", "map_index", "map_name"), ["match_id", "map_index"], "left")
    own = F.struct("map_index", F.coalesce("map_name", F.lit("unknown")).alias("name"), "kills", "deaths", F.col("rating").cast("double").alias("rating"))
    docs = lines.groupBy("match_id", "player_id").agg(F.sort_array(F.collect_list(own)).alias("maps"))
    player = F.struct(F.col("player_id").alias("id"), F.concat(F.lit("player "), F.col("player_id").cast("string")).alias("name")).alias("player")
    return io.wide_stats(io.variants(docs.select(F.to_json(F.struct(player, "maps")).alias("text")), "text", saved))


query("s19_snapshot", "SELECT CAST(event_id AS VARCHAR) AS match_id, CASE event_id % 2 WHEN 0 THEN 'live' ELSE 'upcoming' END AS status FROM events WHERE event_id % 5 NOT IN (0, 1)")(
    lambda x: io.normalised_snapshot(x.table("events").withColumn("d", F.concat(F.lit('{"matches":[{"id":"'), F.col("event_id").cast("string"), F.lit('","team1":"'), F.when(F.col("event_id") % 5 == 0, "TBD").otherwise("Alpha"), F.lit('","team2_name":"'), F.when(F.col("event_id") % 5 == 1, "alpha").otherwise("Beta"), F.lit('"'), F.when(F.col("event_id") % 2 == 0, ',"status":"LIVE"').otherwise(""), F.lit("}]}"))), "d").select("match_id", "status")
)

# -- expectations


@query("q01_q08_report", """, p AS (SELECT event_id, list(team1_id) AS t FROM v_matches GROUP BY 1) SELECT 'unique match' AS "check", 0 AS failed, count(*) AS total FROM v_matches
UNION ALL SELECT 'unique feed', count(CASE WHEN n > 1 THEN 1 END), count(*) FROM (SELECT event_id, count(*) AS n FROM v_feed GROUP BY 1) UNION ALL SELECT 'score range', count(CASE WHEN team1_score > 1 THEN 1 END), count(*) FROM v_matches
UNION ALL SELECT 'tier values', count(CASE WHEN event_tier NOT IN ('S-Tier', 'A-Tier') THEN 1 END), count(*) FROM v_matches UNION ALL SELECT 'coverage', CASE WHEN count(*) < 900 THEN 1 ELSE 0 END, count(*) FROM v_matches
UNION ALL SELECT 'participants', count(CASE WHEN len(list_distinct(t)) <> len(t) THEN 1 END), count(*) FROM p UNION ALL SELECT 'order', count(CASE WHEN l_shipdate < q OR k > 500 THEN 1 END), count(*) FROM (SELECT l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)""", ("v_matches", "v_feed"))
def _(x):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    lines = x.table("lineitem").withColumn("k", place)
    tiers = F.col("event_tier").isin("S-Tier", "A-Tier")
    return expect.report(
        expect.inspect(x.matches, {"score range": F.col("team1_score") <= 1, "tier values": tiers}, {"coverage": 900}), expect.unique(x.matches, ["match_id"], "unique match"), expect.unique(x.feed, ["event_id"], "unique feed"),
        expect.distinct_elements(x.matches.groupBy("event_id").agg(F.collect_list("team1_id").alias("t")), "t", "participants"), expect.in_order(lines, "l_suppkey", "l_shipdate", "k", 500, "order"),
    )


# -- the live feed's batch counterparts (the streams themselves are tested in tests/test_streaming.py)

query("t02_product_rows", "SELECT event_id, team1_id, team2_id, score1, score2 FROM v_feed WHERE event_type IN ('click', 'purchase') AND score1 <> score2", ("v_feed",))(lambda x: __import__("duelspark.streaming.live", fromlist=["product_only"]).product_only(x.feed, ["click", "purchase"]).select("event_id", "team1_id", "team2_id", "score1", "score2"))
query("t04_distinct", "SELECT DISTINCT event_id FROM v_feed", ("v_feed",))(lambda x: __import__("duelspark.streaming.live", fromlist=["bounded_distinct"]).bounded_distinct(x.feed, "event_id", "ts", "10 days").select("event_id"))

# -- joins by names, and maps of traits


@query("j08_any_form", "SELECT c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def _(x):
    from duelspark.operators import joins

    rows = x.table("customer").select(F.col("c_name").alias("name"))
    known = x.table("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("The "), F.translate("c_name", "#", " ")).alias("name"))
    return joins.anti_any_form(rows, known, "name")


@query("j10_j11_aliases", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'zz' END AS side FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(x):
    from duelspark.operators import joins

    n = x.table("nation")
    raw = F.concat(F.lit("alias of "), F.col("n_nationkey").cast("string"))
    names = n.select(F.col("n_nationkey").alias("scope"), raw.alias("raw"))
    found = joins.resolve_aliases(names, n.select(F.col("n_nationkey").alias("scope"), F.col("n_name").alias("name")), "scope", n.select(raw.alias("alias"), F.col("n_name").alias("name")))
    rows = x.table("customer").select("c_custkey", F.col("c_nationkey").alias("scope"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("alias of "), F.col("c_nationkey").cast("string"))).otherwise("zz").alias("side"))
    return joins.apply_aliases(rows, found, "scope", ["side"]).select("c_custkey", "side")


@query("j17_id_or_name", "SELECT c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(x):
    from duelspark.operators import joins

    rows = x.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n_nationkey"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("n_name"))
    return joins.by_id_or_name(rows, x.table("nation"), "n_nationkey", "n_name", "n_regionkey").select("c_custkey", "n_regionkey")


@query("j20_roster", "WITH t AS (SELECT s_nationkey AS team, s_name AS player, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS profiled, s_suppkey AS place FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY profiled DESC, place, player) AS slot FROM t) SELECT team, player, profiled, slot FROM k WHERE slot <= 5")
def _(x):
    from duelspark.operators import joins

    rows = x.table("supplier").select(F.col("s_nationkey").alias("team"), F.col("s_name").alias("player"), F.col("s_suppkey").alias("place"))
    return joins.roster(rows.where("place % 3 = 0"), rows, "team")


query("m17_traits", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS DOUBLE) END, CAST(l_discount AS DOUBLE)) AS a, CAST(l_tax AS DOUBLE) AS b, CAST(l_suppkey AS DOUBLE) AS c FROM lineitem")(
    lambda x: (lambda m: x.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c")))(
        merge.merge_maps(
            F.create_map(F.lit("a"), F.col("l_discount").cast("double"), F.lit("b"), F.col("l_tax").cast("double")),
            F.create_map(F.lit("a"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("double")), F.lit("b"), F.lit(None).cast("double"), F.lit("c"), F.col("l_suppkey").cast("double")),
        )
    )
)

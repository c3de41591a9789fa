"""Queries over the cleaning and rule functions. Each has one input statement that both engines run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelspark.functions import clean, rules
from duelspark.sources.fixtures import Fixtures

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def scalar(name: str, source: str, columns: dict[str, Column], sql: str, keep: tuple[str, ...] = ("k",)) -> None:
    """A query of column functions over an input statement; sql has the same columns over `src`."""
    QUERIES[name] = lambda spark, sf_dir: Fixtures(spark, sf_dir).sql(source).select(*keep, *[c().alias(n) for n, c in columns.items()])
    ORACLE[name] = f"WITH src AS ({source}) SELECT {', '.join(keep)}, {sql} FROM src"


def c(name: str) -> Column:
    return F.col(name)


NAMES = "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN concat('  Équipe ', p_name, '!! ') WHEN 1 THEN concat(p_name, ' (', p_brand, ')') WHEN 2 THEN concat('Intel Extreme Masters ', p_type) WHEN 3 THEN '***' ELSE concat('The_', p_name) END AS raw FROM part"
SLUG = "coalesce(nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', '{}', 'g'), '{}'), ''), 'unknown')"
scalar("f01_f03_keys", NAMES, {"slug": lambda: clean.slug_key(c("raw")), "name_key": lambda: clean.name_key(c("raw")), "hyphen": lambda: clean.hyphen_slug(c("raw"))},
       f"{SLUG.format('raw', '_', '_')} AS slug, trim(regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', ' ', 'g')) AS name_key, {SLUG.format(chr(34) + 'raw2' + chr(34), '-', '-')} AS hyphen".replace('"raw2"', "strip_accents(regexp_replace(raw, 'intel extreme masters', 'IEM', 'gi'))"))

NUMBERS = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_partkey % 8 WHEN 0 THEN concat('1,', CAST(100 + l_suppkey % 900 AS STRING), ' pts') WHEN 1 THEN '-' WHEN 2 THEN 'W' WHEN 3 THEN concat('-', CAST(l_suppkey AS STRING)) WHEN 4 THEN concat(CAST(l_suppkey AS STRING), '.5 kg') WHEN 5 THEN '' WHEN 6 THEN 'abc' ELSE concat(CAST(l_linenumber AS STRING), ' : ', CAST(l_suppkey % 17 AS STRING)) END AS raw FROM lineitem"
scalar("f04_f07_numbers", NUMBERS, {
    "loose_int": lambda: clean.parse_int_loose(c("raw")), "loose_float": lambda: clean.parse_float_loose(c("raw")), "whole": lambda: clean.safe_int(c("raw"), -1), "finite": lambda: clean.safe_float(c("raw"), 0.0),
    "score": lambda: clean.score_int(c("raw")), "a": lambda: clean.score_pair(c("raw"))["a"], "b": lambda: clean.score_pair(c("raw"))["b"],
}, r"""TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '(-?\d+)', 1), '') AS BIGINT) AS loose_int, CASE WHEN trim(raw) <> '-' THEN TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) END AS loose_float,
  coalesce(CASE WHEN regexp_full_match(raw, '\s*[+-]?\d+\s*') THEN TRY_CAST(trim(raw) AS BIGINT) END, -1) AS whole, coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS finite,
  CASE WHEN upper(trim(raw)) NOT IN ('W', 'L', 'FF', 'DQ') THEN TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '(-?\d+)', 1), '') AS BIGINT) END AS score,
  TRY_CAST(nullif(regexp_extract(raw, '(\d+)\s*[-:]\s*(\d+)', 1), '') AS INT) AS a, TRY_CAST(nullif(regexp_extract(raw, '(\d+)\s*[-:]\s*(\d+)', 2), '') AS INT) AS b""", ("k", "n", "raw"))  # fmt: skip

HALVES = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_partkey % 4 AS kind, CAST(l_partkey % 16 AS STRING) AS a, CAST(l_suppkey % 14 AS STRING) AS b, CAST(l_linenumber AS STRING) AS o FROM lineitem"
scalar("f08_half_sums", HALVES, {"score": lambda: clean.half_sum_score(F.when(c("kind") == 0, F.create_map(F.lit("score1"), c("a"), F.lit("t1t"), c("b"))).when(c("kind") == 1, F.create_map(F.lit("T1T"), c("a"), F.lit("t1ct"), c("b"), F.lit("o2t1ct"), c("o"), F.lit("t2t"), F.lit("9"))).when(c("kind") == 2, F.create_map(F.lit("t1t"), F.lit("W"), F.lit("x"), c("a"))).otherwise(F.create_map(F.lit("t2ct"), c("a"))), 1)},
       "CASE kind WHEN 0 THEN CAST(a AS BIGINT) WHEN 1 THEN CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(o AS BIGINT) END AS score", ("k", "n", "p"))

TIMES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN CAST(1700000000 + o_custkey AS STRING) WHEN 1 THEN CAST((1700000000 + o_custkey) * 1000 + 7 AS STRING) WHEN 2 THEN '2025-03-04T05:06:07Z' ELSE 'soon' END AS t, CASE o_orderkey % 3 WHEN 0 THEN '7/11/2024' WHEN 1 THEN '2024-12-01' ELSE 'May 2024' END AS d, CASE o_orderkey % 2 WHEN 0 THEN 'joined 2021-02-03 as player' ELSE 'unknown' END AS j FROM orders"
scalar("f09_f11_dates", TIMES, {"seconds": lambda: clean.epoch_seconds(c("t")), "day": lambda: clean.multi_format_date(c("d")), "joined": lambda: clean.join_date(c("j"))},
       "CASE k % 4 WHEN 0 THEN CAST(t AS BIGINT) WHEN 1 THEN CAST(t AS BIGINT) // 1000 WHEN 2 THEN 1741064767 END AS seconds, CASE d WHEN '7/11/2024' THEN '2024-11-07' ELSE d END AS day, CASE WHEN j LIKE '%2021%' THEN '2021-02-03' ELSE j END AS joined")

FORMATS = "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'BO5' WHEN 1 THEN 'Best of 1 (LAN)' WHEN 2 THEN 'bo3 then bo7' WHEN 3 THEN 'Best of 2 (Online)' WHEN 4 THEN '' ELSE 'Best of 3' END AS f, CASE o_custkey % 5 WHEN 0 THEN ' d2' WHEN 1 THEN 'Dust II' WHEN 2 THEN ' ' WHEN 3 THEN 'Nuke' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'Cache ' ELSE 'DE_mirage ' END END AS m FROM orders"
scalar("f12_f13_f52_format", FORMATS, {"best_of": lambda: clean.best_of(c("f")), "feed": lambda: clean.feed_best_of(c("f")), "map": lambda: clean.map_name(c("m")), "n": lambda: clean.format_text(c("f"))["best_of"], "venue": lambda: clean.format_text(c("f"))["venue"]},
       r"""CASE k % 6 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 3 END AS best_of, CASE k % 6 WHEN 0 THEN 'bo5' WHEN 2 THEN 'bo3' ELSE 'bo3' END AS feed, CASE m WHEN ' d2' THEN 'Dust2' WHEN 'Dust II' THEN 'Dust2' WHEN ' ' THEN 'TBA' WHEN 'Nuke' THEN 'Nuke' WHEN 'DE_mirage ' THEN 'Mirage' ELSE 'Cache' END AS map,
  TRY_CAST(nullif(regexp_extract(f, 'Best of (\d)', 1), '') AS INT) AS n, nullif(regexp_extract(f, '\((LAN|Online)\)', 1), '') AS venue""")  # fmt: skip

WIKI = "SELECT p_partkey AS k, concat('<!-- x --> ''''''', p_name, '''''''&nbsp;[[Page|', p_brand, ']] [[', p_type, ']]<br/>{{Flag|se}}<i>', CAST(p_size AS STRING), '</i>  {{x}} end ') AS raw FROM part"
scalar("f14_clean_text", WIKI, {"text": lambda: clean.clean_wiki(c("raw"))}, "regexp_extract(raw, '''''''([^'']*)''''''', 1) || ' ' || regexp_extract(raw, 'Page.([^\\]]*)\\]', 1) || ' ' || regexp_extract(raw, '\\]\\] \\[\\[([^\\]]*)\\]', 1) || ' ' || regexp_extract(raw, '<i>(\\d+)', 1) || ' end' AS text")

PHASES = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE l_partkey % 13 WHEN 0 THEN 'Grand Final' WHEN 1 THEN 'Semi-final' WHEN 2 THEN 'Semifinal' WHEN 3 THEN 'Semi-Finals' WHEN 4 THEN 'Quarterfinals' WHEN 5 THEN 'Round of 16' WHEN 6 THEN 'Round of 32' WHEN 7 THEN 'Playoffs' WHEN 8 THEN 'Round 2 High' WHEN 9 THEN 'Round 3' WHEN 10 THEN 'Group A' WHEN 11 THEN 'Open Qualifier' ELSE '' END AS stage, CASE l_suppkey % 4 WHEN 0 THEN 'low bracket' WHEN 1 THEN 'Elimination' ELSE '' END AS round FROM lineitem"
PHASE_SQL = "CASE p % 13 WHEN 0 THEN 'grand_final' WHEN 1 THEN 'grand_final' WHEN 2 THEN 'semifinal' WHEN 3 THEN 'semifinal' WHEN 4 THEN 'quarterfinal' WHEN 5 THEN 'round_of_16' WHEN 6 THEN 'round_of_32' WHEN 7 THEN 'playoffs' WHEN 8 THEN 'swiss_high' WHEN 9 THEN CASE WHEN round <> '' THEN 'swiss_low' ELSE 'swiss_round' END WHEN 10 THEN 'group_stage' WHEN 11 THEN 'qualifier' ELSE CASE WHEN round = '' THEN 'unknown' ELSE 'regular' END END"
phase = lambda: clean.infer_phase(c("stage"), c("round"))
scalar("f15_f19_phases", PHASES, {
    "phase": phase, "bracket": lambda: clean.bracket_group(c("round")), "playoff": lambda: rules.is_playoff_phase(phase()), "elimination": lambda: rules.is_elimination_phase(phase(), c("round")), "phase_order": lambda: rules.phase_order(phase()),
    "live_order": lambda: rules.live_phase(c("stage"))["phase_order"], "live_playoff": lambda: rules.live_phase(c("stage"))["is_playoff"], "live_elimination": lambda: rules.live_phase(c("stage"))["is_elimination"],
}, f"""{PHASE_SQL} AS phase, CASE round WHEN '' THEN '' ELSE 'low' END AS bracket, CASE WHEN p % 13 IN (0, 1, 2, 3, 4, 5, 7) THEN 1 ELSE 0 END AS playoff, CASE WHEN p % 13 IN (0, 1, 2, 3, 4, 5, 6, 7) OR round <> '' THEN 1 ELSE 0 END AS elimination,
  CASE p % 13 WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 2 THEN 85 WHEN 3 THEN 85 WHEN 4 THEN 75 WHEN 5 THEN 65 WHEN 6 THEN 55 WHEN 7 THEN 50 WHEN 8 THEN 45 WHEN 9 THEN CASE WHEN round <> '' THEN 30 ELSE 25 END WHEN 10 THEN 20 WHEN 11 THEN 10 ELSE CASE WHEN round = '' THEN 0 ELSE 1 END END AS phase_order,
  CASE p % 13 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 2 THEN 95 WHEN 3 THEN 95 WHEN 4 THEN 95 WHEN 5 THEN 65 WHEN 6 THEN 55 WHEN 7 THEN 50 WHEN 10 THEN 20 ELSE 1 END AS live_order, CASE WHEN p % 13 IN (0, 1, 2, 3, 4, 5, 6, 7) THEN 1 ELSE 0 END AS live_playoff, CASE WHEN p % 13 IN (0, 1, 2, 3, 4) THEN 1 ELSE 0 END AS live_elimination""", ("k", "n", "p", "stage", "round"))  # fmt: skip

TIERS = "SELECT o_orderkey AS k, CASE o_custkey % 5 WHEN 0 THEN 'S-Tier' WHEN 1 THEN 'A-Tier' WHEN 2 THEN 'B-Tier' WHEN 3 THEN 'C-Tier' ELSE 'Showmatch' END AS e, CASE o_custkey % 7 WHEN 0 THEN 'Major' WHEN 1 THEN 'Tier 1 qualifier' ELSE NULL END AS pub, CASE o_orderkey % 2 WHEN 0 THEN 'Offline' ELSE 'Online' END AS o, CASE o_orderkey % 3 WHEN 0 THEN 'qualifier' ELSE 'playoffs' END AS ph, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 160 AS INT) + 1 END AS r1, CASE WHEN o_custkey % 6 <> 0 THEN CAST(o_orderkey % 140 AS INT) + 1 END AS r2 FROM orders"
TIER_SQL = "CASE WHEN lower(coalesce(pub, '')) LIKE '%major%' OR lower(coalesce(pub, '')) LIKE '%tier 1%' OR (e = 'S-Tier' AND o = 'Offline' AND coalesce(least(r1, r2), 999) <= 50) THEN 'T1' WHEN e = 'S-Tier' OR (e = 'A-Tier' AND o = 'Offline' AND coalesce(least(r1, r2), 999) <= 80) OR (coalesce(least(r1, r2), 999) <= 30 AND coalesce(greatest(r1, r2), 999) <= 100 AND ph <> 'qualifier') THEN 'T1_5' WHEN e IN ('A-Tier', 'B-Tier') OR coalesce(least(r1, r2), 999) <= 120 THEN 'T2' ELSE 'T3' END"
tier = lambda: rules.model_tier(c("e"), c("pub"), c("o"), c("ph"), c("r1"), c("r2"))
scalar("f20_f22_f26_tiers", TIERS, {"tier": tier, "risk": lambda: rules.integrity_label(tier(), c("e"), c("pub"), c("o"), c("ph"), c("r1"), c("r2")), "consensus": lambda: rules.mean_known(c("r1"), c("r2")), "label": lambda: rules.tier_label(tier()), "lan": lambda: rules.is_lan(c("o"))},
       f"{TIER_SQL} AS tier, CASE WHEN e = 'Showmatch' THEN 'high' WHEN {TIER_SQL} IN ('T1', 'T1_5') AND o = 'Offline' AND coalesce(pub, '') NOT LIKE '%qualifier%' THEN 'low' WHEN {TIER_SQL} = 'T2' AND coalesce(greatest(r1, r2), 999) <= 120 THEN 'medium' ELSE 'high' END AS risk, (coalesce(r1, r2) + coalesce(r2, r1)) / 2.0 AS consensus, CASE {TIER_SQL} WHEN 'T1' THEN 'tier_1' ELSE 'tier_2' END AS label, CASE o WHEN 'Offline' THEN 1 ELSE 0 END AS lan")

RISK = "SELECT o_orderkey AS k, o_custkey % 50 * 1.0 AS ra, o_orderkey % 60 * 1.0 AS rb, 0.9 + o_custkey % 30 / 100.0 AS rating, o_custkey % 35 AS ma, o_orderkey % 35 AS mb, o_custkey % 4 AS ca, o_orderkey % 3 AS cb, o_orderkey % 2 = 0 AS lan, o_custkey % 31 = 0 AS inv, o_custkey % 11 = 0 AS rum, CASE o_orderkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS letter, o_custkey % 13 AS t12, o_custkey % 17 AS t20, o_orderkey % 50 * 1.0 AS med FROM orders"
ev = lambda: rules.event_tier(F.lit(""), c("letter"), c("lan"), c("t12"), c("t20"), c("med"))
ta = lambda: rules.team_tier(c("ra"), c("rating"), c("ma"), c("ca"))
tb = lambda: rules.team_tier(c("rb"), F.lit(1.0), c("mb"), c("cb"))
risk = lambda: rules.integrity_score(ev(), c("lan"), ~c("lan"), (ta(), tb()), (c("ca"), c("cb")), c("inv"), c("rum"))
out = lambda: rules.excluded(ev(), ~c("lan"), (c("ra"), c("rb")), (c("ma"), c("mb")), c("inv"))
EV = "CASE WHEN letter = 'S' AND lan AND t12 >= 6 AND med <= 18 THEN 'tier_1' WHEN letter IN ('S', 'A') AND t20 >= 8 AND med <= 28 THEN 'tier_1_5' WHEN letter IN ('A', 'B') AND med <= 45 THEN 'tier_2' ELSE 'tier_3' END"
TA = "CASE WHEN ra <= 12 AND rating >= 1.03 AND ma >= 20 AND ca <= 1 THEN 'tier_1' WHEN ra <= 20 THEN 'tier_1_5' WHEN ra <= 40 THEN 'tier_2' ELSE 'tier_3' END"
TB = "CASE WHEN rb <= 20 THEN 'tier_1_5' WHEN rb <= 40 THEN 'tier_2' ELSE 'tier_3' END"
RK = f"greatest(0.0, least(1.0, CASE WHEN lan THEN 0.05 ELSE 0.2 END + CASE {EV} WHEN 'tier_1_5' THEN 0.05 WHEN 'tier_2' THEN 0.2 WHEN 'tier_3' THEN 0.45 ELSE 0 END + CASE {TA} WHEN 'tier_3' THEN 0.1 ELSE 0 END + CASE {TB} WHEN 'tier_3' THEN 0.1 ELSE 0 END + CASE WHEN ca >= 2 THEN 0.1 ELSE 0 END + CASE WHEN cb >= 2 THEN 0.1 ELSE 0 END + CASE WHEN inv THEN 0.5 ELSE 0 END + CASE WHEN rum THEN 0.1 ELSE 0 END + CASE WHEN NOT lan AND {EV} IN ('tier_2', 'tier_3') THEN 0.1 ELSE 0 END))"
EX = f"(inv OR {EV} = 'tier_3' OR (NOT lan AND ra > 40 AND rb > 40) OR least(ma, mb) < 10)"
scalar("f23_f24_integrity", RISK, {"event": ev, "team_a": ta, "team_b": tb, "risk": lambda: F.round(risk(), 6), "excluded": out, "weight": lambda: F.round(rules.training_weight(ev(), c("lan"), risk(), out()), 2)},
       f"{EV} AS event, {TA} AS team_a, {TB} AS team_b, round(CAST({RK} AS DOUBLE), 6) AS risk, {EX} AS excluded, round(CASE WHEN {EX} THEN 0.0 ELSE round(CAST(CASE {EV} WHEN 'tier_1' THEN 1.0 WHEN 'tier_1_5' THEN 0.9 ELSE CASE WHEN lan THEN 0.75 ELSE 0.45 END END * (1.0 - CAST({RK} AS DOUBLE) * 0.5) AS DOUBLE), 3) END, 2) AS weight")

PRODUCT = "SELECT o_orderkey AS k, CASE o_custkey % 6 WHEN 0 THEN 'S-Tier' WHEN 1 THEN 'tier 2' WHEN 2 THEN 'C-Tier' WHEN 3 THEN 'Tier_3' ELSE NULL END AS d, CASE o_orderkey % 5 WHEN 0 THEN 'IEM Spring' WHEN 1 THEN 'CCT Major' WHEN 2 THEN 'Open cup' WHEN 3 THEN 'blastoff' ELSE 'BLAST Final' END AS n, CASE o_orderkey % 4 WHEN 0 THEN 'Not started' WHEN 1 THEN 'Ended' WHEN 2 THEN '' ELSE 'live' END AS w, o_orderdate AS t, CASE o_custkey % 6 WHEN 0 THEN 'Double-Elimination bracket' WHEN 1 THEN 'GSL groups' WHEN 2 THEN 'Swiss (16 teams)' WHEN 3 THEN 'knockout' WHEN 4 THEN 'round_robin' ELSE 'odd' END AS f, CASE o_orderkey % 11 WHEN 0 THEN 'TBD' WHEN 1 THEN 'unknown' WHEN 2 THEN '' WHEN 3 THEN 'Team 1' WHEN 4 THEN 'Quarterfinal winner' WHEN 5 THEN 'finalist  loser' WHEN 6 THEN ' Europe qualifier' WHEN 7 THEN 'Winner of' WHEN 8 THEN 'Team Spirit' ELSE 'Team' END AS team FROM orders"
scalar("f25_f27_f29_product", PRODUCT, {"tier": lambda: rules.product_tier(c("d"), c("n")), "status": lambda: rules.status(c("w"), c("t"), c("t"), F.lit("1997-01-01").cast("timestamp")), "format": lambda: rules.format_alias(c("f")), "placeholder": lambda: rules.is_placeholder(c("team"))},
       "CASE WHEN d = 'S-Tier' THEN 'tier_1' WHEN d = 'tier 2' THEN 'tier_2' WHEN d IN ('C-Tier', 'Tier_3') THEN 'excluded' WHEN n = 'CCT Major' THEN 'tier_2' WHEN n IN ('IEM Spring', 'BLAST Final') THEN 'tier_1' ELSE 'pending' END AS tier, CASE w WHEN 'Not started' THEN 'upcoming' WHEN 'Ended' THEN 'finished' WHEN 'live' THEN 'live' ELSE CASE WHEN t < TIMESTAMP '1997-01-01' THEN 'finished' WHEN t > TIMESTAMP '1997-01-01' THEN 'upcoming' ELSE 'live' END END AS status, CASE f WHEN 'Double-Elimination bracket' THEN 'double_elimination' WHEN 'GSL groups' THEN 'gsl' WHEN 'Swiss (16 teams)' THEN 'swiss' WHEN 'knockout' THEN 'single_elimination' WHEN 'round_robin' THEN 'round_robin' ELSE 'mixed' END AS format, team NOT IN ('Team', 'Team Spirit') AS placeholder")

IDS = "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE c_name END AS a, c_mktsegment AS b, concat('https://x.org/wiki/', c_mktsegment, '/Stage_1%20Group+A#top') AS href, CASE c_custkey % 2 WHEN 0 THEN concat(c_mktsegment, '/Season_1/Group_A') ELSE c_mktsegment END AS title, concat('[', c_name, '](http://x/', c_mktsegment, ') #section:One #section:Two #section:One') AS md FROM customer"
scalar("f30_f33_f50_f56_identity", IDS, {
    "first": lambda: clean.first_non_empty(c("a"), c("b")), "identity": lambda: clean.fallback_identity(c("a"), c("b"), c("k")), "title": lambda: clean.title_from_href(c("href")), "stage": lambda: clean.source_stage(c("title")),
    "parent": lambda: clean.parent_title(c("title"), F.lit(False)), "link": lambda: clean.link_target(c("md")), "sections": lambda: F.array_join(clean.section_titles(c("md")), ","), "negative": lambda: clean.synthetic_id(c("b"), c("k")) < 0,
}, "coalesce(nullif(trim(a), ''), b) AS first, coalesce(nullif(trim(a), ''), b || '|' || CAST(k AS VARCHAR)) AS identity, 'Stage 1 Group+A' AS title, CASE k % 2 WHEN 0 THEN 'Group A' ELSE '' END AS stage, CASE k % 2 WHEN 0 THEN b || '/Season_1' ELSE b END AS parent, 'http://x/' || b AS link, 'One,Two' AS sections, true AS negative".replace("title, CASE", "title, CASE"), ("k",))

PROBS = "SELECT o_orderkey AS k, (o_custkey % 101) / 100.0 AS p, o_custkey % 400 - 200.0 AS d, o_orderkey % 90 - 45.0 AS adv, o_custkey % 1500 - 750.0 AS pts, (o_orderkey % 21 - 10) / 10.0 AS form, o_custkey % 3 <> 0 AS known, o_custkey % 12 AS w, o_custkey % 12 + o_orderkey % 5 AS n FROM orders"
LG = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"
EP = "(1 / (1 + pow(10.0, -d / 400.0)))"
power = lambda name: (lambda: rules.power_probabilities(rules.elo_probability(c("d")), c("adv"), c("known"), c("adv") * 2, c("pts"), c("known"))[name])
scalar("f34_f40_probabilities", PROBS, {
    "sig": lambda: rules.sigmoid(c("adv")), "lg": lambda: rules.logit(c("p")), "elo": lambda: rules.elo_probability(c("d")), "p4": lambda: rules.probability4(c("p") * 1.2), "label": lambda: rules.confidence_label(c("p")), "rank": power("rank"), "vrs": power("vrs"), "rank_vrs": power("rank_vrs"),
    "elo_rank_vrs": power("elo_rank_vrs"), "base": lambda: rules.bounded_baseline(rules.elo_probability(c("d")), c("adv"), c("pts"), c("form")), "shrunk": lambda: rules.shrink_unknown(c("p"), c("known")), "rate": lambda: rules.shrunk_rate(c("w"), c("n")),
}, f"""1 / (1 + exp(-greatest(-35.0, least(35.0, adv)))) AS sig, {LG.format('p')} AS lg, {EP} AS elo, round(least(1.0, p * 1.2), 4) AS p4, CASE WHEN greatest(p, 1 - p) >= 0.75 THEN 'strong' WHEN greatest(p, 1 - p) >= 0.65 THEN 'watch' WHEN greatest(p, 1 - p) >= 0.58 THEN 'lean' ELSE 'thin' END AS label,
  1 / (1 + exp(-(CASE WHEN known THEN 0.055 * adv ELSE 0 END))) AS rank, 1 / (1 + exp(-(CASE WHEN known THEN 0.0115 * adv * 2 + 0.00045 * pts ELSE 0 END))) AS vrs, 1 / (1 + exp(-(0.52 * CASE WHEN known THEN 0.055 * adv ELSE 0 END + 0.48 * CASE WHEN known THEN 0.0115 * adv * 2 + 0.00045 * pts ELSE 0 END))) AS rank_vrs,
  1 / (1 + exp(-(0.42 * {LG.format(EP)} + 0.31 * CASE WHEN known THEN 0.055 * adv ELSE 0 END + 0.27 * CASE WHEN known THEN 0.0115 * adv * 2 + 0.00045 * pts ELSE 0 END))) AS elo_rank_vrs,
  greatest(0.08, least(0.92, 1 / (1 + exp(-({LG.format(EP)} + 0.009 * greatest(-40.0, least(40.0, adv)) + 0.00035 * greatest(-650.0, least(650.0, pts)) + 0.3 * greatest(-0.5, least(0.5, form))))))) AS base,
  greatest(0.08, least(0.92, CASE WHEN known THEN p ELSE 0.5 + (p - 0.5) * 0.45 END)) AS shrunk, CASE WHEN n > 0 THEN (w + 2.0) / (n + 4.0) ELSE 0.5 END AS rate""")  # fmt: skip

TRAITS = "SELECT p_partkey AS k, concat(CAST(p_size AS STRING), '/100') AS t1, CASE p_partkey % 3 WHEN 0 THEN 'n/a' ELSE concat(CAST(p_partkey % 140 AS STRING), ' / 100') END AS t2, CASE p_partkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE '61' END AS t3, CASE WHEN p_partkey % 7 <> 0 THEN CAST(60 + p_partkey % 100 AS DOUBLE) / 100 END AS rating FROM part"
read = lambda *names: F.array(*[rules.trait(c(n)) for n in names])
scalar("f41_traits", TRAITS, {"t1": lambda: rules.trait(c("t1")), "t2": lambda: rules.trait(c("t2")), "signal": lambda: rules.signal_index(read("t1", "t2", "t3"), c("rating")), "none": lambda: rules.signal_index(F.array(rules.trait(F.lit("?"))), c("rating")), "role": lambda: rules.player_role(rules.trait(c("t1")), F.coalesce(rules.trait(c("t2")), F.lit(0.0)), F.lit(0.0), F.lit(0.0), F.lit(0.0))},
       "a AS t1, b AS t2, CAST(floor(greatest(0.0, least(100.0, (coalesce(a, 0) + coalesce(b, 0) + coalesce(d, 0)) / greatest(1, len(list_filter([a, b, d], lambda v: v IS NOT NULL))) * 0.55 + coalesce(rating, 1.0) / 1.35 * 100 * 0.45)) + 0.5) AS INT) AS signal, CAST(floor(coalesce(rating, 1.0) / 1.35 * 100 * 0.45 + 0.5) AS INT) AS none, CASE WHEN a >= 60 THEN 'awper' WHEN coalesce(b, 0) >= 60 THEN 'opener' ELSE 'rifler' END AS role")
ORACLE["f41_traits"] = ORACLE["f41_traits"].replace(" FROM src", r" FROM (SELECT k, CAST(rating AS DOUBLE) AS rating, least(100.0, CAST(regexp_extract(t1, '(\d+)', 1) AS DOUBLE)) AS a, least(100.0, TRY_CAST(nullif(regexp_extract(t2, '^(\d+)', 1), '') AS DOUBLE)) AS b0, t2 IS NULL OR NOT regexp_matches(t2, '^\d') AS none2, CASE t3 WHEN '61' THEN 61.0 END AS d, CASE WHEN none2 THEN NULL ELSE b0 END AS b FROM src)")

NULLS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 101) / 100.0 END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 - 45.0 END AS adv, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 1500 - 750.0 END AS pts, CASE WHEN o_custkey % 7 <> 0 THEN (o_orderkey % 21 - 10) / 10.0 END AS form FROM orders"
scalar("f34_f38_unknowns", NULLS, {"p4": lambda: rules.probability4(c("p")), "sig": lambda: rules.sigmoid(c("adv")), "lg": lambda: rules.logit(c("p")), "base": lambda: rules.bounded_baseline(c("p"), c("adv"), c("pts"), c("form"))},
       f"""CASE WHEN p IS NOT NULL THEN round(CAST(p AS DOUBLE), 4) END AS p4, CASE WHEN adv IS NOT NULL THEN 1 / (1 + exp(-CAST(greatest(-35.0, least(35.0, adv)) AS DOUBLE))) END AS sig, CASE WHEN p IS NOT NULL THEN {LG.format('p')} END AS lg,
  greatest(0.08, least(0.92, 1 / (1 + exp(-({LG.format('coalesce(p, 0.5)')} + 0.009 * greatest(-40.0, least(40.0, coalesce(adv, 0))) + 0.00035 * greatest(-650.0, least(650.0, coalesce(pts, 0))) + 0.3 * greatest(-0.5, least(0.5, coalesce(form, 0)))))))) AS base""")  # fmt: skip

VETO = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('1. ', c_name, ' removed Nuke') WHEN 1 THEN concat('2. ', c_name, ' picked Dust2 ') WHEN 2 THEN '7. Mirage was left over' ELSE 'no veto here' END AS line, CASE c_custkey % 5 WHEN 0 THEN 'PICK' WHEN 1 THEN 'left over' WHEN 2 THEN 'banned' WHEN 3 THEN 'decider' ELSE 'odd' END AS act, c_name AS name FROM customer"
scalar("f42_f43_vetoes", VETO, {"team": lambda: clean.veto_line(c("line"))["team"], "action": lambda: clean.veto_line(c("line"))["action"], "map": lambda: clean.veto_line(c("line"))["map"], "word": lambda: clean.status_word(c("act"))},
       "CASE WHEN k % 4 < 2 THEN name END AS team, CASE k % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'picked' WHEN 2 THEN 'leftover' END AS action, CASE k % 4 WHEN 0 THEN 'Nuke' WHEN 1 THEN 'Dust2' WHEN 2 THEN 'Mirage' END AS map, CASE k % 5 WHEN 0 THEN 'picked' WHEN 1 THEN 'leftover' WHEN 2 THEN 'removed' WHEN 3 THEN 'leftover' END AS word")

SCORES = "SELECT o_orderkey AS k, o_custkey % 17 AS ma, o_orderkey % 15 AS mb, o_custkey % 3 AS sa, o_orderkey % 3 AS sb, CASE o_custkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS own, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE 'y' END AS win FROM orders"
scalar("f44_f45_f49_f51_scores", SCORES, {"label": lambda: rules.score_label(c("ma"), c("mb"), c("sa"), c("sb")), "a": lambda: rules.oriented(c("own"), F.lit("a"), c("sa"), c("sb"))["a"], "b": lambda: rules.oriented(c("own"), F.lit("a"), c("sa"), c("sb"))["b"], "outcome": lambda: rules.pick_outcome(F.lit("x"), c("win")), "target": lambda: (c("sa") > c("sb")).cast("int")},
       "CASE WHEN greatest(sa, sb) <= 1 THEN CAST(ma AS VARCHAR) || '-' || CAST(mb AS VARCHAR) ELSE CAST(sa AS VARCHAR) || '-' || CAST(sb AS VARCHAR) END AS label, CASE own WHEN 'a' THEN sa ELSE sb END AS a, CASE own WHEN 'a' THEN sb ELSE sa END AS b, CASE WHEN win IS NULL THEN 'pending' WHEN win = 'x' THEN 'won' ELSE 'lost' END AS outcome, CASE WHEN sa > sb THEN 1 ELSE 0 END AS target")

EVENTS = "SELECT event_id AS k, max(CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END) = 1 AS sw, max(CASE WHEN match_phase = 'group_stage' AND event_id % 2 = 0 THEN 1 ELSE 0 END) = 1 AS gr, max(CASE WHEN event_id % 3 = 0 THEN is_playoff ELSE 0 END) = 1 AS po FROM v_matches GROUP BY event_id"
from duelspark.sources.fixtures import with_views  # noqa: E402

scalar("f47_event_format", EVENTS, {"type": lambda: rules.event_format(c("sw") & (c("k") % 5 == 0), c("gr"), c("po"))["type"], "label": lambda: rules.event_format(c("sw") & (c("k") % 5 == 0), c("gr"), c("po"))["label"]},
       "CASE WHEN ((sw AND k % 5 = 0) OR gr) AND po THEN 'mixed' WHEN sw AND k % 5 = 0 THEN 'swiss' WHEN gr THEN 'gsl' WHEN po THEN 'single_elimination' ELSE 'mixed' END AS type, coalesce(nullif(concat_ws(' + ', CASE WHEN gr THEN 'Group stage' END, CASE WHEN sw AND k % 5 = 0 THEN 'Swiss stage' END, CASE WHEN po THEN 'Playoffs' END), ''), 'Event series') AS label")
ORACLE["f47_event_format"] = with_views("," + ORACLE["f47_event_format"].removeprefix("WITH"), "v_matches")

EXPLAIN = "SELECT o_orderkey AS k, CASE WHEN o_custkey % 53 <> 0 THEN (o_custkey % 91 + 5) / 100.0 END AS p, CASE WHEN o_custkey % 31 <> 0 THEN 1400.0 + o_custkey % 300 END AS r1, 1400.0 + o_orderkey % 300 AS r2, (o_custkey % 10) / 10.0 AS f1, CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 10) / 10.0 END AS f2, (o_custkey % 9) / 9.0 AS d1, (o_orderkey % 7) / 7.0 AS d2, CAST(o_custkey % 40 AS INT) AS v1, CAST(o_orderkey % 40 AS INT) AS v2, CAST(o_custkey % 7 AS INT) AS l1, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(4 + o_orderkey % 5 AS INT) END AS l2, CASE WHEN o_orderkey % 3 <> 0 THEN ((o_custkey % 91 + 5) + (o_orderkey % 23 - 11)) / 110.0 END AS mp, CAST(o_custkey % 60 AS INT) AS ev, CAST(o_custkey % 37 AS INT) AS s1, CAST(o_orderkey % 41 AS INT) AS s2, o_orderkey % 2 = 0 AS known FROM orders"
expl = lambda field: (lambda: rules.explanation(c("p"), (c("r1"), c("r2")), (c("f1"), c("f2")), (c("d1"), c("d2")), (c("v1"), c("v2")), (c("l1"), c("l2")), c("mp"), c("ev"), (c("s1"), c("s2")), c("known"))[field])
scalar("f48_explanations", EXPLAIN, {"confidence": expl("confidence"), "n_signals": expl("n_signals"), "risk": expl("risk"), "counter": expl("counter"), "supports": lambda: F.array_join(expl("supports")(), ",")},
       """conf AS confidence, len(q) AS n_signals, CASE WHEN conf < 0.56 THEN 'Thin edge' WHEN least(coalesce(l1, 0), coalesce(l2, 0)) < 5 THEN 'Lineup gap' WHEN mp IS NOT NULL AND least(s1, s2) < 10 THEN 'Veto sample' WHEN mp IS NOT NULL AND ev < 20 THEN 'Map sample'
  WHEN against.s < -0.2 THEN against.l || ' disagrees' ELSE 'Balanced evidence' END AS risk, against.k AS counter, array_to_string(list_transform(list_filter(q, lambda z: z.s > 0)[1:3], lambda z: z.k), ',') AS supports""")  # fmt: skip
ORACLE["f48_explanations"] = ORACLE["f48_explanations"].replace(" FROM src", """ FROM (SELECT *, list_filter(q, lambda z: z.s < 0)[1] AS against FROM (SELECT *, list_sort(list_filter([{'n': -abs(e1), 'i': 1, 's': e1, 'k': 'rating', 'l': 'Team rating'}, {'n': -abs(e2), 'i': 2, 's': e2, 'k': 'form', 'l': 'Recent form'}, {'n': -abs(e3), 'i': 3, 's': e3, 'k': 'maps', 'l': 'Map depth'}, {'n': -abs(e4), 'i': 4, 's': e4, 'k': 'ranking', 'l': 'VRS order'}, {'n': -abs(e5), 'i': 5, 's': e5, 'k': 'veto', 'l': CASE WHEN known THEN 'Official veto' ELSE 'Projected veto' END}], lambda z: z.n <= -0.025)) AS q
  FROM (SELECT *, greatest(-1.0, least(1.0, g * ((coalesce(r1, 1500.0) - r2) / 260.0))) AS e1, greatest(-1.0, least(1.0, g * (f1 - coalesce(f2, 0.5)) * 2.2)) AS e2, greatest(-1.0, least(1.0, g * (d1 - d2) * 2.0)) AS e3, CASE WHEN v1 > 0 AND v2 > 0 THEN greatest(-1.0, least(1.0, g * (v2 - v1) / 20.0)) END AS e4, CASE WHEN mp IS NOT NULL THEN greatest(-1.0, least(1.0, g * (mp - pp) * 5.0)) END AS e5
  FROM (SELECT *, greatest(pp, 1 - pp) AS conf, CASE WHEN pp >= 0.5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM (SELECT * REPLACE (CAST(r1 AS DOUBLE) AS r1, CAST(r2 AS DOUBLE) AS r2, CAST(f1 AS DOUBLE) AS f1, CAST(f2 AS DOUBLE) AS f2, CAST(d1 AS DOUBLE) AS d1, CAST(d2 AS DOUBLE) AS d2, CAST(mp AS DOUBLE) AS mp), greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(CAST(p AS DOUBLE), 0.5))) AS pp FROM src))))""" + ")")

OPPONENT = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('{{TeamOpponent|', c_name, '|score=2}}') WHEN 1 THEN concat('{{TeamOpponent|team=', c_name, '|score=W}}') WHEN 2 THEN concat('[[', c_name, ']]') ELSE '' END AS raw, c_name AS name FROM customer"
scalar("f53_opponents", OPPONENT, {"team": lambda: clean.opponent_template(c("raw"))["team"], "score": lambda: clean.opponent_template(c("raw"))["score"]}, "CASE WHEN k % 4 = 3 THEN '' ELSE name END AS team, CASE k % 4 WHEN 0 THEN 2 END AS score")

for _name, _sql in list(ORACLE.items()):
    ORACLE[_name] = _sql.replace(" AS STRING)", " AS VARCHAR)")

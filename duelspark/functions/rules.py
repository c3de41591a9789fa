"""Domain rules as column functions: tiers, integrity, phases, probabilities, explanations."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import blank_null

#: How late in an event a phase is.
PHASE_ORDER = {
    "grand_final": 100, "final": 95, "semifinal": 85, "quarterfinal": 75, "round_of_16": 65, "round_of_32": 55, "playoffs": 50, "swiss_high": 45,
    "swiss_mid": 35, "swiss_low": 30, "swiss_round": 25, "group_stage": 20, "qualifier": 10, "showmatch": 5, "regular": 1, "unknown": 0,
}
#: Phases of a playoff, and those that eliminate.
PLAYOFF = ("grand_final", "final", "semifinal", "quarterfinal", "round_of_16", "playoffs")
ELIMINATION = (*PLAYOFF, "round_of_32")
#: Words of a live stage text and their order, the first that fits.
LIVE_STAGES = (("grand final", 100), ("final", 95), ("semi", 85), ("quarter", 75), ("round of 16", 65), ("round of 32", 55), ("playoff", 50), ("swiss", 25), ("group", 20))
#: Names of series by product tier.
TIER_TWO_NAMES = r"(?i)\b(?:cct|roman imperium|esl challenger|thunderpick world championship)\b"
TIER_ONE_NAMES = r"(?i)\b(?:major|iem|blast|esl pro league|pgl masters|esports world cup|fissure playground)\b"
#: Spellings of formats and states.
FORMATS = {
    "single elimination": "single_elimination", "single elimination bracket": "single_elimination", "knockout": "single_elimination",
    "double elimination": "double_elimination", "double elimination bracket": "double_elimination", "gsl groups": "gsl", "gsl": "gsl", "swiss": "swiss",
    "round robin": "round_robin", "league": "round_robin", "mixed": "mixed",
}
STATUSES = {"scheduled": "upcoming", "not started": "upcoming", "playing": "live", "in progress": "live", "completed": "finished", "ended": "finished", "final": "finished"}
#: Names that stand for a team that isn't known yet; blanks do too.
PLACEHOLDERS = ("tbd", "unknown", r"team\s*\d+", r"(?:quarter|semi)?final(?:ist)?\s+(?:winner|loser)", r"(?:winner|loser)\s+of", r"[a-z]+\s+qualifier", "")
#: Product tiers by how an event's own tier is spelled, _ and - being spaces.
DECLARED_TIERS = {
    "tier 1": "tier_1", "major": "tier_1", "s tier": "tier_1", "a tier": "tier_1", "tier 2": "tier_2", "b tier": "tier_2", "c tier": "excluded", "d tier": "excluded",
    "tier 3": "excluded", "tier3": "excluded", "excluded": "excluded",
}
#: State policies, and the worst rank of those that go by ranks.
POLICIES = ("all", "no_t3", "clean_only", "ranked_top120", "ranked_top200")
RANKED_POLICIES = {"ranked_top120": 120, "ranked_top200": 200}
#: Words of a status that tell a contest is over, and the winner's scores that do.
FINISHED_WORDS, FINISHED_SCORES = ("finished", "completed", "final", "ended"), (2, 3)
#: Labels of the signals an explanation is made of, in their order.
SIGNALS = {"rating": "Team rating", "form": "Recent form", "maps": "Map depth", "ranking": "VRS order", "veto": "veto"}

#: Tiers of contests, events and teams. A line's conditions must all hold; the first line that fits decides.
MODEL_TIERS = (
    ("T1", {"publisher": "major"}), ("T1", {"publisher": "tier 1"}), ("T1", {"letter": ("s-tier",), "offline": True, "best_rank": 50}),
    ("T1_5", {"letter": ("s-tier",)}), ("T1_5", {"letter": ("a-tier",), "offline": True, "best_rank": 80}), ("T1_5", {"best_rank": 30, "worst_rank": 100, "not_phase": "qualifier"}),
    ("T2", {"letter": ("a-tier", "b-tier")}), ("T2", {"best_rank": 120}),
)
EVENT_TIERS = (
    ("tier_1", {"declared": "tier_1"}), ("tier_1", {"letter": ("S",), "lan": True, "top12": 6, "median_rank": 18}),
    ("tier_1_5", {"letter": ("S", "A"), "top20": 8, "median_rank": 28}), ("tier_2", {"letter": ("A", "B"), "median_rank": 45}),
)
TEAM_TIERS = (("tier_1", {"rank": 12, "rating": 1.03, "core_maps": 20, "changes": 1}), ("tier_1_5", {"rank": 20}), ("tier_2", {"rank": 40}))
#: Risks that add up to an integrity score, and the changes of a roster that count as one.
RISKS = {"lan": 0.05, "online": 0.20, "weak_team": 0.10, "changed_team": 0.10, "investigated": 0.50, "rumoured": 0.10, "online_lower": 0.10}
EVENT_RISKS = {"tier_1_5": 0.05, "tier_2": 0.20, "tier_3": 0.45}
MANY_CHANGES, UNRANKED = 2, 999
#: What a contest weighs in training by its event's tier, and what leaves it out.
WEIGHTS, LAN_WEIGHT, OTHER_WEIGHT = {"tier_1": 1.0, "tier_1_5": 0.9}, 0.75, 0.45
FAR_RANK, FEW_MAPS = 40, 10
#: A contest's risk label by its tier.
LOW_RISK_TIERS, MEDIUM_RISK_TIER, MEDIUM_RISK_RANK = ("T1", "T1_5"), "T2", 120


def first_fit(lines: tuple, conditions: dict, otherwise: str) -> Column:
    """The label of the first line all of whose conditions hold; each condition is a function of the line's value."""
    fits = [F.when(functools.reduce(lambda a, b: a & b, [conditions[name](value) for name, value in line.items()]), label) for label, line in lines]
    return F.coalesce(*fits, F.lit(otherwise))


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def clamp(x: Column, low: float, high: float) -> Column:
    """x held in the range; an unknown x stays unknown."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(x, -35.0, 35.0)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = clamp(p, eps, 1.0 - eps)
    return F.log(c / (1.0 - c))


def elo_probability(diff: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -diff / 400.0))


def probability4(p: Column) -> Column:
    return F.round(clamp(p, 0.0, 1.0), 4)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1.0 - p)


def confidence_label(p: Column) -> Column:
    c = confidence(p)
    return F.when(c >= 0.75, "strong").when(c >= 0.65, "watch").when(c >= 0.58, "lean").otherwise("thin")


def is_playoff_phase(phase: Column) -> Column:
    return phase.isin(*PLAYOFF).cast("int")


def is_elimination_phase(phase: Column, *texts: Column) -> Column:
    t = F.lower(F.concat_ws(" ", *texts)) if texts else F.lit("")
    return (phase.isin(*ELIMINATION) | t.contains("low") | t.contains("elimination")).cast("int")


def phase_order(phase: Column) -> Column:
    return F.coalesce(lookup(PHASE_ORDER, F.lower(phase)), F.lit(0))


def live_phase(stage: Column) -> Column:
    """struct(phase_order, is_playoff, is_elimination) of a live stage text."""
    s = F.lower(F.coalesce(stage, F.lit("")))
    any_of = lambda *words: F.greatest(*[s.contains(w).cast("int") for w in words])
    order = F.lit(1)
    for word, n in reversed(LIVE_STAGES):
        order = F.when(s.contains(word), n).otherwise(order)
    return F.struct(order.alias("phase_order"), any_of("playoff", "round of", "quarter", "semi", "final").alias("is_playoff"), any_of("lower", "elimination", "decider", "final").alias("is_elimination"))


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _ranks(rank1: Column, rank2: Column) -> tuple[Column, Column]:
    """The better and the worse of the known ranks."""
    return tuple(F.coalesce(side(rank1, rank2), F.lit(UNRANKED)) for side in (F.least, F.greatest))


def model_tier(event_tier: Column, publisher_tier: Column, event_type: Column, phase: Column, rank1: Column, rank2: Column) -> Column:
    """T1, T1_5, T2 or T3 of a contest (F20); unknown ranks count as 999."""
    best, worst = _ranks(rank1, rank2)
    conditions = {
        "publisher": lambda v: _lower(publisher_tier).contains(v), "letter": lambda v: _lower(event_tier).isin(*v), "offline": lambda v: _lower(event_type).contains("offline") == v,
        "best_rank": lambda v: best <= v, "worst_rank": lambda v: worst <= v, "not_phase": lambda v: _lower(phase) != v,
    }
    return first_fit(MODEL_TIERS, conditions, "T3")


def integrity_label(tier: Column, event_tier: Column, publisher_tier: Column, event_type: Column, phase: Column, rank1: Column, rank2: Column) -> Column:
    """low, medium or high risk of a contest (F21); a showmatch is always a high one."""
    show = _lower(F.concat_ws(" ", phase, event_tier)).contains("showmatch")
    safe = tier.isin(*LOW_RISK_TIERS) & _lower(event_type).contains("offline") & ~_lower(publisher_tier).contains("qualifier")
    middling = (tier == MEDIUM_RISK_TIER) & (_ranks(rank1, rank2)[1] <= MEDIUM_RISK_RANK)
    return F.coalesce(F.when(~show & safe, "low"), F.when(~show & middling, "medium"), F.lit("high"))


def mean_known(*ranks: Column) -> Column:
    """Mean of the ranks that are known."""
    known = F.filter(F.array(*[r.cast("double") for r in ranks]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def team_tier(rank: Column, rating: Column, core_maps: Column, changes: Column) -> Column:
    """tier_1 … tier_3 of a team."""
    rated = F.coalesce(rating, F.lit(1.0))
    return first_fit(TEAM_TIERS, {"rank": lambda v: rank <= v, "rating": lambda v: rated >= v, "core_maps": lambda v: core_maps >= v, "changes": lambda v: changes <= v}, "tier_3")


def event_tier(declared: Column, letter: Column, is_lan: Column, top12: Column, top20: Column, median_rank: Column) -> Column:
    """tier_1 … tier_3 of an event by what it declares, its letter and its field."""
    middle = F.coalesce(median_rank, F.lit(float(UNRANKED)))
    conditions = {
        "declared": lambda v: declared == v, "letter": lambda v: letter.isin(*v), "lan": lambda v: is_lan == v,
        "top12": lambda v: top12 >= v, "top20": lambda v: top20 >= v, "median_rank": lambda v: middle <= v,
    }
    return first_fit(EVENT_TIERS, conditions, "tier_3")


def integrity_score(event: Column, is_lan: Column, online: Column, tiers: tuple[Column, Column], changes: tuple[Column, Column], investigated: Column, rumoured: Column) -> Column:
    """Additive risk in [0, 1]."""
    present = [
        ("lan", is_lan), ("online", F.coalesce(~is_lan, F.lit(True))), *[("weak_team", t == "tier_3") for t in tiers], *[("changed_team", n >= MANY_CHANGES) for n in changes],
        ("investigated", investigated), ("rumoured", rumoured), ("online_lower", online & event.isin("tier_2", "tier_3")),
    ]
    return clamp(sum((F.when(here, RISKS[name]).otherwise(0.0) for name, here in present), F.coalesce(lookup(EVENT_RISKS, event), F.lit(0.0))), 0.0, 1.0)


def excluded(event: Column, online: Column, ranks: tuple[Column, Column], core_maps: tuple[Column, Column], investigated: Column) -> Column:
    """Whether training leaves a contest out."""
    closest = F.least(*[F.coalesce(r, F.lit(float(UNRANKED))) for r in ranks])
    return investigated | (event == "tier_3") | (online & (closest > FAR_RANK)) | (F.least(*core_maps) < FEW_MAPS)


def training_weight(event: Column, is_lan: Column, risk: Column, out: Column) -> Column:
    base = F.coalesce(lookup(WEIGHTS, event), F.when(is_lan, LAN_WEIGHT).otherwise(OTHER_WEIGHT))
    return F.when(out, 0.0).otherwise(F.round(base * (1.0 - risk * 0.5), 3))


def product_tier(declared: Column, name: Column) -> Column:
    """tier_1, tier_2, excluded or pending; what is declared wins over the name."""
    said = lookup(DECLARED_TIERS, F.translate(F.lower(F.trim(F.coalesce(declared, F.lit("")))), "_-", "  "))
    named = F.coalesce(name, F.lit(""))
    by_name = [F.when(named.rlike(names), tier) for tier, names in (("tier_2", TIER_TWO_NAMES), ("tier_1", TIER_ONE_NAMES))]
    return F.coalesce(said, *by_name, F.lit("pending"))


def tier_label(tier: Column) -> Column:
    return F.when(tier == "T1", "tier_1").otherwise("tier_2")


def status(word: Column, start: Column, end: Column, now: Column) -> Column:
    """upcoming, live or finished: the word's alias, else the dates against now."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    known = F.coalesce(lookup(STATUSES, w), F.when(w.isin("upcoming", "live", "finished"), w))
    return F.coalesce(known, F.when(end < now, "finished").when(start > now, "upcoming").when(start.isNotNull(), "live").otherwise("upcoming"))


def format_alias(c: Column) -> Column:
    """A format's canonical name: exact spelling, then what it contains, else mixed."""
    s = F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[_-]+", " "))
    return F.coalesce(lookup(FORMATS, s), F.when(s.contains("double"), "double_elimination").when(s.contains("swiss"), "swiss").when(s.contains("gsl"), "gsl").when(s.contains("robin"), "round_robin").when(s.contains("elimination") | s.contains("knockout"), "single_elimination").otherwise("mixed"))


def is_placeholder(name: Column) -> Column:
    """Whether a name stands for a team that isn't known yet."""
    return F.trim(F.coalesce(name, F.lit(""))).rlike(rf"(?i)^(?:{'|'.join(PLACEHOLDERS)})$")


def power_probabilities(elo: Column, rank_adv: Column, ranks_known: Column, vrs_adv: Column, vrs_points: Column, vrs_known: Column) -> dict[str, Column]:
    """Fixed-weight probabilities from Elo, ranks and points."""
    r = F.when(ranks_known, 0.055 * rank_adv).otherwise(0.0)
    v = F.when(vrs_known, 0.0115 * vrs_adv + 0.00045 * vrs_points).otherwise(0.0)
    return {"elo": elo, "rank": sigmoid(r), "vrs": sigmoid(v), "rank_vrs": sigmoid(0.52 * r + 0.48 * v), "elo_rank_vrs": sigmoid(0.42 * logit(elo) + 0.31 * r + 0.27 * v)}


def form_probability(recent: Column, prior: Column, playoff: Column, elimination: Column, rest: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(1.6 * recent + 1.0 * prior + 0.55 * playoff + 0.35 * elimination + 0.025 * rest)))


def bounded_baseline(elo: Column, rank_adv: Column, points: Column, form: Column) -> Column:
    """The heuristic that a trained model has to beat; what is unknown says nothing."""
    elo = F.coalesce(elo, F.lit(0.5))
    rank_adv, points, form = (F.coalesce(x, F.lit(0.0)) for x in (rank_adv, points, form))
    return clamp(sigmoid(logit(elo) + 0.009 * clamp(rank_adv, -40.0, 40.0) + 0.00035 * clamp(points, -650.0, 650.0) + 0.3 * clamp(form, -0.5, 0.5)), 0.08, 0.92)


def shrink_unknown(p: Column, known: Column) -> Column:
    return clamp(F.when(known, p).otherwise(0.5 + (p - 0.5) * 0.45), 0.08, 0.92)


def shrunk_rate(wins: Column, n: Column, prior: float = 4.0) -> Column:
    return F.when(n > 0, (wins + 0.5 * prior) / (n + prior)).otherwise(0.5)


def trait(c: Column) -> Column:
    """The whole number before the slash of `NN/100`, 0 to 100; null if there is none."""
    return clamp(F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("double"), 0.0, 100.0)


def signal_index(traits: Column, rating: Column) -> Column:
    """0 to 100, rounded half up: the mean of the known traits, 0 without any, and the rating, 1 if unknown."""
    known = F.filter(traits, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(known), F.lit(1))
    rated = F.coalesce(F.nullif(rating.cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.floor(clamp(mean * 0.55 + rated / 1.35 * 100 * 0.45, 0.0, 100.0) + 0.5).cast("int")


def player_role(sniping: Column, opening: Column, entrying: Column, utility: Column, clutching: Column) -> Column:
    """The first role whose trait reaches its threshold."""
    return F.when(sniping >= 60, "awper").when(opening >= 60, "opener").when(entrying >= 60, "entry").when(utility >= 60, "support").when(clutching >= 60, "closer").otherwise("rifler")


def score_label(map_a: Column, map_b: Column, series_a: Column, series_b: Column) -> Column:
    """Map score where the series has one map at most, else the series score."""
    single = F.greatest(series_a, series_b) <= 1
    pick = F.when(single & map_a.isNotNull() & map_b.isNotNull(), F.concat_ws("-", map_a.cast("string"), map_b.cast("string")))
    return F.coalesce(pick, F.concat_ws("-", series_a.cast("string"), series_b.cast("string")))


def oriented(own_key: Column, feed_key: Column, a: Column, b: Column) -> Column:
    """struct(a, b), swapped where the feed names the sides the other way round."""
    same = own_key == feed_key
    return F.struct(F.when(same, a).otherwise(b).alias("a"), F.when(same, b).otherwise(a).alias("b"))


def is_lan(event_type: Column) -> Column:
    return F.lower(F.coalesce(event_type, F.lit(""))).contains("offline").cast("int")


def event_format(swiss: Column, groups: Column, playoffs: Column) -> Column:
    """struct(type, label, stages) of an event by what its phases hold."""
    kind = F.when((swiss | groups) & playoffs, "mixed").when(swiss, "swiss").when(groups, "gsl").when(playoffs, "single_elimination").otherwise("mixed")
    stages = F.array_compact(F.array(F.when(groups, "Group stage"), F.when(swiss, "Swiss stage"), F.when(playoffs, "Playoffs")))
    stages = F.when(F.size(stages) > 0, stages).otherwise(F.array(F.lit("Event series")))
    return F.struct(kind.alias("type"), F.array_join(stages, " + ").alias("label"), stages.alias("stages"))


def explanation(p: Column, rating: tuple, form: tuple, depth: tuple, rank: tuple, lineup: tuple, map_probability: Column, evidence: Column, veto_samples: tuple, veto_known: Column) -> Column:
    """struct(confidence, supports, counter, risk, n_signals): signed evidence for the favourite, strongest first.

    Unknown probabilities, forms and depths count as even, ratings as 1500, counts as none. The veto's signal and risks
    are there only with a map probability.
    """
    or_ = lambda pair, x: [F.coalesce(c.cast("double"), F.lit(x)) for c in pair]
    p = clamp(F.coalesce(p, F.lit(0.5)), 0.001, 0.999)
    side = F.when(p >= 0.5, 1.0).otherwise(-1.0)
    (r1, r2), (f1, f2), (d1, d2) = or_(rating, 1500.0), or_(form, 0.5), or_(depth, 0.5)
    scores = {
        "rating": side * ((r1 - r2) / 260.0), "form": side * (f1 - f2) * 2.2, "maps": side * (d1 - d2) * 2.0,
        "ranking": F.when((rank[0] > 0) & (rank[1] > 0), side * (rank[1] - rank[0]) / 20.0), "veto": side * (map_probability - p) * 5.0,
    }
    label = {key: F.lit(text) for key, text in SIGNALS.items()} | {"veto": F.when(veto_known, "Official veto").otherwise("Projected veto")}
    rows = [F.struct((-F.abs(clamp(x, -1.0, 1.0))).alias("size"), F.lit(i).alias("at"), clamp(x, -1.0, 1.0).alias("score"), F.lit(key).alias("key"), label[key].alias("label")) for i, (key, x) in enumerate(scores.items())]
    ordered = F.array_sort(F.filter(F.array(*rows), lambda s: s["size"] <= -0.025))
    counter = F.get(F.filter(ordered, lambda s: s["score"] < 0), F.lit(0))
    sure, mapped = F.greatest(p, 1.0 - p), map_probability.isNotNull()
    fewest = lambda pair: F.least(*or_(pair, 0.0))
    risk = (
        F.when(sure < 0.56, "Thin edge")
        .when(fewest(lineup) < 5, "Lineup gap")
        .when(mapped & (fewest(veto_samples) < 10), "Veto sample")
        .when(mapped & (F.coalesce(evidence, F.lit(0)) < 20), "Map sample")
        .when(counter["score"] < -0.2, F.concat(counter["label"], F.lit(" disagrees")))
        .otherwise("Balanced evidence")
    )
    supports = F.slice(F.transform(F.filter(ordered, lambda s: s["score"] > 0), lambda s: s["key"]), 1, 3)
    return F.struct(sure.alias("confidence"), supports.alias("supports"), counter["key"].alias("counter"), risk.alias("risk"), F.size(ordered).alias("n_signals"))


def ranked_within(n: int, *rankings: tuple[Column, Column]) -> Column:
    """Whether any ranking knows both sides, neither beyond rank n."""
    known = [F.coalesce(a.isNotNull() & b.isNotNull() & (F.greatest(a, b) <= n), F.lit(False)) for a, b in rankings]
    return functools.reduce(lambda x, y: x | y, known)


def clean_training(tier: Column, risk: Column) -> Column:
    """Whether a contest may train a model."""
    return tier.isin("T1", "T1_5", "T2") & risk.isin("low", "medium")


def updates_state(policy: str, tier: Column, risk: Column, *rankings: tuple[Column, Column]) -> Column:
    """Whether a contest changes the teams' state under a policy."""
    if policy == "all":
        return F.lit(True)
    if policy == "no_t3":
        return tier.isin("T1", "T1_5", "T2")
    if policy == "clean_only":
        return clean_training(tier, risk)
    if policy in RANKED_POLICIES:
        return clean_training(tier, risk) | ranked_within(RANKED_POLICIES[policy], *rankings)
    raise ValueError(f"unknown state policy: {policy}")


def wants_detail(state: Column, starts: Column, now: Column) -> Column:
    """Live, or starting between two hours ago and six hours from now; an unknown start is neither."""
    near = starts.between(now - F.expr("INTERVAL 2 HOURS"), now + F.expr("INTERVAL 6 HOURS"))
    return F.coalesce(state == "live", F.lit(False)) | F.coalesce(near, F.lit(False))


def is_finished(state: Column, score1: Column, score2: Column) -> Column:
    """By the status, or by a decisive score of a series."""
    said = F.lower(F.coalesce(state, F.lit(""))).rlike("|".join(FINISHED_WORDS))
    most = F.greatest(score1, score2)
    return said | F.coalesce(score1.isNotNull() & score2.isNotNull() & most.between(*FINISHED_SCORES) & (score1 != score2), F.lit(False))


def pick_outcome(picked: Column, winner: Column) -> Column:
    return F.when(winner.isNull(), "pending").when(picked == winner, "won").otherwise("lost")


def series_probability(p: Column, best_of: int) -> Column:
    """Probability of winning a series of equal maps, in closed form."""
    q = 1.0 - p
    if best_of == 1:
        return p
    if best_of == 3:
        return p * p * (1.0 + 2.0 * q)
    if best_of == 5:
        return F.pow(p, 3) * (1.0 + 3.0 * q + 6.0 * q * q)
    raise ValueError("best of 1, 3 or 5")


def series_from_maps(p: list[Column]) -> Column:
    """As series_probability for one or three maps with probabilities of their own."""
    if len(p) == 1:
        return p[0]
    a, b, c = p
    return a * b + a * (1.0 - b) * c + (1.0 - a) * b * c


def map_probability(rank_adv: Column, advantage: Column, evidence: Column, rank_coef: float = 0.022, map_coef: float = 2.1, denominator: float = 18.0) -> Column:
    """Rank logit plus map advantage, weighted by the evidence behind it."""
    return 1.0 / (1.0 + F.exp(-(rank_coef * rank_adv + F.least(F.lit(1.0), evidence / denominator) * map_coef * advantage)))


def logistic_score(features: dict[str, Column], artifact: dict, baseline: Column) -> Column:
    """A portable logistic artifact as one column expression; a malformed artifact gives the baseline."""
    try:
        names, mean, std, weights, blend = artifact["features"], artifact["mean"], artifact["std"], artifact["weights"], float(artifact.get("blend_weight", 1.0))
        if not (len(names) == len(mean) == len(std) == len(weights) - 1):
            return baseline
        z = F.lit(float(weights[0]))
        for name, m, s, w in zip(names, mean, std, weights[1:], strict=True):
            z = z + float(w) * clamp((features[name] - float(m)) / float(s or 1.0), -8.0, 8.0)
    except (KeyError, TypeError, ValueError):
        return baseline
    return clamp(blend * sigmoid(z) + (1.0 - blend) * baseline, 0.08, 0.92)


def tree_score(features: dict[str, Column], tree: dict, node: int = 0) -> Column:
    """A portable regression tree as nested conditions; what is at most the threshold goes left."""
    left = tree["left"][node]
    if left < 0:
        return F.lit(float(tree["value"][node]))
    test = features[tree["feature"][node]] <= float(tree["threshold"][node])
    return F.when(test, tree_score(features, tree, left)).otherwise(tree_score(features, tree, tree["right"][node]))


def boosted_score(features: dict[str, Column], artifact: dict) -> Column:
    z = F.lit(float(artifact["init"]))
    for tree in artifact["trees"]:
        z = z + float(artifact["learning_rate"]) * tree_score(features, tree)
    return sigmoid(z)


def portable_score(features: dict[str, Column], artifact: dict, baseline: Column) -> Column:
    """Either kind of portable artifact, blended with the baseline; what can't be read gives the baseline."""
    if not artifact.get("trees"):
        return logistic_score(features, artifact, baseline)
    try:
        p = boosted_score(features, artifact)
        blend = max(0.0, min(1.0, float(artifact.get("blend_weight", 1.0))))
    except (KeyError, TypeError, ValueError, IndexError):
        return baseline
    return clamp(blend * p + (1.0 - blend) * baseline, 0.08, 0.92)


def non_empty(c: Column) -> Column:
    return blank_null(c).isNotNull()

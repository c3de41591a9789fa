"""Joins: alias resolution, fuzzy identity, enclosing intervals, normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelspark.functions import rules

from duelspark.functions.clean import name_key, slug_key

from .prior import asof_join


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def anti_any_form(rows: DataFrame, known: DataFrame, name: str, aliases: DataFrame | None = None) -> DataFrame:
    """rows whose name is in `known` under no normal form: folded, slug, without `the_`, or a trusted alias."""
    have = known.select(F.explode(F.array_distinct(F.array(F.lower(name), slug_key(F.col(name)), F.regexp_replace(slug_key(F.col(name)), "^the_", "")))).alias("__form")).distinct()
    forms = F.array(F.lower(name), slug_key(F.col(name)), F.regexp_replace(slug_key(F.col(name)), "^the_", ""))
    tagged = rows.withColumn("__forms", forms)
    if aliases is not None:
        tagged = tagged.join(aliases.select(slug_key(F.col("alias")).alias("__alias"), slug_key(F.col("name")).alias("__of")), slug_key(F.col(name)) == F.col("__alias"), "left").withColumn("__forms", F.when(F.col("__of").isNotNull(), F.array_append("__forms", F.col("__of"))).otherwise(F.col("__forms"))).drop("__alias", "__of")
    covered = tagged.select(name, F.explode("__forms").alias("__form")).join(have, "__form", "left_semi").select(name).distinct()
    return rows.join(covered, name, "left_anti")


def first_child(rows: DataFrame, children: DataFrame, key: str, index: str) -> DataFrame:
    """rows with the smallest child index (J09); the children are reduced before the join."""
    return rows.join(children.groupBy(key).agg(F.min(index).alias(f"first_{index}")), key, "left")


PIECE = 4  # letters of a piece, and the least length of a slug that may stand inside another


def _pieces(slug: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(slug) - (PIECE - 1)), lambda i: F.substring(slug, i, F.lit(PIECE))))


def _inside(short: DataFrame, long: DataFrame, scope: str) -> DataFrame:
    """(scope, short's columns, long's columns) where short's slug stands inside long's, by an index of pieces.

    Each short slug is looked up by the one of its pieces that the fewest long slugs of its scope have.
    """
    index = long.where(F.length("long") >= PIECE).select("*", F.explode(_pieces(F.col("long"))).alias("piece"))
    sizes = index.groupBy(scope, "piece").agg(F.count(F.lit(1)).alias("n"))
    asked = short.where(F.length("short") >= PIECE).select("*", F.explode(_pieces(F.col("short"))).alias("piece"))
    own = [c for c in short.columns if c not in (scope, "short")]
    # a piece that no long slug has is the rarest: such a slug stands in none, and the join drops it
    rare = asked.join(sizes, [scope, "piece"], "left").groupBy(scope, "short", *own).agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return rare.join(index, [scope, "piece"]).where(F.col("long").contains(F.col("short"))).drop("piece")


def resolve_aliases(names: DataFrame, candidates: DataFrame, scope: str, trusted: DataFrame) -> DataFrame:
    """(scope, raw, resolved): a raw name takes a candidate of its scope where exactly one fits.

    A candidate fits by equal slug, a trusted alias, one slug inside the other (four letters or more), or its initials. Each
    rule is a join on keys of its own, so that no name meets all candidates of a scope.
    """
    raw = names.select(scope, "raw").where(F.col("raw").isNotNull()).distinct().withColumn("a", slug_key(F.col("raw")))
    initials = F.array_join(F.transform(F.split(name_key(F.col("name")), " "), lambda w: F.substring(w, 1, 1)), "")
    known = candidates.select(scope, "name").where(F.col("name").isNotNull()).distinct().withColumn("b", slug_key(F.col("name"))).withColumn("initials", initials)
    pair = [scope, "raw", "name"]
    equal = raw.join(known.withColumn("a", F.col("b")), [scope, "a"]).select(*pair)
    told = raw.join(trusted.select(F.col("alias").alias("raw"), "name"), "raw").join(known, [scope, "name"]).select(*pair)
    short = raw.withColumn("initials", F.translate("a", "_", "")).join(known, [scope, "initials"]).select(*pair)
    a_in_b = _inside(raw.select(scope, "raw", F.col("a").alias("short")), known.select(scope, "name", F.col("b").alias("long")), scope).select(*pair)
    b_in_a = _inside(known.select(scope, "name", F.col("b").alias("short")), raw.select(scope, "raw", F.col("a").alias("long")), scope).select(*pair)
    good = equal.unionByName(told).unionByName(short).unionByName(a_in_b).unionByName(b_in_a)
    return good.groupBy(scope, "raw").agg(F.count_distinct("name").alias("__n"), F.min("name").alias("resolved")).where("__n = 1").drop("__n")


def apply_aliases(rows: DataFrame, aliases: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """rows with each named column rewritten where its scope has an alias for it."""
    for c in columns:
        one = aliases.select(scope, F.col("raw").alias(c), F.col("resolved").alias("__resolved"))
        rows = rows.join(one, [scope, c], "left").withColumn(c, F.coalesce("__resolved", c)).drop("__resolved")
    return rows


def prioritised_lookup(rows: DataFrame, keys: list[tuple[str, str]], table: DataFrame, value: str) -> DataFrame:
    """rows with a value found by the first of several keys that hits (J12): (column of rows, column of table)."""
    found = []
    for i, (own, other) in enumerate(keys):
        one = table.where(F.col(other).isNotNull()).groupBy(F.col(other).alias(own)).agg(F.min(value).alias(f"__v{i}"))
        rows = rows.join(one, own, "left")
        found.append(F.col(f"__v{i}"))
    return rows.withColumn(value, F.coalesce(*found)).drop(*[f"__v{i}" for i in range(len(keys))])


def same_contest(rows: DataFrame, feed: DataFrame, hours: float = 18.0, same_ids: bool = True) -> DataFrame:
    """rows with their feed contest (J14): the same id, else the same unordered pair within hours, the closest first.

    Both sides have (contest_id, a, b, ts). same_ids: whether both number contests alike; if not, equal ids mean nothing.
    The closest is the last of the pair's feed contests up to a row's second or the first from then on, found by as-of joins
    in both directions, so no two contests of a pair meet. Of equal gaps the smallest id wins.
    """
    pair, second = ["__low", "__high"], F.unix_timestamp("ts")
    both = lambda df: df.withColumn("__low", F.least("a", "b")).withColumn("__high", F.greatest("a", "b"))
    timed = both(feed).where("__low is not null").select(*pair, second.alias("at"), "contest_id").where("at is not null").groupBy(*pair, "at").agg(F.min("contest_id").alias("feed_id"))
    near = both(rows).where("__low is not null").select("contest_id", *pair, second.alias("at")).where("at is not null")
    by_id = rows.select("contest_id").join(feed.select(F.col("contest_id").alias("feed_id")), F.col("contest_id") == F.col("feed_id"), "left_semi").select("contest_id", F.col("contest_id").alias("feed_id"), F.lit(0.0).alias("gap"))
    if same_ids:
        near = near.join(by_id.select("contest_id"), "contest_id", "left_anti")
    found = []
    for n, sign in enumerate((1, -1)):  # backwards, time runs the other way
        history = timed.select(*pair, (sign * F.col("at")).alias(f"since{n}"), F.col("feed_id").alias(f"id{n}"))
        near = asof_join(near.withColumn("__by", sign * F.col("at")), history, pair, "__by", f"since{n}", [f"since{n}", f"id{n}"], bucket=F.floor(F.col("__at") / 86_400)).drop("__by")
        gap = F.abs(F.col("at") - sign * F.col(f"since{n}")) / 3600.0
        found.append(F.when(gap < hours, F.struct(gap.alias("gap"), F.col(f"id{n}").isNull().alias("unknown"), F.col(f"id{n}").alias("feed_id"))))
    best = near.withColumn("m", F.least(*found)).where("m is not null").groupBy("contest_id").agg(F.min("m").alias("m")).select("contest_id", "m.feed_id", "m.gap")
    return by_id.unionByName(best) if same_ids else best


def feed_overlay(board: DataFrame, feed: DataFrame) -> DataFrame:
    """The board's contests with the feed's state of the same two sides, in whichever order it names them.

    board: id, a, b, locked; feed: a, b, status, score_a, score_b, seq. The feed's last item of a pair counts. A locked
    contest stays as it is; scores are turned to the board's order.
    """
    pair = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    last = feed.groupBy(*pair).agg(F.max_by(F.struct("a", "status", "score_a", "score_b"), "seq").alias("f"))
    rows = board.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b")).join(last, ["low", "high"], "left")
    score = rules.oriented(F.col("a"), F.col("f.a"), F.col("f.score_a"), F.col("f.score_b"))
    said = F.lower(F.coalesce("f.status", F.lit("scheduled")))
    live = said.contains("live") | said.contains("playing")
    done = ~live & (said.contains("completed") | said.contains("finished") | score["a"].isNotNull() | score["b"].isNotNull())
    whole = done & score["a"].isNotNull() & score["b"].isNotNull()
    open_ = ~F.col("locked") & F.col("f").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return rows.select(
        "id", "a", "b", F.when(F.col("locked"), "locked").when(open_ & live, "live").when(open_ & done, "locked").otherwise("open").alias("status"),
        F.when(open_ & live, F.concat_ws(":", zero(score["a"]), zero(score["b"]))).when(open_ & whole, F.concat_ws(":", score["a"].cast("string"), score["b"].cast("string"))).alias("score_label"),
        F.when(open_ & whole, F.when(score["a"] > score["b"], F.col("a")).otherwise(F.col("b"))).alias("winner"),
    )


def enclosing(blocks: DataFrame, containers: DataFrame, page: str, start: str, end: str, width: int = 4096) -> DataFrame:
    """(block, container): the shortest container of the same page around each block.

    Containers are listed under every width-sized bucket they reach into, so a block meets those of its own bucket only.
    """
    boxes = containers.select(page, F.col("container"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__bucket"))
    rows = blocks.withColumn("__bucket", F.floor(F.col(start) / width))
    inside = rows.join(boxes, [page, "__bucket"]).where((F.col("__s") <= F.col(start)) & (F.col("__e") >= F.col(end)))
    best = inside.groupBy(page, "block").agg(F.min(F.struct((F.col("__e") - F.col("__s")).alias("len"), "container"))["container"].alias("container"))
    return blocks.select(page, "block").join(best, [page, "block"], "left")


def continuity(a: Column, b: Column, least: int = 3) -> Column:
    """Whether two line-ups share enough members, all of the smaller one if it has fewer."""
    return F.size(F.array_intersect(a, b)) >= F.least(F.lit(least), F.size(b))


def by_id_or_name(rows: DataFrame, dim: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """rows with a dimension's value found by id, else by slug of the name."""
    names = dim.groupBy(slug_key(F.col(name)).alias("__slug")).agg(F.min(value).alias("__by_name"))
    out = rows.join(dim.select(key, F.col(value).alias("__by_id")), key, "left").withColumn("__slug", slug_key(F.col(name))).join(names, "__slug", "left")
    return out.withColumn(value, F.coalesce("__by_id", "__by_name")).drop("__by_id", "__by_name", "__slug")


def roster(profiles: DataFrame, ranked: DataFrame, team: str, cap: int = 5) -> DataFrame:
    """Profiled players first, then ranked names without a profile, at most cap a team (J20); both (team, player, place)."""
    extra = ranked.join(profiles.select(team, "player"), [team, "player"], "left_anti")
    both = profiles.withColumn("profiled", F.lit(1)).unionByName(extra.withColumn("profiled", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(team).orderBy(F.col("profiled").desc(), "place", "player"))
    return both.withColumn("slot", place).where(F.col("slot") <= cap).select(team, "player", "profiled", "slot")

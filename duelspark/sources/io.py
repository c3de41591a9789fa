"""Bronze files, logs, nested documents, typed loads and gated publication."""

from __future__ import annotations

import re
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def files_state(spark: SparkSession, path: str) -> str:
    """What a table's files are now: names, lengths and times of change."""
    fs, p = _fs(spark, path)
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in fs.listStatus(p))) if fs.exists(p) else ""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, deleted when the session ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base or 'file:///tmp/checkpoints/duelspark'}/{name}-{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)
    return path


def read_bronze(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headered CSV as strings; columns by name whatever their order; a missing or blank file is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_bronze(df: DataFrame, path: str, columns: list[str] | None = None, compression: str | None = None) -> None:
    """A headered CSV with the declared columns, or all in sorted order (S02); gzip for seeds."""
    writer = df.select(*(columns or sorted(df.columns))).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def nested_items(raw: DataFrame, column: str, item: str) -> DataFrame:
    """Items of JSON texts that hold them bare, under `items` or under `matches` (S05); what isn't an object is dropped."""
    text = F.trim(F.col(column))
    bare = F.from_json(F.when(text.startswith("["), text), f"array<{item}>")
    boxed = F.from_json(F.when(text.startswith("{"), text), f"struct<items: array<{item}>, matches: array<{item}>>")
    return raw.select(F.explode(F.coalesce(bare, boxed["items"], boxed["matches"])).alias("item")).where("item is not null").select("item.*")


def envelopes(raw: DataFrame, column: str, data: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `data` whose envelope has status ok, counts by status) of JSON texts."""
    parsed = raw.select(F.from_json(column, f"struct<status: string, data: {data}>").alias("e"))
    return parsed.where("e.status = 'ok' and e.data is not null").select("e.data.*"), parsed.groupBy(F.coalesce("e.status", F.lit("unreadable")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def history_documents(matches: DataFrame, maps: DataFrame, lineups: DataFrame) -> DataFrame:
    """Contests with their ordered maps and both line-ups, nested."""
    m = maps.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("map_index", "map_name", F.col("team1_rounds").alias("score1"), F.col("team2_rounds").alias("score2"), "winner_team_id"))).alias("maps"))
    side = lambda col: F.array_sort(F.collect_set(F.when(F.col("team_id") == F.col(col), F.col("player_id"))))
    rows = lineups.select("match_id", "team_id", "player_id").join(matches.select("match_id", "team1_id", "team2_id"), "match_id")
    p = rows.groupBy("match_id").agg(F.struct(side("team1_id").alias("team1"), side("team2_id").alias("team2")).alias("lineups"))
    return matches.join(m, "match_id", "left").join(p, "match_id", "left")


def as_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON document a row."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def publish(df: DataFrame, path: str, version: str, gate: Callable[[DataFrame], bool]) -> bool:
    """Write a version aside; it becomes visible only if the gate passes what was written."""
    spark = df.sparkSession
    fs, target = _fs(spark, f"{path}/version={version}")
    _, aside = _fs(spark, f"{path}/_staging-{version}")
    fs.delete(aside, True)
    df.write.parquet(aside.toString())
    if not gate(spark.read.parquet(aside.toString())):
        fs.delete(aside, True)
        return False
    if not fs.exists(target):
        return fs.rename(aside, target)
    # Published again: the version it replaces goes only once the new one is in its place, and comes back if that fails.
    _, old = _fs(spark, f"{path}/_replaced-{version}")
    fs.delete(old, True)
    if not fs.rename(target, old):
        return False
    if not fs.rename(aside, target):
        fs.rename(old, target)
        return False
    fs.delete(old, True)
    return True


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version that passed, None before the first; numbers in a version count as numbers: 10 comes after 9.

    A replacement that was cut short leaves the version it was to replace under another name: that one is read then.
    """
    fs, root = _fs(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    names = [x for x in found if x.startswith("version=")] + [x for x in found if x.startswith("_replaced-") and f"version={x.removeprefix('_replaced-')}" not in found]
    parts = lambda name: [(part.isdigit(), int(part) if part.isdigit() else 0, part) for part in re.split(r"(\d+)", re.sub("^(?:version=|_replaced-)", "", name))]
    names.sort(key=parts)
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def manifest(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The latest run of each key."""
    values = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("v")).select(key, "v.*")


def flatten_members(rows: DataFrame, key: str, members: str) -> DataFrame:
    """Arrays of members as joined names and links."""
    return rows.select(key, F.array_join(F.transform(members, lambda p: p["name"]), ", ").alias("player_names"), F.array_join(F.transform(members, lambda p: p["href"]), ", ").alias("player_hrefs"))


def split_zip(names: Column, hrefs: Column) -> Column:
    """Both lists split, trimmed and zipped, the shorter one deciding; an id comes from the link."""
    a, b = (F.transform(F.split(c, ","), lambda x: F.trim(x)) for c in (names, hrefs))
    n = F.least(F.size(a), F.size(b))
    pairs = F.arrays_zip(F.slice(a, 1, n).alias("name"), F.slice(b, 1, n).alias("href"))
    return F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["href"].alias("href"), F.regexp_extract(p["href"], r"/(\d+)(?:/|$)", 1).try_cast("bigint").alias("id")))


def page_runs(rows: DataFrame, page: str, date: str, cutoff: Column) -> DataFrame:
    """Page: rows, first and last date, whether it reaches the cutoff."""
    return rows.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")).withColumn("stop", F.col("first") <= cutoff)


def typed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Bronze strings projected and cast by expression."""
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def variants(docs: DataFrame, column: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(d): the JSON texts of a column, each parsed once and kept as a variant; what isn't JSON is dropped.

    Every table that is read from the documents then takes its paths from the saved variants.
    """
    return save(docs.select(F.try_parse_json(F.col(column)).alias("d")).where("d is not null"))


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("d", path, kind)


def wide_stats(docs: DataFrame) -> DataFrame:
    """Nested player documents, variants in `d`, as one wide row a map and player."""
    each = docs.select(_field("$.player.id", "bigint").alias("player_id"), _field("$.player.name", "string").alias("player"), F.posexplode(_field("$.maps", "array<struct<name: string, kills: int, deaths: int, rating: double>>")).alias("map_index", "m"))
    return each.select("player_id", "player", (F.col("map_index") + 1).alias("map_index"), "m.*")


#: The children of a detail document.
DETAIL_CHILDREN = {
    "maps": "array<struct<name: string, s1: int, s2: int>>", "vetoes": "array<struct<team: int, action: string, map: string>>",
    "lineups": "array<struct<team: int, player: string>>", "stats": "array<struct<player: string, rating: double>>",
}


def detail_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Detail documents, variants in `d`, as contest, maps, vetoes, line-ups and stat lines (S18); those without an id are dropped."""
    known = docs.select(_field("$.id", "bigint").alias("match_id"), "d").where("match_id is not null")
    child = lambda name: known.select("match_id", F.posexplode(_field(f"$.{name}", DETAIL_CHILDREN[name])).alias("p", "x")).select("match_id", (F.col("p") + 1).alias("index"), "x.*")
    scored = known.select("match_id", _field("$.best_of", "int").alias("best_of"), F.coalesce(_field("$.maps", DETAIL_CHILDREN["maps"]), F.array().cast(DETAIL_CHILDREN["maps"])).alias("maps"))
    wins = lambda f: F.size(F.filter("maps", f))
    s1, s2 = wins(lambda m: m["s1"] > m["s2"]), wins(lambda m: m["s2"] > m["s1"])
    contest = scored.select("match_id", "best_of", s1.alias("score1"), s2.alias("score2"), F.when(s1 > s2, 1).when(s2 > s1, 2).alias("winner"))
    return {"contest": contest} | {name: child(name) for name in DETAIL_CHILDREN}


def normalised_snapshot(docs: DataFrame, column: str) -> DataFrame:
    """Contests of live documents with synonyms settled, self-matches and placeholders dropped."""
    from duelspark.functions.rules import is_placeholder

    schema = "struct<matches: array<struct<id: string, match_id: string, team1: string, team1_name: string, team2: string, team2_name: string, status: string, event: string, event_name: string>>>"
    m = docs.select(F.explode(F.from_json(column, schema)["matches"]).alias("m")).select("m.*")
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    out = m.select(pick("match_id", "id").alias("match_id"), pick("team1_name", "team1").alias("team1"), pick("team2_name", "team2").alias("team2"), F.lower(F.coalesce("status", F.lit("upcoming"))).alias("status"), pick("event_name", "event").alias("event"))
    return out.where(F.col("team1").isNotNull() & F.col("team2").isNotNull() & (F.lower("team1") != F.lower("team2")) & ~is_placeholder(F.col("team1")) & ~is_placeholder(F.col("team2")))


def labelled_files(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Several files with a label each; missing ones are skipped."""
    out = spark.createDataFrame([], f"{schema}, label string")
    for label, path in paths.items():
        if exists(spark, path):
            out = out.unionByName(spark.read.schema(schema).option("header", True).csv(path).withColumn("label", F.lit(label)))
    return out

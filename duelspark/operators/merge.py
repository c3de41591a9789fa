"""Merges, upserts and dedupes: explicit overwrite rules between what is held and what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key wins whole; columns that new rows lack become null."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__new").desc(), F.col(seq).desc()))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def merge_columns(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge with a rule a column: fill (held wins), enrich (incoming wins), new (always incoming), min, add.

    Covers M02 (enrich, name: new), M03 (fill), M04 (enrich), M06 (min; null if either is) and counters (add).
    """
    a = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in rules], F.lit(True).alias("__old"))
    b = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in rules], F.lit(True).alias("__new"))
    both = a.join(b, key, "full_outer")
    out: list[Column] = []
    for c, rule in rules.items():
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        value = {
            "fill": F.coalesce(o, n),
            "enrich": F.coalesce(n, o),
            "new": F.when(F.col("__new"), n).otherwise(o),
            "min": F.when(F.col("__old").isNull(), n).when(F.col("__new").isNull(), o).when(o.isNotNull() & n.isNotNull(), F.least(o, n)),
            "add": F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
        }[rule]
        out.append(value.alias(c))
    return both.select(*key, *out)


def append_tag(source: Column, tag: str) -> Column:
    """source;tag, the tag once."""
    s = F.coalesce(source, F.lit(""))
    return F.when(F.array_contains(F.split(s, ";"), tag), s).when(s == "", tag).otherwise(F.concat(s, F.lit(f";{tag}")))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], seq: list[str] | None = None) -> DataFrame:
    """New keys only; of repeated new keys the first by `seq`, or by all other columns."""
    values = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*(seq or values))).alias("v")).select(*key, "v.*") if values else new.distinct()
    return old.unionByName(first.select(*new.columns).join(old.select(*key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str], touched: DataFrame) -> DataFrame:
    """All child rows of touched parents are the new ones."""
    return old.join(touched.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def overwrite_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def keep_first(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The first row of each key, blanks and nulls being one key."""
    place = F.row_number().over(Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).orderBy(*seq))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def keep_richest(rows: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The row with most non-empty fields of each key; a tie goes to the first."""
    filled = sum((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int") for c in rows.columns)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(filled.desc(), *seq))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def ordered_distinct(rows: DataFrame, value: str, position: list[str]) -> DataFrame:
    """Distinct values with their first position."""
    return rows.groupBy(value).agg(F.min(F.struct(*position)).alias("first_at"))


def merge_events(old: DataFrame, new: DataFrame, key: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Held scalars win, lists are united."""
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    one = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in scalars]
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return both.select(key, *one, *[F.array_sort(F.array_union(empty(f"o.{c}"), empty(f"n.{c}"))).alias(c) for c in lists])


def latest_merged(old: DataFrame, new: DataFrame, key: list[str], time: str, keep: int, by: str | None = None) -> DataFrame:
    """Incoming rows overlay by key, then the latest `keep`, overall or of each `by`."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__new").desc(), F.col(time).desc()))
    one = both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")
    if by is None:
        return one.orderBy(F.col(time).desc(), *key).limit(keep)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(time).desc(), *[F.col(k).desc() for k in key]))
    return one.withColumn("__place", place).where(F.col("__place") <= keep).drop("__place")


def merge_maps(old: Column, new: Column) -> Column:
    """Map union, incoming values winning where they aren't null."""
    none = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(old, none), F.coalesce(new, none), lambda k, o, n: F.coalesce(n, o))


def finished_overlay(rows: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Non-empty detail scores win; a contest with enough wins is finished and has a winner."""
    d = detail.select(key, F.col("score1").alias("__s1"), F.col("score2").alias("__s2"))
    out = rows.join(d, key, "left").withColumn("score1", F.coalesce("__s1", "score1")).withColumn("score2", F.coalesce("__s2", "score2")).drop("__s1", "__s2")
    need = F.when(F.col("best_of") == 5, 3).when(F.col("best_of") == 1, 1).otherwise(2)
    done = (F.greatest("score1", "score2") >= need) & (F.col("score1") != F.col("score2"))
    return out.withColumn("status", F.when(done, "finished").otherwise(F.col("status"))).withColumn("winner", F.when(done, F.when(F.col("score1") > F.col("score2"), 1).otherwise(2)))


def next_status(held: Column, locked: Column, incoming: Column) -> Column:
    """A locked row never changes; a finished one stays finished; else what comes in."""
    return F.when(locked | (held == "finished"), held).otherwise(F.coalesce(incoming, held))


def last_of_lists(lists: list[DataFrame], key: list[str], seq: str) -> DataFrame:
    """Several contest lists as one, the last occurrence of each key."""
    both = None
    for i, df in enumerate(lists):
        df = df.withColumn("__list", F.lit(i))
        both = df if both is None else both.unionByName(df)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__list").desc(), F.col(seq).desc()))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__list")

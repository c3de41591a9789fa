"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent; an exact recount verifies them, and the
verified winners, a bounded number, are broadcast so that frequent copies are settled map-side. All other digests are
settled by an ordinary shuffle in which none of them is large.

Defined cases: a null text counts as empty; null ids sort last; of rows that repeat both id and text exactly one stays;
an empty table gives an empty result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, lean, saved, table

COUNTERS = 1024  # Misra-Gries counters a partition, and so the bound of broadcast winners


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def misra_gries(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(digest, estimate): merged Misra-Gries summaries; an estimate is below the true count by rows/(counters+1) at most."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)).to_pylist():
                held[item["values"]] = held.get(item["values"], 0) + item["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: n - cut for k, n in held.items() if n > cut}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "estimate"])

    parts = digests.select(F.col(column).alias("digest")).mapInArrow(lean(summarise), "digest binary, estimate long")
    return parts.groupBy("digest").agg(F.sum("estimate").alias("estimate"))


def heavy_winners(digests: DataFrame, order: list[str], counters: int = COUNTERS) -> DataFrame:
    """(digest, winner, group_size) of verified frequent digests, `counters` rows at most.

    A digest with over 2/(counters+1) of the rows is always among them: its estimate then exceeds rows/(counters+1), and
    since all estimates together are no more than the rows, only `counters` of them can.
    """
    total = digests.count()
    likely = misra_gries(digests, "digest", counters).where(F.col("estimate") * (counters + 1) > F.lit(total)).select("digest")
    first = F.min(F.struct(*[c for name in order for c in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))]))
    return digests.join(F.broadcast(likely), "digest").groupBy("digest").agg(first.alias("winner"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256)."""
    digests = saved(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    winners = saved(heavy_winners(digests, ["id", "row"], counters), "winners")
    tagged = digests.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("winner is not null").select("id", F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"), "digest")
    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.col("id").asc_nulls_last(), "row")
    light = tagged.where("winner is null").select(
        "id",
        F.first("id").over(ranked).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "digest",
    )
    return heavy.unionByName(light).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns; text is shuffled once, frequent copies not at all."""
    names = docs.columns
    digest, winner, rank = (free_name(docs, name) for name in ("digest", "winner", "rank"))
    keyed = docs.withColumn(digest, text_digest(F.col(text_col)))
    narrow = saved(keyed.select(F.col(id_col).alias("id"), F.col(digest).alias("digest")), "digests")
    winners = saved(heavy_winners(narrow, ["id"], counters), "winners").select(F.col("digest").alias(digest), F.col("winner").alias(winner))
    rest = keyed.join(F.broadcast(winners), digest, "left").where(F.col(winner).isNull() | F.col(f"{winner}.id").eqNullSafe(F.col(id_col)))
    order = F.row_number().over(Window.partitionBy(digest).orderBy(F.col(id_col).asc_nulls_last()))
    return rest.withColumn(rank, order).where(F.col(rank) == 1).select(*names)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""

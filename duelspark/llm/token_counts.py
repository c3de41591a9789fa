"""Token totals kept by signed deltas.

A change feed has a row for each inserted, deleted or revised count: `sign` is 1 for what comes to hold and -1 for what
no longer does, so an insert is one row, a delete one, a revision two. A batch of changes is added up by (source, lang,
tokenizer) before anything is shuffled and written as one small folder; totals are the sum over all batches.

Commits are idempotent: a batch is written under its own id, aside, and renamed into place in one step. A batch that is
already there is left as it is, so a replay changes nothing, and a batch that was cut short leaves nothing behind.
`compact` adds up all batches into one and remembers their ids, so replays of those are still recognised.

Defined cases: null texts count no tokens but are documents; null sources, languages and tokenizer versions are groups of
their own; totals that are zero in documents and tokens are not reported; an empty batch commits its id only; an empty
rollup gives no rows; other columns of a feed are ignored. Of exact copies the row with the least id stays, null ids last;
rows that repeat an id are each judged on their own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RAW_WORD, saved, scratch_path, table
from .exact_dedup import exact_groups

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long")


def number_count(text: Column) -> Column:
    """Words of digits only."""
    edge = RAW_WORD[:-1]
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?<!{edge})[0-9]+(?!{edge})")), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bpe_count(ranks_file: str, pattern: str) -> Callable[[Column], Column]:
    """Counts by a byte-level BPE vocabulary file of ranks; the file, of some megabytes, is read once a worker."""
    held: dict = {}

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        if not held:
            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            held["bpe"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for part in texts:
            yield part.map(lambda t: 0 if t is None else len(held["bpe"].encode_ordinary(t)))

    return count


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]], sign: int = 1, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A feed (source, lang, tokenizer, sign, n_tokens): a row for each document and tokenizer version."""
    counts = F.array(*[F.struct(F.lit(name).alias("tokenizer"), f(F.col(text_col)).alias("n_tokens")) for name, f in tokenizers.items()])
    return docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.inline(counts)).withColumn("sign", F.lit(sign))


class Rollup:
    """Totals under a path in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def committed(self) -> list[str]:
        """Ids of the batches that count, those inside a compacted one too."""
        return sorted(x for name in self._folders() for x in self._inside(name))

    def _folders(self) -> list[str]:
        self.recover()
        if not self._fs.exists(self._Path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path)) if s.isDirectory() and s.getPath().getName().startswith("batch="))

    def _inside(self, name: str) -> list[str]:
        ids = self._folder(f"{name}/_ids")
        if not self._fs.exists(ids):
            return [name.removeprefix("batch=")]
        return [r["value"] for r in self.spark.read.text(f"{self.path}/{name}/_ids").collect()]

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was already committed."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        if batch_id in self.committed():
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        return self._put(f"batch={batch_id}", deltas)

    def _put(self, name: str, rows: DataFrame, ids: list[str] | None = None) -> bool:
        aside, target = self._folder(f"_writing-{name}"), self._folder(name)
        if self._fs.exists(target):  # a rename would put the batch inside it
            return False
        self._fs.delete(aside, True)
        rows.write.parquet(aside.toString())
        if ids:
            self.spark.createDataFrame([(x,) for x in ids], "value string").coalesce(1).write.text(f"{aside.toString()}/_ids")
        return self._fs.rename(aside, target)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) as of the batches committed now."""
        folders = [f"{self.path}/{name}" for name in self._folders()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One batch in place of all: written aside; the old ones go first, then it is renamed into place.

        A run cut short between those two steps is finished by `recover`, which comes before every read and commit.
        """
        old, ids = self._folders(), self.committed()
        if len(old) < 2:
            return
        # no batch can have this name: `apply` refuses ids with a dot
        name, aside = f"batch=all.{len(ids)}", self._folder("_compacted")
        self._fs.delete(aside, True)
        self.totals().write.parquet(f"{aside.toString()}/{name}")
        self.spark.createDataFrame([(x,) for x in ids], "value string").coalesce(1).write.text(f"{aside.toString()}/{name}/_ids")
        self.spark.createDataFrame([(x,) for x in old], "value string").coalesce(1).write.text(f"{aside.toString()}/_old")
        self.recover()

    def recover(self) -> None:
        """Finish a compaction whose new batch and list of old ones are complete; one that isn't counts for nothing."""
        listed = f"{self.path}/_compacted/_old"
        if not self._fs.exists(self._Path(f"{listed}/_SUCCESS")):
            return
        for r in self.spark.read.text(listed).collect():
            self._fs.delete(self._folder(r["value"]), True)
        for s in self._fs.listStatus(self._folder("_compacted")):
            if s.getPath().getName().startswith("batch="):
                self._fs.rename(s.getPath(), self._folder(s.getPath().getName()))
        self._fs.delete(self._folder("_compacted"), True)


def corpus_rollup(docs: DataFrame) -> DataFrame:
    """All documents are loaded, later exact copies deleted, counts of words@2 revised to leave out numbers; batches are replayed.

    words@1 and words@2 are two versions of one tokenizer; the second was loaded with the counts of the first.

    Each row is counted once and its counts go through the search for copies in place of its id, so a row is deleted or
    revised by what that search says of this very row, whatever other rows have its id.
    """
    word, number, octets = word_count(F.col("text")), number_count(F.col("text")), byte_count(F.col("text"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "source", "lang", word.alias("words"), number.alias("numbers"), octets.alias("bytes"))
    rows = saved(exact_groups(docs.select(row.alias("counts"), "text"), "counts").select("counts.*", "kept"), "counts")
    rollup = Rollup(docs.sparkSession, scratch_path(docs.sparkSession, "token-rollup"))
    tokenizers = {"words@1": lambda _: F.col("words"), "words@2": lambda _: F.col("words"), "utf8_bytes@1": lambda _: F.col("bytes")}
    gone, numbers = rows.where("not kept"), rows.where("kept and numbers > 0")
    rollup.apply("load", counted(rows, tokenizers))
    rollup.apply("copies", counted(gone, tokenizers, -1))
    before = counted(numbers, {"words@2": lambda _: F.col("words")}, -1)
    after = counted(numbers, {"words@2": lambda _: F.col("words") - F.col("numbers")})
    rollup.apply("revision", before.unionByName(after))
    rollup.apply("load", counted(rows, tokenizers))  # replays: no-ops
    rollup.apply("copies", counted(gone, tokenizers, -1))
    return rollup.totals()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_rollup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) ORDER BY doc_id) AS copy FROM documents),
w AS (SELECT source, lang, coalesce(octet_length(encode(text)), 0) AS bytes,
  coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS words FROM d WHERE copy = 1)
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_tokens FROM w GROUP BY ALL
UNION ALL SELECT source, lang, 'words@2', count(*), CAST(sum(len(list_filter(words, lambda x: NOT regexp_full_match(x, '[0-9]+')))) AS BIGINT) FROM w GROUP BY ALL
UNION ALL SELECT source, lang, 'utf8_bytes@1', count(*), CAST(sum(bytes) AS BIGINT) FROM w GROUP BY ALL
"""

"""Benchmark decontamination with suffix arrays over the training text.

Every task sorts the suffixes of its documents into suffix arrays, one for each shard of about a million words, and
binary-searches every benchmark suffix in each of them. Each place found is followed to the end of its longest verbatim
match. The contamination rule takes all those matches of at least a window (or a whole shorter item): the words they
cover are the words of all windows that occur, since a window inside a match starts no match of its own.
Suffixes of fewer words than that cannot begin such a match and are searched by `longest_matches` only.

A suffix is kept in an array only if its first `min_match` words all occur in the benchmark, since no other can match
that far. Words are compared as numbers of the benchmark's vocabulary (0: not in it); a match ends at 0.

The benchmark is the query set. It is broadcast in blocks of at most BLOCK_BYTES of text, one pass over the documents a
block, so what is broadcast is bounded however large the benchmark is. Blocks are made
one at a time; those already sent are files of their broadcasts.

Defined cases: null or empty text has no words and is never contaminated; an item without words is ignored; items that
repeat an id count once and with all their texts; items without an id are matched but not named; an item shorter than a window is one window; empty tables give empty or uncontaminated results;
rows that repeat a doc_id are each judged on their own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, lean, pieces, scan_words, table

WINDOW = 13
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 4 << 20  # text bytes of one suffix array, which takes about 20 times that room while it is sorted
#: A sort key has KEYS numbers of PER words of BITS bits; longer matches are followed in the text.
KEYS, PER, BITS = 5, 3, 21
DEPTH, VOCAB = KEYS * PER, (1 << BITS) - 2


class Queries:
    """One block of benchmark items: their words as vocabulary numbers, end to end, each item followed by a 0."""

    def __init__(self, ids: list, texts: list[str | None], window: int, min_match: int):
        data, offsets = buffers(pa.array(texts, pa.string()))
        words, _, bounds = scan_words(data, offsets)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        if len(self.vocabulary) > VOCAB:
            raise ValueError("a benchmark block has more distinct words than a sort key can hold; use a smaller block")
        counts = np.diff(bounds)
        shift = np.repeat(np.arange(len(counts)), counts)
        self.tokens = np.zeros(len(words) + len(counts), np.int32)
        self.tokens[np.arange(len(words)) + shift] = number + 1
        self.ids, self.window, self.min_match = ids, window, max(1, min([min_match, window, *counts[counts > 0].tolist()]))
        self.start = np.arange(len(words)) + shift  # of every suffix
        self.item = shift
        self.offset = np.arange(len(words)) - bounds[:-1][shift]
        self.left = counts[shift] - self.offset  # words from here to the item's end
        self.need = np.minimum(window, counts)[shift]
        self.is_window = self.left >= self.need

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of document words, 0 for words the benchmark lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.int32)


def _keys(tokens: np.ndarray, starts: np.ndarray, length: np.ndarray | None = None) -> list[np.ndarray]:
    """The first DEPTH words from each start as KEYS numbers, words after a 0 (or after `length`) as 0."""
    padded = np.concatenate([tokens, np.zeros(DEPTH, tokens.dtype)])
    alive, keys = np.ones(len(starts), bool), []
    for block in range(0, DEPTH, PER):
        key = np.zeros(len(starts), np.uint64)
        for k in range(block, block + PER):
            value = padded[starts + k]
            alive &= value > 0
            if length is not None:
                alive &= k < length
            key <<= np.uint64(BITS)
            key |= np.where(alive, value, 0).astype(np.uint64)
        keys.append(key)
    return keys


def _search(array: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """For every wanted key the number of keys in the sorted array that are smaller; a binary search of all at once."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(array[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(array, wanted, strict=True):
            got = have[mid]
            less |= same & (got < want)
            same &= got == want
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


class Shard:
    """The suffix array of some documents' words."""

    def __init__(self, queries: Queries, numbers: np.ndarray, bounds: np.ndarray):
        self.queries = queries
        counts = np.diff(bounds)
        text = np.repeat(np.arange(len(counts)), counts)
        self.tokens = np.zeros(len(numbers) + len(counts), np.int32)  # a 0 after each document
        self.tokens[np.arange(len(numbers)) + text] = numbers
        self.first = bounds[:-1] + np.arange(len(counts))
        good = self.tokens > 0
        kept = good.copy()
        for k in range(1, queries.min_match):
            kept[:-k] &= good[k:]
            kept[-k:] = False
        starts = np.flatnonzero(kept)
        keys = _keys(self.tokens, starts)
        order = np.lexsort(keys[::-1])
        for i in range(KEYS):  # one at a time, so that only one is held twice
            keys[i] = keys[i][order]
        self.suffixes, self.keys = starts[order], keys

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(benchmark suffix, place in tokens, length): every longest match of a window or more, none inside another of its item's."""
        q, none = self.queries, (np.zeros(0, np.int64),) * 3
        at = np.flatnonzero(q.is_window)
        if not len(at) or not len(self.suffixes):
            return none
        shared = np.minimum(q.need[at], DEPTH)
        low = _keys(q.tokens, q.start[at], shared)
        block, shift = (shared - 1) // PER, np.uint64(BITS) * (PER - 1 - (shared - 1) % PER).astype(np.uint64)
        high = [key + np.where(block == i, np.uint64(1) << shift, np.uint64(0)) for i, key in enumerate(low)]
        begin, end = _search(self.keys, low), _search(self.keys, high)
        n = end - begin
        which = np.repeat(np.arange(len(at)), n)
        place = self.suffixes[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        suffix = at[which]
        # A match that the word before continues to the left is part of the one that starts there.
        start = q.start[suffix]
        before = np.where((start > 0) & (place > 0), q.tokens[start - 1], 0)
        first = (before == 0) | (before != self.tokens[place - 1])
        suffix, place = suffix[first], place[first]
        length = self._common(q.start[suffix], place)
        long = length >= q.need[suffix]
        return suffix[long], place[long], length[long]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(benchmark suffix, place, length): a longest match of every suffix that matches at least min_match words."""
        q = self.queries
        if not len(q.start) or not len(self.suffixes):
            return (np.zeros(0, np.int64),) * 3
        wanted = _keys(q.tokens, q.start)
        begin = _search(self.keys, wanted)
        end = _search(self.keys, [*wanted[:-1], wanted[-1] + np.uint64(1)])
        best, where = np.zeros(len(q.start), np.int64), np.zeros(len(q.start), np.int64)
        equal = np.maximum(end - begin, 0)
        neighbours = [(np.arange(len(begin))[begin > 0], begin[begin > 0] - 1), (np.arange(len(end))[end < len(self.suffixes)], end[end < len(self.suffixes)])]
        which = np.repeat(np.arange(len(begin)), equal)
        neighbours.append((which, np.repeat(begin, equal) + np.arange(equal.sum()) - np.repeat(np.cumsum(equal) - equal, equal)))
        for suffix, rank in neighbours:
            place = self.suffixes[rank]
            length = self._common(q.start[suffix], place)
            order = np.lexsort((-place, length))
            suffix, place, length = suffix[order], place[order], length[order]
            last = np.full(len(q.start), -1)
            last[suffix] = np.arange(len(suffix))
            hit = np.flatnonzero(last >= 0)
            better = hit[length[last[hit]] > best[hit]]
            best[better], where[better] = length[last[better]], place[last[better]]
        found = np.flatnonzero(best >= q.min_match)
        return found, where[found], best[found]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common from benchmark places a and document places b."""
        length, live, x, y = np.zeros(len(a), np.int64), np.arange(len(a)), self.queries.tokens, self.tokens
        step = 0
        while len(live):
            i, j = a[live] + step, b[live] + step
            ok = (i < len(x)) & (j < len(y))
            ok[ok] = (x[i[ok]] == y[j[ok]]) & (x[i[ok]] > 0)
            live = live[ok]
            length[live] += 1
            step += 1
        return length


def query_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, min_match: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The benchmark's distinct items in blocks of bounded size; `of` is the number of blocks."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("id", "text").collect()
        queries = Queries([r["id"] for r in rows], [r["text"] for r in rows], window, min_match)
        queries.of = blocks
        yield queries


def shards(batches: Iterator[pa.RecordBatch], queries: Queries, text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, Shard, np.ndarray]]:
    """(rows, suffix array, word bounds) of each shard of batches with a text column."""
    for batch in batches:
        data, offsets = buffers(batch.column(text_at))
        for lo, hi in pieces(offsets, SHARD_BYTES):
            words, counts = [], []
            for a, b in pieces(offsets[lo:hi + 1]):
                found, _, upto = scan_words(data, offsets[lo:hi + 1][a:b + 1])
                words.append(queries.numbers(found))
                counts.append(np.diff(upto))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield batch.slice(lo, hi - lo), Shard(queries, np.concatenate(words), bounds), bounds


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a run [start, start+length)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:-1]) > 0


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, min_match: int) -> DataFrame:
    """(id, row, n_words, longest, spans, items) of every document, spans being the hit word runs; items sorted as strings.

    longest is the longest match's words and first word, of equal ones the earliest; null without a match.

    `row` is a hash of id and text where there are several blocks, else null.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for queries in query_blocks(benchmark, item_col, item_text_col, window, min_match):
        blocks = queries.of
        sent = spark.sparkContext.broadcast(queries)

        def judge(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            names = [None if x is None else str(x) for x in q.ids]

            for rows, shard, bounds in shards(batches, q):
                ids = rows.column(0)
                suffix, place, length = shard.matches()
                hit = covered(place, length, len(shard.tokens))
                doc = np.searchsorted(shard.first, place, "right") - 1
                best: list[dict | None] = [None] * len(ids)
                for i in np.lexsort((-place, length)).tolist():  # the longest comes last, of equal ones the earliest
                    d = int(doc[i])
                    best[d] = {"length": int(length[i]), "start": int(place[i] - shard.first[d])}
                pair = np.unique(doc * (len(names) + 1) + q.item[suffix])
                items: list[list[str]] = [[] for _ in range(len(ids))]
                for d, i in zip((pair // (len(names) + 1)).tolist(), (pair % (len(names) + 1)).tolist(), strict=True):
                    if names[i] is not None:
                        items[d].append(names[i])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                spans: list[list[dict]] = [[] for _ in range(len(ids))]
                home = np.searchsorted(shard.first, edges[::2], "right") - 1
                for d, a, b in zip(home.tolist(), (edges[::2] - shard.first[home]).tolist(), (edges[1::2] - shard.first[home]).tolist(), strict=True):
                    spans[d].append({"start": a, "end": b})
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(bounds), pa.int64()), pa.array(best, pa.struct([("length", pa.int64()), ("start", pa.int64())])), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=["id", "n_words", "longest", "spans", "items"],
                )

        schema = f"id {id_type}, n_words long, longest struct<length: long, start: long>, spans array<struct<start: long, end: long>>, items array<string>"
        if blocks == 1:
            return narrow.mapInArrow(lean(judge), schema).withColumn("row", F.lit(None).cast("long"))
        # Several blocks: each pass names a document by id and text, so that the passes can be put together.
        part = narrow.select(F.struct("id", F.xxhash64("id", "text").alias("row")).alias("id"), "text").mapInArrow(lean(judge), schema.replace(f"id {id_type}", f"id struct<id: {id_type}, row: long>", 1))
        out = part if out is None else out.unionByName(part)
    longest = F.max_by("longest", F.struct("longest.length", -F.col("longest.start"))).alias("longest")
    same = out.groupBy("id").agg(F.max("n_words").alias("n_words"), longest, F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), (F.count(F.lit(1)) / blocks).cast("int").alias("copies"))
    return same.select(F.explode(F.array_repeat("id", F.col("copies"))).alias("id"), "n_words", "longest", "spans", F.array_sort(F.array_distinct("items")).alias("items")).select("id.*", "n_words", "longest", "spans", "items")


def hit_words(spans) -> F.Column:
    """How many words the runs cover, overlaps once."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n")),
    )
    return merged["n"]


def _flag(n_hit: F.Column) -> F.Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_match: int = 2) -> DataFrame:
    """One row a document: (id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_start, spans, items).

    longest_match is 0 and longest_start null without a match of a window or a whole shorter item.
    """
    judged = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window, min_match)
    n_hit = hit_words(F.col("spans"))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _flag(n_hit).alias("contaminated"),
        F.coalesce("longest.length", F.lit(0).cast("long")).alias("longest_match"),
        F.col("longest.start").alias("longest_start"),
        "spans",
        "items",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 8) -> DataFrame:
    """(item, item_word, id, doc_word, length): the longest verbatim match of every benchmark suffix over all shards, with its place.

    Where items repeat an id, a word's match is the longest over their texts. Ties go to the smallest document id, then the earliest word. Suffixes that match fewer than min_match words give no row.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    out = None
    for queries in query_blocks(benchmark, item_col, item_text_col, WINDOW, min_match):
        sent = spark.sparkContext.broadcast(queries)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for rows, shard, _ in shards(batches, q):
                ids = rows.column(0)
                suffix, place, length = shard.longest()
                doc = np.searchsorted(shard.first, place, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if q.ids[i] is None else str(q.ids[i]) for i in q.item[suffix]], pa.string()), pa.array(q.offset[suffix]), ids.take(pa.array(doc)), pa.array(place - shard.first[doc]), pa.array(length)],
                    names=["item", "item_word", "id", "doc_word", "length"],
                )

        part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(find), f"item string, item_word long, id {id_type}, doc_word long, length long")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((-F.col("length")).alias("less"), F.col("id").isNull().alias("none"), "id", "doc_word"))
    return out.groupBy("item", "item_word").agg(best.alias("b")).select(F.col("item").cast(item_type).alias(item_col), "item_word", F.col("b.id").alias(id_col), F.col("b.doc_word").alias("doc_word"), (-F.col("b.less")).alias("length"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_match: int = 2) -> DataFrame:
    """The rows of docs whose text is not contaminated, with all their columns.

    With one benchmark block this is one pass without a shuffle; with several, each row is first judged over all of them.
    """
    first = next(query_blocks(benchmark, item_col, item_text_col, window, min_match))
    if first.of > 1:
        bad = _judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window, min_match).where(_flag(hit_words(F.col("spans")))).select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
        return docs.join(bad, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[id_col], docs[text_col]) == F.col("__row")), "left_anti")
    sent, text_at = docs.sparkSession.sparkContext.broadcast(first), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for rows, shard, bounds in shards(batches, q, text_at):
            _, place, length = shard.matches()
            upto = np.concatenate([[0], np.cumsum(covered(place, length, len(shard.tokens)))])
            n_words = np.diff(bounds)
            n_hit = upto[shard.first + n_words] - upto[shard.first]
            yield rows.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(lean(clean), docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS i, item_id, w FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
iwin AS (SELECT i, item_id, o, least(13, len(w)) AS n, array_to_string(w[o : o + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT i, item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS o FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
-- 64 starts at a time with the words that their windows reach, so that a long text is not copied for every word
part AS (SELECT doc_id, 64 * c AS base, w[64 * c + 1 : 64 * c + 76] AS w FROM (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 64)) AS c FROM dw WHERE len(w) > 0)),
dpos AS (SELECT doc_id, base, w, unnest(generate_series(1, least(64, len(w)))) AS t FROM part),
dwin AS (SELECT doc_id, base + t AS s, n, array_to_string(w[t : t + n - 1], ' ') AS win FROM dpos, sizes WHERE t + n - 1 <= len(w)),
hits AS (SELECT doc_id, s, dwin.n AS n, i, item_id, o FROM dwin JOIN iwin ON dwin.win = iwin.win AND dwin.n = iwin.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM hits GROUP BY doc_id),
-- windows that follow each other in a document and in an item are one match
runs AS (SELECT doc_id, min(s) AS s, count(*) + any_value(n) - 1 AS n
  FROM (SELECT *, o - row_number() OVER (PARTITION BY doc_id, i, s - o ORDER BY o) AS run FROM hits) GROUP BY doc_id, i, s - o, run),
best AS (SELECT doc_id, n, s FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(best.n, 0) AS BIGINT) AS longest_match, CAST(best.s - 1 AS BIGINT) AS longest_start
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
"""

"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. A shingle is a run of five words; its weight in a document is tf * idf with idf = 1 + log(N / df) / log(GRADES), from 1
   for what all N documents share to 2 for what under a GRADES-th of them has (less often counts as that often). Document
   frequencies are exact: a sketch of counters over all documents tells which shingles can reach N / GRADES, without
   loss, and those are counted. There are GRADES times a document's mean number of shingles at most; they are broadcast.
2. Documents with equal weighted shingle sets are one class at once; one representative of each goes on.
3. Each representative is sampled BANDS * ROWS times by improved consistent weighted sampling (Ioffe 2010): two documents
   draw the same sample with the probability of their weighted Jaccard similarity. ROWS samples make a bucket of a band.
4. Candidates: in every bucket all members are compared with one leader, the member with most bucket mates over all
   bands, which in a group of near copies is what they were copied from; what is linked to one leader gets one label.
   Members that then have different labels are compared where they meet, in cells of at most BLOCK by BLOCK of them,
   however large the bucket is; a cell returns its links only. So
   no link between bucket mates is lost, and no pairs of a bucket are ever written out. A pair whose total weights differ
   by more than the threshold allows cannot be similar and is not compared, nor is one that differs in more than DIFFER
   of the samples' low four bits.
5. A link is a pair whose weighted Jaccard similarity, computed from the whole texts, is THRESHOLD or more. Classes are
   the connected components of the links.

Defined cases: a null or empty text, or one without words, is a class of its own; a text of fewer than five words has one
shingle; rows that repeat id and text are one class, of which class_size counts each and one is kept; null ids sort last
as class ids; empty tables give empty results; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, buffers, components, dropped, free_name, lean, lookup, mix, pieces, saved, scan_words, shingles, table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
GRADES = 1024  # idf grows as a shingle gets rarer, down to a share of 1/GRADES of the documents
CELLS, SLICE = 1 << 20, 1 << 14  # counters of the sketch, and of one of its slices
PLANES = 4  # low bits of each sample that stay with a document, as so many 64-bit numbers
BLOCK = 128  # members of a bucket that one cell compares with as many others
DIFFER = 25  # a pair of similarity 0.8 differs in more of its 64 samples once in 30,000
_HASH = 50  # bits of a shingle's hash that go with a row number in one sort key
_GRID = 1 << 16  # draws that the table of random variates holds, for all samples


def document_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def weighted_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, shingles sorted in each row, their counts, bounds of each row's shingles)."""
    data, offsets = buffers(column)
    for lo, hi in pieces(offsets):
        for a in range(lo, hi, 8192):
            b = min(hi, a + 8192)
            words, _, bounds = scan_words(data, offsets[a : b + 1])
            runs, limits = shingles(words, bounds, SHINGLE)
            key = np.sort((np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(limits)) << np.uint64(_HASH)) | (runs >> np.uint64(64 - _HASH)))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(key)))
            key = key[first]
            yield a, b, key & np.uint64((1 << _HASH) - 1), count, np.searchsorted(key, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(_HASH))


class Weights:
    """The idf of shingles: a table of those in at least 1/GRADES of the documents, one value for all rarer ones.

    Divided by that value, so that a rare shingle weighs its count.
    """

    def __init__(self, documents: int, frequent: list[tuple[int, int]]):
        frequent = sorted(frequent)
        self.hash = np.array([h for h, _ in frequent], np.uint64)
        n = np.array([n for _, n in frequent], float)
        self.idf = (1 + np.log(max(documents, 1) / np.maximum(n, documents / GRADES)) / math.log(GRADES)) / 2
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.hash):
            maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hash, hashes[maybe]), len(self.hash) - 1)
            hit = self.hash[at] == hashes[maybe]
            out[maybe[hit]] *= self.idf[at[hit]]
        return out


def frequent_cells(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents with words, which cells of the sketch reach 1/GRADES of them).

    A cell counts the documents of all shingles that fall into it, so a frequent shingle's cell always reaches it.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, held, rows = np.zeros(CELLS, np.uint32), [], 0, 0
        for batch in batches:
            for _, _, hashes, _, bounds in weighted_rows(batch.column(0)):
                rows += int((np.diff(bounds) > 0).sum())
                waiting.append(hashes)
                held += len(hashes)
                if held > 1 << 20:
                    cells += np.bincount((np.concatenate(waiting) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                    waiting, held = [], 0
        if waiting:
            cells += np.bincount((np.concatenate(waiting) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        if rows:
            parts = [cells[at : at + SLICE].astype(np.int64).tobytes() for at in range(0, CELLS, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([rows] * len(parts), pa.int64())], names=["slice", "cells", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the slices in a partition one each."""
        total: dict[int, list] = {}
        for batch in batches:
            for at, cells, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                have = total.setdefault(at, [np.zeros(SLICE, np.int64), 0])
                have[0] += np.frombuffer(cells.as_buffer(), np.int64)
                have[1] += rows
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([c.tobytes() for c, _ in total.values()], pa.binary()), pa.array([r for _, r in total.values()], pa.int64())], names=["slice", "cells", "rows"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            bits = [np.packbits(np.frombuffer(c.as_buffer(), np.int64) * GRADES >= r).tobytes() for c, r in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2)], names=["slice", "cells", "rows"])

    fields, slices = "slice int, cells binary, rows long", CELLS // SLICE
    # Slices are added up in two steps, so that no task gets one from each of very many others.
    few = texts.mapInArrow(lean(sketch), fields).withColumn("salt", F.spark_partition_id() % 256).repartition("slice", "salt").drop("salt").mapInArrow(lean(add), fields)
    found = few.repartition(slices, "slice").mapInArrow(lean(reached), fields).collect()
    out = np.zeros(CELLS, bool)
    for r in found:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.unpackbits(np.frombuffer(r["cells"], np.uint8)).astype(bool)
    return max((r["rows"] for r in found), default=0), out


def corpus_weights(docs: DataFrame, text_col: str) -> Weights:
    """Exact document frequencies of all shingles in at least 1/GRADES of the documents."""
    texts = docs.select(text_col)
    documents, cells = frequent_cells(texts)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(cells))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, waiting, held = np.unpackbits(sent.value).astype(bool), [], 0

        def out() -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for _, _, hashes, _, _ in weighted_rows(batch.column(0)):
                waiting.append(hashes[wanted[(hashes & np.uint64(CELLS - 1)).astype(np.int64)]])
                held += len(waiting[-1])
                if held > 1 << 20:
                    yield out()
                    waiting, held = [], 0
        yield out()

    counted = texts.mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") * GRADES >= documents)
    return Weights(documents, [(r["shingle"], r["n"]) for r in counted.collect()])


class Sampler:
    """Improved consistent weighted sampling. Variates of a shingle come from one small table by a hash of shingle and sample."""

    def __init__(self, samples: int = BANDS * ROWS):
        random = np.random.default_rng(77)
        self.r = -np.log((1 - random.random(_GRID)) * (1 - random.random(_GRID)))  # Gamma(2, 1)
        self.log_c = np.log(-np.log((1 - random.random(_GRID)) * (1 - random.random(_GRID))))
        self.beta = random.random(_GRID)
        self.salt = random.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)
        self.unit = self._ordered(self._draw(np.arange(_GRID), np.zeros(_GRID))) << np.uint64(32)

    def _draw(self, cell: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """ln a of Ioffe's scheme: t = floor(ln S / r + beta), ln a = ln c - r (t - beta + 1)."""
        r, beta = self.r[cell], self.beta[cell]
        return self.log_c[cell] - r * (np.floor(log_weight / r + beta) - beta + 1)

    @staticmethod
    def _ordered(x: np.ndarray) -> np.ndarray:
        """Numbers that sort as the floats do."""
        bits = x.astype(np.float32).view(np.uint32)
        return (bits ^ np.where(bits >> 31 > 0, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row of sample ids for each document; documents without shingles get zeros."""
        full = np.flatnonzero(np.diff(bounds))
        out = np.zeros((len(bounds) - 1, len(self.salt)), np.uint64)
        if not len(full):
            return out
        odd = np.flatnonzero(weights != 1.0)
        log_odd = np.log(weights[odd])
        starts = bounds[full]
        tail = mix(hashes)
        low = tail >> np.uint64(32)
        for k, salt in enumerate(self.salt):
            cell = ((tail * salt) >> np.uint64(48)).astype(np.int64)
            value = self.unit[cell]
            if len(odd):
                value[odd] = self._ordered(self._draw(cell[odd], log_odd)) << np.uint64(32)
            value |= low  # equal draws of two shingles: the smaller hash
            # The sample is the shingle and its t: a cell's draw differs with t, so both follow from the value.
            out[full, k] = mix(np.minimum.reduceat(value, starts) + np.uint64(k))
        return out


@functools.lru_cache(maxsize=1)
def shared_sampler() -> Sampler:
    """One table of variates, of 2 MB, a Python worker."""
    return Sampler()


def signatures(docs: DataFrame, weights: Weights, id_col: str, text_col: str) -> DataFrame:
    """(row, id, key, d1, d2, weight, buckets, p0, p1, ...) of every document; d1 and d2 identify its weighted shingle set.

    p0, p1, ... hold the low bits of all samples, a bit of each in every number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, w = shared_sampler(), sent.value
        for batch in batches:
            for a, b, hashes, counts, bounds in weighted_rows(batch.column(3)):
                value = w.of(hashes, counts)
                picked = sampler.samples(hashes, value, bounds)
                mixed = mix(hashes * np.uint64(2 * 0x5851F42D4C957F2D + 1) + counts.astype(np.uint64))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
                again = np.concatenate([[np.uint64(0)], np.cumsum(mix(mixed))])
                mass = np.concatenate([[0.0], np.cumsum(value)])
                bands = np.zeros((b - a, BANDS), np.uint64)
                for band in range(BANDS):
                    x = np.full(b - a, band + 1, np.uint64)
                    for k in range(band * ROWS, (band + 1) * ROWS):
                        x = mix(x * np.uint64(31) + picked[:, k])
                    bands[:, band] = x
                some = np.diff(bounds) > 0
                planes = [np.packbits((picked >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)[:, 0] for p in range(PLANES)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(a, b - a) for i in range(3)],
                        pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64), mask=~some),
                        pa.array((again[bounds[1:]] - again[bounds[:-1]]).view(np.int64)),
                        pa.array(mass[bounds[1:]] - mass[bounds[:-1]]),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())),
                        *map(pa.array, planes),
                    ],
                    names=["row", "id", "key", "d1", "d2", "weight", "buckets", *_PLANES],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(sign), f"row long, id {id_type}, key long, d1 long, d2 long, weight double, buckets array<long>, {', '.join(f'{p} long' for p in _PLANES)}")


_PLANES = [f"p{i}" for i in range(PLANES)]
_OTHER = [f"o{i}" for i in range(PLANES)]


class Sets:
    """The weighted shingle sets of some texts."""

    def __init__(self, column: pa.Array, weights: Weights):
        parts = [(h, weights.of(h, n), np.diff(bounds)) for _, _, h, n, bounds in weighted_rows(column)]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]])
        self.weight = np.concatenate([np.zeros(0), *[p[1] for p in parts]])
        self.size = np.concatenate([np.zeros(0, np.int64), *[p[2] for p in parts]])
        self.start = np.cumsum(self.size) - self.size
        self.total = np.diff(np.concatenate([[0.0], np.cumsum(self.weight)])[np.append(self.start, len(self.hash))])

    def _side(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.start[rows][pair]
        return (pair.astype(np.uint64) << np.uint64(_HASH)) | self.hash[at], self.weight[at]


def jaccard(x: Sets, a: np.ndarray, y: Sets, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of row a[i] of x and row b[i] of y, for all i."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 256):
        i, j = a[lo : lo + 256], b[lo : lo + 256]
        (ka, wa), (kb, wb) = x._side(i), y._side(j)
        if not len(ka) or not len(kb):
            continue
        at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
        same = np.flatnonzero(kb[at] == ka)
        shared = np.bincount((ka[same] >> np.uint64(_HASH)).astype(np.int64), np.minimum(wa[same], wb[at[same]]), len(i))
        out[lo : lo + 256] = shared / np.maximum(x.total[i] + y.total[j] - shared, 1e-12)
    return out


def similarities(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Of saved pairs (a, b) those whose weighted Jaccard similarity reaches the threshold, with it."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = np.arange(part.num_rows)
                found = jaccard(Sets(part.column(2), sent.value), rows, Sets(part.column(3), sent.value), rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["a", "b", "similarity"])

    # Many pairs may share a leader: the second join is by b, whose partitions Spark splits where they are large.
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(lean(compare), "a long, b long, similarity double").where(F.col("similarity") >= threshold - 1e-9)


def labels(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of saved links: the least node of what a node or one neighbour is linked to.

    Nodes of one label are connected; all that is linked to one leader has one.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least", False)
    far = lookup(both.withColumnRenamed("b", "node"), low, ["a"], "n", 2 * links.count()).select("node", "m")
    return saved(far.unionByName(low.select(F.col("a").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("label")), "labels", False)


def met(members: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The links (a, b, similarity) between bucket mates in different components.

    members: (bucket, key, weight, planes, buckets, root, main, n, pivots), main being the bucket's largest component, n
    its members and pivots those outside main. A bucket of up to BLOCK members is one cell; in a larger one blocks of the
    pivots meet blocks of all members. A pair is compared in the first bucket that it shares.
    """
    sent = members.sparkSession.sparkContext.broadcast(weights)
    across, down = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("pivots") / BLOCK)
    own = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    cells = F.when(F.col("n") <= BLOCK, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(2).alias("side")))).otherwise(
        F.concat(
            F.when(F.col("root") != F.col("main"), F.transform(upto(across), lambda j: F.struct((own % down).alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.array()),
            F.transform(upto(down), lambda i: F.struct(i.alias("i"), (own % across).alias("j"), F.lit(1).alias("side"))),
        )
    )
    rows = members.join(texts, "key").select("bucket", F.inline(cells), "key", "root", "main", "weight", "buckets", *_PLANES, "text")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            size = held.nbytes
            if size > 4 << 20:
                cell = np.stack([held.column(k).to_numpy() for k in range(3)])
                last = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0))
                if len(last):  # whole cells only
                    yield from links_of(held.slice(0, int(last[-1]) + 1))
                    held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield from links_of(held)

    def links_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bucket, i, j, side, key, root, main, weight = (rows.column(k).to_numpy() for k in range(8))
        bands = rows.column(8).flatten().to_numpy().reshape(-1, BANDS)
        planes = [rows.column(9 + k).to_numpy().view(np.uint64) for k in range(PLANES)]
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        cell = np.cumsum(new) - 1
        # Rows are ordered by side: those that others meet, sides 1 and 2, are the last of their cell.
        end = np.append(np.flatnonzero(new)[1:], len(new))
        meets = np.bincount(cell, side > 0, len(end)).astype(np.int64)
        left = np.flatnonzero((side != 1) & (root != main))
        n = meets[cell[left]]
        sets, lo = None, 0
        upto = np.cumsum(n)
        while lo < len(left):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 19), "right")))
            a = np.repeat(left[lo:hi], n[lo:hi])
            b = np.arange(len(a)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + (end - meets)[cell[a]]
            lo = hi
            good = (root[a] != root[b]) & ((root[b] == main[b]) | (key[a] < key[b]))
            good &= np.minimum(weight[a], weight[b]) >= np.maximum(weight[a], weight[b]) * (threshold - 1e-9)
            a, b = a[good], b[good]
            apart = functools.reduce(np.bitwise_or, [p[a] ^ p[b] for p in planes])
            good = np.bitwise_count(apart) <= DIFFER
            a, b = a[good], b[good]
            shared = bands[a] == bands[b]
            good = bands[a, shared.argmax(1)] == bucket[a]
            a, b = a[good], b[good]
            if not len(a):
                continue
            sets = sets or Sets(rows.column(9 + PLANES), sent.value)
            found = jaccard(sets, a, sets, b)
            hit = found >= threshold - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(key[a[hit]]), pa.array(key[b[hit]]), pa.array(found[hit])], names=["a", "b", "similarity"])

    return dealt.mapInArrow(lean(compare), "a long, b long, similarity double")


def _apart() -> Column:
    """In how many samples the low bits of two documents differ."""
    return F.bit_count(functools.reduce(lambda x, y: x.bitwiseOR(y), [F.col(p).bitwiseXOR(F.col(o)) for p, o in zip(_PLANES, _OTHER, strict=True)]))


def _comparable(threshold: float) -> Column:
    return (F.least("weight", "other") >= F.greatest("weight", "other") * (threshold - 1e-9)) & (_apart() <= DIFFER)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of docs: (id, key, class_id, class_size, kept); class_id is the smallest id of the class."""
    spark = docs.sparkSession
    bounded_batches(spark, 8 << 20)
    weights = corpus_weights(docs, text_col)
    signed = saved(signatures(docs, weights, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "row", "weight", "buckets", *_PLANES))
    groups = signed.where("d1 is not null").groupBy("d1", "d2").agg(first.alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = saved(groups.select("d1", "d2", "n", *[f"rep.{c}" for c in ("id", "key", "row", "weight", "buckets", *_PLANES)]), "representatives")

    # Bucket mates only: what shares no bucket has no candidate.
    spread = reps.select("key", "weight", *_PLANES, F.explode("buckets").alias("bucket"))
    sizes = saved(reps.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes", False)
    mates = saved(lookup(spread, sizes, ["bucket"], "n", BANDS * reps.count()), "bucket-mates")
    central = mates.groupBy("key").agg(F.sum("n").alias("central"))
    mates = saved(mates.drop("n").join(central, "key"), "bucket-mates")
    total = mates.count()
    wanted = mates.select("key").distinct()
    keyed = docs.select(document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    # The hint keeps one join strategy at every size; the candidates grow with the documents.
    texts = saved(keyed.join(wanted.hint("merge"), "key", "left_semi").dropDuplicates(["key"]), "candidate-texts")

    best = mates.groupBy("bucket").agg(F.max(F.struct("central", "key", "weight", *_PLANES)).alias("l"), F.count(F.lit(1)).alias("n"))
    leaders = saved(best.select("bucket", "n", F.col("l.key").alias("leader"), F.col("l.weight").alias("other"), *[F.col(f"l.{p}").alias(o) for p, o in zip(_PLANES, _OTHER, strict=True)]), "leaders", False)
    stars = lookup(mates, leaders, ["bucket"], "n", total).where("key <> leader").where(_comparable(threshold))
    pairs = saved(stars.select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", False)
    stars = saved(similarities(pairs, texts, weights, threshold), "links")
    label = labels(stars)

    # Bucket mates of different labels, the most common label of a bucket as one side only.
    rooted = mates.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("label", "key")).drop("label")
    parts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    split = saved(split.select("bucket", F.col("main.root").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("pivots")), "split", False)
    across = lookup(rooted, split, ["bucket"], "n", total).join(reps.select("key", "buckets"), "key")
    links = saved(met(across, texts, weights, threshold), "links").select("a", "b").unionByName(stars.select("a", "b"))

    # Components of the labels, then of what has one.
    for side in ("a", "b"):
        links = links.join(label.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    joined = components(links)
    roots = reps.select("key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("node", F.coalesce("label", "key")).drop("label")
    roots = saved(roots.join(joined, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "roots", False)

    placed = saved(reps.select("d1", "d2", "n", "id", "key", "row").join(roots, "key"), "placed", False)
    classes = saved(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "row")).alias("c"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("reps")), "classes", False)
    groups = lookup(placed, classes, ["root"], "reps", reps.count()).select("d1", "d2", "n", F.col("c.id").alias("class_id"), F.col("c.row").alias("class_row"), "class_size")
    groups = saved(groups, "groups", False)
    dropped(texts, mates)
    members = lookup(signed.where("d1 is not null").select("d1", "d2", "id", "key", "row"), groups, ["d1", "d2"], "n", signed.count())
    alone = signed.where("d1 is null").select("id", "key", "row", F.col("id").alias("class_id"), F.col("row").alias("class_row"), F.lit(1).cast("long").alias("class_size"))
    out = members.select(*alone.columns).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "key", "class_id", "class_size", (F.col("row") == F.col("class_row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, one of each class (the smallest id), with all columns."""
    names, key = docs.columns, free_name(docs, "key")
    found = saved(near_classes(docs, id_col, text_col, threshold).select("key", "kept"), "near-classes")
    keys = found.groupBy("key").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))
    keyed = docs.withColumn(key, document_key(id_col, text_col))
    left = keyed.join(keys.where("not stays").select(F.col("key").alias(key)), key, "left_anti")
    # Of rows that repeat id and text, and are a class member each, as many stay as their class keeps.
    again = saved(keys.where("stays and kept < n").select(F.col("key").alias(key)), "repeated-rows", False)
    if again.isEmpty():
        return left.select(*names)
    return left.join(again, key, "left_anti").select(*names).unionByName(left.join(again, key, "left_semi").dropDuplicates([key]).select(*names))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")

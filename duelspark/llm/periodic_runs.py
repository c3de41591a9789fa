"""Periodic runs of words, found by recompression.

A run is a stretch of words with smallest period q, at least `min_words` and `min_exponent` periods long, that no
neighbouring word extends. Every run of period q holds, with a whole period after it, some place of a harmonic grid: the
multiples of max(min_words - q, (min_exponent - 1) q), n log n places in all for a text of n words. A grid place and the
word q further on that agree, with enough of their neighbours to be in a run at all, are a candidate.

How far a candidate extends is answered by a grammar, not by suffix arrays. Recompression (Jez 2015) writes the texts of a
block of rows as one sequence and shortens it in turns: block compression names each maximal run of one symbol by symbol
and length, pair compression splits the alphabet in two by a hash and names each neighbouring pair of a left and a right
symbol. Equal stretches get equal names but for their ends (I 2017), so the longest common extension of two places climbs
while the symbols that start there agree, skips over the largest that do, and descends where they differ: some steps for
each level, for all candidates at once, forwards and backwards on one grammar. Names are exact, not hashed.

Every text is settled by the task that reads it: nothing is shuffled, whatever the size of its source or group of copies.
Texts are joined in blocks of about BLOCK bytes; a longer one is a block of its own, at some 40 bytes a word.

Defined cases: a null text counts as empty and has no runs; an empty text, or one of white space, collapses to the empty
text; rows that repeat come back as often as they came; null ids are kept; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, mix, table

MIN_WORDS, MIN_EXPONENT = 24, 3
BLOCK = 1 << 20  # text bytes of one grammar
GRID_WORDS = 1 << 15  # texts up to so many words share one grid
GRID_PART = 1 << 20  # candidates of longer texts looked at together
OUT_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GRIDS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

#: What a caller may do to a text's words first: (id, number of words) to the word that each place gets, or None.
Rewrite = Callable[[object, int], "np.ndarray | None"]


# -- the grammar ------------------------------------------------------------------------------------------------------


class Grammar:
    """The derivation forest of a sequence, level after level in shared arrays; a node is an index into them.

    symbol; parent (-1 at the top); first and last child (the node itself at the bottom); size in words; blocks tells
    which nodes stand for a run of one symbol. Neighbours of a level are neighbours in the arrays.
    """

    def __init__(self, codes: np.ndarray, names: int):
        """codes: symbols below `names`; the first and the last must occur once each."""
        symbol, size, base, turn = codes.astype(np.int64), np.ones(len(codes), np.int64), 0, 0
        level = np.arange(len(codes))
        symbols, firsts, lasts, sizes, blocks, parents = [symbol], [level], [level], [size], [np.zeros(len(codes), bool)], []
        idle = 0
        while len(symbol) > 2 and idle < 4:
            turn += 1
            starts = self._blocks(symbol) if turn % 2 else self._pairs(symbol, turn)
            n = np.diff(np.append(starts, len(symbol)))
            fresh = n > 1
            idle = 0 if fresh.any() else idle + 1
            if not fresh.any():
                continue
            last = starts + n - 1
            up = symbol[starts]
            other = n if turn % 2 else symbol[last]
            _, name = np.unique((up[fresh] << 32) | other[fresh], return_inverse=True)
            up[fresh] = names + name
            names += int(name.max()) + 1
            parents.append(base + len(symbol) + np.repeat(np.arange(len(starts)), n))
            firsts.append(base + starts)
            lasts.append(base + last)
            size = np.add.reduceat(size, starts)
            base += len(symbol)
            symbol = up
            symbols.append(symbol)
            sizes.append(size)
            blocks.append(np.full(len(symbol), bool(turn % 2)))
        parents.append(np.full(len(symbol), -1))
        self.symbol, self.parent, self.first, self.last, self.size, self.block = (np.concatenate(x) for x in (symbols, parents, firsts, lasts, sizes, blocks))
        self.words = len(codes)

    @staticmethod
    def _blocks(symbol: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))

    @staticmethod
    def _pairs(symbol: np.ndarray, turn: int) -> np.ndarray:
        left = (mix(symbol.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
        joined = left[:-1] & ~left[1:]
        other = ~left[:-1] & left[1:]
        if np.count_nonzero(other) > np.count_nonzero(joined):  # the halves the other way round make more pairs
            joined = other
        return np.flatnonzero(np.append(True, ~joined))

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from the places a and b on (or before and with them, if back) are equal; a and b differ."""
        total = np.zeros(len(a), np.int64)
        x, y, at = a.astype(np.int64), b.astype(np.int64), np.arange(len(a))
        edge, far, step = (self.last, self.first, -1) if back else (self.first, self.last, 1)
        while len(at):
            same = self.symbol[x] == self.symbol[y]
            up, vp = self.parent[x], self.parent[y]
            climb = same & (up >= 0) & (edge[up] == x) & (edge[vp] == y)
            climb &= self.symbol[up] == self.symbol[vp]
            # equal, but what they begin isn't: past them; past all equal ones of two blocks of different length
            skip = same & ~climb
            length = np.where(self.block[up] & (up >= 0), np.minimum(np.abs(far[up] - x), np.abs(far[vp] - y)) + 1, 1)
            total[at[skip]] += (length * self.size[x])[skip]
            down = ~same & (x >= self.words)
            x, y = (np.where(climb, top, np.where(skip, place + step * length, np.where(down, edge[place], place))) for place, top in ((x, up), (y, vp)))
            live = same | down
            x, y, at = x[live], y[live], at[live]
        return total


# -- candidates -------------------------------------------------------------------------------------------------------


def grid(n: int, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, part: int = GRID_PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid of a text of n words, in parts."""
    if n < max(min_words, min_exponent):
        return
    if n <= GRID_WORDS:
        key = (min_words, min_exponent)
        if key not in _GRIDS:
            place, period = (np.concatenate(x) for x in zip(*_grid(GRID_WORDS, *key, part), strict=True))
            need = np.maximum(place + period + 1, min_exponent * period)  # the least n at which it is in the grid
            order = np.argsort(need, kind="stable")
            _GRIDS[key] = place[order].astype(np.int32), period[order].astype(np.int32), need[order]
        place, period, need = _GRIDS[key]
        upto = np.searchsorted(need, n, "right")
        yield place[:upto], period[:upto]
        return
    yield from _grid(n, min_words, min_exponent, part)


def _grid(n: int, min_words: int, min_exponent: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 1
    while at <= n // min_exponent:
        periods = np.arange(at, min(at + part, n // min_exponent + 1))
        step = np.maximum(min_words - periods, (min_exponent - 1) * periods)
        counts = (n - periods + step - 1) // step
        upto = max(1, int(np.searchsorted(np.cumsum(counts), part, "right")))
        periods, step, counts = periods[:upto], step[:upto], counts[:upto]
        row = np.repeat(np.arange(upto), counts)
        yield (np.arange(len(row)) - (np.cumsum(counts) - counts)[row]) * step[row], periods[row]
        at += upto


def _agree(codes: np.ndarray, place: np.ndarray, period: np.ndarray, near: int) -> np.ndarray:
    """Which candidates have `near` words after (with) or before them that agree with those one period on."""
    ahead, behind = np.ones(len(place), bool), np.ones(len(place), bool)
    for k in range(1, near + 1):
        if k < near:
            ahead &= codes[np.minimum(place + k, len(codes) - 1 - period)] == codes[np.minimum(place + k, len(codes) - 1 - period) + period]
        behind &= codes[np.maximum(place - k, 0)] == codes[np.maximum(place - k, 0) + period]
    return ahead | behind


def find_runs(codes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period), in that order, of the runs of texts whose words are codes[bounds[i]:bounds[i+1]]."""
    counts, texts = np.diff(bounds), len(bounds) - 1
    # one sequence, a symbol of its own before each text and after the last
    marks = int(codes.max(initial=-1)) + 1 + np.arange(texts + 1)
    line = np.insert(codes.astype(np.int64), bounds, marks)
    begin = bounds[:-1] + np.arange(1, texts + 1)
    near = -(-min(max(min_words - q, (min_exponent - 1) * q) for q in range(1, min_words + 1)) // 2)
    found = []
    for text in np.flatnonzero(counts >= max(min_words, min_exponent)):
        for place, period in grid(int(counts[text]), min_words, min_exponent):
            own = line[begin[text] : begin[text] + counts[text]]
            hit = np.flatnonzero(own[place] == own[place + period])
            if len(hit):
                place, period = place[hit].astype(np.int64) + begin[text], period[hit].astype(np.int64)
                good = _agree(line, place, period, near)
                if good.any():
                    found.append((np.full(int(good.sum()), text), place[good], period[good]))
    if not found:
        return np.zeros((0, 4), np.int64)
    text, place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # the grammar is that of the texts with candidates, each with the mark before it, and a mark that ends it all
    wanted = np.unique(text)
    of = np.concatenate([np.arange(begin[t] - 1, begin[t] + counts[t]) for t in wanted] + [np.array([len(line) - 1])])
    start_of = np.zeros(texts, np.int64)
    start_of[wanted] = np.cumsum(counts[wanted] + 1) - counts[wanted]
    names, sequence = np.unique(line[of], return_inverse=True)
    grammar = Grammar(sequence, len(names))
    a = place - begin[text] + start_of[text]
    after = grammar.extension(a, a + period)
    before = grammar.extension(a - 1, a + period - 1, back=True)
    start, length = a - before - start_of[text], before + period + after
    long = (length >= min_words) & (length >= min_exponent * period)
    rows = np.stack([text, start, length, period], axis=1)[long]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # one stretch comes with its multiples of the period too; the smallest is the period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's n words stand in some run (start, length, period) behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


# -- over tables ------------------------------------------------------------------------------------------------------


def _blocks_of(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text or b"") > BLOCK:
            yield at, i
            at, held = i, 0
        held += len(text or b"") + 1
    if at < len(texts):
        yield at, len(texts)


def collapse(ids: list, texts: list[bytes | None], rewrite: Rewrite | None = None, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[np.ndarray, memoryview]]:
    """(rows (start, length, period) of its runs, its kept words joined by one space) of each text."""
    data = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    keep = ~space
    keep[1:] |= ~space[:-1]  # a word keeps the white space after it, as one space
    packed = np.where(space, np.uint8(0x20), data)[keep]
    offsets = np.append(np.cumsum(keep)[starts] - 1, len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    bounds = np.searchsorted(starts, np.cumsum([1, *[len(t or b"") + 1 for t in texts]]))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
    source, changed = None, set()
    if rewrite is not None:
        for i, (key, n) in enumerate(zip(ids, np.diff(bounds).tolist(), strict=True)):
            if n and (order := rewrite(key, n)) is not None:
                source = np.arange(len(codes)) if source is None else source
                source[bounds[i] : bounds[i + 1]] = bounds[i] + order
                changed.add(i)
        if source is not None:
            codes = codes[source]
    runs = find_runs(codes, bounds, min_words, min_exponent)
    cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    packed = memoryview(packed)
    for i in range(len(texts)):
        own, lo, hi = runs[cut[i] : cut[i + 1], 1:], int(bounds[i]), int(bounds[i + 1])
        if not len(own) and i not in changed:
            yield own, packed[offsets[lo] : max(offsets[lo], offsets[hi] - 1)]
            continue
        kept = np.flatnonzero(~dropped(own, hi - lo)) + lo
        part = words.take(pa.array(kept if source is None else source[kept]))
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        yield own, memoryview(part.buffers()[2])[ends[0] : ends[-1] - 1]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, runs array of (start, length, period) by start and period, collapsed text) of each row.

    collapsed has the words that stay, joined by one space: of each run those of its first period do, as far as no other
    run drops them.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession, OUT_BYTES)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
            values = ids.to_pylist() if rewrite is not None else [None] * len(texts)
            for a, b in _blocks_of(texts):
                found = list(collapse(values[a:b], texts[a:b], rewrite, min_words, min_exponent))
                offsets = pa.array(np.cumsum([0, *[len(r) for r, _ in found]]), pa.int32())
                rows = np.concatenate([r for r, _ in found])
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_RUN)))
                collapsed = pa.array([bytes(t) for _, t in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), runs, collapsed], names=["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = narrow.mapInArrow(lean(find), f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first of equal ones in an array by start and period; null if empty."""
    better = lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), better)


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's repeats: documents whose id's crc32 ends in 0 repeat a stretch from one of their words on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

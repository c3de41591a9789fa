"""Spelling variants: words one edit apart, each led to the far more frequent word it is a variant of.

Words of one edit are found by asymmetric q-chunks (Qin et al. 2011). The shorter word of a pair (of equal lengths, the
smaller) contributes two disjoint chunks, its halves; the other contributes its positional grams of the same lengths. One
edit touches one half only, so the other half stands in the longer word as a gram, shifted by at most one: the first half
at the same place, the second shifted by the difference of the lengths. Only grams at such places are made, and the join
key holds length, half and letters. What meets is verified by its edit distance.

A half that very many words share would make all their pairs. Such a hot key isn't joined: its words go on with the letters
that the key hasn't fixed, cut into halves and grams again, and so on until the key is shared by few words or one letter is
left. Every pair of near words keeps a key in each round, so none is lost, and words that share all but one letter are no
more than the letters there are.

Defined cases: a null text has no words; null ids write as the empty string; rows that repeat count as often as they come;
an empty table gives an empty result; other columns are ignored, whatever their names; a text is scanned by pieces of CHUNK
bytes, so that only its bytes and one piece's arrays are held.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, bounded_batches, buffers, dropped, lean, lookup, pieces, saved, table

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
HOT_PAIRS = 32  # candidates a row beyond which a key is cut further
HOT_ROWS = 4096  # rows of a key beyond which it is cut further
HELD_WORDS = 1 << 19  # distinct words that a task combines before it sends them

#: What a caller may do to each occurrence: (ids of the texts, text of each word, bytes, starts, lengths in bytes and in
#: code points) to {word: new bytes}.
Change = Callable[[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[int, bytes]]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # U+00C0 to U+00FF are the byte C3 and one more
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


# -- words and their counts -------------------------------------------------------------------------------------------


def scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length in bytes, length in code points) of the maximal runs of letters of some UTF-8."""
    letter = _LETTER[data]
    high = data[:-1] == 0xC3
    letter[1:] |= high
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    before = np.concatenate([[0], np.cumsum(data == 0xC3)])
    return starts, ends - starts, ends - starts - (before[ends] - before[starts])


def _segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about CHUNK bytes, each cut behind a byte that is in no word."""
    at = 0
    while at < len(data):
        upto = min(len(data), at + CHUNK)
        while upto < len(data) and (_LETTER[data[upto - 1]] or data[upto - 2] == 0xC3):
            upto += 1
        yield data[at:upto]
        at = upto


def _counts(ids: list, data: np.ndarray, offsets: np.ndarray, min_letters: int, change: Change | None) -> tuple[pa.Array, pa.Array]:
    """(word, occurrences) of texts at data[offsets[i]:offsets[i+1]]."""
    data = _FOLD[data]
    split = np.insert(data, offsets[1:-1], 0x20)  # no word crosses texts
    offsets = offsets + np.arange(len(offsets))
    starts, size, letters = scan(split)
    long = letters >= min_letters
    starts, size, letters = starts[long], size[long], letters[long]
    text = np.searchsorted(offsets, starts, "right") - 1
    changed = change(ids, text, split, starts, size, letters) if change else {}
    keep = np.zeros(len(split) + 1, np.int8)
    same = np.ones(len(starts), bool)
    same[list(changed)] = False
    starts, size = starts[same], size[same]
    keep[starts], keep[starts + size] = 1, -1
    packed = split[np.cumsum(keep[:-1]).astype(bool)]
    words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(packed)])
    if changed:
        words = pa.concat_arrays([words, pa.array(changed.values(), pa.binary())])
    counts = pc.value_counts(words)
    return counts.field("values"), counts.field("counts")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, change: Change | None = None) -> DataFrame:
    """(word, n) of the words of at least min_letters letters and min_count occurrences in all texts.

    Tasks add up what they read before anything is shuffled, HELD_WORDS words at a time.
    """
    bounded_batches(docs.sparkSession)

    def combined(parts: list[tuple[pa.Array, pa.Array]]) -> pa.Table:
        both = pa.table({"word": pa.chunked_array([w for w, _ in parts]), "n": pa.chunked_array([n for _, n in parts])})
        return both.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.greater_equal(pc.utf8_length(rows["word"].cast(pa.string())), min_letters))
        yield from rows.select(["word", "n"]).cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = buffers(batch.column(1))
            for a, b in pieces(offsets):
                for piece in _segments(data[offsets[a] : offsets[b]]) if b == a + 1 else [data[offsets[a] : offsets[b]]]:
                    bounds = offsets[a : b + 1] - offsets[a] if b > a + 1 else np.array([0, len(piece)])
                    if len(piece):
                        parts.append(_counts(ids[a:b], piece, bounds, min_letters, change))
                        held += len(parts[-1][0])
                if held > HELD_WORDS:
                    whole = combined(parts)
                    if len(whole) > HELD_WORDS // 2:
                        yield from out(whole)
                        parts, held = [], 0
                    else:
                        parts, held = [(whole["word"].combine_chunks(), whole["n"].combine_chunks())], len(whole)
        if parts:
            yield from out(combined(parts))

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- near words -------------------------------------------------------------------------------------------------------


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (key, chunk, more, word, n, rest) cut further: a key for each half of `rest`.

    chunk tells the two sides apart, more is how many letters the other word's rest has beyond the chunk word's.
    """
    own = F.length("rest") - F.col("more")
    half = F.floor(own / 2).cast("int")
    cut = half + F.col("more")

    def part(name: str, fixed: Column, rest: Column) -> Column:
        return F.struct(F.concat_ws("|", "key", F.concat(own.cast("string"), F.lit(name)), fixed).alias("key"), rest.alias("rest"))

    first = part("a", F.expr("left(rest, cast(floor((length(rest) - more) / 2) as int))"), F.substring("rest", half + 1, F.length("rest")))
    second = part("b", F.substring("rest", cut + 1, F.length("rest")), F.substring("rest", F.lit(1), cut))
    return rows.select("chunk", "more", "word", "n", F.explode(F.array(first, second)).alias("cut")).select("cut.key", "chunk", "more", "word", "n", "cut.rest")


def near_pairs(words: DataFrame, hot_pairs: int = HOT_PAIRS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, a_n, b, b_n) of every two words of (word, n) one edit apart, once; a is the shorter or smaller one. Words are distinct."""
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("chunk"), F.lit(m).alias("more")) for c, m in ((True, 0), (False, 0), (False, 1))])).alias("side")
    # the empty chunk's key has the length only, by which chunks of a word meet grams of words as long or one longer
    rows = words.where("word <> ''").select("word", "n", side).select(F.lit("").alias("key"), "side.chunk", "side.more", "word", "n", F.col("word").alias("rest"))
    found: list[DataFrame] = []
    while True:
        rows = saved(_halves(rows), "chunks", False)
        sizes = rows.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.min(F.length("rest")).alias("left")).where("chunks > 0 and grams > 0")
        hot = (F.col("left") > 1) & ((F.col("chunks") * F.col("grams") > hot_pairs * (F.col("chunks") + F.col("grams"))) | (F.col("chunks") + F.col("grams") > hot_rows))
        sizes = saved(sizes.select("key", (F.col("chunks") + F.col("grams")).alias("rows"), hot.alias("hot")), "chunk-sizes", False)
        chunks = rows.where("chunk").select("key", F.col("word").alias("a"), F.col("n").alias("a_n")).join(sizes.where("not hot").select("key"), "key")
        grams = rows.where("not chunk").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
        met = chunks.join(grams, "key").where("(length(a) < length(b) or a < b) and levenshtein(a, b, 1) = 1")
        found.append(saved(met.select("a", "a_n", "b", "b_n"), "near-words", False))
        many = saved(sizes.where("hot").select("key", "rows"), "hot-chunks", False)
        total = many.agg(F.sum("rows")).first()[0]
        if not total:
            break
        rows = lookup(rows, many, ["key"], "rows", total).select(*rows.columns)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def variants(words: DataFrame, ratio: int = RATIO, **limits: int) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of the distinct words of (word, n).

    form is the near word of largest n, the smallest of equal ones, if it has ratio times the word's n; root is where
    following forms ends. ratio is above 1, so forms never lead back.
    """
    if ratio <= 1:
        raise ValueError("forms could lead back to their word")
    pairs = near_pairs(words, **limits)
    sides = [F.struct(F.col(w).alias("word"), F.col(v).alias("near"), F.col(f"{v}_n").alias("near_n")) for w, v in ("ab", "ba")]
    each = pairs.select(F.inline(F.array(*sides)))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    known = words.select("word", "n").join(best, "word", "left").withColumn("good", -F.col("best.order") >= ratio * F.col("n"))
    led = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("good"), F.col("best.near")).alias("form"), F.when(F.col("good"), -F.col("best.order")).alias("form_n")), "forms", False)
    roots = saved(led.where("form is not null").select("word", F.col("form").alias("root")), "roots", False)
    while True:  # each step follows twice as many forms
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = saved(roots.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots", False)
        dropped(roots)
        roots = further
        if roots.where("moved").isEmpty():
            break
    return led.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


# -- the query --------------------------------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def deletions(ids: list, text: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, letters: np.ndarray) -> dict[int, bytes]:
    """The contract's misspellings: words whose crc32 with the id 199 divides lose one letter."""
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    state = ~before[text]
    order = np.argsort(-size, kind="stable")
    state, at, ordered = state[order], starts[order], -size[order]
    for k in range(-int(ordered[0]) if len(ordered) else 0):
        upto = int(np.searchsorted(ordered, -k, "left"))
        head = state[:upto]
        state[:upto] = _CRC[(head ^ data[at[:upto] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
    crc = np.empty(len(order), np.uint32)
    crc[order] = ~state
    out = {}
    for i in np.flatnonzero(crc % 199 == 0).tolist():
        word = data[starts[i] : starts[i] + size[i]].tobytes().decode()
        gone = int(crc[i]) % int(letters[i])
        out[i] = (word[:gone] + word[gone + 1 :]).encode()
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = saved(word_counts(table(spark, sf_dir, "documents"), change=deletions), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM each),
hashed AS (SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(code) // 2), lambda i: CAST(('0x' || substr(code, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
    lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256))) AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, hex(encode(near))) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
led AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1),
way AS (SELECT word, word AS root FROM led WHERE form IS NULL UNION ALL SELECT l.word, w.root FROM led l JOIN way w ON l.form = w.word)
SELECT l.word, l.form, way.root, l.n, l.n_near, l.form_n FROM led l JOIN way ON l.word = way.word
"""

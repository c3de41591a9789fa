"""Language identification with error-correcting output codes.

Every language has a binary codeword. One linear classifier a bit learns from byte n-gram frequencies whether a text's
language has a 1 there; the bits are fitted in parallel, a Spark group each. Decoding adds up, for every codeword, the
logistic losses of all bits and takes the nearest codeword; the gap to the second decides the score and flags ambiguity.

Codes: up to EXHAUSTIVE languages get all distinct splits of the languages in two; more get CODE_BITS columns drawn from
a fixed seed, redrawn until any two codewords differ in a quarter of the bits.

The classifier is fitted on a sample of at most SAMPLE_PER_LANGUAGE labelled texts a language (whole texts), taken by the
order of a hash of their id, language and text. Predictions read the text alone.

Defined cases: a null text, and one without any letter, is `und` with score 0; labels that are null teach nothing; a table
without any label predicts `und` everywhere; one language only predicts it for every text with a letter; rows that repeat
an id are each predicted from their own text; other columns are carried, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, lean, pieces, release, table

SAMPLE_PER_LANGUAGE = 1500
ORDERS = (1, 2, 3)
BUCKETS = 4096  # a power of two; n-grams of each order are counted in as many
EXHAUSTIVE = 6
CODE_BITS = 48
EPOCHS = 150
AMBIGUOUS = 0.2  # a score below it flags a text as ambiguous
SLICE, SLICE_ROWS = 256 << 10, 256  # text bytes and texts of one pass

_BYTE = np.arange(256)
#: A-Z folded, digits as one value, all other ASCII but letters as a space.
_CLASS = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
_CLASS = np.where((_CLASS >= 97) & (_CLASS <= 122) | (_BYTE >= 128), _CLASS, 32).astype(np.uint32)
_LETTER = ((_CLASS >= 97) & (_CLASS <= 122)).astype(bool)


def codebook(languages: int) -> np.ndarray:
    """A codeword of -1 and 1 for each language."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in itertools.product((-1, 1), repeat=languages - 1) if -1 in rest]
        return np.array(columns, float).T
    bits = max(CODE_BITS, 4 * int(np.ceil(np.log2(languages))))
    for seed in itertools.count():
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (languages, bits))
        apart = (code[:, None] != code[None]).sum(2) + bits * np.eye(languages, dtype=int)
        if apart.min() >= bits // 4 and (np.abs(code.sum(0)) < languages).all():
            return code
    raise AssertionError


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of n-gram frequencies, a row for each text; n-grams never cross texts."""
    n = len(offsets) - 1
    begin, local = int(offsets[0]), offsets - offsets[0]
    codes = _CLASS[data[begin : int(offsets[-1])]]
    out = np.zeros((n, len(ORDERS) * BUCKETS), np.float32)
    owner = np.repeat(np.arange(n), np.diff(local))
    for k, order in enumerate(ORDERS):
        if len(codes) < order:
            continue
        grams = codes[: len(codes) - order + 1].copy()
        for step in range(1, order):
            grams *= np.uint32(0x01000193)
            grams ^= codes[step : len(codes) - order + 1 + step]
        if order > 1:
            grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            inside = owner[: len(grams)] == owner[order - 1 :]
            where = owner[: len(grams)][inside] * BUCKETS + grams[inside]
        else:
            where = owner * BUCKETS + grams
        counts = np.bincount(where, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


class Grams:
    """The features of texts without their zeros, by blocks of rows: most n-grams aren't in most texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.blocks = []  # (first row, last row, rows with any, their starts, numbers of all rows, columns, values)
        for a, b in slices(offsets):
            x = features(data, offsets[a : b + 1])
            row, column = np.nonzero(x)
            n = np.bincount(row, minlength=b - a)
            some = np.flatnonzero(n)
            self.blocks.append((a, b, some, (np.cumsum(n) - n)[some], n, column.astype(np.uint16), x[row, column]))
        self.rows, self.nbytes = len(offsets) - 1, sum(x.nbytes for block in self.blocks for x in block[2:])

    def times(self, w: np.ndarray) -> np.ndarray:
        """x @ w."""
        out = np.zeros(self.rows, np.float32)
        for a, b, some, starts, _, column, value in self.blocks:
            if len(some):
                out[a:b][some] = np.add.reduceat(w[column] * value, starts)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """x.T @ g."""
        out = np.zeros(len(ORDERS) * BUCKETS)
        for a, b, _, _, n, column, value in self.blocks:
            out += np.bincount(column, value * np.repeat(g[a:b], n), len(out))
        return out.astype(np.float32)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes and at most SLICE_ROWS texts: a text's features take the same room, long or short."""
    for a, b in pieces(offsets, SLICE):
        for lo in range(a, b, SLICE_ROWS):
            yield lo, min(b, lo + SLICE_ROWS)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    begin, end = int(offsets[0]), int(offsets[-1])
    seen = np.concatenate([[0], np.cumsum(_LETTER[data[begin:end]])])
    local = offsets - begin
    found = seen[local[1:]] > seen[local[:-1]]
    for i in np.flatnonzero(~found):
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[list[str], DataFrame]:
    """The languages in order, and (text, lang) of at most per_language labelled texts of each, by the order of a hash."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(lang_col), F.col(text_col)).alias("order"))
    # The hash is even over its range: twice the share that is wanted leaves few rows of a language to order, and enough.
    shares = [x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, (2 * per_language + 20) / n) * (1 << 52))))]
    if not shares:
        return [], rows.select("text", "lang").limit(0)
    likely = rows.where(F.abs(F.shiftright("order", 11)) < F.create_map(*shares)[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    return sorted(counts), likely.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Languages, their codewords and the weights of one classifier a bit."""
    languages, picked = sample(docs, id_col, text_col, lang_col, per_language)
    code = codebook(len(languages))
    if len(languages) < 2:
        return {"languages": languages, "code": code, "weights": np.zeros((len(ORDERS) * BUCKETS, code.shape[1]), np.float32), "bias": np.ones(code.shape[1], np.float32)}
    index = {lang: i for i, lang in enumerate(languages)}

    def fit(rows: pa.Table) -> pa.Table:
        bit = rows["bit"][0].as_py()
        x = Grams(*buffers(rows["text"]))
        y = code[[index[lang] for lang in rows["lang"].to_pylist()], bit].astype(np.float32)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
        # Weights of n-grams that the sample lacks stay 0.
        w, b, vw, vb = np.zeros(len(ORDERS) * BUCKETS, np.float32), np.float32(0), np.full(len(ORDERS) * BUCKETS, 1e-8, np.float32), np.float32(1e-8)
        for _ in range(EPOCHS):  # logistic regression, all rows a step, step sizes by accumulated squares
            g = -y * weight / (1 + np.exp(np.clip(y * (x.times(w) + b), -30, 30)))
            gw, gb = x.back(g) + 1e-6 * w, g.sum()
            vw, vb = vw + gw * gw, vb + gb * gb
            w, b = w - 0.5 * gw / np.sqrt(vw), b - 0.5 * gb / np.sqrt(vb)
        del x
        release()
        return pa.table({"bit": pa.array([bit], pa.int32()), "weights": pa.array([w.tobytes()], pa.binary()), "bias": [float(b)]})

    rows = picked.withColumn("bit", F.explode(F.array([F.lit(i) for i in range(code.shape[1])])))
    # A partition for each bit, so that they are fitted beside each other.
    fitted = sorted(rows.repartition(code.shape[1], "bit").groupBy("bit").applyInArrow(fit, "bit int, weights binary, bias double").collect())
    return {"languages": languages, "code": code, "weights": np.stack([np.frombuffer(r["weights"], np.float32) for r in fitted], 1), "bias": np.array([r["bias"] for r in fitted], np.float32)}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword by summed logistic loss, and a score: 0 for a tie with the second, 1 for no doubt."""
    loss = np.stack([np.logaddexp(0, -margins * word).mean(1) for word in code], 1)
    best = loss.argmin(1)
    if code.shape[0] < 2:
        return best, np.ones(len(best))
    two = np.partition(loss, 1, axis=1)
    return best, np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9), 0, 1)


RESULT = ("lang_pred", "lang_score", "lang_ambiguous")


def predict(docs: DataFrame, model: dict, text_col: str = "text", names: tuple[str, str, str] = RESULT) -> DataFrame:
    """All columns of docs with the language, its score and whether it is ambiguous; one pass, no shuffle.

    Columns of docs that have one of these names are replaced; other names can be given.
    """
    docs, results = docs.drop(*names), names
    sent, text_at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m["languages"], "und"], dtype=object)
        for batch in batches:
            data, offsets = buffers(batch.column(text_at))
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if len(names) > 1:
                for a, b in slices(offsets):
                    sure = has_letter(data, offsets[a : b + 1])
                    picked, certain = decode(features(data, offsets[a : b + 1]) @ m["weights"] + m["bias"], m["code"])
                    best[a:b], score[a:b] = np.where(sure, picked, len(names) - 1), np.where(sure, certain, 0)
            lang = pa.array(names[best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score), pc.less(pa.array(score), AMBIGUOUS)], names=[*batch.schema.names, *results])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(label), f"{fields}, `{results[0]}` string, `{results[1]}` double, `{results[2]}` boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))

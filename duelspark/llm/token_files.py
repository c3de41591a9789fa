"""Token ids in files of wavelet matrices.

Texts are encoded in the order of their ids, an end id behind each, and the ids of a partition go into shards of SHARD
tokens: one file each, a compressed wavelet matrix (Claude, Navarro and Ordonez 2015). Plane k holds bit k of all ids, from
the highest on; ids are dealt out stably by each plane's bit, zeros first. With the ones before every 512 bits in a
directory, rank and select on planes answer which id stands at a place (access), how often an id occurs before a place
(rank, and so counts), and where its k-th occurrence is (select), without decoding the shard. Decoding all of it puts the
planes' halves back together from the lowest up.

File format, numbers big-endian: magic (8 bytes), partition (4), shard of the partition (4), tokens of the partition before
it (8), tokens (8), planes (4), then sections, each its length (8) and its bytes: an Arrow stream of the documents (number
in the partition, id, tokens in this shard, is it a part only), and for each plane the number of its zeros (8), its bits and
its directory, both zstd with their lengths (8) before them; a line feed ends the file. A document may span shards.
Spark's text writer, whose committer leaves whole files of successful attempts only, writes one file a row.

The tokenizer works on the pieces between spaces and line feeds, which no token of a tokenizer that drops white space
crosses; pieces seen before come from a table of bounded size. Tokenizers of other kinds are refused.

Defined cases: a null text counts as empty and has the end id only; null ids come last; rows that share an id are ordered
by a hash of their text, and rows equal in both keep an order of their own; an empty table writes no shard and reads back
empty; other columns are ignored, whatever their names; a very long text is encoded in slices, and its ids fill shards as
they come.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, saved, scratch_path, table

TOKENIZER, END_ID = "word_bpe_49k.json", 2
SHARD = 1 << 21  # tokens of a file
SEEN, SEEN_LETTERS = 1 << 20, 64  # pieces a worker remembers, and how long they may be
SLICE = 1 << 20  # letters of texts that are encoded at once
MAGIC = b"WAVEMTX1"
_HEAD = struct.Struct(">8sIIQQI")
_TAIL = ".,;:!?"
_U64 = np.uint64
_STEP = 1 << 16  # ids dealt out at a time, so that they stay in a core's cache


# -- planes -----------------------------------------------------------------------------------------------------------


class Plane:
    """A row of bits with its directory: the ones before every 512 bits."""

    def __init__(self, packed: np.ndarray, directory: np.ndarray, zeros: int):
        self.words, self.directory, self.zeros = packed.view("<u8"), directory, zeros

    @staticmethod
    def pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.zeros(-(-len(bits) // 512) * 64 + 64, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return packed, np.append(0, np.cumsum(ones)).astype("<u4")

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=n, bitorder="little").astype(bool)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(_U64)) & _U64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word = i >> 9, i >> 6
        out = self.directory[block].astype(np.int64)
        for k in range(8):
            at = (block << 3) + k
            out += np.where(at < word, np.bitwise_count(self.words[at]), 0)
        return out + np.bitwise_count(self.words[word] & ((_U64(1) << (i & 63).astype(_U64)) - _U64(1)))

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one or zero, counted from 0; there must be one."""
        known = self.directory.astype(np.int64)
        known = known if ones else np.arange(len(known)) * 512 - known
        block = np.searchsorted(known, k, "right") - 1
        left, at = k - known[block], block << 3
        for _ in range(7):  # the word
            n = np.bitwise_count(self.words[at] if ones else ~self.words[at]).astype(np.int64)
            further = left >= n
            left, at = np.where(further, left - n, left), np.where(further, at + 1, at)
        word = self.words[at] if ones else ~self.words[at]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the half that holds it
            n = np.bitwise_count((word >> place.astype(_U64)) & ((_U64(1) << _U64(width)) - _U64(1))).astype(np.int64)
            further = left >= n
            left, place = np.where(further, left - n, left), np.where(further, place + width, place)
        return (at << 6) + place


# -- shards -----------------------------------------------------------------------------------------------------------


def _packed(data: bytes) -> bytes:
    part = bytes(pa.compress(data, codec="zstd", asbytes=True))
    return struct.pack(">QQ", len(data), len(part)) + part


def shard_bytes(ids: np.ndarray, documents: pa.RecordBatch, partition: int = 0, shard: int = 0, before: int = 0) -> bytes:
    """A shard's file."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(documents)
    known = sink.getvalue().to_pybytes()
    out = [_HEAD.pack(MAGIC, partition, shard, before, len(ids), bits), struct.pack(">Q", len(known)), known]
    for k in reversed(range(bits)):
        one = (ids & ids.dtype.type(1 << k)) != 0
        packed, directory = Plane.pack(one)
        halves = [[ids[a : a + _STEP].take(np.flatnonzero(half[a : a + _STEP]), mode="clip") for a in range(0, len(ids), _STEP)] for half in (~one, one)]
        n_zeros = sum(map(len, halves[0]))
        part = struct.pack(">Q", n_zeros) + _packed(packed.tobytes()) + _packed(directory.tobytes())
        out += [struct.pack(">Q", len(part)), part]
        ids = np.concatenate([*halves[0], *halves[1]]) if len(ids) else ids
    return b"".join([*out, b"\n"])


class Shard:
    """A shard's file, opened; planes are unpacked when they are needed."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.partition, self.number, self.before, self.n, self.bits = _HEAD.unpack_from(self.data)
        if magic != MAGIC or self.data[-1] != 10:
            raise ValueError("not a whole shard file")
        at, self._parts = _HEAD.size, []
        for _ in range(self.bits + 1):
            (size,) = struct.unpack_from(">Q", self.data, at)
            self._parts.append((at + 8, size))
            at += 8 + size
        if at != len(self.data) - 1:
            raise ValueError("a shard file is cut short or holds more than a shard")
        self._planes: dict[int, Plane] = {}

    def documents(self) -> pa.Table:
        at, size = self._parts[0]
        return pa.ipc.open_stream(self.data[at : at + size]).read_all()

    def plane(self, level: int) -> Plane:
        if level not in self._planes:
            at, _ = self._parts[1 + level]
            (zeros,), at, found = struct.unpack_from(">Q", self.data, at), at + 8, []
            for kind in (np.uint8, "<u4"):
                size, packed = struct.unpack_from(">QQ", self.data, at)
                found.append(np.frombuffer(pa.decompress(self.data[at + 16 : at + 16 + packed], size, codec="zstd"), kind))
                at += 16 + packed
            self._planes[level] = Plane(*found, zeros)
        return self._planes[level]

    def _levels(self) -> Iterator[tuple[int, Plane]]:
        for level in range(self.bits):
            yield self.bits - 1 - level, self.plane(level)

    def tokens(self) -> np.ndarray:
        """All ids, in order."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in reversed(list(self._levels())):
            one = plane.bits(self.n)
            above, zero_at, one_at = np.empty_like(out), 0, plane.zeros
            out[plane.zeros :] |= out.dtype.type(1 << k)
            for a in range(0, self.n, _STEP):
                part = one[a : a + _STEP]
                ones, zeros = np.flatnonzero(part), np.flatnonzero(~part)
                block = above[a : a + _STEP]
                block[zeros], block[ones] = out[zero_at : zero_at + len(zeros)], out[one_at : one_at + len(ones)]
                zero_at, one_at = zero_at + len(zeros), one_at + len(ones)
            out = above
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for k, plane in self._levels():
            one, rank = plane.at(at), plane.rank(at)
            at = np.where(one, plane.zeros + rank, at - rank)
            out |= one.astype(np.int64) << k
        return out

    def _begin(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, place behind the last) of an id's occurrences in the last plane's order, each as one number."""
        ends = np.array([0, self.n])
        for k, plane in self._levels():
            rank = plane.rank(ends)
            ends = plane.zeros + rank if symbol >> k & 1 else ends - rank
        return ends[:1], ends[1:]

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often an id occurs before each place."""
        at, low = np.asarray(places, np.int64), np.zeros(1, np.int64)
        if symbol < 0 or symbol >> self.bits:
            return np.zeros(len(at), np.int64)
        for k, plane in self._levels():
            one = symbol >> k & 1
            at, low = (plane.zeros + plane.rank(x) if one else x - plane.rank(x) for x in (at, low))
        return at - low

    def count(self, symbol: int) -> int:
        return int(self.rank(symbol, np.array([self.n]))[0])

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """The places of an id's k-th occurrences, from 0; there must be as many."""
        at = self._begin(symbol)[0] + np.asarray(k, np.int64)
        for bit, plane in reversed(list(self._levels())):
            one = bool(symbol >> bit & 1)
            at = plane.select(at - plane.zeros if one else at, one)
        return at


# -- encoding ---------------------------------------------------------------------------------------------------------


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts that tokenizers of this kind encode like the pieces between their spaces and line feeds.
_PROBES = ("a b", " a", "a ", "a\nb", "a  b", "a \n b", ". a", "1 1", "a's 's", "\n")


#: Runs that no token of a byte-level tokenizer of this kind crosses, once letters are small.
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+", re.ASCII)
#: ASCII and letters below U+0100; < may begin a special token, whose case counts.
_PLAIN = re.compile(r"[^<\x80-\xbf\xd7\xf7\u0100-\U0010ffff]+")
#: Words whose ids its model gives by their bytes' characters.
_MIXED = ("don't", "'s'", "a''ll.", "x2y34", "(U.S.A.)", "'re-'VE|_", "\x1c\x00a", "...\x0b", "L'ÉTÉ,à")
_WORDS = ("hello", "x", "straße", "été", "àâæçèéêëîïñôöùûüÿ", "µªº", "honorificabilitudinitatibus")


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a visible byte as its character, the others as characters from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


_BYTES = _byte_characters()


class Encoder(dict):
    """The ids of pieces without spaces and line feeds, as bytes of little-endian numbers; the library makes them.

    Two generations of pieces are remembered: when the young one, the dictionary itself, is full, it becomes the old one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.old: dict[str, bytes] = {}
        for probe in _PROBES:
            if self.whole(probe) != b"".join(self.whole(x) for x in probe.replace("\n", " ").split(" ")):
                raise ValueError("only tokenizers that drop white space encode piece by piece")
        self.by_bytes = all(self.whole(w) == self._word(w) for w in _WORDS) and all(self.whole(w) == b"".join(map(self._word, _RUNS.findall(w.lower()))) for w in _MIXED)

    def whole(self, piece: str) -> bytes:
        return array(self.code, self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Of a lower-case run that no step of the tokenizer but its model changes or cuts."""
        mapped = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self._made(piece)
        if len(piece) <= SEEN_LETTERS:
            if len(self) >= SEEN // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _made(self, piece: str) -> bytes:
        if not self.by_bytes or not _PLAIN.fullmatch(piece):
            return self.whole(piece)
        runs = _RUNS.findall(piece.lower())
        return self._word(piece) if runs == [piece] else b"".join([self[r] for r in runs])

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def parts(self, column: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool]]:
        """(ids, first text, how many ids of it and of those that follow, is the last text whole), about SLICE letters at a time.

        An end id comes behind each text. A long text is cut before spaces.
        """
        end, size = array(self.code, [end_id]).tobytes(), self.kind.itemsize
        held, first, letters = [], 0, 0

        def out(whole: bool) -> tuple[np.ndarray, int, np.ndarray, bool]:
            return np.frombuffer(b"".join(held), self.kind), first, np.array([len(h) for h in held]) // size, whole

        for i, value in enumerate(column):
            text, at = value.as_py() or "", 0
            if held and letters + len(text) > SLICE:
                yield out(True)
                held, first, letters = [], i, 0
            while len(text) - at > 2 * SLICE and (cut := text.find(" ", at + SLICE)) >= 0:
                held = [self.text(text[at:cut])]
                yield out(False)
                held, at = [], cut
            held.append(self.text(text[at:] if at else text) + end)
            letters += len(text) - at
        if held:
            yield out(True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- files ------------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD) -> None:
    """Writes the ids of all texts, by ascending id, to shard files under path."""
    tokenizer = tokenizer or tokenizer_file()
    bounded_batches(docs.sparkSession, 4 << 20)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, partition = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        entries: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        n = before = shard = number = 0
        open_text = -1  # the text that the shard before left unfinished

        def flushed(whole: bool) -> pa.RecordBatch:
            nonlocal open_text
            numbers, sizes = (np.concatenate([e[k] for e in entries]) for k in (0, 2))
            first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))  # a long text comes in slices
            part = (numbers[first] == open_text) | ((numbers[first] == numbers[-1]) & (not whole))
            open_text = -1 if whole else int(numbers[-1])
            ids = pa.concat_arrays([e[1] for e in entries]).take(pa.array(first))
            known = pa.RecordBatch.from_arrays([pa.array(numbers[first], pa.int64()), ids, pa.array(np.add.reduceat(sizes, first), pa.int64()), pa.array(part)], names=["number", "id", "n", "part"])
            data = shard_bytes(np.concatenate(held), known, partition, shard, before)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])  # the writer adds the line feed

        for batch in batches:
            for ids, first, counts, whole in own.parts(batch.column(1), end_id):
                ends, at = np.cumsum(counts), 0
                while at < len(ids):
                    upto = min(len(ids), at + shard_tokens - n)
                    lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(ends, upto, "left") + 1
                    sizes = np.minimum(ends[lo:hi], upto) - np.maximum(ends[lo:hi] - counts[lo:hi], at)
                    entries.append((number + first + np.arange(lo, hi), batch.column(0).slice(first + lo, hi - lo), sizes))
                    held.append(ids[at:upto])
                    n, at = n + upto - at, upto
                    if n == shard_tokens:
                        yield flushed(bool(ends[hi - 1] == upto and (whole or hi < len(ends))))
                        before, shard, n = before + n, shard + 1, 0
                        held.clear()
                        entries.clear()
            number += batch.num_rows
        if entries:
            yield flushed(True)

    blobs = rows.mapInArrow(lean(encode), "value binary")
    blobs.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark, 4 << 20)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for content in batch.column(0):
            yield Shard(content.as_buffer())


def partition_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each partition's, from the files' heads; there are as many as the writer had tasks."""
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    sizes = _files(spark, path).groupBy(number(9, 4).alias("partition")).agg(F.sum(number(25, 8)).alias("n"))
    return _starts(sizes.collect())


def _starts(sizes: list) -> dict[int, int]:
    starts, total = {}, 0
    for partition, n in sorted(map(tuple, sizes)):
        starts[partition] = total
        total += n
    return starts


# -- reading ----------------------------------------------------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, the highest bit standing for x to the 0."""
    out = 0
    for k in range(32):
        if a >> (31 - k) & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two stretches of bytes from theirs, the second `length` bytes long."""
    power, step = 1 << 31, 1 << 23  # x to the 0, x to the 8
    while length:
        if length & 1:
            power = _times(power, step)
        step, length = _times(step, step), length >> 1
    return _times(first, power) ^ second


def read_documents(spark: SparkSession, path: str, id_type: str = "long", ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the files under path, decoded from their planes.

    start counts the ids of all documents before it; ids_crc32 is that of the ids as little-endian 32-bit numbers. With
    ids, a column of them too, whole for each document.
    """
    fields = "partition int, number long, id {}, start long, n long, crc long, part boolean" + (", ids array<int>" if ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            known, tokens = shard.documents().combine_chunks(), shard.tokens().astype("<u4")
            n = known["n"].to_numpy()
            ends = np.cumsum(n)
            data = memoryview(tokens).cast("B")
            crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(np.full(len(n), shard.partition, np.int32)), known["number"], known["id"], pa.array(shard.before + ends - n), known["n"], pa.array(crc, pa.int64()), known["part"]]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(tokens.astype(np.int32))))
            table = pa.table(columns, names=["partition", "number", "id", "start", "n", "crc", "part", *["ids"] * ids])
            yield from table.to_batches(max_chunksize=1 << 16)

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("start")
        crc = 0
        for value, n in zip(parts["crc"].tolist(), parts["n"].tolist(), strict=True):
            crc = crc32_joined(crc, value, 4 * n)
        out = parts.iloc[:1].assign(n=parts["n"].sum(), crc=crc)
        return out.assign(ids=[np.concatenate(parts["ids"].tolist())]) if ids else out

    rows = saved(_files(spark, path).mapInArrow(lean(read), fields.format(id_type)), "token-documents")
    starts = list(_starts(rows.groupBy("partition").agg(F.sum("n")).collect()).items())
    # a document over several shards has few rows; all others are whole
    whole = rows.where("not part").unionByName(rows.where("part").groupBy("partition", "number").applyInPandas(join, rows.schema))
    base = spark.createDataFrame(starts, "partition int, base long")  # a row for each task of the writer
    out = whole.join(F.broadcast(base), "partition")
    return out.select(F.col("id"), (F.col("base") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), *["ids"] * ids)


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token) of a stated list of places among all ids, by access in their shards."""
    starts, wanted = partition_starts(spark, path), np.unique(np.array(places, np.int64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            first = starts[shard.partition] + shard.before
            own = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + shard.n)]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(shard.access(own - first))], names=["place", "token"])

    return _files(spark, path).mapInArrow(lean(look), "place long, token long")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n) of a stated list of ids, by rank at the end of each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _files(spark, path).mapInArrow(lean(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int], id_type: str = "long") -> DataFrame:
    """(token, place, id) of every occurrence of a stated list of ids, by select; place counts all ids, as start does."""
    starts = partition_starts(spark, path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            known = shard.documents()
            ends = np.cumsum(known["n"].to_numpy())
            for token in tokens:
                for at in range(0, shard.count(token), 1 << 16):
                    places = shard.select(token, np.arange(at, min(at + (1 << 16), shard.count(token))))
                    names = known["id"].take(pa.array(np.searchsorted(ends, places, "right"))).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), token, np.int64)), pa.array(starts[shard.partition] + shard.before + places), names], names=["token", "place", "id"])

    return _files(spark, path).mapInArrow(lean(find), f"token long, place long, id {id_type}")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path).withColumnRenamed("id", "doc_id")

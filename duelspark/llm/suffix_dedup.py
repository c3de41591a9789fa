"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts earlier (in a smaller document, or earlier in the
same one). Every place where such a string starts is compared with the others by Burrows-Wheeler transforms: shards of
text are suffix-sorted on their own, and their transforms are merged by iterative interleave refinement (Holt and McMillan
2014). One refinement reads all transforms once, in the current interleave, and deals the entries out by their symbol;
after d of them the interleave is that of the suffixes' first d symbols. The refinement at which two neighbours first
differ is their common prefix, and blocks that are whole after `length` refinements are the repeated intervals. Suffixes
of different shards are never sorted together.

What has to meet in one merge is found first, without loss. Every string of `length` bytes has a minimiser, its k-gram
with the smallest hash; equal strings have equal ones. A run of starts with one minimiser, the fragment, is named by its
minimiser and a hash of its bytes:

1. tasks drop fragments that repeat inside them (all their starts are repeats) and deal the others out by minimiser;
2. fragments equal in minimiser and bytes are repeats but for the first; a minimiser with one distinct fragment is done;
3. only the distinct fragments of the others, the borders of repeated passages, go into shards and merges. A minimiser
   with very many of them is first divided by the hash of each string, so that no merge holds an unbounded group.

Defined cases: null counts as the empty text; texts shorter than `length` keep all bytes; rows that repeat an id, null ids
(last) and ids that aren't integers are put into an order of id and text hash first; an empty table gives an empty result;
other columns are ignored or carried; a very long text is scanned in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _powers, bounded_batches, buffers, CHUNK, lean, mix, pieces, saved, table

LENGTH = 100
PART_BYTES = 16 << 20  # text bytes whose fragments one task compares
TASK_BYTES = 2 << 20  # fragment bytes that one task merges
MERGE_BYTES = 96 << 10  # fragment bytes of one merge: small enough for a core's cache
SHARD_BYTES = 32 << 10
FLUSH_BYTES = 48 << 20  # text bytes of which a task combines fragments before it sends them
HOT = 1 << 15  # distinct fragments of one minimiser (some megabytes) beyond which its strings are dealt out one by one

_VALUES = np.random.default_rng(91).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_AT = np.uint64(CHUNK.bit_length())
RECORD = np.dtype([("anchor", "<u8"), ("bytes", "<u8"), ("id", "<i8"), ("start", "<u4"), ("n", "<u4")])
SPAN = np.dtype([("id", "<i8"), ("start", "<u4"), ("end", "<u4")])


def _gram(length: int) -> int:
    return max(1, min(32, length // 3))


def fragments(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, minimiser, hash of the bytes) of the fragments of texts that end at `ends`."""
    n, k = len(raw), _gram(length)
    width = length - k + 1
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    code = (grams >> _AT << _AT) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(code) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(code)] = code
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(backward[:starts], forward[width - 1 : width - 1 + starts]) & np.uint64((1 << int(_AT)) - 1)).astype(np.int64)
    bounds = np.concatenate([[0], ends])
    good = np.arange(starts) + length <= np.repeat(ends, np.diff(bounds))[:starts]
    at = np.flatnonzero(good)
    if not len(at):
        return none
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)]))
    first, count = at[new], np.diff(np.append(new, len(at)))
    name = mix((sums[first + count - 1 + length] - sums[first]) * down[first] + count.astype(np.uint64))
    return first, count, grams[anchor[new]], name


def batch_records(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The fragments of texts as records."""
    for lo, hi in pieces(offsets, CHUNK - 1):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo == 1 and end - begin >= CHUNK:
            step = CHUNK - length  # segments overlap by length - 1 bytes: every start is in one of them
            parts = [(begin + s, min(end, begin + s + CHUNK - 1)) for s in range(0, end - begin - length + 1, step)]
        else:
            parts = [(begin, end)]
        for a, b in parts:
            ends = np.array([b - a]) if len(parts) > 1 else offsets[lo + 1 : hi + 1] - begin
            first, count, anchor, name = fragments(data[a:b], ends, length)
            out = np.zeros(len(first), RECORD)
            text = np.zeros(len(first), np.int64) if len(parts) > 1 else np.searchsorted(ends, first, "right")
            base = offsets[lo + text]
            out["anchor"], out["bytes"], out["id"], out["n"] = anchor, name, ids[lo + text], count
            out["start"] = first + a - base
            yield out


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Spans sorted by id and start, with those that meet put together."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["id"]))]
    new_id = np.concatenate([[True], spans["id"][1:] != spans["id"][:-1]])
    group = np.cumsum(new_id)
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + (group << 33)) - (group << 33)
    new = new_id.copy()
    new[1:] |= spans["start"][1:] > reach[:-1]
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["end"] = reach[np.append(at[1:], len(spans)) - 1]
    return out


def _later(records: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each distinct fragment, sorted by minimiser; the spans of all others)."""
    records = records[np.lexsort((records["start"], records["id"], records["bytes"], records["anchor"]))]
    again = np.zeros(len(records), bool)
    again[1:] = (records["anchor"][1:] == records["anchor"][:-1]) & (records["bytes"][1:] == records["bytes"][:-1])
    return records[~again], _spans(records[again], length)


def _spans(records: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(records), SPAN)
    out["id"], out["start"], out["end"] = records["id"], records["start"], records["start"] + records["n"] + (length - 1)
    return merged_spans(out)


def _lists(values: np.ndarray, names: list[str]) -> tuple[pa.Array, pa.Array]:
    """(ids, list of structs of each id) of records sorted by id."""
    at = np.flatnonzero(np.concatenate([[True], values["id"][1:] != values["id"][:-1]])) if len(values) else np.zeros(0, np.int64)
    structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[n]).astype(np.int64) if n != "anchor" else np.ascontiguousarray(values[n]).view(np.int64)) for n in names], names)
    return pa.array(values["id"][at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), structs)


# -- merging Burrows-Wheeler transforms -------------------------------------------------------------------------------


def shard_transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array by the first `depth` symbols, the transform, the transform by pairs) of a shard; 0 ends its strings.

    A pair is the two symbols before a suffix, the nearer one in the low byte.
    """
    n = len(symbols)
    key = symbols.astype(np.uint64)
    padded = np.concatenate([key, np.zeros(8, np.uint64)])
    packed = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for k in range(8):  # eight symbols to a number; what follows an end counts as ends
        value = np.where(alive, padded[k : k + n], np.uint64(0))
        alive &= value > 0
        packed = (packed << np.uint64(8)) | value
    order = np.argsort(packed, kind="stable")
    seen = 8
    rank = np.zeros(n + 1, np.int64)
    sorted_ = packed[order]
    rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
    open_ = np.concatenate([alive, [False]])  # suffixes without an end so far
    while seen < depth:
        ahead = np.minimum(np.arange(n) + seen, n)
        pair = rank[:n] * (n + 2) + np.where(open_[:n], rank[ahead], 0)
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        open_[:n] &= open_[ahead]
        rank[order] = np.cumsum(np.concatenate([[1], sorted_[1:] != sorted_[:-1]]))
        seen *= 2
    near, far = symbols[order - 1], symbols[order - 2]  # before the first symbol stands the last one, an end
    return order, near, (far.astype(np.uint16) << np.uint16(8)) | near


def merge_transforms(transforms: list[np.ndarray], pairs: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave: which transform each merged entry comes from; the common prefix of each entry and the one before).

    A refinement by pairs of symbols does the work of two; an odd depth begins with a single one. Two neighbours share the
    symbols of all refinements before the one that parts them, so a prefix is known to two symbols, up to `depth`.
    """
    total = sum(map(len, transforms))
    lanes = np.uint8 if len(transforms) < 256 else np.uint16
    interleave = np.repeat(np.arange(len(transforms), dtype=lanes), [len(t) for t in transforms])
    single, double = np.concatenate(transforms), np.concatenate(pairs)
    new = np.zeros(total, bool)
    new[:1] = True
    block = np.zeros(total, np.int32)
    prefix, seen = np.full(total, depth, np.int16), 0
    for step in [single] * (depth % 2) + [double] * (depth // 2):
        current = np.empty(total, step.dtype)
        current[np.argsort(interleave, kind="stable")] = step  # every transform's entries, in its own order
        deal = np.argsort(current, kind="stable")
        interleave, dealt, before = interleave[deal], current[deal], block[deal]
        new[1:] = dealt[1:] != dealt[:-1]
        new[1:] |= before[1:] != before[:-1]
        ended = (dealt & 255) == 0 if step is single else ((dealt & 255) == 0) | (dealt < 256)
        new |= ended
        new[:1] = True
        prefix[new & (prefix == depth)] = seen  # a border once drawn stays
        seen += 1 if step is single else 2
        block = np.cumsum(new, dtype=np.int32)
    return interleave, prefix


def repeats(strings: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """The spans of all strings of `length` bytes in the fragments that also start earlier among them."""
    transforms, pairs, texts, places, held, size = [], [], [], [], [], 0
    for i, text in enumerate(strings):
        held.append(i)
        size += len(text) + 1
        if size >= shard_bytes or i == len(strings) - 1:
            shard = np.zeros(size, np.uint8)  # bytes plus one: UTF-8 has no byte 255
            owner, place = np.zeros(size, np.int64), np.zeros(size, np.int64)
            at = 0
            for j in held:
                n = len(strings[j])
                shard[at : at + n] = np.frombuffer(strings[j], np.uint8)
                shard[at : at + n] += 1
                owner[at : at + n + 1], place[at : at + n + 1] = j, np.arange(n + 1)
                at += n + 1
            order, transform, double = shard_transform(shard, length)
            transforms.append(transform)
            pairs.append(double)
            texts.append(owner[order])
            places.append(place[order])
            held, size = [], 0
    if not transforms:
        return np.zeros(0, SPAN)
    interleave, prefix = merge_transforms(transforms, pairs, length)
    heads = np.flatnonzero(prefix < length)  # a repeated interval goes on where the common prefix has the whole length
    counts = np.diff(np.append(heads, len(interleave)))
    many = np.repeat(counts > 1, counts)
    lane = np.argsort(interleave, kind="stable")
    owner, place = np.empty(len(lane), np.int64), np.empty(len(lane), np.int64)
    owner[lane], place[lane] = np.concatenate(texts), np.concatenate(places)
    block = np.repeat(np.arange(len(heads)), counts)[many]
    owner, place = owner[many], place[many]
    doc, start = ids[owner], starts[owner] + place
    order = np.lexsort((start, doc, block))
    first = np.concatenate([[True], block[order][1:] != block[order][:-1]]) if len(order) else np.zeros(0, bool)
    # One place may be in two fragments of a long text's segments: it isn't its own repeat.
    same = np.zeros(len(order), bool)
    same[1:] = ~first[1:] & (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1])
    out = np.zeros(int((~first & ~same).sum()), SPAN)
    out["id"], out["start"] = doc[order][~first & ~same], start[order][~first & ~same]
    out["end"] = out["start"] + length
    return merged_spans(out)


# -- the Spark job ----------------------------------------------------------------------------------------------------


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(num, id, text): num orders the documents. It is the id itself where ids are distinct integers, which is usual."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        n, some, different = rows.agg(F.count(F.lit(1)), F.count("id"), F.countDistinct("id")).first()
        if n == some == different:
            return rows.select(F.col("id").cast("long").alias("num"), "id", "text"), True
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    return saved(ordered.select(F.monotonically_increasing_id().alias("num"), "id", "text"), "numbered"), False


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(num, spans) of the documents (num, text) that lose bytes; spans may still overlap."""
    spark = rows.sparkSession
    bounded_batches(spark)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // PART_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            fresh, spans = _later(np.concatenate(held), length)
            held.clear()
            here, there = (fresh["anchor"] % np.uint64(4 * parts)).astype(np.int64), spans["id"] % (4 * parts)
            order, other = np.argsort(here, kind="stable"), np.argsort(there, kind="stable")
            fresh, spans = fresh[order], spans[other]
            buckets = np.unique(np.concatenate([here, there]))
            a, b = np.searchsorted(here[order], buckets), np.searchsorted(here[order], buckets, "right")
            c, d = np.searchsorted(there[other], buckets), np.searchsorted(there[other], buckets, "right")
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([fresh[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()), pa.array([spans[x:y].tobytes() for x, y in zip(c, d, strict=True)], pa.binary())], names=["bucket", "records", "spans"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held.extend(batch_records(ids, data, offsets, length))
            size += int(offsets[-1] - offsets[0])
            if size > FLUSH_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, spans = [], []
        for batch in batches:
            records += [np.frombuffer(x, RECORD) for x in batch.column(1).to_pylist() if x]
            spans += [np.frombuffer(x, SPAN) for x in batch.column(2).to_pylist() if x]
        fresh, more = _later(np.concatenate([np.zeros(0, RECORD), *records]), length)
        spans = merged_spans(np.concatenate([np.zeros(0, SPAN), *spans, more]))
        heads = np.flatnonzero(np.concatenate([[True], fresh["anchor"][1:] != fresh["anchor"][:-1]])) if len(fresh) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(fresh)))
        crowd = np.repeat(counts, counts)
        wants = fresh[crowd > 1]
        wants["bytes"] = crowd[crowd > 1]
        wants = wants[np.argsort(wants["id"], kind="stable")]
        ids, lists = _lists(spans, ["start", "end"])
        yield pa.RecordBatch.from_arrays([ids, lists, pa.nulls(len(ids), _WANTS)], names=["num", "spans", "wants"])
        ids, lists = _lists(wants, ["anchor", "start", "n", "bytes"])
        yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), _SPANS), lists.cast(_WANTS)], names=["num", "spans", "wants"])

    dealt = rows.select("num", "text").mapInArrow(lean(deal), "bucket int, records binary, spans binary").repartition(parts, "bucket")
    found = saved(dealt.mapInArrow(lean(compare), "num long, spans array<struct<start: long, end: long>>, wants array<struct<anchor: long, start: long, n: long, bytes: long>>"), "fragments")

    wants = found.where("wants is not null").groupBy("num").agg(F.flatten(F.collect_list("wants")).alias("wants"))
    wanted = found.where("wants is not null").select(F.explode("wants").alias("w")).agg(F.sum(F.col("w.n") + length).alias("n")).first()["n"] or 0
    merges = max(1, -(-wanted // TASK_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the wanted fragments; of a crowded minimiser each string by its own hash, once a batch."""
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            out: list[tuple[int, int, int, bytes]] = []
            seen: dict[bytes, tuple[int, int, int]] = {}
            for i, (num, wants) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for w in wants:
                    piece = text[w["start"] : w["start"] + w["n"] + length - 1]
                    if w["bytes"] <= HOT:
                        out.append((w["anchor"], num, w["start"], piece))
                        continue
                    for k in range(w["n"]):
                        one = piece[k : k + length]
                        key = hashlib.blake2b(one, digest_size=8, key=w["anchor"].to_bytes(8, "little", signed=True)).digest()
                        place = (int.from_bytes(key, "little", signed=True), num, w["start"] + k)
                        if one not in seen:
                            seen[one] = place
                        elif place[1:] < seen[one][1:]:
                            out.append((*seen[one], one))
                            seen[one] = place
                        else:
                            out.append((*place, one))
                if len(out) > 50_000 or len(seen) > 100_000:
                    yield batch_of(out, seen)
            if out or seen:
                yield batch_of(out, seen)

    def batch_of(out: list, seen: dict) -> pa.RecordBatch:
        out.extend((*place, one) for one, place in seen.items())
        columns = list(zip(*out, strict=True))
        out.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["anchor", "num", "start", "piece"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, nums, starts, strings = [], [], [], []
        for batch in batches:
            anchors.append(batch.column(0).to_numpy())
            nums.append(batch.column(1).to_numpy())
            starts.append(batch.column(2).to_numpy())
            strings += batch.column(3).to_pylist()
        if not strings:
            return
        anchor, num, start = map(np.concatenate, (anchors, nums, starts))
        order = np.argsort(anchor, kind="stable")  # a minimiser's fragments stand together, a merge takes whole ones
        size = np.cumsum([len(strings[i]) for i in order])
        head = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        cuts, last = [0], 0
        for h in head[1:]:
            if size[h - 1] - last > MERGE_BYTES:
                cuts.append(int(h))
                last = size[h - 1]
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            pick = order[a:b]
            ids, lists = _lists(repeats([strings[i] for i in pick], num[pick], start[pick], length), ["start", "end"])
            yield pa.RecordBatch.from_arrays([ids, lists], names=["num", "spans"])

    texts = rows.join(wants, "num").select("num", "text", "wants")
    borders = texts.mapInArrow(lean(cut), "anchor long, num long, start long, piece binary").repartition(merges, "anchor")
    merged = borders.mapInArrow(lean(merge), "num long, spans array<struct<start: long, end: long>>")
    spans = found.where("spans is not null").select("num", "spans").unionByName(merged)
    return spans.groupBy("num").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WANTS = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64())]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a document: (id, n_bytes, n_removed, n_spans, kept_sha256, kept: the remaining bytes, spans: what went)."""
    rows, _ = numbered(docs, id_col, text_col)
    spans = saved(repeated_spans(rows, length), "repeats")
    id_type = docs.schema[id_col].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            removed, n_spans, digests, kept, gone = [], [], [], [], []
            for i, lost in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                whole = np.array([(0, s["start"], s["end"]) for s in lost or ()], SPAN)
                whole = merged_spans(whole)
                at, left = 0, []
                for s, e in zip(whole["start"].tolist(), whole["end"].tolist(), strict=True):
                    left.append(text[at:s])
                    at = e
                left.append(text[at:])
                rest = b"".join(left)
                removed.append(len(text) - len(rest))
                n_spans.append(len(whole))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
                gone.append([{"start": s, "end": e} for s, e in zip(whole["start"].tolist(), whole["end"].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), pa.array(gone, _SPANS)], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    joined = rows.join(spans, "num", "left").select("id", "text", "spans")
    return joined.mapInArrow(lean(keep), f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

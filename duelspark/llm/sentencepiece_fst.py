"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into parts that are composed with each input. The normaliser rewrites a space to the piece mark
and starts a text with one; its states are the start, after a mark and inside a word. The piece acceptor is a trie of all
pieces, in a hash table of (state, symbol) transitions; where a piece ends, its arc carries id and weight. Byte fallback
gives any symbol that no piece begins or continues with the path of its UTF-8 byte pieces.

An encoding is the shortest path of the composition in the tropical semiring, where weights add along a path and the
smallest wins. It is found by relaxing all arcs in the order of their places, for many inputs at once.

Unigram models weigh a piece by the negative of its score, and an unknown symbol more than any piece. In BPE models the
scores only order the merges. Their composition has the last piece as part of its state and an arc weighs its piece's
merge rank, unless merging wouldn't leave the last piece and this one side by side in their joint text: then it weighs
infinitely, the semiring's zero. Of all paths to a place exactly one has a finite weight, the BPE encoding of the text so
far. The relation of pieces is worked out when a pair is first met, and PAIRS of them are kept.

Texts are cut before a piece mark that follows another symbol, where no piece of the model reaches across (checked when
the model is compiled; other models are composed whole), and very long words between symbols that no piece has side by
side. No path crosses such a cut, so equal cuts of a slice of texts are composed once.

Defined cases: null encodes to null and decodes to null; the empty text has no ids; any text is encoded whole, whatever
its length; an empty table gives an empty result; rows that repeat are each encoded; other columns are carried along, and
one that has the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, free_name, lean, pieces, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE = 2 << 20  # text bytes that are encoded together
SYMBOLS = 1 << 18  # symbols that are composed at once; a longer cut is composed alone
LONG = 64  # symbols of a word beyond which it is cut further
PAIRS = (1 << 19) - 1  # pairs of pieces a worker keeps, in a table of 13 MB
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif key & 7 == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (sizes[i] of them), for all i end to end."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Transitions:
    """A hash table of transitions: (state, symbol) to a number, -1 where there is none. Room is for so many at least."""

    def __init__(self, room: int):
        self.mask, self.held = (1 << max(4, int(2 * room).bit_length())) - 1, 0
        self.keys, self.targets = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)

    def add(self, states: np.ndarray, symbols: np.ndarray, targets: np.ndarray) -> None:
        """Put in new transitions, each once."""
        keys = self._key(states, symbols)
        self.held += len(keys)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.targets[at[placed]] = keys[placed], targets[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def _key(states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        return (states.astype(np.int64) << 21) | symbols.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = self._key(states, symbols)
        out, at, live = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        while len(live):
            have = self.keys[at]
            hit = have == keys[live]
            out[live[hit]] = self.targets[at[hit]]
            on = ~hit & (have >= 0)
            live, at = live[on], (at[on] + 1) & self.mask
        return out


class Transducer:
    """The compiled normaliser, piece acceptor and byte fallback of one model file."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.dummy, self.squeeze, charsmap, self.fallback = UNIGRAM, True, True, b"", False
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy, self.squeeze, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisers and unigram or BPE models are compiled")
        if any(t == USER_DEFINED for t in self.types):
            raise ValueError("models with user-defined symbols are not compiled")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array(list(map(len, self.raw)))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.is_byte = np.array([t == BYTE for t in self.types])
        self.compile({p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL})

    def compile(self, ids: dict[str, int]) -> None:
        """The acceptor of these pieces, with arc weights by self.kind and self.scores."""
        self.ids = ids
        letters = sorted({c for p in ids for c in p})
        # Names of arcs: all pieces, then letters that aren't pieces themselves, then any symbol that no piece has.
        bare = [c for c in letters if c not in ids]
        self.names = [*self.pieces, *bare, ""]
        self.outside, self.start = len(self.names) - 1, len(self.names)
        low = min(self.scores, default=0.0)
        self.weight = np.array([*[-x for x in self.scores], *[10.0 - low] * (len(bare) + 1)])
        states, symbols, targets, final, at = [], [], [], [-1], {"": 0}
        for piece, i in ids.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in at:
                    at[piece[:k]] = len(final)
                    final.append(-1)
                    states.append(at[piece[: k - 1]])
                    symbols.append(ord(piece[k - 1]))
                    targets.append(at[piece[:k]])
            final[at[piece]] = i
        self.transitions = Transitions(len(states))
        self.transitions.add(np.array(states, np.int64), np.array(symbols, np.int64), np.array(targets, np.int64))
        self.final = np.array(final)
        self.longest = max(map(len, ids), default=0)
        self.bare = (np.array([ord(c) for c in bare], np.int64), np.arange(len(self.pieces), self.outside))
        self.cuttable = not any(x != MARK and y == MARK for p in ids for x, y in zip(p, p[1:], strict=False))
        self.joined = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        # What merging needs: each name's letters, and which names join to which piece.
        number = ids | {c: len(self.pieces) + k for k, c in enumerate(bare)}
        spelt = [[number[c] for c in name] if name in number else [] for name in self.names]
        self.spelt = np.array([*map(len, spelt), 0])
        self.spelling = np.cumsum(self.spelt) - self.spelt
        self.letters = np.array([c for name in spelt for c in name], np.int64)
        joins = np.array([(number[p[:k]], number[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number], np.int64).reshape(-1, 3)
        self.joins = Transitions(len(joins))
        self.joins.add(*joins.T)
        self.score = np.array(self.scores)
        self.pairs = Transitions(PAIRS)

    def _raw(self, i: int) -> bytes:
        """What a piece decodes to."""
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.types[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    # -- composition

    def _fallback(self, c: str) -> list[int]:
        """The byte path of a symbol that is no piece, or the unknown piece."""
        if self.fallback and self.bytes:
            return [self.bytes[b] for b in c.encode("utf-8")]
        return [self.unknown]

    def _stand(self, last: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Whether merging keeps two names apart, and whole, in their joint text; after the start, the second one whole.

        Merging joins the best-scored adjacent pair first, the leftmost of equals.
        """
        n = np.where(last == self.start, 0, self.spelt[last]), self.spelt[name]
        width = int((n[0] + n[1]).max())
        parts, row = np.full((len(name), width + 1), -1, np.int64), np.arange(len(name))
        for which, size, shift in ((last, n[0], n[0] * 0), (name, n[1], n[0])):
            at = np.repeat(row, size)
            parts[at, ragged(shift, size)] = self.letters[ragged(self.spelling[which], size)]
        open_ = row
        while len(open_):
            have = parts[open_]
            joined = np.where(have[:, 1:] >= 0, self.joins.step(have[:, :-1].ravel(), np.maximum(have[:, 1:], 0).ravel()).reshape(len(open_), -1), -1)
            score = np.where(joined >= 0, self.score[joined], -np.inf)
            best = score.argmax(1)
            some = np.isfinite(score[np.arange(len(open_)), best])
            open_, have, best, joined = open_[some], have[some], best[some], joined[some]
            have[np.arange(len(open_)), best] = joined[np.arange(len(open_)), best]
            place = np.arange(width + 1)
            parts[open_] = np.take_along_axis(have, np.minimum(place + (place > best[:, None]), width), 1)
        first = last == self.start
        return np.where(first, (parts[:, 0] == name) & (parts[:, 1] < 0), (parts[:, 0] == last) & (parts[:, min(1, width)] == name) & (parts[:, min(2, width)] < 0))

    def admitted(self, last: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Whether a name may follow another one."""
        out = np.ones(len(last), bool)
        if self.kind != BPE:
            return out
        asked = np.flatnonzero((name != self.outside) & (last != self.outside) | (last == self.outside) & (name != self.outside))
        last, name = np.where(last == self.outside, self.start, last)[asked], name[asked]
        known = self.pairs.step(last, name)
        new = np.flatnonzero(known < 0)
        if len(new):
            pairs = np.unique(last[new].astype(np.int64) * (self.start + 1) + name[new])
            if self.pairs.held + len(pairs) > PAIRS:
                self.pairs = Transitions(PAIRS)
            for lo in range(0, len(pairs), 1 << 14):
                a, b = np.divmod(pairs[lo : lo + (1 << 14)], self.start + 1)
                self.pairs.add(a, b, self._stand(a, b))
            known[new] = self.pairs.step(last[new], name[new])
        out[asked] = known > 0
        return out

    def arcs(self, symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, name) of all arcs of symbols, of which left[i] remain in their input from place i on."""
        place, state, out = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), []
        single = np.zeros(len(symbols), bool)
        for n in range(1, self.longest + 1):
            on = left[place] >= n
            place, state = place[on], state[on]
            state = self.transitions.step(state, symbols[place + n - 1])
            place, state = place[state >= 0], state[state >= 0]
            if not len(place):
                break
            name = self.final[state]
            ends = name >= 0
            out.append((place[ends], np.full(int(ends.sum()), n), name[ends]))
            if n == 1:
                single[place[ends]] = True
        lone = np.flatnonzero(~single)
        name = np.full(len(lone), self.outside)
        if len(self.bare[0]):
            at = np.minimum(np.searchsorted(self.bare[0], symbols[lone]), len(self.bare[0]) - 1)
            name = np.where(self.bare[0][at] == symbols[lone], self.bare[1][at], name)
        out.append((lone, np.ones(len(lone), np.int64), name))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def shortest(self, inputs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each input): the shortest paths of the inputs' compositions."""
        size = np.array(list(map(len, inputs)), np.int64)
        symbols = np.frombuffer("".join(inputs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(symbols)) - begin[owner]
        place, length, name = self.arcs(symbols, size[owner] - inside)
        # A state for each place of an input and its end; it holds its last arc, since one path to a place has a finite weight.
        state = place + owner[place]
        order = np.argsort(inside[place], kind="stable")
        state, length, name = state[order], length[order], name[order]
        rounds = np.bincount(inside[place])
        upto = np.cumsum(rounds)
        distance = np.full(len(symbols) + len(size), np.inf)
        last, back = np.full(len(distance), self.start), np.zeros(len(distance), np.int64)
        first = begin + np.arange(len(size))
        distance[first] = 0.0
        for lo, hi in zip(upto - rounds, upto, strict=True):
            source, arc, n = state[lo:hi], name[lo:hi], length[lo:hi]
            reached = np.isfinite(distance[source])
            source, arc, n = source[reached], arc[reached], n[reached]
            weight = np.where(self.admitted(last[source], arc), self.weight[arc], np.inf)
            total, target = distance[source] + weight, source + n
            less = total < distance[target]
            target = target[less]
            distance[target], last[target], back[target] = total[less], arc[less], n[less]
        at = first + size
        if not np.isfinite(distance[at]).all():
            raise ValueError("a text has no path through the model's transducer")
        steps = []  # arcs from the ends back
        whose = np.flatnonzero(size > 0)
        at = at[whose]
        while len(whose):
            steps.append((whose, last[at], at - whose - back[at]))
            at = at - back[at]
            on = at > first[whose]
            whose, at = whose[on], at[on]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        whose, names, where = (np.concatenate([x[k] for x in reversed(steps)]) for k in range(3))
        order = np.lexsort((where, whose))
        whose, names, where = whose[order], names[order], where[order]
        odd = np.flatnonzero(names >= len(self.pieces))
        if not len(odd):
            return names.astype(np.int32), np.bincount(whose, minlength=len(size))
        wide = np.ones(len(names), np.int64)
        paths = [self._fallback(chr(symbols[where[i]])) for i in odd.tolist()]
        wide[odd] = list(map(len, paths))
        ids = np.repeat(names, wide)
        ids[ragged((np.cumsum(wide) - wide)[odd], wide[odd])] = np.concatenate(paths)
        return ids.astype(np.int32), np.bincount(whose, wide, len(size)).astype(np.int64)

    def composed(self, inputs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `shortest`, some SYMBOLS at once, long inputs cut where no piece reaches across."""
        if max(map(len, inputs), default=0) <= LONG:
            return self._some(inputs)
        parts: list[str] = []
        of = []
        for text in inputs:
            before = len(parts)
            if len(text) > LONG:
                cut = 0
                for k in range(1, len(text)):
                    if text[k - 1 : k + 1] not in self.joined:
                        parts.append(text[cut:k])
                        cut = k
                parts.append(text[cut:])
            else:
                parts.append(text)
            of.append(len(parts) - before)
        ids, counts = self._some(parts)
        return ids, np.add.reduceat(counts, np.cumsum(of) - of)

    def _some(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size, ids, counts, lo = np.cumsum(list(map(len, parts))), [], [], 0
        while lo < len(parts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SYMBOLS, "right")))
            found, n = self.shortest(parts[lo:hi])
            ids.append(found)
            counts.append(n)
            lo = hi
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    # -- encoding and decoding

    def normalised(self, texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
        if self.squeeze:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        if self.dummy:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        return texts.cast(pa.large_string())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text)."""
        texts = self.normalised(texts)
        if not self.cuttable:
            return self.composed([t.replace(" ", MARK) for t in texts.to_pylist()])
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        at = np.arange(len(words))
        head = np.concatenate([[True], of[1:] != of[:-1]])
        tail = np.append(head[1:], True)
        # A cut is a run of marks and what follows it: an empty word is one more mark of the next cut.
        cut = np.where(head, some, some | tail)
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(cut | head, at, -1))[:-1]])
        marks = np.where(head, 0, at - before)[cut]
        of, words = of[cut], words.filter(pa.array(cut))
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        which, inputs = coded.indices.to_numpy().astype(np.int64), [MARK + w for w in coded.dictionary.to_pylist()]
        for i in np.flatnonzero(marks != 1).tolist():
            inputs.append(MARK * int(marks[i]) + words[i].as_py())
            which[i] = len(inputs) - 1
        ids, size = self.composed(inputs)
        start = np.cumsum(size) - size
        n = size[which]
        return ids[ragged(start[which], n)], np.bincount(of, n, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes that each run of ids stands for."""
        n = self.raw_size[ids]
        data = self.raw_bytes[ragged(self.raw_start[ids], n)].tobytes()
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = []
        for a, b in zip(upto, upto[1:], strict=False):
            out.append(data[a + (self.dummy and data[a : a + 1] == b" ") : b] if b > a else b"")
        return out


_COMPILED: dict[str, Transducer] = {}


def _compiled(model: bytes) -> Transducer:
    """One transducer a Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def _mapped(docs: DataFrame, model_file: str, at: int, fields: str, make) -> DataFrame:
    """docs with further columns that make(transducer, values of column number `at`) gives; the model file, under a megabyte, is broadcast."""
    with open(model_file, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(sent.value)
        for batch in batches:
            column = batch.column(at)
            _, offsets = buffers(column) if not pa.types.is_list(column.type) else (None, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]) * 4)
            for a, b in pieces(offsets, SLICE):
                for lo in range(a, b, 4096):
                    part = batch.slice(lo, min(b, lo + 4096) - lo)
                    more = make(machine, part.column(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{have}, {fields}")


def _lists(ids: np.ndarray, sizes: np.ndarray, column: pa.Array) -> pa.Array:
    """Runs of ids as lists, null where the column is."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pc.is_null(column))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """docs with the ids of its text."""
    docs = docs.drop(out_col) if out_col.lower() != text_col.lower() else docs
    free = free_name(docs, "ids")

    def make(machine: Transducer, texts: pa.Array) -> dict[str, pa.Array]:
        return {free: _lists(*machine.encode(texts), texts)}

    return _mapped(docs, model_file, docs.columns.index(text_col), f"`{free}` array<int>", make).withColumn(out_col, F.col(free)).select(*docs.columns, *[c for c in (out_col,) if c not in docs.columns])


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """docs with the text of its ids."""
    docs = docs.drop(out_col) if out_col.lower() != ids_col.lower() else docs
    free = free_name(docs, "decoded")

    def make(machine: Transducer, column: pa.Array) -> dict[str, pa.Array]:
        texts = [x.decode("utf-8", "replace") for x in machine.decode(column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]
        return {free: pa.array(texts, pa.string(), mask=pc.is_null(column).to_numpy(zero_copy_only=False))}

    return _mapped(docs, model_file, docs.columns.index(ids_col), f"`{free}` string", make).withColumn(out_col, F.col(free)).select(*docs.columns, *[c for c in (out_col,) if c not in docs.columns])


def _round_trip(machine: Transducer, ids: np.ndarray, sizes: np.ndarray, texts: pa.Array) -> pa.Array:
    """Whether ids decode to their texts, null for null."""
    same = [x == y for x, y in zip(machine.decode(ids, sizes), pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist(), strict=True)]
    return pa.array(same, pa.bool_(), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))


def encode_checked(docs: DataFrame, text_col: str = "text", out_col: str = "ids", same_col: str = "round_trip", model_file: str = MODEL) -> DataFrame:
    """docs with the ids of its text and whether they decode to it.

    One pass: `decode` after `encode` would hold a second Python worker a task, with a transducer of its own.
    """
    docs = docs.drop(*[c for c in (out_col, same_col) if c.lower() != text_col.lower()])
    ids, same = free_name(docs, "ids"), free_name(docs, "same")

    def make(machine: Transducer, texts: pa.Array) -> dict[str, pa.Array]:
        found, sizes = machine.encode(texts)
        return {ids: _lists(found, sizes, texts), same: _round_trip(machine, found, sizes, texts)}

    out = _mapped(docs, model_file, docs.columns.index(text_col), f"`{ids}` array<int>, `{same}` boolean", make)
    return out.withColumns({out_col: F.col(ids), same_col: F.col(same)}).select(*docs.columns, *[c for c in (out_col, same_col) if c not in docs.columns])


def encoded_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """(id, n_tokens, n_byte_tokens, ids_sha256, round_trip): of each text's ids, and whether they decode to it."""

    def make(machine: Transducer, texts: pa.Array) -> dict[str, pa.Array]:
        ids, sizes = machine.encode(texts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        fall = np.concatenate([[0], np.cumsum(machine.is_byte[ids])])
        data, none = ids.astype("<i4").tobytes(), pc.is_null(texts).to_numpy(zero_copy_only=False)
        digest = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]
        return {"n_tokens": pa.array(sizes, pa.int64(), mask=none), "n_byte_tokens": pa.array(fall[upto[1:]] - fall[upto[:-1]], pa.int64(), mask=none), "ids_sha256": pa.array(digest, pa.string(), mask=none), "round_trip": _round_trip(machine, ids, sizes, texts)}

    narrow = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return _mapped(narrow, model_file, 1, "n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean", make).drop("__text")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids_sha256 is over the ids as little-endian 32-bit integers, in order."""
    return encoded_summary(table(spark, sf_dir, "documents"))

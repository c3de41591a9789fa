import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("duelspark.llm.suffix_dedup")
from duelspark.llm import suffix_dedup as s  # noqa: E402


def brute(rows, length):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} from a dictionary of all strings."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            one = raw[i : i + length]
            if one in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(one)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [text(rng.randint(length, 4 * length)) for _ in range(5)] + ["ab" * length, "x" * (3 * length)]
    out = []
    for _ in range(60):
        parts = [text(rng.randint(0, 3 * length))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p) // 3)
            parts += [p[cut : len(p) - rng.randint(0, cut)], text(rng.randint(0, length))]
        out.append("".join(parts))
    out += [out[3], out[5], "", None, "short"]
    return list(enumerate(out))


@pytest.mark.parametrize("length,hot", [(20, 2048), (100, 2048), (20, 2)])
def test_equals_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(s, "HOT", hot)
    rows = corpus(length, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.without_repeats(docs, length=length).collect()}
    assert got == brute(rows, length)


@pytest.mark.parametrize("depth", [1, 2, 11, 12])
def test_merge_equals_sorting(depth):
    rng = np.random.default_rng(4)
    shards = [np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(6)]).astype(np.uint8) for _ in range(5)]
    sorted_ = [s.shard_transform(x, depth) for x in shards]
    interleave, shared = s.merge_transforms([t for _, t, _ in sorted_], [p for _, _, p in sorted_], depth)

    def prefix(shard, at):
        out = shards[shard][at : at + depth].tolist()
        return out[: out.index(0) + 1] if 0 in out else out

    nexts = [iter(order.tolist()) for order, _, _ in sorted_]
    merged = [prefix(i, next(nexts[i])) for i in interleave.tolist()]
    assert merged == sorted(merged)
    for a, b, n in zip(merged, merged[1:], shared[1:].tolist(), strict=False):
        true = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0), min(len(a), len(b)))
        assert n <= true < n + 2 or n == depth == true
    heads = np.flatnonzero(shared < depth)
    blocks = np.split(np.arange(len(merged)), heads[1:])
    assert all(len({tuple(merged[i]) for i in b}) == 1 for b in blocks)
    assert sum(len(b) > 1 for b in blocks) == sum(n > 1 for n in __import__("collections").Counter(tuple(m) for m in merged if 0 not in m).values())


def test_long_text_in_segments(monkeypatch):
    rng = random.Random(2)
    part = bytes(rng.randrange(97, 123) for _ in range(3000))
    raw = np.frombuffer(part + b"-" + part, np.uint8)
    monkeypatch.setattr(s, "CHUNK", 1024)
    records = np.concatenate(list(s.batch_records(np.array([7]), raw, np.array([0, len(raw)]), 100)))
    covered = np.zeros(len(raw), bool)
    for r in records:
        covered[r["start"] : r["start"] + r["n"]] = True
    assert covered[: len(raw) - 99].all()


def test_irregular_ids_and_empty(spark):
    long = "once upon a time there was a text of more than one hundred bytes that stood twice in the same small table of texts"
    rows = [(None, long), (3, long), (3, long), (1, "x"), (2, None)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id int, text string, num string, spans int")
    out = sorted((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed, r.n_spans) for r in s.without_repeats(docs).collect())
    n = len(long)
    assert out == [(1, 1, 0, 0), (2, 0, 0, 0), (3, n, 0, 0), (3, n, n, 1), (99, n, n, 1)]
    assert s.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

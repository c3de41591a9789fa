"""Periodic runs against brute force, the grammar's extensions against plain comparison, and the defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("duelspark.llm.registry")
from duelspark.llm import periodic_runs  # noqa: E402

SCHEMA = "doc_id long, text string, runs string, ID string"


def brute(words, min_words=24, min_exponent=3):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_exponent * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def sequence(rng, symbols, upto):
    out = []
    while len(out) < upto:
        part = [rng.randrange(symbols) for _ in range(rng.randint(1, 14))]
        out += (part * rng.randint(1, 20))[: rng.randint(1, 150)] if rng.random() < 0.5 else part
    return out


@pytest.mark.parametrize("limits", [(24, 3), (6, 3), (4, 2), (24, 5), (2, 2)])
@pytest.mark.parametrize("shared", [0, 1 << 15])
def test_runs_equal_brute_force(limits, shared, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID_WORDS", shared)  # 0: every text's grid is made in parts
    monkeypatch.setattr(periodic_runs, "_GRIDS", {})
    rng = random.Random(sum(limits))
    for _ in range(40):
        texts = [sequence(rng, rng.choice([1, 2, 3, 40]), rng.choice([0, 2, 24, 60, 300])) for _ in range(rng.randint(1, 6))]
        codes, bounds = np.array([x for t in texts for x in t], np.int64), np.cumsum([0] + [len(t) for t in texts])
        got = [tuple(r) for r in periodic_runs.find_runs(codes, bounds, *limits).tolist()]
        assert got == [(i, *r) for i, t in enumerate(texts) for r in brute(t, *limits)]


def test_grid_parts_are_the_whole_grid():
    for n in (23, 24, 25, 100, 1000):
        whole = {(i, q) for q in range(1, n // 3 + 1) for i in range(0, n - q, max(24 - q, 2 * q))} if n >= 24 else set()
        for part in (1, 7, 1 << 20):
            pairs = [(int(i), int(q)) for a, b in (periodic_runs._grid(n, 24, 3, part) if n >= 24 else []) for i, q in zip(a, b)]
            assert len(pairs) == len(whole) and set(pairs) == whole
        assert {(int(i), int(q)) for a, b in periodic_runs.grid(n) for i, q in zip(a, b)} == whole


def test_extensions_both_ways():
    rng = random.Random(8)
    for symbols in (1, 2, 5):
        line = [-1, *sequence(rng, symbols, 400), -2]
        names, codes = np.unique(line, return_inverse=True)
        grammar = periodic_runs.Grammar(codes, len(names))
        assert grammar.words == len(line) and len(grammar.symbol) < 8 * len(line)
        pairs = [rng.sample(range(1, len(line) - 1), 2) for _ in range(500)]
        a, b = np.array(pairs).T

        def plain(i, j, step):
            n = 0
            while line[i] == line[j]:
                i, j, n = i + step, j + step, n + 1
            return n

        assert grammar.extension(a, b).tolist() == [plain(i, j, 1) for i, j in pairs]
        assert grammar.extension(a, b, back=True).tolist() == [plain(i, j, -1) for i, j in pairs]


def test_a_long_block_takes_few_steps(monkeypatch):
    codes = np.concatenate([[1], np.zeros(200_000, np.int64), [2], np.zeros(150_000, np.int64), [3]])
    grammar = periodic_runs.Grammar(codes, 4)
    assert len(grammar.symbol) < len(codes) + 20
    assert grammar.extension(np.array([1]), np.array([200_002])).tolist() == [150_000]


def expected(doc_id, text):
    """The contract by hand: words, planted repeats, runs, digests."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    bag = ["a", "b", "the", "été", "日本", "x y", "end.", "\x1c"]
    rows = []
    for i in range(260):
        text = "".join(bag[w] + rng.choice([" ", "\n", "\t\r\n ", "\x0b"]) for w in sequence(rng, rng.choice([1, 3, 8]), rng.choice([1, 20, 30, 200])))
        rows.append((i, rng.choice(["", "  "]) + text, "r", "x"))
    rows += [(300, None, "r", "x"), (301, "", None, None), (302, " \n ", "r", "x"), (303, "word", "r", "x"), (10**12, "a b c " * 40, "r", "x"), (305, "to be or not " * 20_000, "r", "x"), (306, "w" * 300_000, "r", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    found = {r.doc_id: tuple(r) for r in got.collect()}
    # brute force is quadratic in the long one
    assert found[305][1:6] == (1, 0, 80_000, 4, 20_000_000) and found[305][7] == hashlib.sha256(b"to be or not").hexdigest()
    assert [found[r[0]] for r in rows if r[0] != 305] == [expected(*r[:2]) for r in rows if r[0] != 305]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "tick tock " * 15 + "end"
    docs = spark.createDataFrame([(7, text, "r", "x"), (7, text, "r", "x"), (None, text, "r", "x")], SCHEMA)
    out = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()]
    assert out == [(i, [(0, 30, 2)], "tick tock end") for i in (7, 7, None)]
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_exponent=1)


def test_the_strongest_run_by_exact_ratio(spark):
    runs = [(0, 24, 7), (30, 31, 9), (70, 48, 14), (130, 45, 13)]  # 24/7 = 48/14 < 31/9 < 45/13
    df = spark.createDataFrame([(runs,), (runs[:1] + runs[2:3],), ([],), (None,)], "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    best = [r.best and tuple(r.best) for r in df.select(periodic_runs.strongest(df.runs).alias("best")).collect()]
    assert best == [(130, 45, 13), (0, 24, 7), None, None]

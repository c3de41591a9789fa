import itertools
import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("duelspark.llm.near_dedup")
from duelspark.llm.near_dedup import corpus_weights, drop_near_duplicates, near_classes  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_counts(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    if not words:
        return Counter()
    n = max(1, len(words) - 4)
    return Counter(tuple(words[i : i + 5]) for i in range(n))


def brute_classes(rows, threshold=0.8):
    """{row number: smallest id of its class} over all pairs."""
    sets = [shingle_counts(text) for _, text in rows]
    df = Counter(s for one in sets for s in one)
    some = sum(map(bool, sets))
    weights = [{s: n * (1 + math.log(some / max(df[s], some / 1024), 1024)) for s, n in one.items()} for one in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, one in enumerate(sets):
        for s in one:
            holders.setdefault(s, []).append(i)
    pairs = {p for held in holders.values() for p in itertools.combinations(held, 2)}
    for i, j in pairs:
        a, b = weights[i], weights[j]
        shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
        if shared >= (threshold - 1e-9) * (sum(a.values()) + sum(b.values()) - shared):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return {i: least[find(i)] for i in range(len(rows))}


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == {rows[i][0]: c for i, c in want.items()}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "a b"), (5, "a b"), (None, "a b"), (7, "only one text that is long enough to have shingles " * 400)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, d1 string, bucket int").repartition(3)
    out = near_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in out) == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 5), (4, 3, 5), (5, 3, 5), (5, 3, 5), (0, 3, 5), (7, 7, 1)])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]
    again = spark.createDataFrame([(5, "a b"), (5, "a b"), (9, None), (None, "c d e f g h i"), (None, "c d e f g h i")], "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id or 0, r.kept) for r in near_classes(again).collect()) == [(0, False), (0, True), (5, False), (5, True), (9, True)]
    assert sorted(r.doc_id or 0 for r in drop_near_duplicates(again.withColumn("KEY", again.text)).collect()) == [0, 5, 9]


def test_document_frequencies_are_exact(spark):
    """Each frequent shingle has the idf of its true count; rare ones share one."""
    rows = [(i, f"common words that all of them share {'and some that half has too ' * (i % 2)} own{i} a{i} b{i} c{i} d{i}") for i in range(3000)] + [(4000, None)]
    weights = corpus_weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "text")
    df = Counter(s for _, t in rows for s in shingle_counts(t))
    want = sorted((1 + math.log(3000 / n, 1024)) / 2 for n in df.values() if n * 1024 >= 3000)
    assert sorted(weights.idf) == pytest.approx(want) and len(want) > 3


def test_large_group_and_planted_pairs(spark):
    """A group of near copies with most of all rows, and planted pairs at similarities around the threshold: recall and precision."""
    rng = random.Random(11)
    bag = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    base = [rng.choice(bag) for _ in range(150)]
    texts = []
    for _ in range(500):
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(bag)
        texts.append(" ".join(copy))
    for _ in range(200):
        one = [rng.choice(bag) for _ in range(rng.randint(60, 200))]
        two = list(one)
        for _ in range(rng.randint(1, 5)):
            two[rng.randrange(len(two))] = rng.choice(bag)
        texts += [" ".join(one), " ".join(two)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_classes(rows)
    links = [i for i in want if want[i] != i]
    assert sum(got[i] == want[i] for i in links) >= 0.99 * len(links) and all(got[i] == want[i] for i in want if got[i] != i)


def test_empty_table(spark):
    assert near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0

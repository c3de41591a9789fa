"""Spelling variants against brute force and SQL, hot chunks included, and the defined cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

pytest.importorskip("duelspark.llm.registry")
from duelspark.llm import common, spelling_variants  # noqa: E402

SCHEMA = "doc_id long, text string, word string, N long"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(counts, ratio=5):
    rows, form = {}, {}
    for w, n in counts.items():
        mates = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(mates, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        rows[w] = (n, len(mates), form[w], -best[0] if form[w] else None)
    for w in rows:
        root = w
        while form[root]:
            root = form[root]
        rows[w] += (root,)
    return rows


def counted(texts):
    out = Counter()
    for doc_id, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def bag(rng, n):
    """Words with many near ones, some that nearly all share their first or last half."""
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(n // 4)]
    out = set(stems)
    for s in stems:
        for _ in range(3):
            i = rng.randrange(len(s) + 1)
            out.add(s[:i] + rng.choice(["", "a", "ÿ"]) + s[i + rng.randint(0, 1) :])
    out |= {"prefix" + a + b for a in "abcdefg" for b in "abcdefg"} | {a + b + "suffixes" for a in "abcdefg" for b in "abcdefgh"}
    return sorted(w for w in out if w)


@pytest.mark.parametrize("hot", [(32, 4096), (0, 4)])
def test_near_words_equal_brute_force(spark, hot):
    rng = random.Random(hot[0])
    counts = {w: rng.choice([1, 5, 5, 25, 30, 400, 9000]) for w in bag(rng, 60)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert found(spelling_variants.variants(df, hot_pairs=hot[0], hot_rows=hot[1])) == brute(counts)
    pairs = [(r.a, r.b) for r in spelling_variants.near_pairs(df, *hot).collect()]
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == {(a, b) for a in counts for b in counts if a < b and near(a, b)}


def test_a_chunk_that_all_words_share_makes_no_pairs_of_its_group(spark, monkeypatch):
    """Words of one long prefix: what meets stays in proportion to the words, since their key is cut on."""
    words = ["telecommunication" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(0, 26**3, 7)]
    met = []
    real = common.saved
    monkeypatch.setattr(spelling_variants, "saved", lambda df, name, *a: met.append(out.count()) or out if (out := real(df, name, *a)) is not None and name == "near-words" else out)
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    n = spelling_variants.near_pairs(df).count()
    mates, known = 0, set(words)
    for w in words:
        for i in range(len(w) - 3, len(w)):
            mates += sum(w[:i] + c + w[i + 1 :] in known for c in "abcdefghijklmnopqrstuvwxyz" if c != w[i])
    assert 2 * n == mates and sum(met) <= 2 * n and len(met) > 1


def test_forms_are_followed_to_their_root(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 700, "abgggg": 4000, "aggggg": 20000, "zzzzzz": 5, "zzzzzy": 24}
    got = found(spelling_variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and got["abcdef"][4] == "aggggg" and got["zzzzzz"][2] is None
    ties = {"colors": 5, "colorz": 30, "colora": 30, "colorÿ": 30}
    assert found(spelling_variants.variants(spark.createDataFrame(list(ties.items()), "word string, n long")))["colors"][2] == "colora"
    with pytest.raises(ValueError):
        spelling_variants.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_counts_of_odd_texts(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Straße", "ÉTÉS", "naïveté", "word", "×÷×÷×÷", "ĀĀĀĀĀĀ", "日本日本日本", "don't", "x_yzzzzz", "ABCDEFG", "abcdefg", "Ünïcödé"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "", "-", "\n", "é", "1", "Ā"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    texts += [(None, "nullids " * 30), (400, None), (401, ""), (402, "same same"), (402, "sameword " * 6), (402, "sameword " * 6), (403, "long enough, Words; " * 9000), (404, "q" * 5000), (-5, "negative " * 7)]
    want = counted(texts)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], SCHEMA).repartition(3)
    for chunk, held in ((1 << 19, 1 << 19), (64, 3)):
        monkeypatch.setattr(spelling_variants, "CHUNK", chunk)
        got = {}
        # the same task as the operator's, in this process so that the bounds above hold
        task = {}
        monkeypatch.setattr(spelling_variants, "HELD_WORDS", held)
        monkeypatch.setattr(spelling_variants, "lean", lambda f: task.setdefault("f", f))
        spelling_variants.word_counts(docs, change=spelling_variants.deletions)
        for batch in task["f"](iter(docs.select("doc_id", "text").toArrow().to_batches())):
            for r in batch.to_pylist():
                got[r["word"]] = got.get(r["word"], 0) + r["n"]
        assert {w: n for w, n in got.items() if n >= 5} == want
    monkeypatch.undo()
    assert {r.word: r.n for r in spelling_variants.word_counts(docs, change=spelling_variants.deletions).collect()} == want


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(11)
    words = [w for w in bag(rng, 120) if len(w) >= 5]
    rows = [(i, " ".join(rng.choices(words, [1 + 900 // (k + 1) for k in range(len(words))], k=rng.randint(0, 80))).replace("ab", rng.choice(["ab", "AB"])), "w", 1) for i in range(400)]
    rows += [(1000, None, None, None), (1001, "", "w", 1), (None, "nullid " * 9, "w", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    df = spelling_variants.op12_spelling_variants(spark, str(tmp_path))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and [t for _, t in df.dtypes] == ["string"] * 3 + ["bigint"] * 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(spelling_variants.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and len(want) > 50
    assert found(df) == brute(counted([r[:2] for r in rows]))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants.word_counts(empty).count() == 0
    assert spelling_variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0

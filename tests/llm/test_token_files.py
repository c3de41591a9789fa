"""Token files: planes against plain arrays, encoding against the library, files read back, and the defined cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("duelspark.llm.registry")
from duelspark.llm import token_files  # noqa: E402

SCHEMA = "doc_id long, text string, id string, PART int"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_file())


def texts(seed=1, n=60):
    rng = random.Random(seed)
    bag = ["the", "The", "THE.", "don't", "'s", "a's,", "İstanbul", "ΣΑΣ", "é", "é", "́x", "日本語", "1234", "x2y", "...", "?!", "word,", "<|endoftext|>", "<|ENDOFTEXT|>,", "a<|startoftext|>b", "\x1c", " ", " ", "ﬁ", "\x01", "🙂", "-", "it's.", "'S.", "KÅ"]
    return ["".join(rng.choice(bag) + rng.choice([" ", " ", "\n", "\t", "", "  \r\n", "\x0b", "　"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def one_shard(ids):
    known = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([7]), pa.array([len(ids)]), pa.array([False])], names=["number", "id", "n", "part"])
    return token_files.Shard(token_files.shard_bytes(ids, known, 3, 1, 50))


@pytest.mark.parametrize("n,top,kind", [(0, 1, "<u2"), (1, 1, "<u2"), (511, 2, "<u2"), (512, 9, "<u2"), (5000, 49408, "<u2"), (3000, 200_000, "<u4")])
def test_shard_answers_like_an_array(n, top, kind):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype(kind)
    shard = one_shard(ids)
    assert (shard.partition, shard.number, shard.before, shard.n) == (3, 1, 50, n) and shard.documents().to_pylist() == [{"number": 0, "id": 7, "n": n, "part": False}]
    assert (shard.tokens() == ids).all()
    places = rng.permutation(n)[:700]
    assert (shard.access(places) == ids[places]).all()
    for symbol in {0, 1, top - 1, top + 5, *ids[:40].tolist()}:
        at = np.flatnonzero(ids == symbol)
        ends = rng.integers(0, n + 1, 50)
        assert shard.rank(symbol, ends).tolist() == [int((ids[:e] == symbol).sum()) for e in ends]
        assert shard.count(symbol) == len(at)
        if len(at):
            assert (shard.select(symbol, np.arange(len(at))) == at).all()


def test_damaged_files_are_refused():
    known = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([7]), pa.array([3]), pa.array([False])], names=["number", "id", "n", "part"])
    data = token_files.shard_bytes(np.array([1, 2, 3], "<u2"), known)
    for bad in (b"X" + data[1:], data[:-1], data[:-2] + b"\n", data + b"\n"):
        with pytest.raises(ValueError):
            token_files.Shard(bad)


def test_pieces_encode_like_whole_texts(monkeypatch):
    own, whole = token_files.Encoder(token_files.tokenizer_file()), library()
    assert own.by_bytes
    rows = [*texts(), None, "", " ", "\n\n", "w" * 500, "a " * 3000, "ÀÉÎ,", "Straße.", "ß", "ÿÿ!", "Μu µ", "", ""]
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in rows]
    for limits in ((1 << 19, 64, 1 << 20), (20, 3, 10)):
        for name, value in zip(("SEEN", "SEEN_LETTERS", "SLICE"), limits):
            monkeypatch.setattr(token_files, name, value)
        got = [[] for _ in rows]
        for ids, first, counts, last in own.parts(pa.array(rows), 2):
            assert len(ids) == counts.sum() and (last or len(counts) == 1)
            for i, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                got[first + i] += part.tolist()
        assert got == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_files.Encoder(token_files.tokenizer_file("byte_bpe_50k.json"))


def test_crc_of_joined_bytes():
    rng = random.Random(1)
    for a, b in ((b"", b""), (b"x", b""), (b"", b"yz"), (rng.randbytes(999), rng.randbytes(70_001))):
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows):
    whole, start, out = library(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [40, 1000, 1 << 22])
def test_files_read_back(spark, tmp_path, shard_tokens):
    rows = [(i * 37 % 101, t) for i, t in enumerate(texts(2, 25))] + [(5000, None), (5001, ""), (None, "null id"), (5002, "long text, of words. " * (40 if shard_tokens < 1000 else 2000)), (-4, "first")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(6)
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, shard_tokens=shard_tokens)
    want = expected(rows)
    got = token_files.read_documents(spark, path, ids=True)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    narrow = token_files.read_documents(spark, path)
    assert sorted((tuple(r) for r in narrow.collect()), key=lambda r: r[1]) == [w[:4] for w in want]
    line = [(t, w[0]) for w in want for t in w[4]]
    places = [0, 5, len(line) - 1, len(line), 17, 5]
    assert sorted(tuple(r) for r in token_files.tokens_at(spark, path, places).collect()) == [(p, line[p][0]) for p in sorted(set(places)) if p < len(line)]
    asked = [2, line[3][0], line[40][0], 48_000]
    assert {r.token: r.n for r in token_files.token_counts(spark, path, asked).collect()} == {t: sum(x == t for x, _ in line) for t in asked}
    found = sorted((r.token, r.place, r.id) for r in token_files.occurrences(spark, path, asked).collect())
    assert [f[:2] for f in found] == sorted((x, p) for p, (x, _) in enumerate(line) if x in asked) and all(line[p][1] == i for _, p, i in found)


def test_query_repeats_and_empty_tables(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(3, 50))] + [(7, "again", "x", 1), (7, "again", "x", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = token_files.op11_token_files(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes] == ["bigint"] * 4
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    want = expected([r[:2] for r in rows])
    assert [r[0] for r in got] == [w[0] for w in want] and sorted((r[0], *r[2:]) for r in got) == sorted((w[0], *w[2:4]) for w in want)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]
    path = f"file://{tmp_path}/none"
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), path)
    assert token_files.read_documents(spark, path).count() == 0 and token_files.occurrences(spark, path, [2]).count() == 0


def test_ids_of_other_types(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "name string, body string")
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, "name", "body")
    got = sorted(((r.id, r.start) for r in token_files.read_documents(spark, path, "string").collect()), key=lambda r: r[1])
    assert [i for i, _ in got] == ["a", "b", None]

"""The pipeline's stages against brute force on a small corpus with one planted case a stage."""

import random

import pytest

pytest.importorskip("duelspark.llm.registry")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    parts = {"en": ["the", "ing", "tion", "wh", "and", "er"], "de": ["sch", "ung", "ß", "der", "ü", "keit"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 4)))
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(word(lang) for _ in range(rng.randint(60, 90))), lang, f"s{i % 4}", 1))
    item = " ".join(word("en") for _ in range(20))
    near = rows[5][1].split(" ")
    near[30] = "changed"
    rows += [
        (100, rows[4][1].replace(" ", "\n\t"), "en", "s0", 1),  # an exact copy of 4
        (101, " ".join(near), "en", "s0", 1),  # a near copy of 5
        (102, "some words " + item.upper() + " and a tail", "en", "s0", 1),  # a benchmark passage
        (103, "12 34 !!", "en", "s0", 1),  # no letter
        (104, None, None, None, None),
        (105, "", "en", "s0", 0),
        (106, "short clean text", "en", "s1", 16),
    ]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return rows, f"file://{folder}"


def test_stages(spark, corpus):
    import sentencepiece

    rows, folder = corpus
    gone = [{103, 104, 105}, {100}, {101}, {102}]
    left = {r[0] for r in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        docs = corpus_pipeline.saved(stage(spark, docs, folder), "test-stage")
        left -= lost
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.collect()} == left, name
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.sentencepiece_fst.MODEL)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in out} == left and all(list(r.ids) == library.encode(texts[r.doc_id]) and r.round_trip for r in out)


def test_run_is_the_stages(spark, corpus):
    rows, folder = corpus
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows} - {100, 101, 102, 103, 104, 105}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0

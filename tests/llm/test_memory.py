"""Room that the pipeline's stages take: an executor holds all of its Python workers at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("duelspark.llm.registry")

from duelspark.llm import decontaminate, language_id  # noqa: E402
from duelspark.llm.common import buffers, lookup, saved  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_holds_one_python_worker_a_task(spark):
    import corpus_pipeline

    rows = [(1, "some words  and ümlaut 漢", "en", "s"), (2, "", "en", "s"), (3, None, None, None)]
    out = corpus_pipeline.encoded(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "")
    assert plan(out).count("MapInArrow") == 1
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[1]["round_trip"] and found[1]["n_tokens"] == len(found[1]["ids"]) > 0
    assert found[2]["round_trip"] and found[2]["ids"] == []
    assert found[3]["round_trip"] is None and found[3]["ids"] is None


def test_hot_groups_are_not_sent_through_python(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 500, 0).otherwise(F.col("id"))).alias("k"), "id")
    groups = saved(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "groups")
    out = lookup(rows, groups, ["k"], "n", 1000)
    assert "ExistingRDD" not in plan(out)
    assert sorted((r["id"], r["n"], r["top"]) for r in out.collect()) == [(i, 500 if i < 500 else 1, 499 if i < 500 else i) for i in range(1000)]


def test_room_of_a_suffix_array():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(600)]
    queries = decontaminate.Queries([1, 2], [" ".join(words), texts[7][:400]], 13, 2)
    batch = pa.record_batch({"id": pa.array(range(600)), "text": pa.array(texts)})
    tracemalloc.start()
    n = [len(shard.matches()[0]) for _, shard, _ in decontaminate.shards(iter([batch]), queries)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == 1  # the passage is found, wherever the text is cut
    assert batch.nbytes > 9e6 and peak < 130e6, (batch.nbytes, peak)


def test_features_without_zeros():
    rng = random.Random(6)
    texts = ["", None, "7 8", *(" ".join("".join(rng.choices("abcdefghijk", k=5)) for _ in range(rng.randint(1, 90))) for _ in range(600))]
    data, offsets = buffers(pa.array(texts))
    dense, sparse = language_id.features(data, offsets), language_id.Grams(data, offsets)
    w, g = np.random.default_rng(1).normal(size=dense.shape[1]).astype(np.float32), np.random.default_rng(2).normal(size=len(texts)).astype(np.float32)
    assert np.allclose(sparse.times(w), dense @ w, atol=1e-4) and np.allclose(sparse.back(g), dense.T @ g, atol=1e-4)
    assert 2 * sparse.nbytes < dense[:, dense.any(0)].nbytes

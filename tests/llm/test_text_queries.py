"""Small tests of the corpus operators: defined cases, and SQL or brute force on small fixtures."""

import base64
import gzip
import hashlib
import random
import re

import duckdb
import pytest

pytest.importorskip("duelspark.llm.registry")
from pyspark.sql import functions as F  # noqa: E402

from duelspark.llm import common, decontaminate, exact_dedup, language_id, license_scan, sentencepiece_fst, token_counts, warc  # noqa: E402

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)


def by_spark(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def documents(seed=1, n=80):
    rng = random.Random(seed)
    bag = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "the", "river", "Straße", "été", "日本", "1", "x2", "MIT", "released", "under", "licensed", "gnu", "nc", "4", "0"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(bag) + rng.choice([" ", " ", "-", ".\n", "\t  ", ", "]) for _ in range(rng.randint(0, 60)))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
    out += [(n, None, None, "a", None), (n + 1, "", "en", None, 0), (n + 2, out[3][1].replace(" ", "\t"), "en", "b", 1), (n + 3, "...", "en", "b", 3), (n + 4, "All RIGHTS-reserved " * 3000, "en", "b", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# -- exact dedup


def test_exact_dedup_matches_sql(spark):
    rows = documents() + [(200 + i, "the same  text", "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_spark(exact_dedup.exact_groups(docs, counters=8)) == by_sql(exact_dedup.ORACLE_SQL, documents=docs.toPandas().astype({"doc_id": "int64"}))


def test_exact_dedup_cases(spark):
    docs = spark.createDataFrame([(2, "a b", "x", "y"), (2, "a b", "x", "y"), (None, "a\n\tb", "x", "y"), (3, None, "x", "y"), (4, "", None, None)], "doc_id long, text string, digest string, row string")
    out = sorted((r.doc_id or 99, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert out == [(2, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True), (4, 3, 2, False), (99, 2, 3, False)]
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_misra_gries_bound(spark):
    rng = random.Random(5)
    values = [bytes([rng.randrange(50)]) if rng.random() < 0.5 else rng.randbytes(4) for _ in range(4000)] + [b"hot"] * 2000
    rng.shuffle(values)
    table = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(6)
    est = {bytes(r.digest): r.estimate for r in exact_dedup.misra_gries(table, "digest", 20).collect()}
    true = {v: values.count(v) for v in set(values)}
    assert all(n - len(values) / 21 <= est.get(v, 0) <= n for v, n in true.items())


# -- license scan


def test_a_notice_counts_whatever_stands_around_it(spark):
    """Its label depends neither on how its lines wrap nor on the length of lines near it."""
    notice = "Redistribution and use in source and binary forms\nwith or without modification are permitted"
    filler = "filler " * 90
    texts = [f"{notice}\nshort", f"{notice}\n{filler}", f"{filler}\n{notice}\n{filler}", notice.replace(" ", "\n"), filler + notice.replace("\n", " ") + " " + filler, *[("x " * n) + notice for n in range(45)]]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(99, filler, "en", "a", 1)], SCHEMA)
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got.pop(99) == "" and set(got.values()) == {"bsd"} and len(got) == 50


def test_license_scan_matches_sql(spark):
    rows = documents(7) + [(500, "Licensed under the Apache License, Version 2.0.\nAll  rights\nreserved", "en", "a", 1), (501, "the cc by cc by CC-BY ccby", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert by_spark(license_scan.scan(docs)) == by_sql(license_scan.ORACLE_SQL, documents=docs.toPandas())
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licences_are_told_apart(spark):
    texts = [
        "Licensed under CC BY 4.0",
        "Released under the Apache license",
        "Released under the MIT license",
        "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided that\nthe following conditions are met",
        "Licensed under the GNU Lesser General Public License, version 3",
        "Licensed under CC BY-NC 4.0",
        "the rights of all are reserved for a reader who wants " + "many more words in one long line " * 30,
    ]
    docs = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])], "doc_id long, text string")
    got = by_spark(license_scan.scan(docs).select("labels"))
    assert got == sorted([("cc-by",), ("cc-by",), ("",), ("mit",), ("bsd",), ("gpl,lgpl",), ("cc-by,cc-by-nc",), ("reserved",)], key=str)
    assert by_spark(license_scan.scan(docs)) == by_sql(license_scan.ORACLE_SQL, documents=docs.toPandas())


def test_license_join_filters_lose_nothing(spark):
    """All pairs by brute force over random token sets, at several thresholds."""
    rng = random.Random(3)
    order = [f"t{i}" for i in range(14)]
    templates = {f"l{i}": " ".join(rng.sample(order, rng.randint(1, 7))) for i in range(9)}
    marks = license_scan.own_words(templates)
    blocks = [(i, 0, sorted(rng.sample(range(14), rng.randint(0, 12)))) for i in range(200)]
    frame = spark.createDataFrame(blocks, "row long, block int, words array<int>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.row, r.label) for r in license_scan.template_matches(frame, templates, order, threshold).collect()}
        want = {(i, l) for i, _, w in blocks for l, t in templates.items() if len({order[k] for k in w} & set(t.split())) >= threshold * len(set(t.split())) - 1e-9 and 2 * len({order[k] for k in w} & set(marks[l])) >= len(marks[l])}
        assert got == want


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i % 7}", f"<p>{i % 5}</p>\r\n\r\nWARC/1.1\r\n" * (i % 4)) for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", "<p>1</p>"), (62, "a\r\nb", "é" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, archive_bytes=5000)
    out = warc.read_archives(spark, path, payloads=True).collect()
    assert not [r for r in out if r.kind == "gap"] and len(out) == len(rows)
    want = by_sql(warc.ORACLE_SQL, pages=pages.where("page_id is not null").toPandas().astype({"page_id": "int64"}))
    names = sorted(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    assert sorted((tuple(r[n] for n in names) for r in out if r.page_id is not None), key=str) == want
    texts = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in out if r.record_type == "response")


def test_warc_long_header_few_archives_and_empty(spark, tmp_path):
    rows = [(i, "http://x/" + "u" * (100_000 if i == 7 else 3), f"<p>{i % 50}</p>", "z") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(4)
    path = f"file://{tmp_path}/w"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    warc.write_archives(pages, path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = warc.read_archives(spark, path)
    assert out.where("kind = 'record'").count() == 400 and out.where("kind = 'gap'").count() == 0
    assert out.select("archive").distinct().count() <= 8
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_salvage():
    records = [warc.build_record(i, "http://x", (f"<p>{i}</p>WARC/1.1\r\n" * 3).encode()) for i in range(6)]
    damaged = [records[0], b"junk junk", records[1], records[2][:-30], gzip.compress(records[3]), gzip.compress(records[4])[:60], records[5].replace(b"<p>5", b"<p>6", 1), records[4]]
    data = b"".join(damaged)
    out = list(warc.salvage(data))
    assert [o[1] for o in out] == [0, *[o[2] for o in out[:-1]]] and out[-1][2] == len(data)
    names = [o[3][0]["warc-record-id"] for o in out if o[0] == "record"]
    assert names == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>", "<urn:page:4>"]
    assert [o[0] for o in out].count("gap") == 3 and all(o[3] for o in out)
    assert list(warc.salvage(b"")) == [] and [o[0] for o in warc.salvage(b"nothing")] == ["gap"]


def test_warc_digest():
    assert warc.base32_sha1(b"x") == base64.b32encode(hashlib.sha1(b"x").digest()).decode()


# -- decontamination


def contaminated_corpus(seed=2):
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(25)] + ["été", "Ab"]
    items = [(100 + i, " ".join(rng.choice(bag) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(200, None), (201, " -- ")]
    docs = []
    for i in range(50):
        parts = [rng.choice(bag) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            w = words(rng.choice(items[:12])[1])
            cut = rng.randint(0, max(0, len(w) - 13))
            at = rng.randint(0, len(parts))
            parts[at:at] = w[cut : cut + rng.randint(10, 40)]
        docs.append((i, ", ".join(parts).upper() if i % 3 else " ".join(parts), "en", "a", 1))
    return docs + [(50, None, "en", "a", 1), (51, "", "en", "a", 1), (52, "w1 " * 30000, "en", "a", 1)], items


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_contamination_matches_sql(spark, monkeypatch, block):
    rows, items = contaminated_corpus()
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.query_blocks, "__defaults__", (block,))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start"]
    got = by_spark(decontaminate.contamination(docs, bench).select(*names))
    assert got == by_sql(decontaminate.ORACLE_SQL, documents=docs.toPandas(), benchmark=bench.toPandas())
    bad = {r[2] for r in got if r[0]}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    flagged = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert bad is not None and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - flagged and flagged


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_items_and_documents_that_repeat_or_lack_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.query_blocks, "__defaults__", (block,))
    items = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (1, "alpha beta gamma"), (None, "eta theta"), (None, "iota kappa"), (2, "delta epsilon zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["x alpha beta gamma y", "delta epsilon zeta", "a eta theta", "iota kappa", "alpha beta gamma and delta epsilon zeta", "clean", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start"]
    assert by_spark(decontaminate.contamination(docs, bench).select(*names)) == by_sql(decontaminate.ORACLE_SQL, documents=docs.toPandas(), benchmark=bench.toPandas().astype({"item_id": "Int64"}))
    same = [(7, "alpha beta gamma"), (7, "clean one"), (None, "iota kappa"), (None, "clean two"), (None, None), (7, "clean one")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(same, "doc_id long, text string").repartition(2), bench)
    assert by_spark(kept) == sorted([(7, "clean one"), (7, "clean one"), (None, "clean two"), (None, None)], key=str)


def test_longest_matches(spark):
    rows, items = contaminated_corpus(9)
    docs, bench = spark.createDataFrame(rows, SCHEMA).repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.item_word): r.length for r in decontaminate.longest_matches(docs, bench, min_match=5).collect()}
    texts = [words(r[1]) for r in rows]

    def run(a, b):
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    want = {}
    for item, text in items:
        w = words(text)
        for s in range(len(w)):
            best = max((run(w[s:], t[p:]) for t in texts for p in range(len(t) if len(t) < 1000 else 1000) if t[p] == w[s]), default=0)
            if best >= min(5, *(len(words(x)) for _, x in items if words(x))):
                want[item, s] = best
    assert got == want


def test_clashing_names_and_repeated_rows(spark):
    """Columns that bear the operators' own names, and rows that repeat."""
    rows = [(1, "alpha beta gamma delta", "x", 7, "q"), (1, "alpha beta gamma delta", "x", 7, "q"), (2, None, None, None, None), (None, "other words here", "y", 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, rank long, lang_pred string").repartition(2)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and by_spark(kept) == by_spark(docs.distinct())
    bench = spark.createDataFrame([(5, "beta gamma", "x")], "item_id long, text string, id string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and by_spark(clean) == by_spark(docs.where("doc_id = 2 or doc_id is null"))
    assert sorted(r.n_hit for r in decontaminate.contamination(docs, bench).collect()) == [0, 0, 2, 2]
    model = language_id.train(docs.withColumn("lang", docs.digest))
    out = language_id.predict(docs, model, names=("lang_pred_", "s", "a"))
    assert out.columns == [*docs.columns, "lang_pred_", "s", "a"] and out.count() == 4


def test_contamination_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "a", 3)], SCHEMA)
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(one, bench).collect()] == [(2, 0, False)]


# -- token counts


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    docs = spark.createDataFrame(documents(4), SCHEMA)
    tokenizers = {"words@1": token_counts.word_count, "bytes@1": token_counts.byte_count}
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.apply("a", token_counts.counted(docs, tokenizers)) and not rollup.apply("a", token_counts.counted(docs, tokenizers))
    gone = docs.where("doc_id % 3 = 0")
    assert rollup.apply("b", token_counts.counted(gone, tokenizers, -1))
    want = {}
    for doc_id, text, lang, source, _ in documents(4):
        if doc_id % 3:
            for name, n in (("words@1", len(words(text))), ("bytes@1", len((text or "").encode()))):
                have = want.get((source, lang, name), (0, 0))
                want[source, lang, name] = (have[0] + 1, have[1] + n)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert totals() == want
    rollup.compact()
    assert totals() == want and rollup.committed() == ["a", "b"]
    assert not rollup.apply("b", token_counts.counted(gone, tokenizers, -1))
    assert rollup.apply("c", token_counts.counted(docs.where("doc_id % 3 <> 0"), tokenizers, -1)) and rollup.totals().count() == 0


def test_rollup_cut_between_deletion_and_rename(spark, tmp_path):
    """All reads and commits finish such a compaction first."""
    import shutil

    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    docs = spark.createDataFrame(documents(4), SCHEMA)
    for name in "ab":
        rollup.apply(name, token_counts.counted(docs, {"words@1": token_counts.word_count}))
    want = by_spark(rollup.totals())
    recover, rollup.recover = rollup.recover, lambda: None
    rollup.compact()
    shutil.rmtree(tmp_path / "r" / "batch=a")  # the cut comes after the first deletion
    rollup.recover = recover
    assert by_spark(rollup.totals()) == want and rollup.committed() == ["a", "b"]
    assert not rollup.apply("a", token_counts.counted(docs, {"words@1": token_counts.word_count})) and by_spark(rollup.totals()) == want


def test_no_batch_can_take_a_compacted_ones_place(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    docs = spark.createDataFrame(documents(4), SCHEMA)
    feed = token_counts.counted(docs, {"words@1": token_counts.word_count})
    n = sum(r.n_docs for r in feed.groupBy().agg(F.count(F.lit(1)).alias("n_docs")).collect())
    total = lambda: rollup.totals().agg(F.sum("n_docs")).first()[0]
    assert rollup.apply("b0", feed) and rollup.apply("b1", feed)
    rollup.compact()
    assert rollup.apply("all-2", feed) and total() == 3 * n and rollup.committed() == ["all-2", "b0", "b1"]
    assert not rollup.apply("all-2", feed) and not rollup.apply("b0", feed) and total() == 3 * n
    rollup.compact()
    assert rollup.apply("all-3", feed) and total() == 4 * n and rollup.committed() == ["all-2", "all-3", "b0", "b1"]
    with pytest.raises(ValueError):
        rollup.apply("all.2", feed)


def test_rollup_recovers(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    docs = spark.createDataFrame(documents(4), SCHEMA)
    (tmp_path / "r" / "_writing-batch=x").mkdir(parents=True)
    (tmp_path / "r" / "_writing-batch=x" / "part").write_text("cut short")
    assert rollup.apply("x", token_counts.counted(docs, {"words@1": token_counts.word_count}))
    assert rollup.committed() == ["x"]


def test_rollup_of_repeated_and_null_ids(spark):
    rows = [(1, "one 2 three", "web", "en"), (1, "one 2 three", "web", "en"), (2, "four  five", "web", "en"), (3, "four five", "book", "en"), (3, "six 77 eight nine", "book", "de"), (None, "four five", "web", None), (None, "ten 1", None, "en"), (4, None, "web", "en"), (None, "", "web", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    assert by_spark(token_counts.corpus_rollup(docs)) == by_sql(token_counts.ORACLE_SQL, documents=docs.toPandas().astype({"doc_id": "Int64"}))


def test_bpe_counts(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(documents(4), SCHEMA)
    count = token_counts.bpe_count(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r.n for r in docs.select("doc_id", count(F.col("text")).alias("n")).collect()}
    assert got == {r[0]: 0 if r[1] is None else len(own.encode_ordinary(r[1])) for r in documents(4)}


# -- language ID


def test_language_id(spark):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "wh", "and"], "fr": ["eau", "que", "ç", "les", "oi"], "de": ["sch", "ung", "ß", "der", "ü"], "es": ["ción", "ñ", "llo", "que", "ado"]}
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang, "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = language_id.train(docs.where(~language_id.held_out()), per_language=60)
    more = docs.unionByName(spark.createDataFrame([(900, None, "en", "a", 1), (901, "12 ?! 3", "en", "a", 1), (902, "", None, "a", 1), (903, "日本", None, None, None)], SCHEMA))
    out = {r.doc_id: r for r in language_id.predict(more, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert sum(out[i].lang_pred == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred != "und"
    assert all(0 <= r.lang_score <= 1 for r in out.values())
    nothing = language_id.train(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.predict(more, nothing).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.predict(more.where("doc_id < 900"), language_id.train(docs.where("lang = 'en'"))).collect()} == {"en"}
    assert language_id.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_language_prediction_equals_a_plain_loop(spark):
    """Features, margins and loss-weighted decoding, one text and one n-gram at a time."""
    import math

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["das", "ein", "the", "of", "une", "le"][k : k + 2]) for _ in range(9)), "dde"[k // 2] + str(k // 2)) for i in range(60) for k in (0, 2, 4)], "doc_id long, text string, lang string")
    model = language_id.train(docs, per_language=30)
    texts = ["das ein das", "the of", "une LE 12 le", "é", "long " * 3000, "x"]

    def plain(text):
        codes = [int(language_id._CLASS[b]) for b in text.encode()]
        margins = [float(b) for b in model["bias"]]
        for k, order in enumerate(language_id.ORDERS):
            counts = {}
            for i in range(len(codes) - order + 1):
                gram = codes[i]
                for step in range(1, order):
                    gram = (gram * 0x01000193 & 0xFFFFFFFF) ^ codes[i + step]
                if order > 1:
                    gram = (gram * 0x9E3779B1 & 0xFFFFFFFF) >> (33 - language_id.BUCKETS.bit_length())
                counts[gram] = counts.get(gram, 0) + 1
            for gram, n in counts.items():
                for bit in range(len(margins)):
                    margins[bit] += math.sqrt(n / sum(counts.values())) * float(model["weights"][k * language_id.BUCKETS + gram, bit])
        losses = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word, strict=True)) / len(margins) for word in model["code"]]
        first, second = sorted(losses)[:2]
        return model["languages"][losses.index(first)], (second - first) / second

    got = {r.text: (r.lang_pred, r.lang_score) for r in language_id.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for text in texts:
        lang, score = plain(text)
        assert got[text][0] == lang and got[text][1] == pytest.approx(score, abs=1e-3)


def test_codebook_distances():
    for n in (2, 3, 6, 7, 20):
        code = language_id.codebook(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert len(code) == n and min(apart) >= max(1, code.shape[1] // 4)


# -- SentencePiece


def test_encoding_equals_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    rng = random.Random(6)
    alphabet = "      abcdethion\n\tñß😀世▁A.,-　\x00$%"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "a" * 5000, " ".join(["Ünder"] * 9000)]
    rows = list(enumerate(texts)) + [(9999, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids_old string").repartition(3)
    ids = sentencepiece_fst.encode(docs)
    got = {r.doc_id: (r.ids, r.back) for r in sentencepiece_fst.decode(ids, "ids", "back").collect()}
    assert got.pop(9999) == (None, None)
    assert all(list(v[0]) == library.encode(t) for (i, t), v in zip(enumerate(texts), (got[i] for i in range(len(texts))), strict=True))
    assert all(got[i][1] == library.decode(library.encode(t)) for i, t in enumerate(texts))
    assert sentencepiece_fst.encoded_summary(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unigram_shortest_path():
    machine = sentencepiece_fst.Transducer(open(sentencepiece_fst.MODEL, "rb").read())
    machine.kind = sentencepiece_fst.UNIGRAM
    names = {"▁a": 1.0, "▁": 2.0, "a": 1.5, "ab": 1.0, "b": 1.0, "▁ab": 3.5}
    ids = {piece: machine.ids[piece] for piece in names}
    machine.scores = [0.0] * len(machine.pieces)
    for piece, i in ids.items():
        machine.scores[i] = -names[piece]
    machine.compile(ids)

    def cheapest(text):
        """All segmentations."""
        if not text:
            return 0.0, []
        ways = [(names[text[:k]] + cost, [text[:k], *rest]) for k in range(1, len(text) + 1) if text[:k] in names for cost, rest in [cheapest(text[k:])]]
        return min(ways)

    texts = ["▁ab", "▁aab", "ab▁", "abab▁▁b"]
    found, sizes = machine.shortest(texts)
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + int(n))
    for k, text in enumerate(texts):
        path = [machine.pieces[i] for i in found[upto[k] : upto[k + 1]]]
        assert "".join(path) == text and sum(names[p] for p in path) == cheapest(text)[0]
    assert [machine.pieces[i] for i in found[: upto[1]]] == ["▁a", "b"]


def test_result_columns_that_are_there_already(spark):
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, "y")], "doc_id long, text string, ids string")
    out = sentencepiece_fst.encode(docs)
    assert out.columns == ["doc_id", "text", "ids"]
    back = sentencepiece_fst.decode(out)
    assert back.columns == ["doc_id", "ids", "text"] and sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "some words"), (2, None)]


# -- shared helpers


def test_words_and_components(spark):
    import numpy as np
    import pyarrow as pa

    texts = ["A b", None, "", "été-x  y", "b a", "a"]
    data, offsets = common.buffers(pa.array(texts))
    hashes, _, bounds = common.scan_words(data, offsets)
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    assert hashes[0] == hashes[-1] and hashes[0] != hashes[1]
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0

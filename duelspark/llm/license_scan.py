"""License scans as an exact set-similarity join, in DataFrame functions only.

A text block is a window of twice as many words as the longest template has, and such windows begin every so many words:
a notice stands wholly inside one of them, however its lines wrap and whatever stands around it. A template is a licence
notice. Both count as sets of lower-cased words. A
block meets a template if it holds CONTAINMENT or more of the template's words and, of the words that no other template
has, half or more: those tell a licence from its neighbours. All such pairs are found:

* tokens are ordered by their frequency over all texts, rarest first (ties by the token itself);
* prefix filter: a template that must share `alpha` of its words has one of its first size - alpha + 1 words in any block
  that meets it, and that word is among the block's first size - alpha + 1 template words;
* length filter: a block with fewer than alpha template words cannot meet it;
* positional filter: what is left of both sets after the shared word bounds the overlap.

Pairs that pass are verified by their whole intersection. Templates, their words and the frequencies of those words are
fixed in number and broadcast. Phrases (BASE) are counted wherever their words stand consecutively.

Defined cases: null counts as the empty text; a document without any label has score 0, empty labels and null places; a
base phrase scores 1; rows that repeat an id are each scanned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RAW_WORD, ascii_lower, saved, table

CONTAINMENT = 0.8

#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and their labels.
TEMPLATES = {
    "agpl": "licensed under the gnu affero general public license version 3",
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl": "licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license version 3",
    "mit": "released under the mit license",
    "mpl": "subject to the terms of the mozilla public license version 2 0",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD_BEFORE, _WORD_AFTER = rf"(?<!{RAW_WORD[:-1]})", rf"(?!{RAW_WORD[:-1]})"


def _phrase(words: str) -> str:
    return rf"{_WORD_BEFORE}{(_SEPARATOR + '+').join(words.split(' '))}{_WORD_AFTER}"


_ANY = f"(?:{'|'.join(map(_phrase, BASE))})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(RAW_WORD)).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a text without nulls."""
    found = {phrase: F.regexp_like(text, F.lit(f"(?i){_phrase(phrase)}")) for phrase in BASE}
    some = F.regexp_like(text, F.lit(f"(?i){_ANY}"))
    return {
        "n_base": F.when(some, F.regexp_count(text, F.lit(f"(?i){_ANY}"))).otherwise(0).cast("long"),
        "first_word": F.when(some, n_words(F.regexp_extract(text, rf"(?is)^(.*?){_ANY}", 1))),
        "last_word": F.when(some, n_words(F.regexp_extract(text, rf"(?is)^(.*){_ANY}", 1))),
        "base_labels": F.when(some, F.array_compact(F.array(*[F.when(yes, F.lit(BASE[phrase])) for phrase, yes in found.items()]))).otherwise(F.array().cast("array<string>")),
    }


def own_words(templates: dict[str, str]) -> dict[str, list[str]]:
    """Of each template the words that no other one has."""
    sets = {label: set(text.split(" ")) for label, text in templates.items()}
    return {label: sorted(words.difference(*[x for other, x in sets.items() if other != label])) for label, words in sets.items()}


def block_words(templates: dict[str, str]) -> int:
    """Words of the longest template: half a window, and how far windows are apart."""
    return max(len(text.split(" ")) for text in templates.values())


def token_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The templates' words by their frequency over all texts, rarest first. The counts are as many as the vocabulary."""
    words = docs.select(F.explode(F.split(F.col(text_col), _SEPARATOR + "+")).alias("raw"))
    counts = words.where(F.length("raw") <= max(map(len, vocabulary))).select(ascii_lower(F.col("raw")).alias("token")).where(F.col("token").isin(vocabulary)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n = {r["token"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda t: (n.get(t, 0), t))


def template_matches(blocks: DataFrame, templates: dict[str, str], order: list[str], containment: float) -> DataFrame:
    """(row, label, score) of blocks (row, block, words: sorted array of token ranks) for all pairs that meet the threshold."""
    spark = blocks.sparkSession
    rank = {t: i for i, t in enumerate(order)}
    prefixes, sets, own_of = [], [], own_words(templates)
    for label, text in templates.items():
        have = sorted(rank[t] for t in set(text.split(" ")))
        alpha = math.ceil(containment * len(have) - 1e-9)
        sets.append((label, have, alpha, [rank[t] for t in own_of[label]]))
        prefixes += [(label, r, i, len(have), alpha) for i, r in enumerate(have[: len(have) - alpha + 1])]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "label string, token int, at int, size int, alpha int"))
    whole = F.broadcast(spark.createDataFrame(sets, "label string, have array<int>, alpha int, marks array<int>"))
    least = min(alpha for _, _, alpha, _ in sets)
    own = F.size("words")
    starts = blocks.where(own >= least).select("row", "block", "words", F.posexplode(F.slice("words", F.lit(1), own - least + 1)).alias("pos", "token"))
    candidates = starts.join(prefix, "token").where((own >= F.col("alpha")) & (F.col("pos") <= own - F.col("alpha")) & (1 + F.least(F.col("size") - F.col("at") - 1, own - F.col("pos") - 1) >= F.col("alpha")))
    pairs = candidates.select("row", "block", "words", "label").distinct().join(whole, "label")
    overlap = F.size(F.array_intersect("words", "have"))
    marked = 2 * F.size(F.array_intersect("words", "marks")) >= F.size("marks")
    return pairs.where((overlap >= F.col("alpha")) & marked).select("row", "label", (overlap / F.size("have")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row a document: (id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark, templates = docs.sparkSession, templates or TEMPLATES
    vocabulary = sorted({t for text in templates.values() for t in text.split(" ")})
    order = token_order(docs, text_col, vocabulary)
    rank = {t: i for i, t in enumerate(order)}
    # Any block that meets a template holds one of its prefix tokens; only such blocks are read further.
    needed = set()
    for text in templates.values():
        have = sorted(set(text.split(" ")), key=rank.__getitem__)
        needed |= set(have[: len(have) - math.ceil(containment * len(have) - 1e-9) + 1])
    holds = F.lit(rf"(?i){_WORD_BEFORE}(?:{'|'.join(sorted(needed))}){_WORD_AFTER}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    stride = block_words(templates)
    literal = lambda words: F.array(*[F.lit(w) for w in words])

    def windows(words: Column) -> Column:
        """Of each window of words those that templates have, where one of them is a prefix token."""
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
        own = F.transform(starts, lambda i: F.array_intersect(F.slice(words, i + 1, 2 * stride), literal(vocabulary)))
        return F.filter(own, lambda b: F.arrays_overlap(b, literal(sorted(needed))))

    # the words are bound once, as the element of an array of one, and not split anew for every window
    words = F.array(F.split(ascii_lower(text), _SEPARATOR + "+"))
    blocks = F.when(F.regexp_like(text, holds), F.flatten(F.transform(words, lambda w: windows(F.filter(w, lambda x: x != ""))))).otherwise(F.array().cast("array<array<string>>"))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), n_words(text).alias("n_words"), *[c.alias(name) for name, c in base_columns(text).items()], blocks.alias("blocks"))
    base = saved(base, "license-blocks")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    blocks = base.select("row", F.posexplode("blocks").alias("block", "tokens")).select("row", "block", F.array_sort(F.transform("tokens", lambda t: ranks[t])).alias("words"))
    found = template_matches(blocks, templates, order, containment).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = base.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"('{label}', '{text}', {own_words(TEMPLATES)[label]})" for label, text in TEMPLATES.items())
_STRIDE = block_words(TEMPLATES)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
  list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c FROM w),
base AS (SELECT r, doc_id, n_words, len(a) + len(b) + len(c) AS n_base, list_min(a || b || c) AS first_word, list_max(a || b || c) AS last_word,
  (CASE WHEN len(a) > 0 THEN ['cc-by'] ELSE [] END) || (CASE WHEN len(b) > 0 THEN ['gpl'] ELSE [] END) || (CASE WHEN len(c) > 0 THEN ['reserved'] ELSE [] END) AS labels FROM p),
t AS (SELECT label, list_distinct(string_split(notice, ' ')) AS t, CAST(marks AS VARCHAR[]) AS marks FROM (VALUES {_VALUES}) v(label, notice, marks)),
lines AS (SELECT r, list_distinct(w[{_STRIDE} * i + 1 : {_STRIDE} * (i + 2)]) AS l FROM (SELECT r, w, unnest(range((len(w) + {_STRIDE - 1}) // {_STRIDE})) AS i FROM w)),
met AS (SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(l, t)) / len(t)) AS best FROM lines, t
  WHERE len(list_intersect(l, t)) >= ceil(0.8 * len(t) - 1e-9) AND 2 * len(list_intersect(l, marks)) >= len(marks) GROUP BY r)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(labels), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(labels || coalesce(more, []))), ',') AS labels,
  greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM base LEFT JOIN met USING (r)
"""

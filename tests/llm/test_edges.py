"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from skein.llm import entropy_mix, jaccard_join, katz_lm, language_id, line_edit_join, quality_rules, secret_crf, sentencepiece_codec, suffix_dedup, uniform_threshold

LONG = "lorem ipsum dolor sit amet " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, key string, size long, cls long, copies long, score double, lang_pred string, kept_text string, ids string, block long, stats string, h1 long, t long, no int, train boolean, g long, root long"
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (None, "the null document has words"), (7, "é日😀\x00▁<s>"), (8, "x" * 5000), (9, "same line of more than twenty signs\nsame line of more than twenty signs")]


def frame(spark, rows):
    full = [(i, t, None if i == 3 else "en" if (i or 0) % 2 else "de", None if i == 4 else "s", None, *[None] * 18) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (99, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")


def run_all(spark, docs, labels):
    yield "codec", sentencepiece_codec.encode_texts(docs, sentencepiece_codec.model_path())
    net = language_id.train_network(docs.filter("lang is not null").select(F.col("doc_id").alias("id"), "text", "lang"))
    yield "language", language_id.predict_languages(docs, net)
    yield "katz", katz_lm.score_documents(docs, F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False)))
    yield "lines", line_edit_join.dedup_lines(docs)
    yield "jaccard", jaccard_join.near_duplicates(docs)
    yield "mix", entropy_mix.mix_sources(docs)
    yield "suffix", suffix_dedup.dedup_substrings(docs)
    field = secret_crf.train_field(docs.select(F.col("doc_id").alias("id"), "text"), 50, 50)
    yield "secrets", secret_crf.scan_secrets(docs, field)
    yield "quality", quality_rules.apply_quality_rules(docs, labels)


def test_every_row_comes_back(spark, docs, labels):
    for name, out in run_all(spark, docs, labels):
        rows = out.collect()
        assert len(rows) == len(ROWS), name
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS), name


def test_empty_tables(spark, docs, labels):
    for name, out in run_all(spark, docs.limit(0), labels.limit(0)):
        assert out.collect() == [], name


def test_defined_results(spark, docs, labels):
    out = dict(run_all(spark, docs, labels))
    ids = {r.doc_id: r for r in out["codec"].collect()}
    assert len(ids[2].ids) == len(ids[3].ids) == 8 and ids[2].decoded == ""
    lang = {r.doc_id: r for r in out["language"].collect()}
    assert lang[2].lang_pred == lang[3].lang_pred == lang[4].lang_pred == "und" and lang[5].lang_pred in ("en", "de")
    near = {r.doc_id: r for r in out["jaccard"].collect()}
    assert near[2].n_shingles == 0 and near[6].component_id == 5 and near[1].component_id == 1
    gone = {r.doc_id: r for r in out["suffix"].collect()}
    assert gone[6].n_removed == gone[6].n_bytes == len(LONG) and gone[5].n_removed < len(LONG)
    assert gone[8].n_removed == 4999 and gone[2].n_bytes == 0
    line = {r.doc_id: r for r in out["lines"].collect()}
    assert (line[9].n_lines, line[9].n_equal, line[2].n_lines, line[3].n_lines) == (2, 1, 0, 1)
    mix = {r.doc_id: r for r in out["mix"].collect()}
    assert mix[2].size == mix[2].copies == 0 and all(0 <= r.copies <= 3 for r in mix.values())
    quality = {r.doc_id: r for r in out["quality"].collect()}
    assert quality[2].base_failed and not quality[2].kept


def test_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [1e12, -1e12]), (9, [1e12, -1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("v", F.lit(2))
    out = uniform_threshold.top_k(df, lambda i: i % 50 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out if r.query_id == 0] == [9, 9, 8, 1, 2] and [r.vec_id for r in out if r.query_id == 50] == [9, 9, 8, 0, 1]
    assert out[0].score == 128 * 256 * 10**12 - 64 * 256 * 10**12
    assert uniform_threshold.top_k(df.limit(0), lambda i: i % 50 == 0).collect() == []
    assert uniform_threshold.top_k(df, lambda i: i < 0).collect() == []

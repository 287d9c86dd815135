import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.llm import language


@pytest.mark.parametrize("count", [2, 3, 4, 6, 7, 40])
def test_codewords(count):
    code = language.codewords(count)
    assert len(np.unique(code, axis=0)) == count
    assert (abs(code.sum(axis=0)) < count).all()
    distance = (code[:, None] != code[None]).sum(axis=2)[~np.eye(count, dtype=bool)]
    assert distance.min() >= code.shape[1] // 4
    assert (code == language.codewords(count)).all()


def test_grams():
    assert len(language.gram_bins("")) == 0
    assert len(language.gram_bins("é")) == 2 + 1
    assert language.gram_counts("ABC").tolist() == language.gram_counts("abc").tolist()
    assert language.gram_counts("abcabc").sum() == 6 + 5 + 4 + 3


def test_held_out_accuracy(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    rows = language.predicted_languages(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == frame.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    first = language.predicted_languages(frame)
    held = language.fold(F.col("doc_id")) == 0
    spoiled = frame.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    assert sorted(first.collect()) == sorted(language.predicted_languages(spoiled).collect())


def test_edges(spark):
    rows = [(i, "der und die das ist nicht " * 3, "de", 1.0) for i in range(12)]
    rows += [(i, "the and of that is not " * 3, "en", 1.0) for i in range(12, 24)]
    rows += [(30, None, "en", 1.0), (31, "", "en", 0.0), (32, "12 .,!", "en", 0.0), (33, "THE THAT OF", None, 0.0), (None, "und der", None, 0.0), (34, "日本語", None, 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.predicted_languages(frame).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (30, 31, 32)] == ["und"] * 3
    assert [got[i].score for i in (30, 31, 32)] == [0.0] * 3
    assert got[33].lang_pred == "en" and got[None].lang_pred == "de" and got[34].lang_pred in ("de", "en")
    assert all(got[i].lang_pred == ("de" if i < 12 else "en") for i in range(24))
    one = language.predicted_languages(frame.where("lang = 'de'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("de", 1.0)}
    none = language.predicted_languages(frame.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.predicted_languages(frame.limit(0)).collect() == []

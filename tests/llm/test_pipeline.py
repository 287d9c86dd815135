"""The pipeline stage by stage, against what each stage's input says."""

import math
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_personal import base
from test_shingle_join import brute

import corpus_pipeline
from newsweave.llm import mixing, shingle_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = re.compile(r"\[(email|ip|card|phone|login|account)\]")


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame(
        [(90001, None, None, "src1", 0), (90002, "12 - 3", "en", "src1", 6), (None, "the and of", None, None, 10)], docs.schema
    )
    docs = docs.unionByName(odd)
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        results.append((name, docs))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    frames = dict(results)
    given = {r.doc_id: r for r in spark.read.parquet(f"{tables}/documents.parquet").unionByName(odd).collect()}

    language = {r.doc_id: r for r in frames["language"].collect()}
    assert language.keys() == {i for i, r in given.items() if r.text and any(map(str.isalpha, r.text))}
    assert language[None].lang == "en" and all(r.text == given[i].text for i, r in language.items())

    kept = {r.doc_id: r for r in frames["near_duplicates"].collect()}
    groups = brute([(i, r.text) for i, r in language.items()], 5, 80, 100)
    assert kept.keys() == {i for i, _, c in groups if i == c} | {None}

    masked = {r.doc_id: r for r in frames["personal_data"].collect()}
    assert masked.keys() == kept.keys()
    for i, row in masked.items():
        assert base(row.text) == [] and row.n_chars == len(row.text)
        assert (row.text != kept[i].text) == bool(MASK.search(row.text)) or not base(kept[i].text)

    mixed = frames["mixing"]
    sized = frames["personal_data"].select("source", mixing.word_count(F.col("text")).alias("size"))
    targets = {r.source: r for r in mixing.source_targets(sized).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, row in masked.items():
        plan = targets[row.source]
        rate = plan.target / plan.source_size if plan.source_size else 0
        assert counts.get(i, 0) in (math.floor(rate), math.floor(rate) + 1)
    assert {r.text for r in mixed.collect()} <= {r.text for r in masked.values()}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    rows = frames["pieces"].collect()
    assert len(rows) == mixed.count()
    for row in rows:
        assert row.ids == library.encode(masked[row.doc_id].text, add_eos=True)
        assert row.n_tokens == len(row.ids) and row.round_trip


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert rows.count() > 0 and rows.where("not round_trip").count() == 0


def test_one_of_each_keeps_one_row_of_each(spark):
    """Repeated rows, one id with two texts, and copies without an id."""
    one, two, three = (" ".join(f"{word}{i}" for i in range(40)) for word in "abc")
    rows = [
        (1, one), (1, one), (1, one), (3, one + " more"), (3, two), (4, two), (4, two), (None, two), (None, three),
        (None, three), (None, three), (7, ""), (7, ""), (8, ""), (None, ""), (None, None),
    ]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = shingle_join.one_of_each(frame.repartition(5))
    assert got.columns == frame.columns
    expected = [(1, one), (3, two), (None, three), (7, ""), (8, ""), (None, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    assert shingle_join.one_of_each(frame.limit(0)).collect() == []


def test_language_is_predicted_once(spark, tables):
    """A condition on the prediction does not predict again, in a second Python worker of each task."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select(*COLUMNS)
    plan = corpus_pipeline.identify_language(spark, docs, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

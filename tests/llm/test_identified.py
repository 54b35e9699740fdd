"""The pipeline's language stage rejects on evidence only."""

import numpy as np

import corpus_pipeline
from papyra.llm import language_id
from papyra.llm.common import written

DOCS = "doc_id long, text string, lang string"


def test_nothing_learnt_keeps_what_has_letters(spark):
    rows = [(1, "a clean text", None), (2, "another", None), (3, "123 ...", None), (4, None, None), (5, "", None)]
    kept = corpus_pipeline.identify_language(spark, written(spark.createDataFrame(rows, DOCS), "test"), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


def test_close_languages_are_no_reason(spark):
    pieces, langs = ["▁", "a", "b"], ["w", "x", "y", "z"]
    model = pieces, langs, np.full((3, 4), 0.2)  # four languages that are alike: the posterior is 0.25
    rows = [(1, "ab", None), (2, "字字", None), (3, "12", None)]
    frame = spark.createDataFrame(rows, DOCS)
    assert {r.score for r in language_id.identify(frame, model).where("doc_id = 1").collect()} == {0.25}
    kept = language_id.only_identified(frame, model)
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == rows[:1]

"""The corpus pipeline against plain versions of its stages, each on what the one before kept."""

import itertools

from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import language_id, packing
from papyra.llm.common import written
from tests.llm.test_operators import D, dedup_lines, gram_set, plain, similar_groups, without_repeats


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "suffix_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(100_000, "123 456", None, "s", 7), (100_001, None, None, "s", None), (100_002, "", "en", "s", 0)], docs.schema)
    docs = written(docs.unionByName(extra), "test")
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    run = dict(corpus_pipeline.STAGES)
    known = written(run["language_id"](spark, docs, D), "a")
    model = language_id.Models(*language_id.train(docs))
    good = [(d, t) for d, t in pairs(docs) for lang, score in [[x[0] for x in model.texts([t])]] if lang != "und" and score >= 0.5]
    assert plain(pairs(known)) == plain(good) and known.columns == docs.columns

    lines = written(run["line_dedup"](spark, known, D), "b")
    assert plain(pairs(lines)) == plain(dedup_lines(good)) and lines.columns == docs.columns

    single = written(run["ngram_join"](spark, lines, D), "c")
    rows = pairs(lines)
    assert plain(pairs(single)) == plain(r for r, (d, n, c) in zip(rows, similar_groups(rows), strict=True) if not n or d == c) and single.columns == docs.columns
    assert not any(a[0] != b[0] and gram_set(a[1]) and gram_set(a[1]) == gram_set(b[1]) for a, b in itertools.combinations(pairs(single), 2))

    unique = written(run["suffix_dedup"](spark, single, D), "d")
    want = {d: n - gone for d, n, gone, *_ in without_repeats(pairs(single))}
    sizes = {r[0]: r[1] for r in unique.select("doc_id", F.octet_length("text")).collect()}
    assert set(sizes) == set(want) and all(0 <= want[d] - sizes[d] <= 6 * 50 for d in want) and unique.columns == docs.columns

    packed = run["packing"](spark, unique, D).collect()
    assert plain((x.doc_id, x.n_tokens) for x in packed) == plain((d, len((t or "").split())) for d, t in pairs(unique))
    assert {x.padded_tokens for x in packed} == set(packing.bucket_bounds({n: sum(x.n_tokens == n for x in packed) for n in {x.n_tokens for x in packed}}))


def test_run(spark):
    assert corpus_pipeline.run(spark, D).columns == ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch", "slot"]

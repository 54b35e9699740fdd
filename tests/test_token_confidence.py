"""token_confidence against a plain version: every word of every text is a box."""

import re

import pyarrow.parquet as pq

from papyra.plans import catalog

D = "/root/testdata/sf0.001"


def confidence(text):
    words = [w for w in re.split(r"[\t\n\f\r ]+", text or "") if w]
    tokens = set(re.findall(r"[A-Za-z0-9]+", " ".join(words[:2]).upper()))
    sure = [n * 7 % 100 / 100 for n, w in enumerate(words, 1) if n % 5 and re.sub(r"[^A-Za-z0-9]", "", w).upper() in tokens]
    return sum(sure) / len(sure) * 100 if sure else 50.0


def test_all_words_are_boxes(spark, tmp_path):
    late = " ".join(["alpha", "beta", *("x" for _ in range(48)), "alpha"])  # the 51st word is the first one again
    rows = [(1, late), (2, "alpha"), (3, "alpha beta"), (4, "alpha beta gamma"), (5, None), (6, "... !"), (7, "Straße SSE strasse")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.sure for r in catalog.token_confidence(spark, str(tmp_path)).collect()}
    assert found == {1: (7 + 14 + 57) / 3, 2: 7.0, 3: 10.5, 4: 10.5, 5: 50.0, 6: 50.0, 7: 17.5}


def test_whole_table(spark):
    table = pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = {r.doc_id: r.sure for r in catalog.token_confidence(spark, D).collect()}
    want = {r["doc_id"]: confidence(r["text"]) for r in table}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 2e-6 for i in want)

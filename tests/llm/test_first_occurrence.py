"""Different texts under one id, or under none, have a defined first occurrence of each window."""

from papyra.llm import line_dedup


def test_shared_heads_stay_once(spark):
    head = "terms\nof use\nof this page"
    for of in (None, 7):
        rows = [(of, f"{head}\nown line {i}") for i in range(6)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted(r.text for r in line_dedup.line_dedup(frame.repartition(3)).collect())
        whole = [t for t in kept if t.startswith(head)]
        assert len(kept) == 6 and len(whole) == 1 and sorted(t.rpartition("\n")[2] for t in kept) == [f"own line {i}" for i in range(6)]
        assert kept == sorted(r.text for r in line_dedup.line_dedup(frame.repartition(2).orderBy("text", ascending=False)).collect())


def test_copies_of_one_document_stay_alike(spark):
    rows = [(7, "a\nb\nc"), (7, "a\nb\nc")]
    assert [tuple(r) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == rows

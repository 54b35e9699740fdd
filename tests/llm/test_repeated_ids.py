"""Rows that repeat an id, or have none, are rows of their own."""

from papyra.llm import ngram_join

SAY = "one two three four five six seven eight nine ten"


def test_one_of_each_keeps_unlinked_rows(spark):
    rows = [(None, "a river runs past the old mill"), (None, "seven cooks in one small kitchen"), (None, SAY), (None, SAY), (4, SAY.upper() + " "), (4, "quite another text under that id"), (9, "all by itself in here"), (9, "nor is this like any other"), (None, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r[1] != SAY], key=str)


def test_groups_of_null_ids_stay_apart(spark):
    rows = [(None, SAY), (None, SAY), (None, SAY[::-1]), (None, SAY[::-1])]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.text for r in kept) == sorted([SAY, SAY[::-1]])

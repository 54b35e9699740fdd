"""Removal of passages of three or more lines that occurred before, in DataFrame operations only.

Every window of three consecutive lines is hashed. Windows found more than once anywhere keep their first
occurrence, by document id, text and then by position; the lines of every later occurrence are marked, marks that
overlap merge, and the marked lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import id_order, text_or_empty, written

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """owner, body, at and a 128-bit key (w1, w2) of every window that has a line that is not blank.

    The key's halves come from two hashes of each line, with seeds of their own, so lines that share one differ in the other.
    """
    line = lambda x, *seed: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(*seed, x))
    lines = F.split("content", "\n")
    hashed = docs.select("owner", "body", F.transform(lines, lambda x: line(x)).alias("h1"), F.transform(lines, lambda x: line(x, F.lit("second"))).alias("h2")).where(F.size("h1") >= WINDOW)
    at = lambda name, i, k: F.element_at(F.col(name), (i + k).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("h1") - (WINDOW - 1)),
        lambda i: F.struct(
            (i - 1).alias("at"),
            F.xxhash64(*(at("h1", i, k) for k in range(WINDOW))).alias("w1"),
            F.xxhash64(*(at("h2", i, k) for k in range(WINDOW))).alias("w2"),
            F.greatest(*((at("h1", i, k) != 0) for k in range(WINDOW))).alias("any"),
        ),
    )
    return hashed.select("owner", "body", F.explode(windows).alias("w")).where("w.any").select("owner", "body", "w.at", "w.w1", "w.w2")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """df with the repeated lines gone from text_col; n_chars, if there, follows.

    report: instead id_col, n_lines, n_removed and the text that is left, as ``kept``.

    Lines end at ``\\n``; lines of spaces alone, or of nothing, are blank and equal one another (a line of tabs is text), and windows of blank lines alone are never repeats. Texts
    of fewer than three lines stay as they are, a null text stays null. Occurrences in a document with a smaller
    id, or earlier in the same one, come first; a null id is the largest. Different texts under one id, or under none,
    follow each other by the texts' hashes. Rows that repeat an id and a text are one document, so neither removes the
    other's lines. All windows are judged on the input. Helper columns live in a struct of their own, so columns of df
    may have any names.

    Windows are hashed once and written. Their keys are counted with partial aggregation, so a line in a third of the rows
    costs one row a task; only keys found twice are joined, by a join whose hot keys Spark can split. Texts are shuffled once.
    """
    owner, body = id_order(id_col), F.xxhash64(text_or_empty(text_col))
    windows = written(_windows(df.select(owner.alias("owner"), body.alias("body"), text_or_empty(text_col).alias("content"))), "windows")
    first = written(
        windows.groupBy("w1", "w2").agg(F.min(F.struct("owner", "body", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats"
    )
    marked = (
        windows.join(first, ["w1", "w2"])
        .where(F.struct("owner", "body", "at") > F.col("first"))
        .groupBy("owner", "body")
        .agg(F.collect_set("at").alias("at"))
        .select(
            F.col("owner").alias("__owner"),
            F.col("body").alias("__body"),
            F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (WINDOW - 1))))).alias("__gone"),
        )
    )
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), owner.alias("owner"), body.alias("body")).join(
        marked, (F.col("owner") == F.col("__owner")) & (F.col("body") == F.col("__body")), "left"
    )
    content, lines = F.col("row").getField(text_col), F.split(F.col("row").getField(text_col), "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("__gone").isNull(), content).otherwise(F.array_join(rest, "\n"))
    if report:
        return kept.select(
            F.col("row").getField(id_col).alias(id_col),
            F.size(F.split(F.coalesce(content, F.lit("")), "\n")).cast("long").alias("n_lines"),
            F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
            text.alias("kept"),
        )
    kept = kept.withColumn("left", text)
    new = {text_col: F.col("left")} | ({"n_chars": F.length("left").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {})
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))

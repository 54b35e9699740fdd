"""The hash-chained audit ledger: hashes, building, verification, import and reading."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions.text import json_string
from papyra.schema import GENESIS, LEDGER, NOT_DETECTED

#: The hashed fields in the order in which their JSON has them.
HASHED = ("decision", "document_id", "prev_hash", "risk_score", "timestamp")


def record_hash(decision: Column, document_id: Column, prev_hash: Column, risk_score: Column, timestamp: Column) -> Column:
    """SHA-256 of the record's canonical JSON. risk_score is a number's JSON spelling, as text: 15 and 15.0 differ."""
    values = (json_string(decision), json_string(document_id), json_string(prev_hash), F.coalesce(risk_score, F.lit("null")), json_string(timestamp))
    parts = [x for name, value in zip(HASHED, values, strict=True) for x in (F.lit(f'"{name}": '), value, F.lit(", "))]
    return F.sha2(F.concat(F.lit("{"), *parts[:-1], F.lit("}")), 256)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A ledger from a JSON array file: its entries by position, and ``corrupt``, true in one row if the file is damaged.

    A missing file fails; a damaged one isn't taken for an empty chain.
    """
    schema = ", ".join(f.replace("index long", "index long") for f in LEDGER.split(", ")) + ", _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(path)
    return rows.select(*(F.col(f.split()[0]) for f in LEDGER.split(", ")), F.col("_corrupt_record").isNotNull().alias("corrupt"))


def build(records: DataFrame, order: str = "index", prev_hash: str = GENESIS, start: int = 0, key: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """records (order, timestamp, document_id, risk_score as text, decision) as chained entries.

    A chain is serial by nature: each hash has the one before. Without key there is one chain, and its five narrow columns
    go through one task in order, a batch at a time. With key each of its values has a chain of its own, in parallel;
    heads() of those can be chained in turn. A missing document id is the sentinel. Columns named in keep go beside their
    own entry as text and aren't hashed: nothing else tells for sure which record an entry is of.
    """
    columns = ("timestamp", "document_id", "risk_score", "decision")
    keys = [F.col(key).cast("string").alias("chain")] if key else [F.lit("").alias("chain")]
    rows = records.select(*keys, F.col(order).cast("long").alias("at"), *(F.col(c).cast("string").alias(c) for c in (*columns, *keep)))
    rows = rows.withColumn("document_id", F.when(F.col("document_id") != "", F.col("document_id")).otherwise(NOT_DETECTED))
    rows = (rows.repartition("chain") if key else rows.repartition(1)).sortWithinPartitions("chain", "at")

    def run(batches):
        chain, before, n = None, prev_hash, start
        for pdf in batches:
            out = []
            for c, _, timestamp, document_id, score, decision, *kept in pdf.itertuples(index=False):
                if c != chain:
                    chain, before, n = c, prev_hash, start
                score_text = "null" if score is None else score
                text = (
                    f'{{"decision": {json.dumps(decision)}, "document_id": {json.dumps(document_id)}, "prev_hash": {json.dumps(before)}, '
                    f'"risk_score": {score_text}, "timestamp": {json.dumps(timestamp)}}}'
                )
                own = hashlib.sha256(text.encode()).hexdigest()
                out.append((c, before, timestamp, document_id, score, decision, own, n, *kept))
                before, n = own, n + 1
            yield pd.DataFrame(out, columns=["chain", *(f.split()[0] for f in LEDGER.split(", ")), *keep])

    built = rows.mapInPandas(run, ", ".join(["chain string", LEDGER, *(f"`{c}` string" for c in keep)]))
    return built if key else built.drop("chain")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger that append() keeps in folder; an empty one if nothing was ever stored there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark)
        raise


def append(records: DataFrame, folder: str, order: str = "index") -> DataFrame:
    """Chains records on to the ledger stored in folder and gives the entries that were added.

    Its head is found by a maximum over two narrow columns; what is there isn't rewritten, and the new entries come in one
    committed write, so a job that fails leaves the ledger as it was. One writer at a time: a chain has one end.
    """
    spark = records.sparkSession
    last = stored(spark, folder).agg(F.max(F.struct("index", "hash")).alias("last")).first()["last"]
    start = 0 if last is None else last["index"] + 1
    build(records, order, GENESIS if last is None else last["hash"], start).write.mode("append").parquet(folder)
    return stored(spark, folder).where(F.col("index") >= start)


def export(entries: DataFrame, path: str) -> None:
    """Writes the entries as JSON lines in the order of the chain, in one file; risk scores are the numbers that were hashed."""
    text = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    parts = [F.concat(F.lit('"index": '), F.col("index").cast("string"))]
    parts += [F.concat(F.lit(f'"{c}": '), F.coalesce(F.col(c), F.lit("null")) if c == "risk_score" else text(c)) for c in ("prev_hash", "timestamp", "document_id", "risk_score", "decision", "hash")]
    lines = entries.select("index", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("index").select("value").write.mode("errorifexists").text(path)


def heads(chains: DataFrame) -> DataFrame:
    """The last hash and the length of each chain."""
    return chains.groupBy("chain").agg(F.max_by("hash", "index").alias("head"), F.count(F.lit(1)).alias("entries"))


def ranges(entries: DataFrame, order: str = "index", key: str | None = None) -> DataFrame:
    """A row a chain and range of its order: chain, __range, n, first_prev, last (its hash) and broken.

    broken: at, counted from 0 in the range, and linked, of the first entry that doesn't hold by what its range has; a
    range's first entry has its link in first_prev alone. The rows are placed once and only sums of a range leave its task:
    a second placing has other borders, as they come from a sample.
    """
    narrow = entries.select(F.col(key).cast("string").alias("chain") if key else F.lit("").alias("chain"), F.col(order).alias("__order"), *HASHED, "hash")
    narrow = narrow.select("chain", "__order", "prev_hash", "hash", F.coalesce(F.col("hash") == record_hash(*(F.col(n) for n in HASHED)), F.lit(False)).alias("intact"))
    placed = narrow.repartitionByRange("chain", "__order").withColumn("__range", F.spark_partition_id())
    inside = Window.partitionBy("__range", "chain").orderBy("__order", "hash")
    rows = placed.withColumns({"at": F.row_number().over(inside) - 1, "before": F.lag("hash").over(inside)})
    linked = (F.col("at") == 0) | F.coalesce(F.col("prev_hash") == F.col("before"), F.lit(False))
    return rows.groupBy("chain", "__range").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("prev_hash", "at").alias("first_prev"), F.max_by("hash", "at").alias("last"),
        F.min(F.when(~(linked & F.col("intact")), F.struct(F.col("at").cast("long").alias("at"), linked.alias("linked")))).alias("broken"),
    )


def verify(entries: DataFrame, order: str = "index", key: str | None = None) -> DataFrame:
    """is_valid, total_records, broken_at_index and reason: one row, or one a chain. An empty ledger is valid.

    Positions count from 0 in order. Links compare stored hashes, so each chain is checked in ranges of its order, in
    parallel, and a range's first entry with the last hash of the range before.
    """
    earlier = Window.partitionBy("chain").orderBy("__range")
    passed = F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = ranges(entries, order, key).withColumns({"passed": passed, "start": F.row_number().over(earlier) == 1, "before": F.lag("last").over(earlier)})
    linked = F.coalesce(F.col("first_prev") == F.when(F.col("start"), GENESIS).otherwise(F.col("before")), F.lit(False))
    first = F.when(~linked, F.struct(F.col("passed").alias("at"), F.lit(False).alias("linked"))).when(
        F.col("broken").isNotNull(), F.struct((F.col("passed") + F.col("broken.at")).alias("at"), F.col("broken.linked").alias("linked"))
    )
    number = F.col("broken_at_index").cast("string")
    link = F.concat(
        F.lit("Entry "), number, F.lit("'s prev_hash does not match entry "), (F.col("broken_at_index") - 1).cast("string"),
        F.lit("'s actual hash (an entry may have been inserted, removed, or reordered)."),
    )
    content = F.concat(F.lit("Entry "), number, F.lit("'s stored hash does not match its recomputed hash (one of its fields was likely edited after the fact)."))
    found = joined.groupBy(*(["chain"] if key else [])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.min(first).alias("first"))
    return found.withColumn("broken_at_index", F.col("first.at")).select(
        *(["chain"] if key else []),
        F.col("first").isNull().alias("is_valid"),
        "total_records",
        "broken_at_index",
        F.when(F.col("first").isNotNull(), F.when(~F.col("first.linked"), link).otherwise(content)).alias("reason"),
    )


def integrity(entries: DataFrame, order: str = "index") -> DataFrame:
    return verify(entries, order).select("is_valid", "broken_at_index")


def entry(entries: DataFrame, index: int) -> DataFrame:
    """The entry of that index, if there is one; the filter reaches the scan."""
    return entries.where(F.col("index") == index).limit(1)


def oldest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy("index")


def now_utc() -> Column:
    """The current time as the ledger writes it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")

"""Screening of documents as they arrive: each micro-batch is screened like a table and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyra.plans.screen import Config, screen


def screen_stream(documents: DataFrame, known: DataFrame, config: Config, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Screens a stream of documents into Parquet at out, a folder a batch: a batch that runs twice replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        screen(batch, known, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_risk(results: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Screenings and high-risk ones by window of a stream (or table) with time and risk_band; later rows are dropped."""
    rows = results.withWatermark(time, late) if results.isStreaming else results
    return rows.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("risk_band").isin("HIGH", "CRITICAL")).alias("high_risk"))

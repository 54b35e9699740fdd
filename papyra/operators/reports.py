"""Views of screening results and of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.schema import LOW_CONFIDENCE

HIGH = ("HIGH", "CRITICAL")


def dashboard(entries: DataFrame) -> DataFrame:
    """total_screened, high_risk and avg_risk_score (null of an empty ledger); partial aggregates, one row."""
    score = F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0))
    return entries.agg(
        F.count(F.lit(1)).alias("total_screened"), F.count_if(F.upper("decision").isin(*HIGH)).alias("high_risk"), F.bround(F.avg(score), 1).alias("avg_risk_score")
    )


def history(entries: DataFrame) -> DataFrame:
    """Timestamp, document, score and decision, newest first."""
    return entries.orderBy(F.desc("index")).select("timestamp", "document_id", "risk_score", "decision")


def review_queue(results: DataFrame, flagged: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """Results of a HIGH or CRITICAL band that aren't in flagged yet, one a key."""
    rows = results.where(F.col("risk_band").isin(*HIGH)).dropDuplicates([key])
    return rows if flagged is None else rows.join(flagged.select(key), key, "left_anti")


def field_rows(df: DataFrame, key: str = "document_id") -> DataFrame:
    """A row a field: key, field, value, confidence, flagged (low, or below LOW_CONFIDENCE)."""
    rows = df.select(key, "field_confidence", "low_confidence_fields", F.explode("fields").alias("field", "value"))
    confidence = F.coalesce(F.try_element_at("field_confidence", F.col("field")), F.lit(0))
    return rows.select(key, "field", "value", confidence.alias("confidence"), (F.array_contains("low_confidence_fields", F.col("field")) | (confidence < LOW_CONFIDENCE)).alias("flagged"))


def errors_first(issues: Column) -> Column:
    """Errors, then warnings, each in their order."""
    of = lambda severity: F.filter(issues, lambda x: x["severity"] == severity)
    return F.concat(of("error"), of("warning"))


def face_text(is_match: Column, checked: Column) -> Column:
    return F.when(~checked, "not checked").when(is_match, "match").when(~is_match, "no match").otherwise("inconclusive")


def summary(results: DataFrame) -> DataFrame:
    """One line a screening of a results table: type, number, band, score, and the state of each check."""
    return results.select(
        "document_type", "document_number", F.col("risk.risk_band").alias("risk_band"), F.col("risk.risk_score").alias("risk_score"), F.upper("validation.status").alias("validation"),
        F.col("registry_status").alias("registry"), F.upper("tampering.risk_level").alias("tampering"),
        face_text(F.col("face_match.is_match"), F.col("face_match").isNotNull()).alias("face_match"),
    )


def records(results: DataFrame, level: str | None = None, kind: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored screenings by band, document type and time; the filters reach the scan."""
    if level:
        results = results.where(F.col("risk_band") == level)
    if kind:
        results = results.where(F.col("document_type") == kind)
    if since:
        results = results.where(F.col("timestamp") >= since)
    if until:
        results = results.where(F.col("timestamp") < until)
    return results

"""The whole screening of a table of documents."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import Steps, spread
from papyra.operators import extract, ledger, registry, risk, validate
from papyra.schema import RISK_WEIGHTS

FACE = "struct<is_match:boolean,similarity_score:double>"
TAMPERING = "struct<tampering_score:int,risk_level:string,flags:array<string>>"


@dataclass(frozen=True)
class Config:
    """as_of: the day on which documents count as expired. cross_check: whether registered fields are compared."""

    as_of: datetime.date
    cross_check: bool = True
    fuzzy_dates: bool = True
    contained_numbers: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(RISK_WEIGHTS))


def screen(documents: DataFrame, known: DataFrame, config: Config, photos: DataFrame | None = None, finder=None, decoder=None) -> DataFrame:
    """documents with fields, validation, registry_status, record, risk and the rest of a screening.

    documents: document_type and either raw_text (with bounding_boxes, ocr_confidence if there) or fields; optional
    structs tampering and face_match, or an image selfie, which is held against the photo (document_number, reference:
    file bytes) of the registered number. A signal that is missing is left out of the score. A text that can't be
    parsed gives undetected fields, never a failed job.
    """
    rows = spread(documents) if "fields" in documents.columns else extract.extract(documents)
    for name, kind in (("tampering", TAMPERING), ("face_match", FACE)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = validate.validated(rows, config.as_of, config.fuzzy_dates)
    steps = Steps(rows)
    rows = steps.ended("document_number", registry.document_number(F.col("fields"), F.col("document_type"), steps))
    if config.contained_numbers and rows.sparkSession.conf.get("spark.checkpoint.dir", None):
        rows = rows.checkpoint()  # the search for contained numbers uses the rows twice; extraction need not run again
    rows = registry.lookup(rows, known, "document_number", config.contained_numbers)
    if "selfie" in rows.columns:
        rows = _faced(rows, photos, finder, decoder)
    if config.cross_check:
        steps = Steps(rows)
        rows = steps.ended("validation", validate.with_mismatches(F.col("validation"), registry.mismatches(F.col("fields"), F.col("record"), steps), steps))
    tampering, face = F.col("tampering.tampering_score").cast("double"), F.col("face_match.similarity_score")
    return risk.with_risk(rows, "risk", *risk.of_validation(F.col("validation")), F.col("registry_status"), tampering, face, config.weights)


def _faced(rows: DataFrame, photos: DataFrame | None, finder, decoder) -> DataFrame:
    """rows with face_match of their selfie and the registered photo of their number."""
    from papyra.sources import face_detection, images

    if photos is None:
        rows = rows.withColumn("__reference", F.lit(None).cast("binary"))
    else:
        own = photos.select(F.col("document_number").alias("__of"), F.col("reference").alias("__reference"))
        rows = rows.join(own, F.col("record.document_number") == F.col("__of"), "left").drop("__of")
    rows = images.preprocess(rows, "__reference", *((decoder.most_side, decoder.image) if decoder else ()), stages=("original",)).withColumnRenamed("original", "__photo_image")
    return face_detection.match_of(rows, "__photo_image", "selfie", finder).drop("__photo_image", "__reference", "image_error")


def ledger_entries(results: DataFrame, timestamp: str, order: str, prev_hash: str | None = None, start: int = 0) -> DataFrame:
    """The screenings as entries of one chain, once each, in the order of a column; timestamp names a text column."""
    rows = results.select(
        F.col(order).alias("index"), F.col(timestamp).alias("timestamp"), F.col("document_number").alias("document_id"),
        F.col("risk.risk_score").cast("string").alias("risk_score"), F.col("risk.risk_band").alias("decision"),
    )
    return ledger.build(rows, "index", **({"prev_hash": prev_hash} if prev_hash else {}), start=start)

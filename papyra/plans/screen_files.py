"""Screening from files: upload checks, preprocessing, recognition, detectors and faces, then the screening of a table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import forensics
from papyra.plans.screen import Config, screen
from papyra.sources import face_detection, images, pixels

STAGE_ERRORS = "array<struct<stage:string,error:string>>"


@dataclass(frozen=True)
class Backends:
    """What reads images, text and faces; None is what needs no library, or tesseract."""

    image: Any = None
    engine: Any = None
    finder: Any = None
    most_side: int = images.MAX_SIDE


def upload_documents(files: DataFrame, backends: Backends = Backends(), name: str = "path", content: str = "content") -> DataFrame:  # noqa: B008
    """files with ``upload`` (the check of name and size), the images of preprocessing and image_error; rejected files aren't decoded."""
    own = files.withColumn("upload", images.check_upload(F.col(name), F.length(content).cast("long")))
    own = own.withColumn("__read", F.when(F.col("upload.is_valid"), F.col(content)))
    rows = images.preprocess(own, "__read", backends.most_side, backends.image)
    said = F.when(F.col("upload.is_valid"), F.col("image_error")).otherwise(F.array_join("upload.errors", " "))
    return rows.withColumn("image_error", said).drop("__read")


def upload_selfies(files: DataFrame, backends: Backends = Backends(), content: str = "content") -> DataFrame:  # noqa: B008
    """files with ``selfie``, the decoded image, and selfie_error; they are decoded and not checked otherwise."""
    rows = images.preprocess(files.withColumnRenamed("image_error", "__image_error"), content, backends.most_side, backends.image, ("original",))
    return rows.withColumnsRenamed({"original": "selfie", "image_error": "selfie_error", "__image_error": "image_error"})


def screen_files(documents: DataFrame, known: DataFrame, config: Config, photos: DataFrame | None = None, backends: Backends = Backends()) -> DataFrame:  # noqa: B008
    """A screening of document files, with ``errors``: the stages that failed, by name, and why.

    documents: path, content, document_type, document_id; optional selfie (file bytes). photos: document_number and
    reference (file bytes), the registry's photos, which selfies are held against; without one a selfie matches nothing.
    A stage that fails leaves its signal out, or undetected fields; no row is lost and no job fails.
    """
    rows = upload_documents(documents, backends)
    rows = images.recognise(rows, "enhanced", backends.engine)
    rows = rows.withColumns({"raw_text": F.col("ocr.raw_text"), "ocr_confidence": images.ocr_confidence(), "bounding_boxes": images.ocr_boxes()})
    rows = pixels.detectors(rows, "resized").withColumn("__photo", face_detection.photo_of(F.col("resized"), backends.finder))
    meta = forensics.metadata(forensics.exif_of(F.when(F.col("upload.is_valid"), F.col("content"))))
    found = forensics.tampering(forensics.photo_substitution(F.col("__photo.ela_ratio"), F.col("__photo.noise_ratio")), F.col("text_manipulation"), F.col("stamp_forgery"), meta)
    rows = rows.withColumn("tampering", F.when(F.col("resized.data").isNotNull(), found))
    if "selfie" in documents.columns:
        rows = rows.withColumnRenamed("selfie", "__selfie_file")
        rows = upload_selfies(rows, backends, "__selfie_file")
    else:
        rows = rows.withColumns({"selfie": F.lit(None).cast(images.IMAGE), "selfie_error": F.lit(None).cast("string")})
    failed = {"upload": F.col("image_error"), "recognition": F.when(F.col("image_error").isNull(), F.col("ocr.error")), "photo": F.col("__photo.error")}
    rows = rows.withColumn("__failed", F.array(*(F.struct(F.lit(k).alias("stage"), v.alias("error")) for k, v in failed.items())))
    out = screen(rows.drop("image_error"), known, config, photos=photos, finder=backends.finder, decoder=backends)
    faces = F.array(F.struct(F.lit("selfie").alias("stage"), F.when(F.col("selfie.data").isNull(), F.col("selfie_error")).alias("error")), F.struct(F.lit("faces").alias("stage"), F.col("face_error").alias("error")))
    absent = F.lit("ValueError: no file")
    errors = F.filter(F.concat("__failed", faces), lambda x: x["error"].isNotNull() & ~((x["stage"] == "selfie") & (x["error"] == absent)))
    return out.withColumn("errors", errors.cast(STAGE_ERRORS)).drop("__failed", "__photo", "__selfie_file", "selfie_error", "face_error")

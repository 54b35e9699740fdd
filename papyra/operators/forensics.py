"""Tampering scores from what image detectors measured, and EXIF metadata from file bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import clamp, strip, to_int
from papyra.schema import EDITORS, TAMPERING_WEIGHTS

EXIF = "struct<has_exif:boolean,software:string,taken:string,changed:string,error:string>"
NO_EXIF = (
    "No EXIF metadata found. Common for scans/screenshots and not conclusive on its own, but also consistent with metadata having been stripped after editing."
)


def detector(confidence: Column, limit: float = 0.5, suspicious: Column | None = None) -> Column:
    """is_suspicious and confidence; a detector that gave nothing is not suspicious, 0."""
    value = F.coalesce(confidence.cast("double"), F.lit(0.0))
    return F.struct((value >= limit if suspicious is None else suspicious).alias("is_suspicious"), value.alias("confidence"))


def photo_substitution(ela_ratio: Column, noise_ratio: Column) -> Column:
    """From the ratios of compression error and of noise, photo to background; no photo (null) is not suspicious."""
    part = lambda ratio, scale, weight: F.abs(F.ln(F.when(ratio > 0, ratio))) / scale * weight
    total = part(ela_ratio, 2.0, 0.6) + part(noise_ratio, 3.0, 0.4)
    return detector(F.when(total.isNotNull(), F.bround(F.least(F.lit(1.0), total), 3)))


def font_consistency(deviation: Column, median_height: Column, outliers: Column, glyphs: Column) -> Column:
    """From the mean baseline deviation, the median glyph height and the outliers among the glyphs (fewer than 6: 0)."""
    drift = F.least(F.lit(1.0), deviation / (0.5 * median_height))
    share = F.least(F.lit(1.0), 5.0 * outliers / glyphs)
    return detector(F.when(glyphs >= 6, F.bround(0.6 * drift + 0.4 * share, 3)).otherwise(0.0))


def stamp_forgery(flagged: Column, candidates: Column) -> Column:
    """The share of stamp candidates that look irregular."""
    return detector(F.when(candidates > 0, F.bround(flagged / candidates, 3)).otherwise(0.0))


def editor_in(software: Column) -> Column:
    """The software's name if it is a known editor's, else null."""
    text = strip(software)
    known = F.lit(False)
    for name in EDITORS:
        known = known | F.contains(F.lower(text), F.lit(name))
    return F.when(known, text)


def metadata(exif: Column) -> Column:
    """has_exif, editing_software_detected, date_inconsistency, is_suspicious, confidence and notes of parsed EXIF."""
    editor = editor_in(exif["software"])
    time = lambda c: F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss"))
    late = F.coalesce(F.unix_timestamp(time(exif["changed"])) - F.unix_timestamp(time(exif["taken"])) > 3600, F.lit(False))
    score = F.bround(F.least(F.lit(1.0), F.when(editor.isNotNull(), 0.7).otherwise(0.0) + F.when(late, 0.3).otherwise(0.0)), 3)
    has = exif["has_exif"]
    confidence = F.when(has, score).when(~has, 0.15).otherwise(0.0)
    notes = F.array_compact(
        F.array(
            F.when(editor.isNotNull(), F.concat(F.lit("EXIF 'Software' tag indicates editing with: "), editor, F.lit("."))),
            F.when(late, "File's modification timestamp is significantly later than its original capture timestamp."),
        )
    )
    said = (
        F.when(has, F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("EXIF metadata present with no editing-software signature or timestamp inconsistency detected."))))
        .when(~has, F.array(F.lit(NO_EXIF)))
        .otherwise(F.array(F.coalesce(F.concat(F.lit("Metadata analysis failed: "), exif["error"]), F.lit("No original file path provided; metadata analysis skipped."))))
    )
    return F.struct(
        has.alias("has_exif"), F.when(has, editor).alias("editing_software_detected"), F.coalesce(has & late, F.lit(False)).alias("date_inconsistency"),
        F.coalesce(has & (confidence >= 0.5), F.lit(False)).alias("is_suspicious"), confidence.alias("confidence"), said.alias("notes"),
    )


def tampering(photo: Column, text: Column, stamp: Column, meta: Column) -> Column:
    """tampering_score, risk_level and flags of the four detectors; weights are not scaled up for a missing one."""
    parts = dict(zip(TAMPERING_WEIGHTS, (photo, text, stamp, meta), strict=True))
    total = F.lit(0.0)
    for name, weight in TAMPERING_WEIGHTS.items():
        total = total + F.lit(weight) * F.coalesce(parts[name]["confidence"], F.lit(0.0))
    score = to_int(clamp(total, 0.0, 1.0) * 100)
    flags = F.array_compact(F.array(*(F.when(p["is_suspicious"], F.lit(n)) for n, p in parts.items())))
    return F.struct(score.alias("tampering_score"), F.when(score >= 60, "high").when(score >= 30, "medium").otherwise("low").alias("risk_level"), flags.alias("flags"))


# -- EXIF --------------------------------------------------------------------------------------------------------


def _tags(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """A directory of a TIFF block: tag to type, count and value bytes."""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    (count,) = struct.unpack_from(f"{order}H", data, at)
    out = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        size = sizes.get(kind, 1) * n
        start = at + 2 + 12 * i + 8
        if size > 4:
            (start,) = struct.unpack_from(f"{order}I", data, start)
        out[tag] = (kind, n, data[start : start + size])
    return out


def read_exif(content: bytes | None) -> dict:
    """EXIF tags that screening uses, of a JPEG or PNG file's bytes; no file, and damage, are told apart from no EXIF."""
    none = {"has_exif": None, "software": None, "taken": None, "changed": None, "error": None}
    if content is None:
        return none
    try:
        block = None
        if content[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
                (size,) = struct.unpack_from(">H", content, at + 2)
                if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                    block = content[at + 10 : at + 2 + size]
                    break
                at += 2 + size
        elif content[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(content):
                (size,) = struct.unpack_from(">I", content, at)
                if content[at + 4 : at + 8] == b"eXIf":
                    block = content[at + 8 : at + 8 + size]
                    break
                at += 12 + size
        else:
            raise ValueError("cannot identify image file")
        if not block:
            return none | {"has_exif": False}
        order = {b"II": "<", b"MM": ">"}[block[:2]]
        (first,) = struct.unpack_from(f"{order}I", block, 4)
        tags = _tags(block, first, order)
        more = _tags(block, struct.unpack(f"{order}I", tags[0x8769][2][:4])[0], order) if 0x8769 in tags else {}
        text = lambda t: t[2].split(b"\0")[0].decode("latin-1") if t else None
        # the capture time belongs to the sub-directory; only tags of the main one count, as screening reads them
        return none | {"has_exif": bool(tags), "software": text(tags.get(0x0131)), "changed": text(tags.get(0x0132)), "taken": text(tags.get(0x9003) or more.get(0x9003))}
    except (ValueError, KeyError, struct.error) as error:
        return none | {"error": str(error)}


def _read_all(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_exif(None if x is None else bytes(x)) for x in content], columns=["has_exif", "software", "taken", "changed", "error"])


def exif_of(content: Column) -> Column:
    """read_exif of a column of file bytes, as a struct."""
    return F.pandas_udf(_read_all, EXIF)(content)

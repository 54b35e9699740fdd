"""Face comparison over detected faces and embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import clamp

SHOWN_MATCH = 50.0
#: Largest distance of two embeddings of one person.
MATCH_DISTANCE = 0.6
#: Least composite similarity of the gradient comparison that is a match.
COMPOSITE_MATCH = 0.58


def largest_face(faces: Column) -> Column:
    """Of boxes with width and height, the one of the largest area, the first if several; null of none."""
    ranked = F.transform(faces, lambda f, i: F.struct((f["width"].cast("long") * f["height"]).alias("area"), (-i).alias("place"), f.alias("face")))
    best = F.array_max(F.transform(ranked, lambda r: F.struct(r["area"], r["place"])))
    return F.try_element_at(faces, (1 - best["place"]).cast("int"))


def box_to_location(box: Column) -> Column:
    return F.struct(box["top"].alias("top"), (box["left"] + box["width"]).alias("right"), (box["top"] + box["height"]).alias("bottom"), box["left"].alias("left"))


def location_to_box(location: Column) -> Column:
    return F.struct(
        location["left"].alias("left"), location["top"].alias("top"), (location["right"] - location["left"]).alias("width"), (location["bottom"] - location["top"]).alias("height")
    )


def crop_box(box: Column, width: Column, height: Column, margin: float = 0.15) -> Column:
    """x0, y0, x1, y1 of the box with a margin, inside the image."""
    mx, my = F.floor(box["width"] * margin), F.floor(box["height"] * margin)
    return F.struct(
        F.greatest(F.lit(0), box["left"] - mx).alias("x0"), F.greatest(F.lit(0), box["top"] - my).alias("y0"),
        F.least(width, box["left"] + box["width"] + mx).alias("x1"), F.least(height, box["top"] + box["height"] + my).alias("y1"),
    )


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two embeddings of equal length, in double precision; null if lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), 1.0 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def similarity(distance: Column, limit: float = MATCH_DISTANCE) -> Column:
    """0 to 100, 50 at the limit; 0 for a limit that isn't positive."""
    if limit <= 0:
        return F.when(distance.isNotNull(), 0.0)
    return F.bround(clamp(SHOWN_MATCH * (2.0 - distance / limit)), 1)


def composite(fine: Column, medium: Column, coarse: Column) -> Column:
    return 0.45 * fine + 0.35 * medium + 0.20 * coarse


def composite_similarity(best: Column) -> Column:
    """80 to 85 from the matching composite up, else 0."""
    mapped = F.least(F.lit(85.0), 80.0 + (best - COMPOSITE_MATCH) / (1.0 - COMPOSITE_MATCH) * 5.0)
    return F.when(best >= COMPOSITE_MATCH, F.bround(mapped, 1)).otherwise(F.when(best.isNotNull(), 0.0))


def compare(
    has_reference: Column, reference_faces: Column, selfie_faces: Column, distance: Column, error: Column | None = None, limit: float = MATCH_DISTANCE, backend: str = "embedding"
) -> Column:
    """The verdict ladder: no reference, a failure, no face, then the distance of the largest faces' embeddings.

    Without a reference photo the similarity is 0; without a face it is null and the answer is no; a failure (error) answers
    neither. More than one face on either side is flagged.
    """
    error = F.lit(None).cast("string") if error is None else error
    failed = has_reference & error.isNotNull()
    found = lambda n: F.coalesce(n, F.lit(0))
    both = has_reference & ~failed & (found(reference_faces) > 0) & (found(selfie_faces) > 0)
    faceless = has_reference & ~failed & ~both
    like = similarity(distance, limit)
    many = lambda n, where: F.concat(F.lit("Multiple faces ("), n.cast("string"), F.lit(f") detected in the {where}; used the largest face region."))
    notes = F.array_compact(
        F.array(
            F.when(~has_reference, "Document record / reference photo not found in database — face match set to 0.0%."),
            F.when(has_reference & ~failed, "Compared uploaded selfie against official high-resolution database reference face photo."),
            F.when(faceless & (found(reference_faces) == 0), "No human face detected in the document photo."),
            F.when(faceless & (found(selfie_faces) == 0), "No valid human face detected in the uploaded photo/selfie — please upload a clear human face photo."),
            F.when(both & (reference_faces > 1), many(reference_faces, "document photo")),
            F.when(both & (selfie_faces > 1), many(selfie_faces, "selfie")),
        )
    )
    return F.struct(
        F.when(~has_reference | faceless, False).when(both, like >= SHOWN_MATCH).alias("is_match"),
        F.when(~has_reference, 0.0).when(both, like).alias("similarity_score"),
        F.lit(SHOWN_MATCH).alias("threshold"),
        F.lit(backend).alias("backend_used"),
        F.when(both, distance).alias("raw_distance"),
        F.when(has_reference, found(reference_faces)).otherwise(0).alias("document_face_count"),
        F.when(has_reference, found(selfie_faces)).otherwise(0).alias("selfie_face_count"),
        (both & ((reference_faces > 1) | (selfie_faces > 1))).alias("multiple_faces_flagged"),
        faceless.alias("no_face_detected"),
        F.when(has_reference, error).alias("error"),
        notes.alias("notes"),
    )

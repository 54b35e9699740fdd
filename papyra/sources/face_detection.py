"""Faces in images: search by passes, the largest one, its embedding, and the comparison of two photos.

Trained detectors and embedders are backends: a finder gives boxes in a grey image and says whether it sees eyes, an
embedder turns a face crop into a vector. Without a finder the passes that need none remain, the search for regions of
the colour of skin and, in documents, the place where a photo usually is; without an embedder the even pixels stand in.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.faces import COMPOSITE_MATCH
from papyra.sources.enhance import photo_ratios
from papyra.sources.images import _unpacked, grayscale
from papyra.sources.pixels import SKIN, _counts, face_composite, labelled, normalised_face, skin_share

BOX = "struct<left:int,top:int,width:int,height:int>"
FACES = f"struct<face_count:int,face:{BOX},encoding:array<float>,error:string>"
PHOTO = f"struct<ela_ratio:double,noise_ratio:double,region:{BOX},error:string>"
COMPARED = "struct<document_faces:int,selfie_faces:int,composite:double,error:string>"
# Results depend on them.
LEAST_FACE, SKIN_ENOUGH = 15, 0.04
LARGE_SIDE = 250
REGION_SHARE, REGION_SHAPE = (0.002, 0.45), (0.6, 2.0)
PHOTO_PLACE, DOCUMENT_SIZE = (0.05, 0.08, 0.35, 0.55), (350, 250)
#: Parts of an image that are searched by themselves: left, top, width and height as shares.
QUARTERS = ((0.0, 0.0, 0.55, 0.65), (0.45, 0.0, 0.55, 0.65), (0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 0.5, 1.0))
#: Step of scale, neighbours and least side of the searches: plain, evened, and evened in a part.
SEARCHES = {"plain": (1.1, 3, 25), "even": (1.05, 2, 20), "part": (1.03, 2, 18)}


class Finder(Protocol):
    def find(self, grey: np.ndarray, scale: float, neighbours: int, least: int) -> list[dict]:
        """Boxes (left, top, width, height) of what looks like a face."""

    def eyes(self, grey: np.ndarray) -> bool:
        """Whether the crop of a face shows eyes."""


def even(grey: np.ndarray) -> np.ndarray:
    """The image with a level histogram: each value goes to its share of the darker ones."""
    counts = np.bincount(grey.ravel(), minlength=256)
    below = np.cumsum(counts)
    first = int(below[np.flatnonzero(counts)[0]])
    if first == grey.size:
        return grey
    return np.clip(np.rint((below - first) * 255 / (grey.size - first)), 0, 255).astype(np.uint8)[grey]


def inside(image: np.ndarray, box: dict) -> np.ndarray:
    return image[max(0, box["top"]) : max(0, box["top"] + box["height"]), max(0, box["left"]) : max(0, box["left"] + box["width"])]


def crop(image: np.ndarray, box: dict, margin: float = 0.15) -> np.ndarray:
    """The box with a margin, inside the image; the whole image if nothing of it is."""
    dx, dy = int(box["width"] * margin), int(box["height"] * margin)
    own = image[max(0, box["top"] - dy) : max(0, box["top"] + box["height"] + dy), max(0, box["left"] - dx) : max(0, box["left"] + box["width"] + dx)]
    return own if own.size else image


def is_face(image: np.ndarray, box: dict, finder: Finder | None = None) -> bool:
    """Whether a box is large enough and shows eyes or enough skin."""
    own = inside(image, box)
    if min(own.shape[:2]) < LEAST_FACE:
        return False
    return (finder is not None and finder.eyes(even(grayscale(own)))) or skin_share(own) >= SKIN_ENOUGH


def _skin_regions(image: np.ndarray) -> list[dict]:
    """Boxes of parts of the colour of skin that have a face's size and shape, by their place from the top."""
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    light = 0.299 * r + 0.587 * g + 0.114 * b
    red, blue = np.rint((r - light) * 0.713 + 128), np.rint((b - light) * 0.564 + 128)
    mask = (red >= SKIN[0][0]) & (red <= SKIN[0][1]) & (blue >= SKIN[1][0]) & (blue <= SKIN[1][1])
    mask = _counts(~mask, 3, 3) == 0  # specks go, what is left grows by two
    labels, n = labelled(_counts(mask, 5, 5) > 0)
    if not n:
        return []
    y, x = np.nonzero(labels)
    own = pd.DataFrame({"part": labels[y, x], "x": x, "y": y}).groupby("part").agg(left=("x", "min"), right=("x", "max"), top=("y", "min"), low=("y", "max"), area=("x", "size"))
    out = []
    for left, right, top, low, area in own.itertuples(index=False):
        width, height = int(right - left + 1), int(low - top + 1)
        if REGION_SHARE[0] <= area / labels.size <= REGION_SHARE[1] and REGION_SHAPE[0] <= height / width <= REGION_SHAPE[1]:
            out.append({"left": int(left), "top": int(top), "width": width, "height": height})
    return out


def find_faces(image: np.ndarray, finder: Finder | None = None, is_document: bool = False) -> list[dict]:
    """Boxes of faces: the first pass that finds any decides.

    The passes: the finder in the grey image, then in the evened one; in parts of a large image; one region of skin; and
    in a document the usual place of the photo, which is taken unseen.
    """
    if image is None or not image.size:
        return []
    height, width = image.shape[:2]
    grey, large = grayscale(image), max(height, width) > LARGE_SIDE
    good = lambda boxes: [b for b in boxes if is_face(image, b, finder)]
    if finder is not None:
        level = even(grey)
        for kind, page in (("plain", grey), ("even", level)):
            if found := good(finder.find(page, *SEARCHES[kind])):
                return found
        for x, y, w, h in QUARTERS if large else ():
            left, top, wide, high = int(width * x), int(height * y), int(width * w), int(height * h)
            if min(wide, high) >= 20:
                part = even(grey[top : top + high, left : left + wide])
                boxes = [{**b, "left": b["left"] + left, "top": b["top"] + top} for b in finder.find(part, *SEARCHES["part"])]
                if found := good(boxes):
                    return found
    if large and image.ndim == 3:
        for box in _skin_regions(image):
            if is_face(image, box, finder):
                return [box]
    if is_document and width > DOCUMENT_SIZE[0] and height > DOCUMENT_SIZE[1]:
        x, y, w, h = PHOTO_PLACE
        return [{"left": int(width * x), "top": int(height * y), "width": int(width * w), "height": int(height * h)}]
    return []


def largest(faces: list[dict]) -> dict | None:
    return max(faces, key=lambda b: b["width"] * b["height"], default=None)


def encoding(image: np.ndarray, face: dict | None, embedder=None) -> np.ndarray | None:
    """The embedding of a face's crop; without an embedder its even pixels, which are no biometric embedding."""
    if face is None:
        return None
    own = crop(image, face)
    return np.asarray(embedder(own), dtype=np.float32).ravel() if embedder else normalised_face(own).ravel().astype(np.float32) / 255


# -- columns -----------------------------------------------------------------------------------------------------


def _rows(images: pd.DataFrame):
    return (None if pd.isna(r["height"]) or r["data"] is None else _unpacked(r) for r in images.to_dict("records"))


def _safely(function, empty: dict):
    """function of what a row has, with error; a failure is that row's result."""

    def run(*row) -> dict:
        try:
            return empty | function(*row) | {"error": None}
        except Exception as error:  # noqa: BLE001  a row's failure is that row's result
            return empty | {"error": f"{type(error).__name__}: {error}"}

    return run


def faces_of(image: Column, finder: Finder | None = None, is_document: bool = False, embedder=None, encode: bool = False) -> Column:
    """face_count, face (the largest), encoding (if asked for) and error of a column of images."""

    def one(own) -> dict:
        if own is None:
            return {}
        found = find_faces(own, finder, is_document)
        face = largest(found)
        vector = encoding(own, face, embedder) if encode else None
        return {"face_count": len(found), "face": face, "encoding": None if vector is None else vector.tolist()}

    safe = _safely(one, {"face_count": 0, "face": None, "encoding": None})

    @F.pandas_udf(FACES)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([safe(x) for x in _rows(images)], columns=["face_count", "face", "encoding", "error"])

    return run(image)


def photo_of(image: Column, finder: Finder | None = None) -> Column:
    """ela_ratio and noise_ratio for forensics.photo_substitution, the region and error; null where the finder sees no face."""

    def one(own) -> dict:
        face = None if own is None or finder is None else largest(finder.find(grayscale(own), 1.1, 5, 40))
        return photo_ratios(own, face) if face is not None else {}

    safe = _safely(one, {"ela_ratio": None, "noise_ratio": None, "region": None})

    @F.pandas_udf(PHOTO)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([safe(x) for x in _rows(images)], columns=["ela_ratio", "noise_ratio", "region", "error"])

    return run(image)


def compared(reference: Column, selfie: Column, finder: Finder | None = None) -> Column:
    """Faces in a reference photo and a selfie, and the gradient composite of the largest ones, for faces.composite_similarity."""

    def one(left, right) -> dict:
        if left is None or right is None:
            return {}
        faces = find_faces(left, finder, True), find_faces(right, finder)
        both = [largest(f) for f in faces]
        value = face_composite(crop(left, both[0]), crop(right, both[1])) if all(both) else None
        return {"document_faces": len(faces[0]), "selfie_faces": len(faces[1]), "composite": value}

    safe = _safely(one, {"document_faces": 0, "selfie_faces": 0, "composite": None})

    @F.pandas_udf(COMPARED)
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([safe(a, b) for a, b in zip(_rows(left), _rows(right), strict=True)], columns=["document_faces", "selfie_faces", "composite", "error"])

    return run(reference, selfie)


def match_of(rows: DataFrame, reference: str, selfie: str, finder: Finder | None = None) -> DataFrame:
    """rows with face_match by gradients, as screening takes it: null without a selfie, no match at 0.0 without a reference."""
    own = rows.withColumn("__c", compared(F.col(reference), F.col(selfie), finder))
    value, known = F.col("__c.composite"), F.col(f"{reference}.data").isNotNull()
    like = F.when(value >= COMPOSITE_MATCH, F.bround(F.least(F.lit(85.0), 80.0 + (value - COMPOSITE_MATCH) / (1.0 - COMPOSITE_MATCH) * 5.0), 1)).otherwise(F.when(value.isNotNull(), 0.0))
    score = F.when(~known, 0.0).otherwise(like)
    verdict = F.struct((F.coalesce(score, F.lit(0.0)) >= 50.0).alias("is_match"), score.alias("similarity_score"))
    return own.withColumn("face_match", F.when(F.col(f"{selfie}.data").isNotNull() & F.col("__c.error").isNull(), verdict)).withColumn("face_error", F.col("__c.error")).drop("__c")

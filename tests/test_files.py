"""Images and files without a library: decoding, enhancement, error levels, faces, screening; stored ledgers and registries."""

import datetime
import hashlib
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import ledger, registry
from papyra.plans import catalog
from papyra.plans.screen import Config
from papyra.plans.screen_files import Backends, screen_files
from papyra.schema import GENESIS
from papyra.sources import enhance, face_detection, images


def png(image):
    """A colour PNG file, each line under another filter."""
    height, width, n = image.shape
    raw, above = b"", np.zeros(width * n, int)
    for y in range(height):
        line = image[y, :, ::-1].reshape(-1).astype(int)
        left, corner = (np.concatenate([np.zeros(n, int), x[:-n]]) for x in (line, above))
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        guess = (0 * line, left, above, (left + above) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner)))[y % 5]
        raw += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def page(skin=True):
    image = np.full((300, 420, 3), 235, np.uint8)
    for y in range(40, 260, 24):
        image[y : y + 8, 200:400] = 25
    if skin:
        image[70:190, 40:130] = (120, 150, 205)
    return image


class Finder:
    """Sees the skin of page()."""

    def find(self, grey, scale, neighbours, least):
        return [{"left": 40, "top": 70, "width": 90, "height": 120}] if grey.shape == (300, 420) else []

    def eyes(self, grey):
        return False


class Engine:
    def read(self, image):
        return {"raw_text": "Name : JANE DOE\nDocument No : X0000123\nDate of Expiry : 20-01-2030", "confidence": 0.9, "bounding_boxes": [], "error": None}


def test_files_are_decoded():
    image = np.random.default_rng(1).integers(0, 256, (23, 17, 3), dtype=np.uint8)
    assert np.array_equal(enhance.decode(png(image)), image)
    assert np.array_equal(enhance.decode(b"P6 17 23 255\n" + image[..., ::-1].tobytes()), image)
    assert np.array_equal(enhance.decode(b"P5\n17\n23\n255\n" + image[..., 0].tobytes()), image[..., 0])
    for broken in (png(image)[:60], b"", b"text", b"P6 17 23 255\nxx"):
        with pytest.raises(ValueError):
            enhance.decode(broken)


def test_enhancement():
    clean = np.full((90, 130), 230, np.uint8)
    clean[20:28, 20:110] = clean[50:58, 20:110] = 30
    noisy = np.clip(clean + np.random.default_rng(2).normal(0, 8, clean.shape), 0, 255).astype(np.uint8)
    apart = lambda x: np.abs(x.astype(int) - clean).mean()
    assert apart(enhance.denoise(noisy)) < 0.3 * apart(noisy)
    text = images.grayscale(page(False))
    for degrees in (4.0, -7.0):
        assert abs(enhance.skew(enhance.rotated(text, -degrees)) - degrees) < 0.4
    assert enhance.deskew(text) is text and abs(enhance.skew(enhance.deskew(enhance.rotated(text, 5.0)))) < 0.5
    flat = np.full((64, 64, 3), 90, np.uint8)
    assert np.ptp(enhance.contrast(flat).reshape(-1, 3), axis=0).max() == 0 and enhance.contrast(page()).shape == page().shape
    dull = (page() // 8 + 100).astype(np.uint8)
    assert images.grayscale(enhance.contrast(dull)).std() > images.grayscale(dull).std()


def test_error_levels():
    c = enhance._cosines()
    assert np.allclose(c @ c.T, np.eye(8))
    assert enhance._steps(enhance.LIGHT_STEPS, 50).tolist()[0] == [16, 11, 10, 16, 24, 40, 51, 61] and (enhance._steps(enhance.COLOUR_STEPS, 100) == 1).all()
    noise = np.random.default_rng(3).integers(0, 256, (40, 40, 3), dtype=np.uint8)
    assert enhance.error_level(np.full((16, 24, 3), 100, np.uint8))["mean"] == 0.0
    assert enhance.error_level(noise, 90)["mean"] < enhance.error_level(noise, 20)["mean"] and enhance.error_level(noise)["map"].max() >= 254
    assert np.array_equal(enhance.recompressed(enhance.recompressed(page(False))), enhance.recompressed(page(False)))
    assert enhance.photo_region({"left": 10, "top": 10, "width": 50, "height": 100}, 150, 300) == {"left": 0, "top": 0, "width": 80, "height": 150}
    pasted = page(False)
    pasted[70:190, 40:130] = np.random.default_rng(4).integers(0, 256, (120, 90, 3))
    ratios = enhance.photo_ratios(pasted, {"left": 40, "top": 70, "width": 90, "height": 120})
    assert ratios["ela_ratio"] > 2 and ratios["noise_ratio"] > 2


def test_faces_by_passes():
    box = {"left": 40, "top": 70, "width": 90, "height": 120}
    assert face_detection.find_faces(page(), Finder()) == [box]
    found = face_detection.find_faces(page())
    assert len(found) == 1 and abs(found[0]["left"] - 40) <= 2 and abs(found[0]["height"] - 120) <= 4
    assert face_detection.find_faces(page(False)) == [] and face_detection.find_faces(None) == []
    assert face_detection.find_faces(page(False), None, True) == [{"left": 21, "top": 24, "width": 147, "height": 165}]
    assert not face_detection.is_face(page(), {"left": 60, "top": 90, "width": 14, "height": 40}) and face_detection.is_face(page(), box)
    assert face_detection.encoding(page(), box).shape == (150 * 150,) and face_detection.encoding(page(), None) is None
    assert face_detection.encoding(page(), box, lambda crop: [len(crop)]).tolist() == [120 + 2 * 18]
    assert face_detection.even(np.full((5, 5), 9, np.uint8)).max() == 9 and face_detection.even(np.array([[10, 20], [30, 40]], np.uint8)).tolist() == [[0, 85], [170, 255]]


def test_engines(spark, monkeypatch):
    square = lambda x, y: [(x, y), (x + 9, y), (x + 9, y + 5), (x, y + 5)]
    read = images.detections([(square(30, 20), "b", 0.5), (square(5, 40), "c ", 1.0), (square(4, 20), "a", 0.6), (square(0, 0), "  ", 0.1)])
    assert read["raw_text"] == "a\nb\nc" and abs(read["confidence"] - 0.7) < 1e-9 and read["bounding_boxes"][0]["bbox"] == {"left": 4, "top": 20, "width": 9, "height": 5}
    rows = spark.createDataFrame([(png(page()),)], "content binary")
    got = images.recognise(images.preprocess(rows, stages=("grayscale",)), "grayscale", "EasyOCR").first().ocr
    assert got.error and got.confidence == 0.0 and got.engine_used == "tesseract"
    six = images.preprocess(rows, most=100, stages=images.STAGES).first()
    assert six.original.width == 420 and six.resized.width == 100 and six.grayscale.channels == six.enhanced.channels == 1 and six.image_error is None


def test_picture_stages_equal_single_images(spark):
    rows = catalog.picture_stages(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 150 and all(r.image_error is None for r in rows)
    i = np.arange(16 * 20 * 3)
    for r in rows[::25]:
        k = r.c_custkey
        rgb = ((k * 31 + i * i * 7 + i * (13 + k % 5)) % 256).astype(np.uint8).reshape(16, 20, 3)
        image = np.ascontiguousarray(rgb[..., ::-1])
        grey = images.grayscale(image)
        clean = enhance.denoise(grey)
        steps = dict(zip(images.STAGES, (image, image, grey, clean, enhance.deskew(clean), enhance.contrast(enhance.deskew(clean))), strict=True))
        assert {s: r[s] for s in images.STAGES} == {s: hashlib.sha256(x.tobytes()).hexdigest() for s, x in steps.items()}
        assert abs(r.ela - enhance.error_level(image)["mean"]) < 1e-6


def plain_denoise(grey):
    """Patch by patch."""
    image = np.pad(grey.astype(float), 13, mode="symmetric" if min(grey.shape) <= 13 else "reflect")
    patch, out = lambda y, x: image[y + 10 : y + 17, x + 10 : x + 17], np.zeros(grey.shape)
    for y, x in np.ndindex(grey.shape):
        shifts = [(dy, dx) for dy in range(-10, 11) for dx in range(-10, 11)]
        w = np.array([np.exp(-((patch(y, x) - patch(y + dy, x + dx)) ** 2).mean() / 100) for dy, dx in shifts])
        out[y, x] = (w * [image[y + dy + 13, x + dx + 13] for dy, dx in shifts]).sum() / w.sum()
    return np.clip(np.rint(out), 0, 255)


def test_denoised_together(monkeypatch):
    """images of one size take a shift together, with what each gets alone."""
    r = np.random.default_rng(4)
    grey = (np.arange(9 * 11).reshape(9, 11) % 7 * 9 + r.integers(0, 12, (70, 9, 11))).astype(np.uint8)
    monkeypatch.setattr(enhance, "STACK", 2000)  # in several parts
    whole = enhance.denoise_stack(grey)
    assert whole.shape == grey.shape and np.array_equal(whole[3], plain_denoise(grey[3])) and all(np.array_equal(a, enhance.denoise(b)) for a, b in zip(whole, grey, strict=True))
    monkeypatch.undo()
    start = time.perf_counter()
    [enhance.denoise(x) for x in grey]
    alone, start = time.perf_counter() - start, time.perf_counter()
    enhance.denoise_stack(grey)
    assert time.perf_counter() - start < alone / 2


def test_stages_of_files_of_many_sizes(spark, monkeypatch):
    """sizes mixed, broken and empty files among them, each with its own result, whatever is taken together."""
    r = np.random.default_rng(5)
    pixmap = lambda h, w: f"P6 {w} {h} 255\n".encode() + r.integers(0, 256, h * w * 3, dtype=np.uint8).tobytes()
    files = [pixmap(*s) for s in ((16, 20), (20, 16), (16, 20), (5, 0), (30, 41))] + [b"broken", None, pixmap(16, 20)]
    monkeypatch.setattr(images, "TOGETHER", 4000)
    rows = images.preprocess(spark.createDataFrame(list(enumerate(files)), "id int, content binary").coalesce(1), stages=images.STAGES).orderBy("id").collect()
    for i, row in enumerate(rows):
        if i in (3, 5, 6):
            assert row.enhanced is None and row.original is None and {3: "empty axis", 5: "cannot decode", 6: "no file"}[i] in row.image_error
            continue
        image = enhance.decode(files[i])
        clean = enhance.denoise(images.grayscale(image))
        assert row.image_error is None and row.original.data == image.tobytes() and row.denoised.data == clean.tobytes()
        assert row.enhanced.data == enhance.contrast(enhance.deskew(clean)).tobytes()


def test_screening_from_files(spark):
    files = [("a", "a.png", png(page()), png(page())), ("b", "b.gif", b"GIF8", None), ("c", "c.png", b"broken", b"broken"), ("d", "d.png", None, None), ("e", "e.png", png(page(False)), None)]
    documents = spark.createDataFrame(files, "document_id string, path string, content binary, selfie binary").withColumn("document_type", F.lit("permit"))
    known = registry.conform(spark.createDataFrame([(1, "X0000123", "permit", "JANE DOE", "valid")], "id long, document_number string, document_type string, full_name string, status string"))
    photos = spark.createDataFrame([("X0000123", png(page()))], "document_number string, reference binary")
    config = Config(as_of=datetime.date(2025, 1, 1), fuzzy_dates=False)
    out = {r.document_id: r for r in screen_files(documents, known, config, photos, Backends(engine=Engine(), finder=Finder())).collect()}
    assert sorted(out) == list("abcde")
    a = out["a"]
    assert (a.registry_status, a.fields["Name"], a.errors) == ("Valid", "JANE DOE", []) and a.face_match.is_match and a.face_match.similarity_score == 85.0
    assert a.tampering.tampering_score is not None and a.risk.risk_band in ("LOW", "MEDIUM")
    assert [e.stage for e in out["b"].errors] == ["upload"] and "Unsupported" in out["b"].errors[0].error and out["b"].tampering is None
    assert [e.stage for e in out["c"].errors] == ["upload", "selfie"] and [e.stage for e in out["d"].errors] == ["upload"]
    assert out["e"].errors == [] and out["e"].face_match is None and "face_match" in out["e"].risk.excluded_factors


def test_stored_ledger(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = lambda a, b: spark.createDataFrame([(i, f"t{i}", f"d{i}", str(i), "LOW") for i in range(a, b)], "index long, timestamp string, document_id string, risk_score string, decision string")
    assert ledger.stored(spark, folder).collect() == []
    assert [r["index"] for r in ledger.append(rows(0, 5), folder).orderBy("index").collect()] == list(range(5))
    assert ledger.append(rows(5, 5), folder).count() == 0
    added = ledger.append(rows(5, 300), folder).orderBy("index").collect()
    whole = ledger.stored(spark, folder).orderBy("index").collect()
    assert whole == ledger.build(rows(0, 300)).orderBy("index").collect() and added[0].prev_hash == whole[4].hash and whole[0].prev_hash == GENESIS
    assert ledger.verify(ledger.stored(spark, folder)).first().is_valid
    cut = ledger.stored(spark, folder).where("index <> 150")
    found = ledger.verify(cut).first()
    assert (found.is_valid, found.total_records, found.broken_at_index) == (False, 299, 150) and "prev_hash" in found.reason
    edited = ledger.stored(spark, folder).withColumn("decision", F.when(F.col("index") == 299, "HIGH").otherwise(F.col("decision")))
    assert ledger.verify(edited).first().broken_at_index == 299
    ledger.export(ledger.stored(spark, folder), str(tmp_path / "out"))
    back = spark.read.schema("hash string, index long, risk_score int").json(str(tmp_path / "out"))
    assert [r.hash for r in back.orderBy("index").collect()] == [r.hash for r in whole] and back.agg(F.sum("risk_score")).first()[0] == sum(range(300))


def test_stored_registry(spark, tmp_path):
    folder = str(tmp_path / "registry")
    assert registry.create(spark, folder).count() == 0
    old = spark.createDataFrame([(1, "A1", "visa", "X", "valid", "gone")], "id long, document_number string, document_type string, full_name string, status string, extra string")
    old.write.mode("append").parquet(folder)
    more = old.unionByName(spark.createDataFrame([(2, "B2", "visa", "Y", "expired", "z")], old.schema))
    rows = registry.create(spark, folder, more).orderBy("id").collect()
    assert [(r.document_number, r.status, r.dob) for r in rows] == [("A1", "valid", None), ("B2", "expired", None)] and rows[1].id > 1
    assert registry.create(spark, folder, more).count() == 2

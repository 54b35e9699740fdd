import datetime
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import text
from papyra.operators import extract, faces, forensics, ledger, registry, reports, risk, validate
from papyra.plans.screen import Config, ledger_entries, screen
from papyra.schema import GENESIS, LEDGER, REGISTRY
from papyra.sources import images

AS_OF = datetime.date(2026, 1, 1)

LICENCE = """STATE TRANSPORT DRIVING LICENCE
AB12 20240001234
Issue Date Validity ( NT ) Validity ( TR )
{gap}11-03-2024 09-08-2044

Name : MIRA ANAND
Date Of Birth :17-02-1999 Blood Group: Unknown
"""
PASSPORT = """REPUBLIC OF EXAMPLE
Surname
ROE
Given Names
ANNA LEE
Passport No: K7654321
Nationality: Examplian
Date of Birth: 15 JAN 1990
Sex: F
Date of Expiry: 20 JAN 2030
"""
KNOWN = [
    (1, "AB12 20240001234", "drivers_license", "MIRA ANAND", "IN", "valid", "09/08/2044", "17/02/1999"),
    (2, "K7654321", "passport", "ANNA LEE ROE", "EX", "valid", "2030-01-20", "1990-01-15"),
    (3, "B1122000", "passport", "SAM STONE", "EX", "blacklisted", "2031-05-01", "1987-12-01"),
    (4, "ZB1122000X", "visa", "SAM STONE", "EX", "expired", None, None),
]


@pytest.fixture(scope="module")
def known(spark):
    return registry.conform(
        spark.createDataFrame(KNOWN, "id long, document_number string, document_type string, full_name string, nationality string, status string, expiry_date string, dob string")
    )


def texts(spark, *rows):
    return spark.createDataFrame([(i, kind, t, 0.95) for i, (kind, t) in enumerate(rows)], "document_id long, document_type string, raw_text string, ocr_confidence double")


def many(spark, *columns):
    """The values of several expressions, in one job."""
    return list(spark.range(1).select(*(c.alias(f"x{i}") for i, c in enumerate(columns))).first())


def one(spark, column):
    return many(spark, column)[0]


def test_licence_takes_the_date_below_its_header(spark):
    rows = extract.extract(texts(spark, *(("Driving License", LICENCE.format(gap=g)) for g in ("", "ADPVEH No.(Regn.Numbers) :\n")))).collect()
    for r in rows:
        assert r.fields["Date of Expiry"] == "09-08-2044" and r.fields["Date of Birth"] == "17-02-1999"
        assert r.fields["License Number"] == "AB12 20240001234" and r.fields["Name"] == "MIRA ANAND"
    checked = extract.extract(texts(spark, ("Driving License", LICENCE.format(gap=""))))
    assert validate.validated(checked, AS_OF).first().validation.status == "pass"


def test_passport_fields_and_confidence(spark):
    r = extract.extract(texts(spark, ("Passport", PASSPORT))).first()
    assert r.fields == {
        "Name": "ROE ANNA LEE", "Passport Number": "K7654321", "Nationality": "Examplian", "Date of Birth": "15 JAN 1990", "Date of Expiry": "20 JAN 2030", "Gender": "F",
    }
    assert r.field_confidence["Passport Number"] == 95 and r.field_confidence["Name"] == 86
    assert extract.extract(texts(spark, ("Passport", None), ("Visa", ""))).select("low_confidence_fields").collect()[1][0] == ["Visa Number", "Visa Type", "Entry Validation", "Stay Duration"]


def test_mrz(spark):
    zone = "P<STONE<<SAMUEL<<<<<<<<<sss<<<<<<<<<<<\nZ435R34255ARE03071978M10022020<<<<<<<<8\n"
    dates = (extract.mrz_date(F.lit(x)) for x in ("490102", "500102", "01022003", "1234567"))
    m, nothing, *dates = many(spark, extract.mrz(F.lit(zone)), extract.mrz(F.lit("no zone here")), *dates)
    assert (m.name, m.number, m.nationality, m.gender, m.born, m.ends) == ("STONE SAMUEL", "Z435R34255", "ARE", "M", "03/07/1978", "10/02/2020")
    assert nothing is None and dates == ["02/01/2049", "02/01/1950", "01/02/2003", "1234567"]


DATES = [
    ("15 JAN 1990", "1990-01-15"), ("1 february 2001", "2001-02-01"), ("3-Mar-1999", "1999-03-03"), ("05/04/2004", "2004-04-05"), ("5-4-2004", "2004-04-05"),
    ("5.4.2004.", "2004-04-05"), ("01/02/68", "2068-02-01"), ("01/02/69", "1969-02-01"), ("1990-01-12", "1990-01-12"), ("31/02/1997", None), ("Not Detected", None), ("", None),
]


def test_dates(spark):
    rows = spark.createDataFrame(DATES, "said string, day string").select("said", "day", text.any_date(F.col("said")).cast("string").alias("read")).collect()
    assert [r for r in rows if r.read != r.day] == []


def test_fuzzy_dates_reach_what_plain_ones_cannot(spark):
    rows = spark.createDataFrame([("expires 5th of May 2031",), ("nonsense",), ("15 JAN 1990",)], "d string")
    assert [str(r.x) for r in text.with_date(rows, "x", F.col("d"), AS_OF).collect()] == ["2031-05-05", "None", "1990-01-15"]


def test_validation_issues(spark):
    fields = F.create_map(*(F.lit(x) for x in ("Visa Number", "12", "Visa Type", "T", "Entry Validation", "Single", "Stay Duration", "1 year")))
    v = one(spark, validate.validate(fields, F.lit("Visa"), AS_OF))
    assert v.status == "fail" and [(i.field, i.severity) for i in v.issues] == [("Visa Number", "warning"), ("Stay Duration", "error")]
    note = one(spark, validate.validate(F.create_map(F.lit("note"), F.lit("no parser")), F.lit("X"), AS_OF))
    assert note.status == "warning" and note.issues[0].message == "no parser"
    s = one(spark, validate.summary(validate.validate(fields, F.lit("Visa"), AS_OF)))
    assert not s.is_valid and list(s.field_errors) == ["Stay Duration"] and len(s.warnings) == 1


def test_lookup_takes_the_first_row(spark, known):
    numbers = ["ab12 20240001234 ", "AB1220240001234", "b1122000", "B-1122000", "122000", "12200", "Not Detected", None, "  ", "1122000"]
    rows = registry.lookup(spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i long, document_number string"), known).orderBy("i").collect()
    assert [r.record.id if r.record else None for r in rows] == [1, 1, 3, 3, 3, None, None, None, None, 3]
    assert [r.registry_status for r in rows][:4] == ["Valid", "Valid", "Blacklisted", "Blacklisted"] and rows[5].registry_status == "Not Found"


def test_registry_seed_ignores_known_numbers(spark, known):
    more = spark.createDataFrame([(1, "NEW1", "visa", "A", "valid"), (2, "K7654321", "visa", "B", "valid"), (3, "BAD", "visa", "C", "lost")], "id long, document_number string, document_type string, full_name string, status string")
    rows = registry.seed(known, registry.conform(more)).orderBy("id").collect()
    assert [r.document_number for r in rows][4:] == ["NEW1"] and rows[-1].id == 5
    assert [f.split()[0] for f in REGISTRY.split(", ")] == known.columns


def test_screening_end_to_end(spark, known):
    blacklisted = PASSPORT.replace("K7654321", "B1122000")
    docs = texts(spark, ("Passport", PASSPORT), ("Passport", blacklisted), ("Driving License", LICENCE.format(gap="")), ("Permit", None))
    tampered = F.struct(F.lit(2).alias("tampering_score"), F.lit("low").alias("risk_level"), F.array().cast("array<string>").alias("flags"))
    plain = screen(docs.withColumn("tampering", tampered), known, Config(AS_OF, cross_check=False)).orderBy("document_id").collect()
    assert [r.registry_status for r in plain] == ["Valid", "Blacklisted", "Valid", "Not Found"]
    assert [r.risk.risk_band for r in plain][:3] == ["LOW", "CRITICAL", "LOW"] and plain[0].validation.status == "pass"
    assert plain[1].risk.risk_score == 80 and "floored" in plain[1].risk.explanation and plain[0].risk.excluded_factors == ["face_match"]
    results = screen(docs, known, Config(AS_OF))
    checked = results.orderBy("document_id").collect()
    assert checked[0].validation.status == "fail"  # names in another order and dates in another form are mismatches
    results = spark.createDataFrame(checked, results.schema)
    chain = ledger_entries(results.withColumn("ts", F.lit("2026-01-01T00:00:00+00:00")), "ts", "document_id")
    assert ledger.verify(chain).first().is_valid and chain.count() == 4
    assert [r.face_match for r in reports.summary(results).collect()] == ["not checked"] * 4


SIGNALS = "status string, errors int, warnings int, registry string, tampering double, face double"


def scores(spark, *rows, weights=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SIGNALS}")
    return [r.r for r in df.select("i", risk.risk(*(F.col(x.split()[0]) for x in SIGNALS.split(", ")), weights=weights).alias("r")).orderBy("i").collect()]


def test_risk_as_columns_is_the_same(spark):
    rows = [("warning", 0, 3, "Expired", 10.0, 72.5), (None,) * 6, ("pass", 0, 0, "Blacklisted", 0.0, None), ("fail", 9, 2, "Lost", 45.0, 20.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {SIGNALS}")
    found = risk.with_risk(df, "r", *(F.col(x.split()[0]) for x in SIGNALS.split(", ")))
    assert found.columns == [*df.columns, "r"] and [x.r for x in found.orderBy("i").collect()] == scores(spark, *rows)
    assert risk.with_risk(df, "status", *(F.col(x.split()[0]) for x in SIGNALS.split(", "))).columns == [*df.columns[:1], *df.columns[2:], "status"]


def test_risk_rules(spark):
    usual = ("warning", 0, 3, "Expired", 10.0, 72.5)
    r = scores(
        spark, usual, (None,) * 6, ("pass", 0, 0, "Valid", 0.0, 100.0), ("pass", 0, 0, "Valid", 0.0, 49.9), ("pass", 0, 0, "Valid", 0.0, 50.0), ("fail", 1, 0, "Valid", 30.0, None),
        ("pass", 0, 0, "Blacklisted", 0.0, None), ("odd", 0, 0, "Lost", None, None), ("fail", 9, 0, "", -5.0, 170.0),
    )
    assert [x.risk_score for x in r[1:]] == [50, 0, 65, 8, 55, 80, 50, 36]
    assert r[1].risk_band == "MEDIUM" and r[1].contributing_factors == [] and len(r[1].excluded_factors) == 4
    assert [f.factor for f in r[0].contributing_factors] == ["Registry check", "Document validation", "Face match", "Tampering analysis"]
    assert "(72% similarity)" in r[0].contributing_factors[2].detail and r[0].weights_used == {"validation": 0.25, "db_status": 0.3, "tampering": 0.3, "face_match": 0.15}
    doubled = {"validation": 0.5, "db_status": 0.6, "tampering": 0.6, "face_match": 0.3}
    assert scores(spark, usual, weights=doubled)[0].risk_score == r[0].risk_score
    assert many(spark, *(risk.band(F.lit(x)) for x in (20, 20.5, 21, 50, 51, 75, 76))) == ["LOW", "CRITICAL", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def chain_of(rows):
    out, before = [], GENESIS
    for i, (stamp, who, points, decision) in enumerate(rows):
        record = {"prev_hash": before, "timestamp": stamp, "document_id": who, "risk_score": points, "decision": decision}
        own = hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()
        out.append((before, stamp, who, json.dumps(points), decision, own, i))
        before = own
    return out


@pytest.fixture
def sampled_borders(spark):
    """Borders of ranges from a sample of few rows, as large tables have them."""
    own = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def ledger_rows(spark, n):
    return spark.range(n).select(F.col("id").alias("index"), F.lit("t").alias("timestamp"), (F.col("id") % 40).cast("string").alias("document_id"), F.lit("1").alias("risk_score"), F.lit("LOW").alias("decision"))


def test_ledger_verified_in_ranges(spark, sampled_borders):
    """every entry is counted once and none before the first edited one is broken, wherever the ranges' borders lie."""
    chain = ledger.build(ledger_rows(spark, 3000))
    assert ledger.verify(chain).first().asDict() == {"is_valid": True, "total_records": 3000, "broken_at_index": None, "reason": None}
    edited = ledger.verify(chain.withColumn("decision", F.when(F.col("index") >= 2703, "LOW!").otherwise(F.col("decision")))).first()
    assert (edited.total_records, edited.broken_at_index) == (3000, 2703) and "recomputed" in edited.reason
    gone = ledger.verify(chain.where("index <> 1500")).first()
    assert (gone.total_records, gone.broken_at_index) == (2999, 1500) and "prev_hash" in gone.reason


def test_ledgers_by_key_in_ranges(spark, sampled_borders):
    """each chain is there with all its entries, and only the edited one is broken; a null key has a chain too."""
    rows = ledger_rows(spark, 3000).withColumn("user", F.when(F.col("document_id") != "7", F.col("document_id")))
    chains = ledger.build(rows, key="user")
    edited = chains.withColumn("decision", F.when((F.col("chain") == "11") & (F.col("index") == 33), "LOW!").otherwise(F.col("decision")))
    found = {r.chain: (r.is_valid, r.total_records, r.broken_at_index) for r in ledger.verify(edited, key="chain").collect()}
    assert found == {None if k == 7 else str(k): (k != 11, 75, 33 if k == 11 else None) for k in range(40)}


def test_ledgers_of_texts_that_end_a_line(spark):
    """a line's end as a text's last character is escaped in both hashes, so an unedited chain holds."""
    ends = ["LOW", "LOW\n", "LOW\r", "LOW\r\n", "LOW\u0085", "LOW\u2028", "LOW\u2029", '"LOW"', "\n", ""]
    texts = spark.createDataFrame([(x,) for x in ends], "x string")
    assert {r.x: r.found for r in texts.select("x", text.json_string(F.col("x")).alias("found")).collect()} == {x: json.dumps(x) for x in ends}
    chains = ledger.build(texts.select(F.lit(0).alias("index"), "x", *(F.col("x").alias(c) for c in ("timestamp", "document_id", "decision")), F.lit("1").alias("risk_score")), key="x")
    assert all(r.is_valid and r.total_records == 1 for r in ledger.verify(chains, key="chain").collect())


def test_ledger_without_hashes(spark, sampled_borders):
    """an entry that has lost its hash is broken, and the one after it isn't linked, also where a range starts."""
    chain = ledger.build(ledger_rows(spark, 300)).withColumn("hash", F.when(F.col("index") < 200, F.col("hash")))
    chain = chain.withColumn("prev_hash", F.when(F.col("index") > 200, GENESIS).otherwise(F.col("prev_hash")))
    found = ledger.ranges(chain).orderBy("__range").collect()
    assert sum(r.n for r in found) == 300 and ledger.verify(chain).first().broken_at_index == 200


def test_ledger(spark, tmp_path):
    golden = ledger.record_hash(F.lit("LOW"), F.lit("OD0720250006115"), F.lit(GENESIS), F.lit("15.0"), F.lit("2026-09-24T14:08:54.711991+00:00"))
    assert one(spark, golden) == "0b345e7092a14455b3c61cdedf432eb7a12020736486eeeec864e3d00d2745d3"
    rows = [(f"2026-01-0{i + 1}", who, points, "LOW") for i, (who, points) in enumerate([("A", 15), ('q"\\', 15.0), ("Ünï", 3), ("D", 0)])]
    want = chain_of(rows)
    entries = spark.createDataFrame(want, LEDGER)
    built = ledger.build(entries.select("index", "timestamp", "document_id", "risk_score", "decision"))
    assert sorted(map(tuple, built.collect()), key=lambda r: r[-1]) == want
    assert ledger.verify(entries).first().asDict() == {"is_valid": True, "total_records": 4, "broken_at_index": None, "reason": None}
    edited = entries.withColumn("decision", F.when(F.col("index") == 2, "HIGH").otherwise(F.col("decision")))
    assert ledger.integrity(edited).first().asDict() == {"is_valid": False, "broken_at_index": 2}
    gone = ledger.verify(entries.where("index <> 1")).first()
    assert gone.broken_at_index == 1 and "prev_hash" in gone.reason
    assert ledger.verify(ledger.empty(spark)).first().is_valid and reports.dashboard(ledger.empty(spark)).first().avg_risk_score is None
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps([{"prev_hash": r[0], "timestamp": r[1], "document_id": r[2], "risk_score": json.loads(r[3]), "decision": r[4], "hash": r[5], "index": r[6]} for r in want]))
    loaded = ledger.load(spark, str(path))
    assert ledger.verify(loaded).first().is_valid and not any(r.corrupt for r in loaded.collect())
    path.write_text('[{"prev_hash": ')
    assert any(r.corrupt for r in ledger.load(spark, str(path)).collect())
    assert ledger.entry(entries, 3).first().document_id == "D" and reports.history(entries).first().document_id == "D"


def test_faces(spark):
    boxes = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("width"), F.lit(h).alias("height")) for n, w, h in (("a", 2, 3), ("b", 3, 4), ("c", 4, 3))))
    compare = lambda *a: faces.compare(*(F.lit(x) for x in a))
    largest, nothing, faceless, several, failed, *rest = many(
        spark, faces.largest_face(boxes), compare(False, 1, 1, 0.1), compare(True, 1, 0, 0.1), compare(True, 2, 1, 0.5), compare(True, 1, 1, 0.5, "broken"),
        *(faces.similarity(F.lit(x)) for x in (0.0, 0.6, 0.3, 2.0)), *(faces.composite_similarity(F.lit(x)) for x in (0.57, 0.58, 1.0)),
    )
    assert largest.name == "b" and rest == [100.0, 50.0, 75.0, 0.0, 0.0, 80.0, 85.0]
    assert nothing.is_match is False and nothing.similarity_score == 0.0
    assert faceless.no_face_detected and faceless.similarity_score is None and faceless.is_match is False
    assert several.is_match and several.multiple_faces_flagged
    assert failed.is_match is None and failed.error == "broken"


def exif_jpeg(tags):
    """A JPEG header with ASCII tags in its main directory."""
    count = len(tags)
    at, entries, data = 8 + 2 + 12 * count + 4, b"", b""
    for tag, value in sorted(tags.items()):
        value = value.encode() + b"\0"
        entries += tag.to_bytes(2, "little") + b"\2\0" + len(value).to_bytes(4, "little") + (at + len(data)).to_bytes(4, "little")
        data += value
    block = b"II*\0" + (8).to_bytes(4, "little") + count.to_bytes(2, "little") + entries + b"\0" * 4 + data
    body = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"


def test_metadata(spark):
    edited = exif_jpeg({0x0131: "Adobe Photoshop 24.0", 0x0132: "2024:01:02 10:00:00", 0x9003: "2024:01:01 10:00:00"})
    files = [(0, edited), (1, exif_jpeg({0x0131: "Camera 1.0"})), (2, b"\xff\xd8\xff\xd9"), (3, b"not an image"), (4, None)]
    rows = spark.createDataFrame(files, "i int, content binary").select("i", forensics.metadata(forensics.exif_of(F.col("content"))).alias("m")).orderBy("i").collect()
    assert [r.m.confidence for r in rows] == [1.0, 0.0, 0.15, 0.0, 0.0] and [r.m.has_exif for r in rows] == [True, True, False, None, None]
    assert rows[0].m.is_suspicious and rows[0].m.date_inconsistency and "failed" in rows[3].m.notes[0] and "No original" in rows[4].m.notes[0]
    d = lambda x: forensics.detector(F.lit(x))
    t = one(spark, forensics.tampering(d(0.9), d(0.6), d(0.1), d(0.15)))
    assert (t.tampering_score, t.risk_level, t.flags) == (54, "medium", ["photo_substitution", "text_manipulation"])
    assert one(spark, forensics.font_consistency(F.lit(5.0), F.lit(20.0), F.lit(2), F.lit(5))).confidence == 0.0
    assert one(spark, forensics.photo_substitution(F.lit(None).cast("double"), F.lit(1.0))).is_suspicious is False


def test_uploads_and_images(spark, tmp_path):
    files = (("a.JPG", 1024), ("a.tar.png", 10485760), ("a.png", 10490000), ("a.gif", 20 << 20), ("noext", 0))
    checks = many(spark, *(images.check_upload(F.lit(n), F.lit(s)) for n, s in files))
    assert [len(c.errors) for c in checks] == [0, 0, 0, 2, 2] and checks[0].extension == "jpg"
    (tmp_path / "x.png").write_bytes(b"broken")
    rows = images.recognise(images.preprocess(images.read_files(spark, str(tmp_path)).select("path", "content"))).collect()
    assert rows[0].enhanced is None and rows[0].image_error and rows[0].ocr.confidence == 0.0 and rows[0].ocr.error
    image = np.arange(4 * 8 * 3, dtype=np.uint8).reshape(4, 8, 3)
    assert images.shrink(image, 4).shape == (2, 4, 3) and images.shrink(image, 100) is image
    assert np.array_equal(images.shrink(np.full((300, 200), 7, np.uint8), 30), np.full((30, 20), 7))
    assert images.grayscale(image).shape == (4, 8) and images.laplacian_variance(np.full((5, 5), 9, np.uint8)) == 0.0


def test_stream(spark, known, tmp_path):
    from papyra.streaming.ingest import screen_stream

    docs = texts(spark, ("Passport", PASSPORT), ("Permit", "x"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    screen_stream(stream, known, Config(AS_OF), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_field_confidence_uses_the_words_own_boxes(spark):
    boxes = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).cast("double").alias("confidence")) for t, c in (("MIRA", 0.5), ("anand.", 0.7), ("other", 0.1), ("MIRA", None))))
    cases = (("Mira Anand", "direct_match"), ("Zed", "regex_match"), ("Zed", "not_found"))
    assert many(spark, *(extract.field_confidence(F.lit(v), F.lit(s), boxes, F.lit(0.9)) for v, s in cases)) == [54, 90, 0]

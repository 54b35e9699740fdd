"""Queries of the screening engine and the SQL they are compared with.

The tables hold no identity documents, so screenings are derived from orders and customers, the registry from
customers, the ledger from events and faces from embeddings; every query runs over whole tables.
"""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text
from papyra.operators import extract, faces, forensics, ledger, registry, reports, risk, validate
from papyra.plans import screen as plan
from papyra.schema import GENESIS, NOT_DETECTED
from papyra.session import shared_folder, table
from papyra.sources import enhance, face_detection, images, pixels

AS_OF = datetime.date(1998, 1, 1)
CONFIG = plan.Config(as_of=AS_OF, fuzzy_dates=False)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- derived tables ----------------------------------------------------------------------------------------------


def screenings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = F.concat(F.lit("X"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    ends = F.date_format("o_orderdate", "dd-MM-yyyy")
    return rows.select(
        F.col("o_orderkey").alias("document_id"), "c_name", "o_orderdate", "o_custkey", number.alias("number"),
        F.concat(F.lit("Name : "), "c_name", F.lit("\nDocument No : "), number, F.lit("\nDate of Expiry : "), ends).alias("raw_text"),
        (F.col("o_orderkey") % 101).cast("double").alias("tampering_score"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 101).cast("double")).alias("face_score"),
    )


def known(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    status = F.when(c % 10 == 0, "blacklisted").when((c % 10).isin(1, 2), "expired").otherwise("valid")
    rows = table(spark, d, "customer").where(c % 7 != 0)
    return registry.conform(
        rows.select(
            c.alias("id"), F.concat(F.lit("X"), F.lpad(c.cast("string"), 7, "0")).alias("document_number"), F.lit("passport").alias("document_type"), F.col("c_name").alias("full_name"),
            status.alias("status"), F.lit("1999-06-30").alias("expiry_date"), F.concat(F.lit("19"), F.lpad((c % 90 + 10).cast("string"), 2, "0"), F.lit("-05-17")).alias("dob"),
        )
    )


SCREENINGS_SQL = """
screenings AS (
  SELECT o_orderkey AS document_id, c_name, o_orderdate, o_custkey, 'X' || lpad(o_custkey::VARCHAR, 7, '0') AS number,
         (o_orderkey % 101)::DOUBLE AS tampering_score, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 101)::DOUBLE END AS face_score
  FROM orders JOIN customer ON o_custkey = c_custkey
), known AS (
  SELECT c_custkey AS id, 'X' || lpad(c_custkey::VARCHAR, 7, '0') AS document_number, c_name AS full_name,
         CASE WHEN c_custkey % 10 = 0 THEN 'blacklisted' WHEN c_custkey % 10 IN (1, 2) THEN 'expired' ELSE 'valid' END AS status,
         '1999-06-30' AS expiry_date, '19' || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || '-05-17' AS dob
  FROM customer WHERE c_custkey % 7 <> 0
)"""
SHOWN_SQL = "CASE k.status WHEN 'valid' THEN 'Valid' WHEN 'expired' THEN 'Expired' WHEN 'blacklisted' THEN 'Blacklisted' ELSE 'Not Found' END"

#: From columns validation_status, errors, warnings, registry_status, tampering_score, face_score to score and band.
RISK_SQL = """
signals AS (
  SELECT *, CASE validation_status WHEN 'pass' THEN 0.0::DOUBLE WHEN 'warning' THEN least(100.0::DOUBLE, 20.0::DOUBLE + 10.0::DOUBLE * warnings)
              WHEN 'fail' THEN least(100.0::DOUBLE, 60.0::DOUBLE + 15.0::DOUBLE * errors) END AS v,
         CASE lower(registry_status) WHEN 'valid' THEN 0.0::DOUBLE WHEN 'not found' THEN 35.0::DOUBLE WHEN 'expired' THEN 65.0::DOUBLE
              WHEN 'blacklisted' THEN 100.0::DOUBLE WHEN 'error' THEN 50.0::DOUBLE ELSE CASE WHEN registry_status <> '' THEN 50.0::DOUBLE END END AS r,
         greatest(0.0::DOUBLE, least(100.0::DOUBLE, tampering_score)) AS t, 100.0::DOUBLE - greatest(0.0::DOUBLE, least(100.0::DOUBLE, face_score)) AS f
  FROM base
), weights AS (
  SELECT *, (CASE WHEN v IS NULL THEN 0 ELSE 0.25::DOUBLE END) AS wv, (CASE WHEN r IS NULL THEN 0 ELSE 0.3::DOUBLE END) AS wr,
         (CASE WHEN tampering_score IS NULL THEN 0 ELSE 0.3::DOUBLE END) AS wt, (CASE WHEN face_score IS NULL THEN 0 ELSE 0.15::DOUBLE END) AS wf
  FROM signals
), total AS (
  SELECT *, CASE WHEN wv + wr + wt + wf = 0 THEN 1.0::DOUBLE ELSE wv + wr + wt + wf END AS w FROM weights
), weighted AS (
  SELECT *, round_even(coalesce(v * (wv / w), 0) + coalesce(r * (wr / w), 0) + (CASE WHEN tampering_score IS NULL THEN 0 ELSE t * (wt / w) END)
                       + (CASE WHEN face_score IS NULL THEN 0 ELSE f * (wf / w) END), 0)::INT AS plain
  FROM total
), scored AS (
  SELECT *, CASE WHEN v IS NULL AND r IS NULL AND tampering_score IS NULL AND face_score IS NULL THEN 50 ELSE
         greatest(plain, CASE WHEN lower(registry_status) = 'blacklisted' THEN 80 ELSE 0 END, CASE WHEN face_score < 50 THEN 65 ELSE 0 END,
                  CASE WHEN tampering_score >= 30 AND validation_status = 'fail' THEN 55 ELSE 0 END) END AS risk_score
  FROM weighted
)"""
BAND_SQL = "CASE WHEN risk_score <= 20 THEN 'LOW' WHEN risk_score <= 50 THEN 'MEDIUM' WHEN risk_score <= 75 THEN 'HIGH' ELSE 'CRITICAL' END"


# -- flagship ----------------------------------------------------------------------------------------------------


def _fields(number, name, ends):
    keys = F.array(*(F.lit(k) for k in ("Name", "Document Number", "Date of Expiry", "License Number", "ID Number", "Permit Number")))
    return F.map_from_arrays(keys, F.array(name, number, ends, number, number, number))


def _screened(spark: SparkSession, d: str, cross_check: bool = True) -> DataFrame:
    rows = screenings(spark, d).select(
        "document_id", F.lit("Permit").alias("document_type"), _fields(F.col("number"), F.col("c_name"), F.date_format("o_orderdate", "dd-MM-yyyy")).alias("fields"),
        F.struct(F.col("tampering_score").cast("int").alias("tampering_score"), F.lit("low").alias("risk_level"), F.array().cast("array<string>").alias("flags")).alias("tampering"),
        F.when(F.col("face_score").isNotNull(), F.struct((F.col("face_score") >= 50).alias("is_match"), F.col("face_score").alias("similarity_score"))).alias("face_match"),
    )
    return plan.screen(rows, known(spark, d), plan.Config(as_of=AS_OF, cross_check=cross_check, fuzzy_dates=False, contained_numbers=False))


@query(f"""
WITH {SCREENINGS_SQL}, base AS (
  SELECT s.document_id, {SHOWN_SQL} AS registry_status, tampering_score, face_score,
         CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 1 ELSE 0 END AS errors,
         CASE WHEN k.id IS NOT NULL AND strftime(s.o_orderdate, '%d%m%Y') <> '19990630' THEN 1 ELSE 0 END AS warnings,
         CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 'fail' ELSE 'pass' END AS validation_status
  FROM screenings s LEFT JOIN known k ON s.number = k.document_number
), {RISK_SQL}
SELECT document_id, registry_status, validation_status, risk_score, {BAND_SQL} AS risk_band FROM scored
""")
def screen_flagship(spark, d):
    """A1 over fields: validation, exact lookup, cross-check, weighted risk with floors, band."""
    return _screened(spark, d).select("document_id", "registry_status", F.col("validation.status").alias("validation_status"), "risk.risk_score", "risk.risk_band")


def _said(words: dict[str, str]) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())


@query(f"""
WITH {SCREENINGS_SQL}, base AS (
  SELECT s.*, k.id, k.expiry_date, {SHOWN_SQL} AS registry_status, CASE WHEN o_orderdate::DATE < DATE '1998-01-01' THEN 1 ELSE 0 END AS errors,
         1 + CASE WHEN k.id IS NOT NULL THEN 1 ELSE 0 END AS warnings, CASE WHEN o_orderdate::DATE < DATE '1998-01-01' THEN 'fail' ELSE 'warning' END AS validation_status
  FROM (SELECT document_id, c_name, o_orderdate, number, NULL::DOUBLE AS tampering_score, NULL::DOUBLE AS face_score FROM screenings) s LEFT JOIN known k ON s.number = k.document_number
), {RISK_SQL}, banded AS (SELECT *, {BAND_SQL} AS risk_band, round_even(v * (wv / w), 1) AS pv, round_even(r * (wr / w), 1) AS pr FROM scored), factors AS (
  SELECT *, 'Document validation — ' || CASE validation_status WHEN 'fail' THEN errors || ' validation error(s), e.g. expired or logically inconsistent dates.'
           ELSE warnings || ' field(s) flagged for manual review.' END AS fv,
         'Registry check — ' || CASE lower(registry_status) {_said(risk.STATUS_DETAIL)} END AS fr FROM banded
)
SELECT document_id, c_name AS name, number, strftime(o_orderdate, '%d-%m-%Y') AS ends, 'Date of Birth;Gender' AS low, registry_status,
  concat_ws(';', 'Date of Birth:warning', CASE WHEN errors = 1 THEN 'Date of Expiry:error' END, CASE WHEN id IS NOT NULL THEN 'Date of Expiry:warning' END) AS issues,
  validation_status AS status, risk_score, risk_band,
  CASE risk_band {_said(risk.HEADLINES)} END || CASE WHEN pv < 2 AND pr < 2 THEN '' ELSE ' Primary contributors: '
    || concat_ws('; ', CASE WHEN pv >= 2 AND pv >= pr THEN fv END, CASE WHEN pr >= 2 THEN fr END, CASE WHEN pv >= 2 AND pv < pr THEN fv END) || '.' END
    || CASE WHEN risk_score > plain THEN '{risk.FLOORED}' ELSE '' END || ' (No data for: Tampering analysis, Face match — excluded from scoring.)' AS explanation
FROM factors
""")
def screen_text(spark, d):
    """A1 from recognised text: extraction, validation, lookup and cross-check, risk with its recommendation (K6) and explanation."""
    rows = screenings(spark, d).select("document_id", F.lit("Driving License").alias("document_type"), "raw_text", F.lit(0.9).alias("ocr_confidence"))
    out = plan.screen(rows, known(spark, d), CONFIG)
    found = F.transform("validation.issues", lambda x: F.concat(x["field"], F.lit(":"), x["severity"]))
    return out.select(
        "document_id", F.col("fields")["Name"].alias("name"), F.col("fields")["License Number"].alias("number"), F.col("fields")["Date of Expiry"].alias("ends"),
        F.array_join("low_confidence_fields", ";").alias("low"), "registry_status", F.array_join(found, ";").alias("issues"), F.col("validation.status").alias("status"),
        "risk.risk_score", "risk.risk_band", "risk.explanation",
    )


@query(f"""
WITH {SCREENINGS_SQL}, base AS (
  SELECT s.document_id, {SHOWN_SQL} AS registry_status, tampering_score, face_score,
         CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 1 ELSE 0 END AS errors, 0 AS warnings,
         CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 'fail' ELSE 'pass' END AS validation_status
  FROM screenings s LEFT JOIN known k ON s.number = k.document_number
), {RISK_SQL}
SELECT {BAND_SQL} AS risk_band, count(*) AS n, sum(risk_score)::BIGINT AS total FROM scored GROUP BY 1
""")
def screen_headless(spark, d):
    """A1 without the cross-check, counted by band."""
    rows = _screened(spark, d, cross_check=False)
    return rows.groupBy(F.col("risk.risk_band").alias("risk_band")).agg(F.count(F.lit(1)).alias("n"), F.sum("risk.risk_score").alias("total"))


# -- registry ----------------------------------------------------------------------------------------------------


@query(f"WITH {SCREENINGS_SQL} SELECT s.document_id, {SHOWN_SQL} AS registry_status, k.id FROM screenings s LEFT JOIN known k ON s.number = k.document_number")
def registry_exact(spark, d):
    return registry.lookup(screenings(spark, d), known(spark, d), "number", contained=False).select("document_id", "registry_status", "record.id")


@query(f"""
WITH {SCREENINGS_SQL}, probes AS (
  SELECT c_custkey AS probe_id, CASE c_custkey % 4 WHEN 0 THEN ' x' || lpad(c_custkey::VARCHAR, 7, '0') || ' '
         WHEN 1 THEN 'X-' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 2 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE c_custkey::VARCHAR END AS number FROM customer
), cleaned AS (
  SELECT probe_id, upper(trim(number)) AS raw, regexp_replace(upper(number), '[^A-Z0-9]', '', 'g') AS clean FROM probes
), exact AS (
  SELECT c.*, k.id FROM cleaned c LEFT JOIN known k ON c.raw = k.document_number
), loose AS (
  SELECT e.probe_id, min(k.id) AS id FROM exact e JOIN known k ON k.document_number = e.clean OR (length(e.clean) >= 6 AND contains(k.document_number, e.clean))
  WHERE e.id IS NULL GROUP BY e.probe_id
)
SELECT e.probe_id, k.id, {SHOWN_SQL} AS registry_status
FROM exact e LEFT JOIN loose l ON e.probe_id = l.probe_id LEFT JOIN known k ON k.id = coalesce(e.id, l.id)
""")
def registry_fallback(spark, d):
    """R2 with equality, equality of letters and digits, and contained numbers."""
    c = F.col("c_custkey")
    wide = lambda n: F.lpad(c.cast("string"), n, "0")
    number = F.when(c % 4 == 0, F.concat(F.lit(" x"), wide(7), F.lit(" "))).when(c % 4 == 1, F.concat(F.lit("X-"), wide(7))).when(c % 4 == 2, wide(6)).otherwise(c.cast("string"))
    probes = table(spark, d, "customer").select(c.alias("probe_id"), number.alias("number"))
    return registry.lookup(probes, known(spark, d), "number").select("probe_id", "record.id", "registry_status")


@query(f"""
WITH {SCREENINGS_SQL}, joined AS (
  SELECT s.document_id, k.id, CASE WHEN s.document_id % 3 = 0 THEN 'Not Detected' WHEN s.document_id % 3 = 1 THEN s.c_name ELSE 'Someone Else' END AS name,
         CASE WHEN s.document_id % 2 = 0 THEN k.dob ELSE strftime(s.o_orderdate, '%d/%m/%Y') END AS born, strftime(s.o_orderdate, '%Y-%m-%d') AS ends, k.full_name, k.dob, k.expiry_date
  FROM screenings s LEFT JOIN known k ON s.number = k.document_number
)
SELECT document_id, CASE WHEN id IS NULL THEN '' ELSE concat_ws(';',
    CASE WHEN NOT contains(upper(name), upper(full_name)) AND NOT contains(upper(full_name), upper(name)) THEN 'Name:error' END,
    CASE WHEN regexp_replace(born, '[^0-9]', '', 'g') <> regexp_replace(dob, '[^0-9]', '', 'g') THEN 'Date of Birth:error' END,
    CASE WHEN regexp_replace(ends, '[^0-9]', '', 'g') <> regexp_replace(expiry_date, '[^0-9]', '', 'g') THEN 'Date of Expiry:warning' END) END AS found
FROM joined
""")
def registry_cross_check(spark, d):
    rows = registry.lookup(screenings(spark, d), known(spark, d), "number", contained=False)
    i = F.col("document_id")
    name = F.when(i % 3 == 0, NOT_DETECTED).when(i % 3 == 1, F.col("c_name")).otherwise("Someone Else")
    born = F.when(i % 2 == 0, F.col("record.dob")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    fields = F.create_map(F.lit("Name"), name, F.lit("Date of Birth"), born, F.lit("Date of Expiry"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    found = F.transform(registry.mismatches(fields, F.col("record")), lambda x: F.concat(x["field"], F.lit(":"), x["severity"]))
    return rows.select("document_id", F.array_join(found, ";").alias("found"))


@query("SELECT s_suppkey AS id, s_name AS full_name, 1 AS fresh FROM supplier UNION ALL SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey % 7 <> 0")
def registry_seed(spark, d):
    """Rows whose number the registry lacks are added, others ignored."""
    own = known(spark, d)
    c = F.col("s_suppkey")
    more = table(spark, d, "supplier").select(
        c.alias("id"), F.concat(F.lit("S"), c.cast("string")).alias("document_number"), F.lit("visa").alias("document_type"), F.col("s_name").alias("full_name"), F.lit("valid").alias("status")
    )
    again = own.select("id", "document_number", "document_type", "full_name", "status")
    rows = registry.seed(own, more.unionByName(again))
    fresh = F.col("document_number").startswith("S")
    return rows.select(F.when(fresh, F.substring("document_number", 2, 20).cast("long")).otherwise(F.col("id")).alias("id"), "full_name", fresh.cast("int").alias("fresh"))


# -- validation --------------------------------------------------------------------------------------------------

TYPES = ("Passport", " VISA ", "driving-license", "ID Card", "permit", "Library card", "")


def _type(key):
    return F.element_at(F.array(*(F.lit(t) for t in TYPES)), (key % 7 + 1).cast("int"))


TYPE_SQL = "(['Passport', ' VISA ', 'driving-license', 'ID Card', 'permit', 'Library card', ''])[(o_orderkey % 7 + 1)::INT]"
KEY_SQL = f"translate(lower(trim({TYPE_SQL})), ' -', '__')"
NORMAL_SQL = f"CASE {KEY_SQL} WHEN 'driving_license' THEN 'drivers_license' WHEN 'driver_license' THEN 'drivers_license' WHEN 'id_card' THEN 'national_id' ELSE {KEY_SQL} END"


@query(f"SELECT o_orderkey, {NORMAL_SQL} AS kind FROM orders")
def doc_type_normalize(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.document_type(_type(F.col("o_orderkey"))).alias("kind"))


@query(f"""
WITH n AS (SELECT o_orderkey, {NORMAL_SQL} AS kind, upper(trim(CASE WHEN o_orderkey % 3 = 0 THEN 'ab ' || o_orderkey ELSE ' x' || (o_orderkey * 977)::VARCHAR END)) AS v FROM orders)
SELECT o_orderkey, CASE kind WHEN 'passport' THEN regexp_full_match(v, '[A-Z0-9]{{6,9}}') WHEN 'visa' THEN regexp_full_match(v, '[A-Z0-9]{{6,12}}')
  WHEN 'national_id' THEN regexp_full_match(v, '[A-Z0-9]{{6,12}}') WHEN 'drivers_license' THEN regexp_full_match(v, '[A-Z0-9\\-\\s]{{5,20}}')
  WHEN 'permit' THEN regexp_full_match(v, '[A-Z0-9\\-\\s]{{4,20}}') ELSE false END AS matches FROM n
""")
def number_format(spark, d):
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("ab "), k.cast("string"))).otherwise(F.concat(F.lit(" x"), (k * 977).cast("string")))
    return table(spark, d, "orders").select(k, validate.number_matches(number, _type(k)).alias("matches"))


def _date_text(key, day):
    """A date in one of several forms, some of them unreadable."""
    form = lambda f: F.date_format(day, f)
    return (
        F.when(key % 8 == 0, form("dd MMM yyyy")).when(key % 8 == 1, form("d/M/yyyy")).when(key % 8 == 2, form("dd-MM-yyyy")).when(key % 8 == 3, form("dd.MM.yyyy"))
        .when(key % 8 == 4, form("yyyy-MM-dd")).when(key % 8 == 5, form("dd/MM/yy")).when(key % 8 == 6, F.lit("31/02/1997")).otherwise(F.upper(form("dd-MMMM-yyyy")))
    )


DATES_SQL = """
dates AS (SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 8 = 6 THEN NULL ELSE o_orderdate::DATE END AS parsed FROM orders)"""


@query(f"WITH {DATES_SQL} SELECT o_orderkey, parsed::VARCHAR AS parsed, parsed < DATE '1998-01-01' AS is_expired, date_diff('day', DATE '1998-01-01', parsed)::INT AS days FROM dates")
def expiry_days(spark, d):
    """V3's known forms and V6."""
    value = _date_text(F.col("o_orderkey"), F.col("o_orderdate"))
    found = validate.expiry(value, AS_OF)
    return table(spark, d, "orders").select(
        "o_orderkey", text.any_date(value).cast("string").alias("parsed"), found["is_expired"].alias("is_expired"), found["days_until_expiry"].alias("days")
    )


@query(f"""
WITH {DATES_SQL}, b AS (SELECT *, day + INTERVAL 400 DAY AS born, day + 0 AS ends FROM dates WHERE o_orderkey % 2 = 0 UNION ALL SELECT *, day - INTERVAL 9000 DAY, day FROM dates WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, concat_ws(';', CASE WHEN parsed IS NULL THEN 'Date of Expiry:warning' END, CASE WHEN born > DATE '1998-01-01' THEN 'Date of Birth:error' END,
  CASE WHEN parsed < DATE '1998-01-01' THEN 'Date of Expiry:error' END, CASE WHEN born >= parsed THEN 'Date of Expiry:error' END) AS found FROM b
""")
def date_logic(spark, d):
    k = F.col("o_orderkey")
    born = F.when(k % 2 == 0, F.date_add("o_orderdate", 400)).otherwise(F.date_add("o_orderdate", -9000)).cast("string")
    fields = F.create_map(F.lit("Date of Birth"), born, F.lit("Date of Expiry"), _date_text(k, F.col("o_orderdate")))
    found = F.transform(validate.date_logic(fields, AS_OF), lambda x: F.concat(x["field"], F.lit(":"), x["severity"]))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(found, ";").alias("found"))


@query("""
WITH p AS (SELECT p_partkey, p_size, (['day', 'days', 'MONTHS', 'Year', 'weeks'])[(p_partkey % 5 + 1)::INT] AS unit, (['single', 'Double', ' MULTIPLE ', '1', '2', '7', 'none'])[(p_partkey % 7 + 1)::INT] AS entry FROM part),
s AS (SELECT p_partkey, CASE lower(unit) WHEN 'day' THEN p_size * 4 WHEN 'days' THEN p_size * 4 WHEN 'months' THEN p_size * 4 * 30 WHEN 'year' THEN p_size * 4 * 365 END AS days,
  CASE lower(trim(entry)) WHEN 'single' THEN 180 WHEN '1' THEN 180 WHEN 'double' THEN 270 WHEN '2' THEN 270 WHEN 'multiple' THEN 365 WHEN '7' THEN 365 END AS most FROM p)
SELECT p_partkey, days::BIGINT AS days, most::INT AS most, coalesce(days > most, false) AS too_long FROM s
""")
def visa_stay_limit(spark, d):
    """V4 and V10."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("p_partkey") % n + 1).cast("int"))
    stay = F.concat((F.col("p_size") * 4).cast("string"), F.lit(" "), pick(("day", "days", "MONTHS", "Year", "weeks"), 5))
    entry = pick(("single", "Double", " MULTIPLE ", "1", "2", "7", "none"), 7)
    fields = F.create_map(F.lit("Entry Validation"), entry, F.lit("Stay Duration"), stay)
    found = validate.cross_fields(fields, F.lit("Visa"))
    return table(spark, d, "part").select("p_partkey", text.stay_days(stay).alias("days"), validate.stay_limit(entry).cast("int").alias("most"), (F.size(found) > 0).alias("too_long"))


def _gappy(spark, d):
    """Orders as generic documents some of whose fields weren't detected."""
    k = F.col("o_orderkey")
    gap = lambda n, v: F.when(k % n == 0, NOT_DETECTED).when(k % n == 1, "").otherwise(v)
    number = gap(5, F.concat(F.lit("N"), k.cast("string")))
    fields = F.map_from_arrays(
        F.array(*(F.lit(x) for x in ("Name", "ID Number", "Date of Birth", "Date of Expiry"))),
        F.array(gap(3, F.lit("A Name")), number, gap(4, F.lit("01/02/1970")), gap(7, F.date_format("o_orderdate", "dd/MM/yyyy"))),
    )
    return table(spark, d, "orders").select(k, F.element_at(F.array(F.lit("Permit"), F.lit("National ID")), (k % 2 + 1).cast("int")).alias("kind"), fields.alias("fields"))


GAPPY_SQL = """
g AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS permit, o_orderkey % 3 < 2 AS no_name, o_orderkey % 5 < 2 AS no_number, o_orderkey % 4 < 2 AS no_birth,
       o_orderkey % 7 < 2 AS no_expiry, length('N' || o_orderkey) AS size, o_orderdate::DATE < DATE '1998-01-01' AS expired FROM orders),
f AS (SELECT *, concat_ws(';', CASE WHEN no_name THEN 'Name' END, CASE WHEN no_number THEN 'Document Number' END,
       CASE WHEN NOT permit AND no_birth THEN 'Date of Birth' END, CASE WHEN permit AND no_expiry THEN 'Date of Expiry' END) AS missing,
       NOT permit AND NOT no_number AND NOT size BETWEEN 6 AND 12 AS misshapen, NOT no_expiry AND expired AS ended FROM g)"""


@query(f"WITH {GAPPY_SQL} SELECT o_orderkey, missing FROM f")
def required_fields(spark, d):
    found = F.transform(validate.required_fields(F.col("fields"), F.col("kind")), lambda x: x["field"])
    return _gappy(spark, d).select("o_orderkey", F.array_join(found, ";").alias("missing"))


@query(f"""
WITH {GAPPY_SQL} SELECT o_orderkey, CASE WHEN ended THEN 'fail' WHEN missing <> '' OR misshapen THEN 'warning' ELSE 'pass' END AS status, NOT ended AS is_valid,
  ((CASE WHEN missing = '' THEN 0 ELSE length(missing) - length(replace(missing, ';', '')) + 1 END) + (CASE WHEN misshapen THEN 1 ELSE 0 END))::INT AS warnings FROM f
""")
def validation_status(spark, d):
    """V11 and V12."""
    rows = validate.validated(text.spread(_gappy(spark, d)), AS_OF, False, kind="kind").withColumn("s", validate.summary(F.col("validation")))
    return rows.select("o_orderkey", "validation.status", "s.is_valid", F.size("s.warnings").alias("warnings"))


@query(f"""
WITH {GAPPY_SQL}, l AS (SELECT (CASE WHEN ended THEN ['error:Date of Expiry'] ELSE []::VARCHAR[] END)
    || (CASE WHEN missing = '' THEN []::VARCHAR[] ELSE list_transform(string_split(missing, ';'), lambda x: 'warning:' || x) END) || (CASE WHEN misshapen THEN ['warning:ID Number'] ELSE []::VARCHAR[] END) AS found FROM f),
u AS (SELECT unnest(found) AS issue, unnest(range(len(found))) AS place FROM l)
SELECT place::INT AS place, string_split(issue, ':')[1] AS severity, string_split(issue, ':')[2] AS field, count(*) AS n FROM u GROUP BY ALL
""")
def issue_unpivot(spark, d):
    """Issues as rows, errors first, counted by their place."""
    found = validate.validate(F.col("fields"), F.col("kind"), AS_OF)["issues"]
    rows = _gappy(spark, d).select(F.posexplode(reports.errors_first(found)).alias("place", "i"))
    return rows.groupBy("place", "i.severity", "i.field").agg(F.count(F.lit(1)).alias("n"))



# -- extraction --------------------------------------------------------------------------------------------------


@query(f"""
WITH {SCREENINGS_SQL} SELECT document_id, c_name AS name, number, strftime(o_orderdate, '%d-%m-%Y') AS ends,
  round_even((document_id % 11) / 10.0::DOUBLE * 0.9::DOUBLE * 100, 0)::INT AS name_confidence, round_even((document_id % 11) / 10.0::DOUBLE * 100, 0)::INT AS number_confidence FROM screenings
""")
def label_extract(spark, d):
    """T11, T14-T16, T19, T21 on derived licence texts."""
    rows = screenings(spark, d).select("document_id", "raw_text", F.lit("Driving License").alias("document_type"), (F.col("document_id") % 11 / F.lit(10.0)).alias("ocr_confidence"))
    out = extract.extract(rows)
    return out.select(
        "document_id", F.col("fields")["Name"].alias("name"), F.col("fields")["License Number"].alias("number"), F.col("fields")["Date of Expiry"].alias("ends"),
        F.col("field_confidence")["Name"].alias("name_confidence"), F.col("field_confidence")["Document Number"].alias("number_confidence"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ROE ' || c_name ELSE c_name END AS name, 'P' || lpad(c_custkey::VARCHAR, 7, '0') AS number,
  CASE c_custkey % 4 WHEN 0 THEN 'Indian' WHEN 1 THEN 'Not Detected' ELSE 'French' END AS nationality, '17-05-19' || (c_custkey % 90 + 10) AS born,
  CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'X' WHEN 3 THEN 'Not Detected' ELSE 'F' END AS gender, CASE WHEN c_custkey % 4 = 1 THEN 'Nationality' ELSE '' END
    || CASE WHEN c_custkey % 5 = 3 THEN CASE WHEN c_custkey % 4 = 1 THEN ';Gender' ELSE 'Gender' END ELSE '' END AS low
FROM customer
""")
def passport_text(spark, d):
    """T15-T17 on derived passports: surname and given names or a full name, values beside or below their labels, a label taken for a country."""
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("Surname\nROE\nGiven Names : "), "c_name")).otherwise(F.concat(F.lit("Name : "), "c_name"))
    country = F.element_at(F.array(*(F.lit(x) for x in ("Indian", "Passport", "French", "French"))), (c % 4 + 1).cast("int"))
    sex = F.element_at(F.array(*(F.lit(x) for x in ("Sex : male", "Sex : F", "Sex\nX", "", "Gender : Female"))), (c % 5 + 1).cast("int"))
    lines = F.concat_ws(
        "\n", F.lit("REPUBLIC"), name, F.concat(F.lit("Passport No\nP"), F.lpad(c.cast("string"), 7, "0")), F.concat(F.lit("Nationality : "), country),
        F.concat(F.lit("Date of Birth : 17-05-19"), (c % 90 + 10).cast("string")), sex, F.lit("Date of Expiry : 20-01-2030"),
    )
    out = extract.extract(table(spark, d, "customer").select("c_custkey", lines.alias("raw_text"), F.lit("Passport").alias("document_type"), F.lit(1.0).alias("ocr_confidence")))
    value = lambda f: F.col("fields")[f]
    return out.select(
        "c_custkey", value("Name").alias("name"), value("Passport Number").alias("number"), value("Nationality").alias("nationality"), value("Date of Birth").alias("born"),
        value("Gender").alias("gender"), F.array_join("low_confidence_fields", ";").alias("low"),
    )


@query("""
SELECT c_custkey, 'V' || lpad(c_custkey::VARCHAR, 8, '0') AS number, CASE WHEN c_custkey % 3 = 0 THEN 'Not Detected' ELSE 'Tourist ' || (c_custkey % 7) END AS type,
  CASE c_custkey % 4 WHEN 0 THEN 'Single' WHEN 1 THEN 'MULTIPLE' WHEN 2 THEN '2' ELSE 'Not Detected' END AS entries, CASE WHEN c_custkey % 5 = 0 THEN 'Not Detected' ELSE (c_custkey % 200) || ' days' END AS stay
FROM customer
""")
def visa_text(spark, d):
    """T18 on derived visas, with values beside and below their labels and some that are missing."""
    c = F.col("c_custkey")
    entries = F.element_at(F.array(*(F.lit(x) for x in ("Number of Entries : Single", "Entries\nMULTIPLE", "No. of entries 2", "-"))), (c % 4 + 1).cast("int"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Visa No : V"), F.lpad(c.cast("string"), 8, "0")), F.when(c % 3 != 0, F.concat(F.lit("Visa Type : Tourist "), (c % 7).cast("string"))), entries,
        F.when(c % 5 != 0, F.concat(F.lit("Duration of Stay\nup to "), (c % 200).cast("string"), F.lit(" days"))),
    )
    out = extract.extract(table(spark, d, "customer").select("c_custkey", lines.alias("raw_text"), F.lit("visa").alias("document_type")))
    names = {"number": "Visa Number", "type": "Visa Type", "entries": "Entry Validation", "stay": "Stay Duration"}
    return out.select("c_custkey", *(F.col("fields")[f].alias(n) for n, f in names.items()))


@query("""
SELECT o_orderkey, 'OD07 ' || lpad(o_orderkey::VARCHAR, 11, '0') AS number, strftime(o_orderdate + INTERVAL 7300 DAY, '%d/%m/%Y') AS ends FROM orders
""")
def number_fallback(spark, d):
    """T19 without labels: a standalone number, and the latest year as expiry."""
    number = F.concat(F.lit("OD07 "), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"))
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "dd/MM/yyyy")
    body = F.concat(F.lit("REPUBLIC\n"), number, F.lit("\nDOB "), day(-9000), F.lit("\nseen "), day(10), F.lit(" until "), day(7300))
    out = extract.extract(table(spark, d, "orders").select("o_orderkey", body.alias("raw_text"), F.lit("permit").alias("document_type")))
    return out.select("o_orderkey", F.col("fields")["Permit Number"].alias("number"), F.col("fields")["Date of Expiry"].alias("ends"))


@query("""
WITH c AS (SELECT c_custkey, 'X' || lpad(c_custkey::VARCHAR, 8, '0') AS number, lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '07' || (1950 + c_custkey % 50)::VARCHAR AS born,
  (10 + c_custkey % 80)::VARCHAR || '0510' AS ends FROM customer)
SELECT c_custkey, 'DOE JANE ' || (['ANNA', 'MARY'])[(c_custkey % 2 + 1)::INT] AS name, number, CASE WHEN c_custkey % 3 = 0 THEN 'USA' ELSE 'IND' END AS nationality,
  substr(born, 1, 2) || '/' || substr(born, 3, 2) || '/' || substr(born, 5, 4) AS born, 'F' AS gender,
  '10/05/' || (CASE WHEN substr(ends, 1, 2) < '50' THEN '20' ELSE '19' END) || substr(ends, 1, 2) AS ends FROM c
""")
def mrz_parse(spark, d):
    """T7-T9 on derived zones, with misread fillers."""
    c = F.col("c_custkey")
    number = F.concat(F.lit("X"), F.lpad(c.cast("string"), 8, "0"))
    born = F.concat(F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit("07"), (c % 50 + 1950).cast("string"))
    first = F.concat(F.lit("P<"), F.when(c % 3 == 0, "USA").otherwise("IND"), F.lit("DOE<<JANE<"), F.element_at(F.array(F.lit("ANNA"), F.lit("MARY")), (c % 2 + 1).cast("int")), F.lit("<<<<sss<<<<<<"))
    second = F.concat(number, F.when(c % 3 == 0, "USA").otherwise("IND"), born, F.lit("F"), (c % 80 + 10).cast("string"), F.lit("0510<<<<"))
    zone = extract.mrz(F.concat(F.lit("PASSPORT\n"), first, F.lit("\n"), second))
    return table(spark, d, "customer").select(c, *(zone[n].alias(n) for n in ("name", "number", "nationality", "born", "gender", "ends")))


# ß in capitals is SS, which one of the engines leaves as it is
@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\t\\n\\f\\r ]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS nth, upper(replace(concat_ws(' ', words[1], words[2]), 'ß', 'SS')) AS value FROM w),
b AS (SELECT doc_id, value, CASE WHEN nth % 5 = 0 THEN NULL ELSE ((nth * 7) % 100) / 100.0::DOUBLE END AS sure, upper(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) AS bare FROM i),
m AS (SELECT doc_id, avg(sure) FILTER (WHERE bare <> '' AND list_contains(regexp_extract_all(value, '[A-Za-z0-9]+'), bare)) AS mean FROM b GROUP BY doc_id)
SELECT doc_id, round_even(coalesce(mean, 0.5::DOUBLE) * 100, 6) AS sure FROM documents LEFT JOIN m USING (doc_id)
""")
def token_confidence(spark, d):
    """T13 with all words of a document as boxes, for its first two as the value; a null text has none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\t\n\f\r ]+"), lambda x: x != "")
    boxes = F.transform("words", lambda w, i: F.struct(w.alias("text"), F.when((i + 1) % 5 != 0, ((i + 1) * 7 % 100) / F.lit(100.0)).alias("confidence")))
    rows = table(spark, d, "documents").select("doc_id", words.alias("words"))
    sure = extract.word_confidence(F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(1))), boxes, F.lit(0.5))
    return rows.select("doc_id", F.bround(sure * 100, 6).alias("sure"))



# -- risk --------------------------------------------------------------------------------------------------------

LINES_SQL = """
base AS (SELECT row_number() OVER () AS row, l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'warning' WHEN 2 THEN 'fail' END AS validation_status,
  (l_linenumber % 3)::INT AS errors, (l_partkey % 9)::INT AS warnings, (['Valid', 'Not Found', 'Expired', 'Blacklisted', ''])[(l_suppkey % 5 + 1)::INT] AS registry_status,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE (l_partkey % 131 - 10)::DOUBLE END AS tampering_score, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_orderkey % 101)::DOUBLE END AS face_score FROM lineitem)"""


def _risked(spark, d):
    k, n, p, s = (F.col(f"l_{x}") for x in ("orderkey", "linenumber", "partkey", "suppkey"))
    status = F.when((k + n) % 4 == 0, "pass").when((k + n) % 4 == 1, "warning").when((k + n) % 4 == 2, "fail")
    shown = F.element_at(F.array(*(F.lit(x) for x in ("Valid", "Not Found", "Expired", "Blacklisted", ""))), (s % 5 + 1).cast("int"))
    tampering, face = F.when(p % 6 != 0, (p % 131 - 10).cast("double")), F.when(s % 3 != 0, (k % 101).cast("double"))
    return risk.with_risk(table(spark, d, "lineitem"), "r", status, n % 3, (p % 9).cast("int"), shown, tampering, face).select(k, n, "r")


@query(f"WITH {LINES_SQL}, {RISK_SQL} SELECT l_orderkey, l_linenumber, risk_score, {BAND_SQL} AS risk_band FROM scored")
def risk_renormalize(spark, d):
    """K1-K5 and K8 over every line, with missing signals and floors."""
    return _risked(spark, d).select("l_orderkey", "l_linenumber", "r.risk_score", "r.risk_band")


@query(f"""
WITH {LINES_SQL}, {RISK_SQL}, parts AS (
  SELECT row, 'Document validation' AS factor, 0 AS nth, round_even(v * (wv / w), 1) AS weighted FROM scored WHERE v IS NOT NULL
  UNION ALL SELECT row, 'Registry check', 1, round_even(r * (wr / w), 1) FROM scored WHERE r IS NOT NULL
  UNION ALL SELECT row, 'Tampering analysis', 2, round_even(t * (wt / w), 1) FROM scored WHERE tampering_score IS NOT NULL
  UNION ALL SELECT row, 'Face match', 3, round_even(f * (wf / w), 1) FROM scored WHERE face_score IS NOT NULL
)
SELECT factor, place, count(*) AS n FROM (SELECT factor, row_number() OVER (PARTITION BY row ORDER BY weighted DESC, nth) AS place FROM parts) GROUP BY 1, 2
""")
def factor_rank(spark, d):
    """K8's factors by weighted score, ties in the signals' order."""
    # an inner explode would have the optimizer compute the factors once more, in a filter on their number
    rows = _risked(spark, d).select(F.posexplode_outer("r.contributing_factors").alias("place", "f")).where("place is not null")
    return rows.groupBy("f.factor", (F.col("place") + 1).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT score, CASE WHEN score BETWEEN 0 AND 20 THEN 'LOW' WHEN score BETWEEN 21 AND 50 THEN 'MEDIUM' WHEN score BETWEEN 51 AND 75 THEN 'HIGH' ELSE 'CRITICAL' END AS band
FROM (SELECT DISTINCT (l_quantity * 2 + (l_linenumber % 2) * 0.5) AS score FROM lineitem)
""")
def risk_band(spark, d):
    """K5, with scores between two bands."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") * 2 + F.col("l_linenumber") % 2 * 0.5).alias("score")).distinct()
    return rows.select("score", risk.band(F.col("score")).alias("band"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 11) / 10.0::DOUBLE AS p, (l_suppkey % 9) / 10.0::DOUBLE AS x, (l_orderkey % 7) / 10.0::DOUBLE AS s, (l_linenumber % 4) / 4.0::DOUBLE AS m FROM lineitem),
t AS (SELECT *, round_even(greatest(0, least(1, 0.35::DOUBLE * p + 0.3::DOUBLE * x + 0.2::DOUBLE * s + 0.15::DOUBLE * m)) * 100, 0)::INT AS score FROM b)
SELECT l_orderkey, l_linenumber, score AS tampering_score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS risk_level,
  concat_ws(';', CASE WHEN p >= 0.5 THEN 'photo_substitution' END, CASE WHEN x >= 0.5 THEN 'text_manipulation' END, CASE WHEN s >= 0.5 THEN 'stamp_forgery' END, CASE WHEN m >= 0.5 THEN 'metadata' END) AS flags FROM t
""")
def tamper_score(spark, d):
    """F9 from four confidences."""
    own = (F.col("l_partkey") % 11 / F.lit(10.0), F.col("l_suppkey") % 9 / F.lit(10.0), F.col("l_orderkey") % 7 / F.lit(10.0), F.col("l_linenumber") % 4 / F.lit(4.0))
    t = forensics.tampering(*(forensics.detector(c) for c in own))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t["tampering_score"].alias("tampering_score"), t["risk_level"].alias("risk_level"), F.array_join(t["flags"], ";").alias("flags"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, 0.5::DOUBLE + l_quantity / 10 AS e, 0.4::DOUBLE + l_discount * 20 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(least(1.0::DOUBLE, abs(ln(e)) / 2 * 0.6::DOUBLE + abs(ln(n)) / 3 * 0.4::DOUBLE), 3) AS confidence FROM b
""")
def photo_score(spark, d):
    """F5's score from two ratios."""
    s = forensics.photo_substitution(0.5 + F.col("l_quantity") / 10, 0.4 + F.col("l_discount") * 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s["confidence"].alias("confidence"))


@query("""
SELECT doc_id, (contains(lower(t), 'photoshop') OR contains(lower(t), 'gimp') OR contains(lower(t), 'canva')) AS edited
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Adobe Photoshop 24.0 ' WHEN 1 THEN ' GIMP 2.10 ' WHEN 2 THEN 'scanner ' ELSE '' END || coalesce(source, '') AS t FROM documents)
""")
def editor_signature(spark, d):
    """F8's search for editors in a software tag."""
    i = F.col("doc_id")
    made = F.when(i % 4 == 0, "Adobe Photoshop 24.0 ").when(i % 4 == 1, " GIMP 2.10 ").when(i % 4 == 2, "scanner ").otherwise("")
    return table(spark, d, "documents").select("doc_id", forensics.editor_in(F.concat(made, F.coalesce("source", F.lit("")))).isNotNull().alias("edited"))


# -- faces -------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, dist, round_even(greatest(0, least(100, 50.0::DOUBLE * (2.0::DOUBLE - dist / 0.6::DOUBLE))), 1) AS similarity FROM p)
SELECT vec_id, round(dist, 6) AS dist, similarity, similarity >= 50 AS is_match FROM s
""")
def face_similarity(spark, d):
    """B8, B14, B17 on neighbouring embeddings."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    dist = faces.euclidean(F.col("embedding"), F.col("other"))
    verdict = faces.compare(F.lit(True), F.lit(1), F.lit(1), dist)
    return pairs.select("vec_id", F.round(dist, 6).alias("dist"), verdict["similarity_score"].alias("similarity"), verdict["is_match"].alias("is_match"))


@query("""
SELECT l_orderkey, arg_max(l_linenumber, (l_quantity * (1 + l_linenumber % 3)) * 1000 - l_linenumber)::INT AS largest FROM lineitem GROUP BY l_orderkey
""")
def largest_face(spark, d):
    """The largest box of each order's lines, the first of equals."""
    box = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("width"), (F.col("l_linenumber") % 3 + 1).alias("height"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return rows.select("l_orderkey", faces.largest_face(F.col("boxes"))["l_linenumber"].alias("largest"))


# -- ledger and reports ------------------------------------------------------------------------------------------


def entries(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("index"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("document_id"),
        F.pmod(F.floor("value"), F.lit(101)).cast("string").alias("risk_score"),
        F.when(F.col("event_id") % 5 == 0, "CRITICAL").when(F.col("event_id") % 5 == 1, "High").otherwise(F.upper("event_type")).alias("decision"),
    )


ENTRIES_SQL = """
entries AS (SELECT event_id AS index, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, user_id::VARCHAR AS document_id, (((floor(value)::BIGINT % 101) + 101) % 101)::VARCHAR AS risk_score,
  CASE event_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' ELSE upper(event_type) END AS decision FROM events)"""
HASH_SQL = """sha256('{"decision": "' || decision || '", "document_id": "' || document_id || '", "prev_hash": "' || prev_hash || '", "risk_score": ' || risk_score || ', "timestamp": "' || timestamp || '"}')"""


@query(f"WITH {ENTRIES_SQL}, h AS (SELECT *, '{GENESIS}' AS prev_hash FROM entries) SELECT index, {HASH_SQL} AS hash FROM h")
def ledger_hash(spark, d):
    return entries(spark, d).select("index", ledger.record_hash(F.col("decision"), F.col("document_id"), F.lit(GENESIS), F.col("risk_score"), F.col("timestamp")).alias("hash"))


#: The chain over all entries, by position n, one after another.
CHAIN_SQL = f"""
{ENTRIES_SQL}, e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY index) - 1 AS n FROM entries),
chain AS (
  SELECT 0::BIGINT AS n, '{GENESIS}' AS prev_hash, {HASH_SQL.replace("prev_hash ||", f"'{GENESIS}' ||")} AS hash FROM e WHERE n = 0
  UNION ALL SELECT e.n, chain.hash, {HASH_SQL.replace("prev_hash ||", "chain.hash ||")} FROM chain JOIN e ON e.n = chain.n + 1
)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT e.n AS index, prev_hash, timestamp, document_id, risk_score, decision, hash FROM chain JOIN e USING (n)")
def ledger_build(spark, d):
    """L2: one serial chain over all events."""
    return ledger.build(entries(spark, d))


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT e.n AS index, prev_hash, timestamp, document_id, risk_score, decision, hash FROM chain JOIN e USING (n)")
def ledger_append(spark, d):
    """A stored ledger that two further runs continue from its last head."""
    rows = entries(spark, d)
    folder = shared_folder(spark, "ledger")
    cuts = rows.agg(F.percentile("index", F.array(F.lit(0.3), F.lit(0.8))).alias("at")).first()["at"] or [0, 0]
    i = F.col("index")
    for part in (i <= cuts[0], (i > cuts[0]) & (i <= cuts[1]), i > cuts[1]):
        ledger.append(rows.where(part), folder)
    return ledger.stored(spark, folder).select("index", "prev_hash", "timestamp", "document_id", "risk_score", "decision", "hash")


@query(f"""
WITH RECURSIVE {CHAIN_SQL}, last AS (SELECT max(n) AS n FROM e), edited AS (SELECT n FROM e WHERE n >= (SELECT n FROM last) * 0.9 AND n % 7 = 3)
SELECT (SELECT count(*) FROM e) AS total_records, (SELECT min(n) FROM edited) AS broken_at_index, (SELECT count(*) = 0 FROM edited) AS is_valid,
  'Entry ' || (SELECT min(n) FROM edited) || chr(39) || 's stored hash does not match its recomputed hash (one of its fields was likely edited after the fact).' AS reason
""")
def ledger_verify(spark, d):
    """A true chain of which some late entries were edited; all before them must hold."""
    built = ledger.build(entries(spark, d))
    last = built.agg(F.max("index").alias("last"))
    rows = built.join(last).withColumn("decision", F.when((F.col("index") >= F.col("last") * F.lit(0.9)) & (F.col("index") % 7 == 3), "LOW!").otherwise(F.col("decision")))
    return ledger.verify(rows.drop("last")).select("total_records", "broken_at_index", "is_valid", "reason")


@query("SELECT user_id::VARCHAR AS chain, count_if(event_id % 50 = 3) = 0 AS is_valid, count(*) AS total_records FROM events GROUP BY 1")
def ledger_partitioned(spark, d):
    """L2 and L4 with a chain for each user: built in parallel, some of them edited, each verified."""
    own = entries(spark, d).withColumns({"user": F.col("document_id"), "event": F.col("index")})
    rows = ledger.build(own, key="user", keep=("event",))
    edited = F.col("event").cast("long") % 50 == 3
    rows = rows.withColumn("document_id", F.when(edited, F.concat("document_id", F.lit("!"))).otherwise(F.col("document_id")))
    return ledger.verify(rows, key="chain").select("chain", "is_valid", "total_records")


@query(f"WITH {ENTRIES_SQL} SELECT index, timestamp, document_id, risk_score, decision FROM entries ORDER BY index")
def ledger_list(spark, d):
    """The entries, oldest first."""
    return ledger.oldest_first(entries(spark, d))


@query(f"WITH {SCREENINGS_SQL} SELECT id, document_number, full_name, status, dob FROM known ORDER BY id DESC")
def registry_list(spark, d):
    """A stored registry, seeded in two runs, newest first."""
    own = known(spark, d)
    folder = shared_folder(spark, "registry")
    own.where("id % 2 = 0").write.parquet(folder)
    stored = registry.create(spark, folder, own)
    ids = own.select(F.col("document_number").alias("of"), F.col("id").alias("own_id"))
    rows = stored.join(ids, F.col("document_number") == F.col("of")).withColumn("id", F.col("own_id"))
    return registry.newest_first(rows).select("id", "document_number", "full_name", "status", "dob")


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS total_screened, count_if(upper(decision) IN ('HIGH', 'CRITICAL'))::BIGINT AS high_risk, round_even(avg(risk_score::DOUBLE), 1) AS avg_risk_score FROM entries")
def dashboard(spark, d):
    return reports.dashboard(entries(spark, d))


@query(f"WITH {ENTRIES_SQL} SELECT timestamp, document_id, risk_score, decision FROM entries ORDER BY index DESC")
def history(spark, d):
    return reports.history(entries(spark, d))


@query(f"WITH {ENTRIES_SQL} SELECT DISTINCT document_id FROM entries WHERE decision IN ('HIGH', 'CRITICAL') AND document_id::BIGINT % 10 <> 0")
def flag_queue(spark, d):
    """High-risk documents that aren't flagged yet."""
    rows = entries(spark, d).withColumnRenamed("decision", "risk_band")
    flagged = rows.where(F.col("document_id").cast("long") % 10 == 0).select("document_id").distinct()
    return reports.review_queue(rows, flagged).select("document_id")


@query(f"WITH {ENTRIES_SQL} SELECT index, timestamp, document_id, risk_score, decision FROM entries WHERE index = 42")
def ledger_entry(spark, d):
    return ledger.entry(entries(spark, d), 42)


@query(f"""
WITH {GAPPY_SQL}, r AS (
  SELECT o_orderkey, 'Name' AS field, CASE WHEN o_orderkey % 3 = 0 THEN 'Not Detected' WHEN o_orderkey % 3 = 1 THEN '' ELSE 'A Name' END AS value FROM g
  UNION ALL SELECT o_orderkey, 'Date of Birth', CASE WHEN o_orderkey % 4 = 0 THEN 'Not Detected' WHEN o_orderkey % 4 = 1 THEN '' ELSE '01/02/1970' END FROM g
)
SELECT o_orderkey, field, value, CASE field WHEN 'Name' THEN o_orderkey % 100 ELSE 0 END::INT AS confidence, CASE field WHEN 'Name' THEN o_orderkey % 100 < 60 ELSE true END AS flagged FROM r
""")
def field_unpivot(spark, d):
    """A10: fields as rows with their confidence and flag."""
    names = F.array(F.lit("Name"), F.lit("Date of Birth"))
    rows = _gappy(spark, d).select(
        F.col("o_orderkey"), F.map_filter("fields", lambda k, v: F.array_contains(names, k)).alias("fields"),
        F.create_map(F.lit("Name"), (F.col("o_orderkey") % 100).cast("int")).alias("field_confidence"), F.array(F.lit("Date of Birth")).alias("low_confidence_fields"),
    )
    return reports.field_rows(rows, "o_orderkey")


@query("""
WITH n AS (SELECT page_id, coalesce(url, '') AS name, (page_id * 104857 * 3) % 31457280 AS size FROM pages),
e AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS extension, round_even(size / 1048576.0::DOUBLE, 2) AS size_mb FROM n)
SELECT page_id, extension, size_mb, ((extension = '' OR extension NOT IN ('jpg', 'jpeg', 'png'))::INT + (size_mb > 10)::INT + (size = 0)::INT)::INT AS errors FROM e
""")
def upload_check(spark, d):
    """S1 on page names and derived sizes."""
    c = images.check_upload(F.col("url"), F.col("page_id") * (104857 * 3) % 31457280)
    return table(spark, d, "pages").select("page_id", c["extension"].alias("extension"), c["size_mb"].alias("size_mb"), F.size(c["errors"]).alias("errors"))


@query("""
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS screened, count_if(event_id % 5 < 2)::BIGINT AS high_risk FROM events GROUP BY 1
""")
def windowed_risk(spark, d):
    """Screenings by five-minute window."""
    from papyra.streaming.ingest import windowed_risk as by_window

    rows = table(spark, d, "events").select("ts", F.when(F.col("event_id") % 5 == 0, "CRITICAL").when(F.col("event_id") % 5 == 1, "HIGH").otherwise("LOW").alias("risk_band"))
    return by_window(rows).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "screened", "high_risk")


@query(f"""
WITH {SCREENINGS_SQL}, base AS (
  SELECT s.document_id, s.number, {SHOWN_SQL} AS registry_status, tampering_score, face_score, CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 1 ELSE 0 END AS errors, 0 AS warnings,
         CASE WHEN s.o_orderdate::DATE < DATE '1998-01-01' THEN 'fail' ELSE 'pass' END AS validation_status
  FROM screenings s LEFT JOIN known k ON s.number = k.document_number
), {RISK_SQL}
SELECT 'Permit' AS document_type, number AS document_number, {BAND_SQL} AS risk_band, risk_score, upper(validation_status) AS validation, registry_status AS registry, 'LOW' AS tampering,
  CASE WHEN face_score IS NULL THEN 'not checked' WHEN face_score >= 50 THEN 'match' ELSE 'no match' END AS face_match FROM scored
""")
def summary_lines(spark, d):
    """A line a screening."""
    return reports.summary(_screened(spark, d, cross_check=False))


# -- images ------------------------------------------------------------------------------------------------------

HEIGHT, WIDTH = 16, 20


def pictures(spark, d):
    """A small colour image for each customer, blue, green and red by a rule, as files give them once they are decoded."""
    key, at = F.col("c_custkey"), F.sequence(F.lit(0).cast("long"), F.lit(HEIGHT * WIDTH * 3 - 1).cast("long"))
    data = F.unhex(F.array_join(F.transform(at, lambda i: F.lpad(F.hex((key * 31 + i * i * 7 + i * (13 + key % 5)) % 256), 2, "0")), ""))
    image = F.struct(F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(3).alias("channels"), data.alias("data"))
    return table(spark, d, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).select(key, image.alias("image"))


PICTURES_SQL = f"""
place AS (SELECT y, x FROM range({HEIGHT}) a(y), range({WIDTH}) b(x)),
colour AS (SELECT c_custkey, y, x, {", ".join(f"(c_custkey * 31 + i * i * 7 + {2 * c * 7} * i + {c * c * 7} + (i + {c}) * (13 + c_custkey % 5)) % 256 AS {n}" for c, n in enumerate("bgr"))}
  FROM (SELECT c_custkey, y, x, (y * {WIDTH} + x) * 3 AS i FROM customer, place)),
light AS (SELECT *, floor(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE + 0.5::DOUBLE) AS grey, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS whole FROM colour)"""


@query(f"WITH {PICTURES_SQL} SELECT c_custkey, {WIDTH} AS width, {HEIGHT} AS height, sum(grey)::BIGINT AS total, max(grey * 1000 + y * {WIDTH} + x)::BIGINT AS brightest FROM light GROUP BY c_custkey")
def picture_grey(spark, d):
    """Grey values of every pixel."""
    measured = pixels.measured(F.col("image"), lambda x: [images.grayscale(x)], lambda x: {"total": int(x.sum()), "brightest": int((x.astype(int) * 1000 + np.arange(x.size).reshape(x.shape)).max())}, "total long, brightest long")
    return pictures(spark, d).withColumn("m", measured).select("c_custkey", F.col("image.width").alias("width"), F.col("image.height").alias("height"), "m.total", "m.brightest")


@query(f"""
WITH {PICTURES_SQL}, small AS (SELECT c_custkey, y // 2 AS y, x // 2 AS x, round_even(avg(b), 0) AS b, round_even(avg(g), 0) AS g, round_even(avg(r), 0) AS r FROM colour GROUP BY ALL)
SELECT c_custkey, {WIDTH // 2} AS width, {HEIGHT // 2} AS height, sum((b + 3 * g + 7 * r) * (y * {WIDTH // 2} + x + 1))::BIGINT AS checksum FROM small GROUP BY c_custkey
""")
def picture_shrink(spark, d):
    """No side longer than half of the longer one, by the mean of areas."""
    weigh = lambda x: int((x.astype(int) @ np.array([1, 3, 7]) * (np.arange(x.shape[0] * x.shape[1]).reshape(x.shape[:2]) + 1)).sum())
    small = lambda x: {"width": x.shape[1], "height": x.shape[0], "checksum": weigh(x)}
    measured = pixels.measured(F.col("image"), lambda x: [images.shrink(x, WIDTH // 2)], small, "width int, height int, checksum long")
    return pictures(spark, d).withColumn("m", measured).select("c_custkey", "m.*")


@query(f"""
WITH {PICTURES_SQL}, near AS (
  SELECT o.c_custkey, u.grey + w.grey + l.grey + q.grey - 4 * o.grey AS edge FROM light o
  JOIN light u ON u.c_custkey = o.c_custkey AND u.x = o.x AND u.y = CASE WHEN o.y = 0 THEN 1 ELSE o.y - 1 END
  JOIN light w ON w.c_custkey = o.c_custkey AND w.x = o.x AND w.y = CASE WHEN o.y = {HEIGHT - 1} THEN {HEIGHT - 2} ELSE o.y + 1 END
  JOIN light l ON l.c_custkey = o.c_custkey AND l.y = o.y AND l.x = CASE WHEN o.x = 0 THEN 1 ELSE o.x - 1 END
  JOIN light q ON q.c_custkey = o.c_custkey AND q.y = o.y AND q.x = CASE WHEN o.x = {WIDTH - 1} THEN {WIDTH - 2} ELSE o.x + 1 END
)
SELECT c_custkey, round(var_pop(edge) * {(HEIGHT * WIDTH) ** 2}, 0)::BIGINT AS variance FROM near GROUP BY c_custkey
""")
def picture_noise(spark, d):
    """F5's measure of noise: the variance of the Laplacian, as a whole number of its smallest steps."""
    measured = pixels.measured(F.col("image"), lambda x: [x], lambda x: {"variance": images.laplacian_variance(x)}, "variance double")
    return pictures(spark, d).withColumn("m", measured).select("c_custkey", F.round(F.col("m.variance") * (HEIGHT * WIDTH) ** 2).cast("long").alias("variance"))


@query(f"""
WITH {PICTURES_SQL}, skin AS (SELECT c_custkey, round_even((r - whole) * 0.713::DOUBLE + 128, 0) BETWEEN 133 AND 173 AND round_even((b - whole) * 0.564::DOUBLE + 128, 0) BETWEEN 77 AND 127 AS is_skin
  FROM light WHERE x BETWEEN 2 AND 18 AND y < 15)
SELECT c_custkey, round(avg(is_skin::INT), 9) AS share, avg(is_skin::INT) >= 0.04 AS is_face FROM skin GROUP BY c_custkey
""")
def picture_skin(spark, d):
    """The share of skin in a box, and the verdict."""
    box = {"left": 2, "top": 0, "width": 17, "height": 15}
    seen = lambda x: {"share": pixels.skin_share(face_detection.inside(x, box)), "is_face": face_detection.is_face(x, box)}
    measured = pixels.measured(F.col("image"), lambda x: [x], seen, "share double, is_face boolean")
    return pictures(spark, d).withColumn("m", measured).select("c_custkey", F.round("m.share", 9).alias("share"), "m.is_face")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 300 AS x, l_suppkey % 200 AS y, l_quantity::INT + 10 AS w, l_linenumber * 9 + 10 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(0, x - floor(w * 0.15::DOUBLE))::BIGINT AS x0, greatest(0, y - floor(h * 0.15::DOUBLE))::BIGINT AS y0, least(320, x + w + floor(w * 0.15::DOUBLE))::BIGINT AS x1,
  least(240, y + h + floor(h * 0.15::DOUBLE))::BIGINT AS y1, (x + w)::BIGINT AS "right", (y + h)::BIGINT AS bottom, w AS width, h AS height FROM b
""")
def face_boxes(spark, d):
    """B4's box with a margin, and B7's two forms of a box, there and back."""
    box = F.struct((F.col("l_partkey") % 300).alias("left"), (F.col("l_suppkey") % 200).alias("top"), (F.col("l_quantity").cast("int") + 10).alias("width"), (F.col("l_linenumber") * 9 + 10).alias("height"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    rows = rows.withColumn("c", faces.crop_box(F.col("box"), F.lit(320), F.lit(240))).withColumn("l", faces.box_to_location(F.col("box"))).withColumn("back", faces.location_to_box(F.col("l")))
    return rows.select(
        "l_orderkey", "l_linenumber", *(F.col(f"c.{n}").cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")), F.col("l.right").cast("long").alias("right"),
        F.col("l.bottom").cast("long").alias("bottom"), F.col("back.width").cast("int").alias("width"), F.col("back.height").cast("int").alias("height"),
    )


@query()
def picture_stages(spark, d):
    """Pixmap files decoded and taken through all six stages, with the error level (F3) of each; held against single images in tests."""
    head = F.lit(f"P6 {WIDTH} {HEIGHT} 255\n").cast("binary")
    files = pictures(spark, d).select("c_custkey", F.concat(head, "image.data").alias("content"), F.lit("a.png").alias("path"))
    rows = images.preprocess(files, stages=images.STAGES)
    level = pixels.measured(F.col("original"), lambda x: [x], lambda x: {"ela": enhance.error_level(x)["mean"]}, "ela double")
    return rows.withColumn("m", level).select("c_custkey", F.round("m.ela", 6).alias("ela"), *(F.sha2(f"{s}.data", 256).alias(s) for s in images.STAGES), "image_error")

"""The document registry: loading, lookup by number, and comparison of fields with the registered ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import alphanumeric, digits, document_type, let, none_if_blank, strip
from papyra.operators.validate import issue, issues
from papyra.schema import NOT_DETECTED, NUMBER_ALIASES, NUMBER_FIELD, REGISTRY, STATUS_SHOWN

#: Characters of a number by which the contained-in search meets candidates; shorter numbers are never searched so.
GRAM = 6


def document_number(fields: Column, kind: Column, bind=let) -> Column:
    """The number to look up: the type's field, then the general ones; the sentinel if none was detected."""
    names = sorted({*NUMBER_FIELD.values(), "Document Number", *NUMBER_ALIASES})
    raw = {n: F.try_element_at(fields, F.lit(n)) for n in names}
    return bind(raw | {"__key": document_type(kind, bind)}, lambda r: _number(lambda n: none_if_blank(r[n]), r["__key"]))


def _number(value, key: Column) -> Column:
    own = F.lit(None).cast("string")
    for name, field in NUMBER_FIELD.items():
        own = F.when(key == name, value(field)).otherwise(own)
    return F.coalesce(own, *(value(f) for f in ("Document Number", *NUMBER_ALIASES)), F.lit(NOT_DETECTED))


def conform(df: DataFrame) -> DataFrame:
    """df as a registry: its columns of that schema, cast; those that it lacks are null."""
    fields = [f.split() for f in REGISTRY.split(", ")]
    return df.select(*((F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in fields))


def seed(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """registry with those of rows whose number it lacks, numbered on after its largest id; rows without a number, type, name or known status are left out."""
    good = rows.where(
        F.col("document_number").isNotNull() & F.col("document_type").isNotNull() & F.col("full_name").isNotNull() & F.col("status").isin(*STATUS_SHOWN)
    )
    fresh = good.join(registry.select("document_number"), "document_number", "left_anti").groupBy("document_number").agg(F.min_by(F.struct(*good.columns), "id").alias("r"))
    last = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return registry.unionByName(conform(fresh.select("r.*").withColumn("id", F.col("id") + last)))


def migrated(df: DataFrame) -> DataFrame:
    """A registry of an earlier shape in today's: columns that it lacks are null, unknown ones go."""
    return conform(df)


def create(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """The registry stored in folder, made there if it isn't; rows (a registry's, of any shape) seed what it lacks.

    Files written under an earlier schema stay as they are and are read in today's shape. Only new rows are written.
    """
    from pyspark.errors import AnalysisException

    try:
        own = migrated(spark.read.option("mergeSchema", True).parquet(folder))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        own = conform(spark.createDataFrame([], REGISTRY))
        own.write.parquet(folder)
    if rows is not None:
        last = own.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
        seed(own, migrated(rows)).where(F.col("id") > last).write.mode("append").parquet(folder)
    return migrated(spark.read.option("mergeSchema", True).parquet(folder))


def newest_first(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("id"))


def lookup(df: DataFrame, registry: DataFrame, number: str = "document_number", contained: bool = True) -> DataFrame:
    """df with ``registry_status`` and ``record`` (the registered row, null if none).

    A number, upper-cased and stripped, equal to a registered one wins; otherwise the first row, by id, whose
    letters and digits equal the number's or, if those are at least GRAM, contain them. contained=False
    stops after equality. Blank and undetected numbers are not searched for. Registered numbers are unique.

    The search for contained numbers is an equi-join: a number contained in another shares each of its grams of GRAM
    characters with it, so it is sought by the one that the fewest registered numbers have. Only distinct numbers without
    an equal one go there, so rows that share a number cost one search.
    """
    columns = df.columns
    record = F.struct(*registry.columns).alias("record")
    known = registry.select(F.col("document_number").alias("__known"), record)
    probes = df.withColumn("__raw", F.upper(strip(none_if_blank(F.col(number))))).withColumn("__raw", F.nullif("__raw", F.lit("")))
    exact = probes.join(known, F.col("__raw") == F.col("__known"), "left")
    if not contained:
        found = exact
    else:
        missing = (
            exact.where(F.col("record").isNull() & F.col("__raw").isNotNull())
            .select(F.col("__raw").alias("raw"), alphanumeric(F.col("__raw")).alias("clean"))
            .where("clean <> ''")
            .distinct()
        )
        rows = registry.select("id", alphanumeric(F.col("document_number")).alias("key"), record)
        same = missing.join(rows, F.col("clean") == F.col("key")).select("raw", "id", "record")
        grams = rows.where(F.length("key") > GRAM).select(
            "id", "key", "record", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - GRAM + 1), lambda i: F.substring("key", i, GRAM)))).alias("gram")
        )
        pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, GRAM)))
        sought = missing.where(F.length("clean") >= GRAM).select("raw", "clean", F.explode(pieces("clean")).alias("gram"))
        known_grams = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
        rarest = sought.join(known_grams, "gram", "left").groupBy("raw", "clean").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram")).alias("best"))
        inside = (
            rarest.where("best.rows > 0").select("raw", "clean", "best.gram").join(grams, "gram")
            .where(F.contains("key", "clean") & (F.col("key") != F.col("clean"))).select("raw", "id", "record")
        )
        first = same.unionAll(inside).groupBy("raw").agg(F.min_by("record", "id").alias("__inexact")).withColumnRenamed("raw", "__probe")
        found = exact.join(first, F.col("__raw") == F.col("__probe"), "left").withColumn("record", F.coalesce("record", "__inexact"))
    status = F.lit("Not Found")
    for stored, shown in STATUS_SHOWN.items():
        status = F.when(F.col("record.status") == stored, shown).otherwise(status)
    return found.select(*(f"`{c}`" for c in columns), status.alias("registry_status"), "record")


def mismatches(fields: Column, record: Column, bind=let) -> Column:
    """Issues where the extracted name, birth or expiry date differ from the registered ones.

    Names are equal if one contains the other; an undetected name counts as a name here, as screening always did. Dates
    are compared by their digits alone. No registered row, no issues.
    """
    return bind({"fields": fields, "record": record}, lambda r: _mismatches(r["fields"], r["record"], bind))


def _mismatches(fields: Column, record: Column, bind) -> Column:
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    of = lambda name: blank(F.try_element_at(fields, F.lit(name)))
    read = {
        "name": F.upper(of("Name")), "known_name": F.upper(blank(record["full_name"])), "born": of("Date of Birth"), "known_born": blank(record["dob"]),
        "ends": of("Date of Expiry"), "known_ends": blank(record["expiry_date"]),
    }
    none = F.array().cast("array<struct<field:string,severity:string,message:string>>")
    return F.when(record.isNotNull(), bind(read, _compared)).otherwise(none)


def _compared(r: Column) -> Column:
    name, known = r["name"], r["known_name"]
    differs = (known != "") & (name != "") & (name != NOT_DETECTED) & ~F.contains(name, known) & ~F.contains(known, name)

    def dates(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (a != NOT_DETECTED) & (digits(a) != "") & (digits(b) != "") & (digits(a) != digits(b))

    said = lambda what, a, middle, b: F.concat(F.lit(f"Extracted {what} '"), a, F.lit(f"' {middle} official database record '"), b, F.lit("'."))
    return issues(
        (differs, issue("Name", "error", said("Name", name, "does not match", known))),
        (dates(r["born"], r["known_born"]), issue("Date of Birth", "error", said("DOB", r["born"], "does not match", r["known_born"]))),
        (dates(r["ends"], r["known_ends"]), issue("Date of Expiry", "warning", said("Expiry", r["ends"], "differs from", r["known_ends"]))),
    )

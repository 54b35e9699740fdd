"""Field validation: required fields, number shape, date and stay logic, as arrays of issues."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import Steps, any_date, document_type, let, literal_map, none_if_blank, stay_days, strip, with_date
from papyra.schema import FIELD_FALLBACKS, MAX_STAY, NUMBER_FIELD, NUMBER_SHAPE, REQUIRED_FIELDS


def issue(field: Column | str, severity: str, message: Column) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(severity).alias("severity"), message.alias("message"))


def issues(*found: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(condition, value) for condition, value in found)))


def field_value(fields: Column, name: str) -> Column:
    """A field or the first of its stand-ins that was detected; null if none was."""
    return F.coalesce(*(none_if_blank(F.try_element_at(fields, F.lit(k))) for k in (name, *FIELD_FALLBACKS.get(name, ()))))


def _values(fields: Column):
    """What gives a field's value by its name."""
    return lambda name: field_value(fields, name)


def number_matches(number: Column, kind: Column) -> Column:
    """Whether a number has the shape of its document type (raw label); false without number or known type."""
    return let(F.struct(number.alias("n"), document_type(kind).alias("k")), lambda r: _matches(r["n"], r["k"]))


def _matches(number: Column, key: Column, bind=let) -> Column:
    return bind(F.upper(strip(none_if_blank(number))), lambda value: _shape(value, key))


def _shape(value: Column, key: Column) -> Column:
    shape = F.lit(False)
    for name, pattern in NUMBER_SHAPE.items():
        shape = F.when(key == name, value.rlike(pattern)).otherwise(shape)
    return F.coalesce(shape, F.lit(False))


def expiry(date_text: Column, as_of: datetime.date) -> Column:
    """is_expired and days_until_expiry, both null if the date can't be read."""
    days = F.datediff(any_date(date_text), F.lit(as_of))
    return let(days, lambda n: F.struct((n < 0).alias("is_expired"), n.alias("days_until_expiry")))


def required_fields(fields: Column, kind: Column) -> Column:
    """A warning for each required field that is missing, in the type's order."""
    return let(_with_key(fields, kind), lambda r: _required(_values(r["f"]), r["k"]))


def _with_key(fields: Column, kind: Column) -> Column:
    return F.struct(fields.alias("f"), document_type(kind).alias("k"), kind.alias("kind"))


def _required(value, key: Column) -> Column:
    out = F.array().cast("array<struct<field:string,severity:string,message:string>>")
    for name, required in REQUIRED_FIELDS.items():
        missing = ((F.coalesce(strip(value(f)), F.lit("")) == "", issue(f, "warning", F.lit(f"'{f}' could not be extracted and requires manual review."))) for f in required)
        out = F.when(key == name, issues(*missing)).otherwise(out)
    return out


def number_format(fields: Column, kind: Column) -> Column:
    """A warning if the type's number was detected and has the wrong shape."""
    return let(_with_key(fields, kind), lambda r: _number_format(_values(r["f"]), r["k"], r["kind"]))


def _number_format(of, key: Column, kind: Column, bind=let) -> Column:
    value, name = F.lit(None).cast("string"), F.try_element_at(literal_map(NUMBER_FIELD), key)
    for known, field in NUMBER_FIELD.items():
        value = F.when(key == known, of(field)).otherwise(value)
    message = lambda v: F.concat(F.lit("'"), v, F.lit("' does not match the expected format for "), F.coalesce(kind, F.lit("None")), F.lit(" numbers."))
    return bind(value, lambda v: issues((v.isNotNull() & ~_matches(v, key, bind), issue(name, "warning", message(v)))))


def date_logic(fields: Column, as_of: datetime.date, dates: tuple[Column, Column] | None = None) -> Column:
    """dates: those of birth and expiry, where they were read beforehand. Unreadable dates (warnings); birth in the future, expiry in the past, expiry not after birth (errors)."""
    return let(fields, lambda f: _date_logic(_values(f), as_of, dates))


def _date_logic(value, as_of: datetime.date, dates: tuple[Column, Column] | None, bind=let) -> Column:
    texts = {name: value(field) for name, field in (("born", "Date of Birth"), ("ends", "Date of Expiry"))}
    read = dict(zip(texts, dates, strict=True)) if dates else {n: any_date(t, bind) for n, t in texts.items()}
    return bind({f"{n}_text": t for n, t in texts.items()} | read, lambda r: _date_issues(r["born_text"], r["ends_text"], r["born"], r["ends"], F.lit(as_of)))


def _date_issues(born_text: Column, ends_text: Column, born: Column, ends: Column, today: Column) -> Column:
    unread = lambda text: F.concat(F.lit("'"), text, F.lit("' could not be parsed as a valid date."))
    return issues(
        (born_text.isNotNull() & born.isNull(), issue("Date of Birth", "warning", unread(born_text))),
        (ends_text.isNotNull() & ends.isNull(), issue("Date of Expiry", "warning", unread(ends_text))),
        (born > today, issue("Date of Birth", "error", F.concat(F.lit("Date of birth '"), born_text, F.lit("' is in the future.")))),
        (ends < today, issue("Date of Expiry", "error", F.concat(F.lit("Document expired on "), ends.cast("string"), F.lit(".")))),
        (born >= ends, issue("Date of Expiry", "error", F.lit("Date of expiry is not after date of birth."))),
    )


def stay_limit(entry: Column, bind=let) -> Column:
    """Most days of a stay by entry type: single, double, multiple, or a number of entries."""
    return bind(F.lower(strip(entry)), _stay_limit)


def _stay_limit(key: Column) -> Column:
    count = F.when(key.rlike(r"^\d+$"), F.coalesce(key.try_cast("decimal(38,0)"), F.lit(3).cast("decimal(38,0)")))
    by_count = F.when(count <= 1, MAX_STAY["single"]).when(count == 2, MAX_STAY["double"]).when(count > 2, MAX_STAY["multiple"])
    return F.coalesce(F.try_element_at(literal_map(MAX_STAY), key), by_count)


def cross_fields(fields: Column, kind: Column) -> Column:
    """For visas, an error if the stay is longer than the entry type allows."""
    return let(_with_key(fields, kind), lambda r: _cross_fields(_values(r["f"]), r["k"]))


def _cross_fields(value, key: Column, bind=let) -> Column:
    entry = value("Entry Validation")
    read = {"entry": entry, "days": stay_days(value("Stay Duration")), "most": stay_limit(entry, bind)}
    message = lambda r: F.concat(
        F.lit("Requested stay of "), r["days"].cast("string"), F.lit(" days exceeds the typical maximum of "), r["most"].cast("string"),
        F.lit(" days for a '"), r["entry"], F.lit("' entry visa."),
    )
    return bind(read, lambda r: issues(((key == "visa") & (r["days"] > r["most"]), issue("Stay Duration", "error", message(r)))))


def status_of(found: Column) -> Column:
    """fail with any error, warning with any issue, else pass."""
    return F.when(F.exists(found, lambda x: x["severity"] == "error"), "fail").when(F.size(found) > 0, "warning").otherwise("pass")


def validate(fields: Column, kind: Column, as_of: datetime.date, dates: tuple[Column, Column] | None = None) -> Column:
    """document_type, status and issues of a document's fields (a map); fields that hold a note alone give that as a warning.

    Dates in known forms are read here; for others, see validated.
    """
    return let(_with_key(fields, kind), lambda r: _validate(_values(r["f"]), r["f"], r["k"], r["kind"], as_of, dates))


def _validate(value, fields: Column, key: Column, kind: Column, as_of: datetime.date, dates: tuple[Column, Column] | None, bind=let) -> Column:
    note_only = (F.size(fields) == 1) & F.map_contains_key(fields, F.lit("note"))
    note = F.array(issue("_document_type", "warning", F.try_element_at(fields, F.lit("note"))))
    checks = F.concat(_required(value, key), _number_format(value, key, kind, bind), _date_logic(value, as_of, dates, bind), _cross_fields(value, key, bind))
    found = F.when(note_only, note).otherwise(checks)
    return bind(found, lambda f: F.struct(kind.alias("document_type"), status_of(f).alias("status"), f.alias("issues")))


#: Every field that a rule looks at.
RULED = sorted({f for required in REQUIRED_FIELDS.values() for f in required} | set(NUMBER_FIELD.values()) | {"Date of Birth", "Date of Expiry", "Entry Validation", "Stay Duration"})


def validated(df: DataFrame, as_of: datetime.date, fuzzy: bool = True, fields: str = "fields", kind: str = "document_type") -> DataFrame:
    """df with ``validation``; fuzzy: dates in free form are read too. Steps are columns of their own, which compile."""
    steps = Steps(df)
    names = sorted({n for f in RULED for n in (f, *FIELD_FALLBACKS.get(f, ()))})
    own = steps({n: F.try_element_at(F.col(fields), F.lit(n)) for n in names}, lambda raw: raw)
    own = steps({n: none_if_blank(c) for n, c in own.items()}, lambda known: known)
    value = lambda name: F.coalesce(*(own[n] for n in (name, *FIELD_FALLBACKS.get(name, ()))))
    value = steps({f: value(f) for f in RULED}, lambda v: v).__getitem__
    for name, field in (("__born", "Date of Birth"), ("__ends", "Date of Expiry")):
        steps.df = with_date(steps.df, name, value(field), as_of, fuzzy)
    key = document_type(F.col(kind), steps)
    return steps.ended("validation", steps(key, lambda k: _validate(value, F.col(fields), k, F.col(kind), as_of, (F.col("__born"), F.col("__ends")), steps)))


def summary(validation: Column) -> Column:
    """is_valid, field_errors (the last error of each field) and warnings."""
    return let(validation, _summary)


def _summary(validation: Column) -> Column:
    found = validation["issues"]
    errors = F.filter(found, lambda x: x["severity"] == "error")
    names = F.array_distinct(F.transform(errors, lambda x: x["field"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(errors, lambda x: x["field"] == n), -1)["message"])
    warnings = F.transform(F.filter(found, lambda x: x["severity"] == "warning"), lambda x: x["message"])
    return F.struct((validation["status"] != "fail").alias("is_valid"), F.map_from_arrays(names, last).alias("field_errors"), warnings.alias("warnings"))


def with_mismatches(validation: Column, mismatches: Column, bind=let) -> Column:
    """validation with the registry's mismatches after its issues; any error among those makes it fail."""
    more = F.coalesce(mismatches, F.array().cast("array<struct<field:string,severity:string,message:string>>"))
    failed = lambda m: F.exists(m, lambda x: x["severity"] == "error")
    return bind(
        {"v": validation, "m": more},
        lambda r: F.struct(
            r["v"]["document_type"].alias("document_type"),
            F.when(failed(r["m"]), "fail").otherwise(r["v"]["status"]).alias("status"),
            F.concat(r["v"]["issues"], r["m"]).alias("issues"),
        ),
    )

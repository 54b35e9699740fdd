"""String, number and date expressions with the screening rules' exact semantics."""

from __future__ import annotations

import datetime
import json
import uuid
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.schema import NOT_DETECTED, TYPE_ALIASES

#: White space as text tools outside the JVM see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def let(value: Column | dict[str, Column], f) -> Column:
    """f(value) with value computed once, however often f uses it; keeps expressions of several steps small. A dict is a struct."""
    if isinstance(value, dict):
        value = F.struct(*(v.alias(k) for k, v in value.items()))
    return F.get(F.transform(F.array(value), f), F.lit(0))


class Steps:
    """let() over a table: a value is a column of its own, computed once and in compiled code, and not at all if nothing uses it."""

    def __init__(self, df: DataFrame):
        self.df, self.columns, self.mark = df, df.columns, uuid.uuid4().hex[:8]

    def __call__(self, value: Column | dict[str, Column], f) -> Column:
        values = value if isinstance(value, dict) else {"": value}
        names = {k: f"__{self.mark}_{len(self.df.columns) + i}" for i, k in enumerate(values)}
        self.df = self.df.withColumns({names[k]: v for k, v in values.items()})
        own = {k: F.col(n) for k, n in names.items()}
        return f(own if isinstance(value, dict) else own[""])

    def ended(self, name: str, value: Column) -> DataFrame:
        """The table with value in a column, which takes the place of one of that name, and without the steps."""
        kept = [c for c in self.columns if c != name]
        return self.df.select(*(F.col(f"`{c}`") for c in kept), value.alias(name))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def literal_map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def none_if_blank(c: Column) -> Column:
    """Null for null, empty and the sentinel: the only place where the sentinel becomes null."""
    return F.when((c != "") & (c != NOT_DETECTED), c)


def document_type(c: Column, bind=let) -> Column:
    """The key of a document type; unknown ones pass through, null is empty."""
    key = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), " -", "__")
    return bind(key, lambda k: F.coalesce(F.try_element_at(literal_map(TYPE_ALIASES), k), k))


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores, if it comes from fewer files than that: their row groups would be as few tasks."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or len(df.inputFiles()) >= parts else df.repartition(parts)


def lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"), strip), lambda x: x != "")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def to_int(c: Column) -> Column:
    """Rounded half to even, as an int."""
    return F.bround(c).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def _matched(c: Column, pattern: str, order: str) -> Column:
    """A date from the groups of pattern; order names them: d, m, n (a month's name), Y, y (two digits, 69 is 1969)."""
    part = {name: F.regexp_extract(c, pattern, i + 1) for i, name in enumerate(order)}
    if "n" in part:
        names = {n: str(i + 1) for known in (MONTHS, LONG_MONTHS) for i, n in enumerate(known)}
        month = F.try_element_at(literal_map(names), F.lower(part["n"]))
    else:
        month = part["m"]
    year = part.get("Y")
    if year is None:
        two = part["y"].try_cast("int")
        year = F.when(two >= 69, two + 1900).otherwise(two + 2000).cast("string")
    return F.when(c.rlike(pattern), _date(year, month, part["d"]))


DAY = r"(3[01]|[12]\d|0[1-9]|[1-9])"
MONTH = r"(1[0-2]|0[1-9]|[1-9])"


def plain_date(c: Column, bind=let) -> Column:
    """A date in one of the ten known forms; null otherwise."""
    return bind(F.regexp_replace(strip(c), r"^\.+|\.+$", ""), _plain_date)


def _plain_date(c: Column) -> Column:
    return F.coalesce(
        _matched(c, rf"^{DAY}\s+([A-Za-z]+)\s+(\d{{4}})$", "dnY"),
        _matched(c, rf"^{DAY}-([A-Za-z]+)-(\d{{4}})$", "dnY"),
        _matched(c, rf"^{DAY}/{MONTH}/(\d{{4}})$", "dmY"),
        _matched(c, rf"^{DAY}-{MONTH}-(\d{{4}})$", "dmY"),
        _matched(c, rf"^{DAY}\.{MONTH}\.(\d{{4}})$", "dmY"),
        _matched(c, rf"^{DAY}/{MONTH}/(\d{{2}})$", "dmy"),
        _matched(c, rf"^{DAY}-{MONTH}-(\d{{2}})$", "dmy"),
        _matched(c, rf"^(\d{{4}})-{MONTH}-{DAY}$", "Ymd"),
    )


def fuzzy_date(as_of: datetime.date):
    """An Arrow UDF for what plain_date can't read: day first, words ignored, missing parts from as_of."""
    from dateutil import parser

    start = datetime.datetime.combine(as_of, datetime.time())

    def read(text):
        if text is None:
            return None
        try:
            return parser.parse(text.strip().strip("."), dayfirst=True, fuzzy=True, default=start).date()
        except (ValueError, OverflowError, TypeError):
            return None

    @F.pandas_udf("date")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return run.asNondeterministic()  # keeps the call out of the expressions that use its result


def any_date(c: Column, bind=let) -> Column:
    """A date in one of the known forms, null for the sentinel too."""
    return plain_date(none_if_blank(c), bind)


def with_date(df: DataFrame, name: str, source: Column, as_of: datetime.date, fuzzy: bool = True) -> DataFrame:
    """df with the date of source as a column; only texts in no known form reach Python, and none with fuzzy=False.

    The steps are columns of their own, so that the UDF's input is one plain column.
    """
    steps = Steps(df.withColumn("__said", none_if_blank(source)))
    own = steps.ended(name, plain_date(F.col("__said"), steps))
    if fuzzy:
        own = own.withColumn("__left", F.when(F.col(name).isNull(), F.col("__said"))).withColumn("__read", fuzzy_date(as_of)(F.col("__left")))
        own = own.withColumn(name, F.coalesce(name, "__read"))
    return own.drop("__said", "__left", "__read")


def stay_days(c: Column) -> Column:
    """Days of a stay such as ``3 MONTHS``; null if there is none."""
    value, pattern = none_if_blank(c), r"(?i)(\d+)\s*(day|month|year)s?"
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    return F.regexp_extract(value, pattern, 1).try_cast("long") * F.when(unit == "day", 1).when(unit == "month", 30).when(unit == "year", 365)


def json_string(c: Column) -> Column:
    """A JSON string literal in ASCII, as ledger hashes need it: null is ``null``."""
    plain = c.rlike(r'^[\x20-\x21\x23-\x5b\x5d-\x7e]*\z')
    return F.when(c.isNull(), "null").when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(_escaped(F.when(~plain, c)))


def _escape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else json.dumps(x))


def _escaped(c: Column) -> Column:
    return F.pandas_udf(_escape, "string")(c)

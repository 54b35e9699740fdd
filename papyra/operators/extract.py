"""Fields, confidences and machine-readable zones out of recognised text.

The search for labelled values depends on the order of lines and on offsets of matches, so it runs in one Arrow UDF a
document; everything around it (confidence, merging, flags) is column expressions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import document_type, let, literal_map, spread, to_int
from papyra.schema import GENERIC_FIELDS, LOW_CONFIDENCE, MRZ_COUNTRIES, NOT_DETECTED, NUMBER_ALIASES, PASSPORT_FIELDS, STRENGTHS, VISA_FIELDS

FOUND = "array<struct<field:string,value:string,pieces:array<struct<value:string,strength:string>>>>"
MRZ = "struct<document_type:string,name:string,number:string,nationality:string,born:string,gender:string,ends:string,mrz_raw:string,confidence:double>"

# Labels and shapes that decide what is found.
DATE = r"\b\d{1,2}[\/\-\. ][A-Za-z]{3,9}[\/\-\. ]\d{2,4}\b|\b\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
HEADERS = (
    r"\b(?:issue\s*date|date\s*of\s*issue|issued\s*date|issued\s*on|validity(?:\s*\([^)]*\))?|valid\s*until|valid\s*till|"
    r"valid\s*upto|valid\s*up\s*to|valid\s*to|expiry|exp|dob|date\s*of\s*birth)\b"
)
LABELS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "surname": ((r"surname", r"family\s*name", r"nom"), None),
    "given": ((r"given\s*name\(?s?\)?", r"first\s*name", r"forename", r"prenoms?"), None),
    "full": ((r"names?", r"full\s*name", r"holder(?:'s)?\s*name"), None),
    "gender": ((r"sex", r"gender", r"sexe"), r"\b(m|f|male|female|x)\b"),
    "passport_number": (
        (r"passport\s*no\.?", r"passport\s*number", r"document\s*no\.?", r"doc\s*no\.?", r"passportno"),
        r"\b(?=[A-Za-z0-9]{6,10}\b)(?=.*\d)[A-Za-z0-9]{6,10}\b",
    ),
    "nationality": ((r"nationality", r"citizen(?:ship)?", r"country\s*of\s*issue", r"issuing\s*state"), r"\b[A-Za-z]{3,15}\b"),
    "passport_born": ((r"date\s*of\s*birth", r"\bdob\b", r"birth\s*date", r"date\s*de\s*naissance"), DATE),
    "passport_ends": (
        (r"date\s*of\s*expiry", r"expiry\s*date", r"date\s*of\s*expiration", r"expiration\s*date", r"valid\s*until", r"\bvalidity\b", r"valid\s*to", r"expires", r"\bexp\b"),
        DATE,
    ),
    "visa_number": ((r"visa\s*no\.?", r"visa\s*number"), r"\b(?=[A-Za-z0-9]{6,12}\b)(?=.*\d)[A-Za-z0-9]{6,12}\b"),
    "visa_type": ((r"visa\s*type", r"type\s*of\s*visa", r"category", r"classification", r"\btype\b"), None),
    "entries": ((r"number\s*of\s*entries", r"no\.?\s*of\s*entries", r"entries", r"entry\s*type"), r"\b(single|multiple|double|\d+)\b"),
    "stay": ((r"duration\s*of\s*stay", r"stay\s*duration", r"length\s*of\s*stay", r"period\s*of\s*stay"), r"\d+\s*(?:days?|months?|years?)"),
    "number": (
        (
            r"license\s*no\.?", r"licence\s*no\.?", r"dl\s*no\.?", r"id\s*no\.?", r"card\s*no\.?", r"document\s*no\.?", r"document\s*number",
            r"license\s*number", r"licence\s*number", r"id\s*number",
        ),
        r"\b(?=[A-Za-z0-9\-]{5,20}\b)(?=.*\d)[A-Za-z0-9\-]{5,20}\b",
    ),
    "born": ((r"date\s*of\s*birth", r"\bdob\b", r"birth\s*date", r"born"), DATE),
    "ends": (
        (
            r"date\s*of\s*expiry", r"expiry\s*date", r"expiration\s*date", r"valid\s*until", r"\bexp\b", r"\bvalidity\b", r"validity\s*\(?\s*nt\s*\)?",
            r"validity\s*\(?\s*tr\s*\)?", r"valid\s*till", r"valid\s*upto", r"valid\s*up\s*to", r"valid\s*to", r"valid\s*through", r"expires",
            r"val\.?\s*date", r"val\.?\s*until",
        ),
        DATE,
    ),
}
LOOSE_NUMBERS = (r"\b[A-Z]{2}\d{2}[\s\-]?\d{11,13}\b", r"\b(?=[A-Za-z0-9\-\s]{6,20}\b)(?=.*\d)[A-Z]{1,3}[0-9\-\s]{5,18}\b")
NOT_COUNTRIES = ("date", "birth", "passport", "code", "type")
EDGE = " .:-"
AHEAD = 3

Found = tuple[str, str]
NOTHING: Found = (NOT_DETECTED, "not_found")


@lru_cache(64)
def _compiled(labels: tuple[str, ...], shape: str | None):
    return re.compile(rf"(?:{'|'.join(labels)})\s*[:\-]?\s*(?P<rest>.*)$", re.I), re.compile(shape, re.I) if shape else None


@lru_cache(64)
def _marks(labels: tuple[str, ...]) -> tuple[str, ...]:
    """For each label the letters that it starts with: a line of ASCII without any of them has none of the labels."""
    return tuple(dict.fromkeys(re.match(r"(?:\\b)?([a-z]+?)(?=[a-z]\?|[^a-z?]|$)", x)[1] for x in labels))


class Lines(list):
    """A text's lines, with those in small letters where that is safe, so that most searches for labels needn't begin."""

    def __init__(self, lines: list[str]):
        super().__init__(lines)
        self.small = [x.lower() if x.isascii() else None for x in lines]

    def candidates(self, labels: tuple[str, ...]):
        """Places of the lines that may have a label."""
        marks = _marks(labels)
        return (i for i, x in enumerate(self.small) if x is None or any(m in x for m in marks))


def split_lines(text: str | None) -> list[str]:
    return Lines([x for x in map(str.strip, (text or "").splitlines()) if x])


def _under_header(line: str, label_at: int, hits: list[re.Match]) -> str:
    """Of several values on one line, the one below the label: by its place among the date headers, else by offset."""
    columns = [abs(h.start() - label_at) <= 5 for h in re.finditer(HEADERS, line, re.I)]
    place = columns.index(True) if True in columns else 0
    chosen = hits[place] if place < len(hits) else min(hits, key=lambda h: abs(h.start() - label_at))
    return chosen.group().strip()


def find_labelled(lines: list[str], labels: tuple[str, ...], shape: str | None = None) -> Found:
    """The value that the first line with a label yields, and how: beside the label, or in the next lines."""
    label, value = _compiled(labels, shape)
    for at in lines.candidates(labels) if isinstance(lines, Lines) else range(len(lines)):
        line = lines[at]
        hit = label.search(line)
        if hit is None:
            continue
        beside = hit["rest"].strip(EDGE)
        if value is None:
            if len(beside) >= 2:
                return beside, "direct_match"
            below = lines[at + 1].strip(EDGE) if at + 1 < len(lines) else ""
            if len(below) >= 2:
                return below, "direct_match"
            continue
        if own := value.search(beside):
            return own.group().strip(), "regex_match"
        for candidate in lines[at + 1 : at + 1 + AHEAD]:
            hits = list(value.finditer(candidate.strip(EDGE)))
            if hits:
                return (hits[0].group().strip() if len(hits) == 1 else _under_header(line, hit.start(), hits)), "regex_match"
    return NOTHING


def _entry(field: str, value: str, *pieces: Found) -> dict:
    return {"field": field, "value": value, "pieces": [{"value": v, "strength": s} for v, s in pieces]}


def _name(lines: list[str]) -> dict:
    surname, given = (find_labelled(lines, *LABELS[k]) for k in ("surname", "given"))
    parts = [p for p in (surname, given) if p[0] != NOT_DETECTED] or [find_labelled(lines, *LABELS["full"])]
    return _entry("Name", " ".join(v for v, _ in parts).strip(), *parts)


def _gender(lines: list[str]) -> dict:
    raw = find_labelled(lines, *LABELS["gender"])
    known = {"m": "M", "male": "M", "f": "F", "female": "F"}
    return _entry("Gender", raw[0] if raw == NOTHING else known.get(raw[0].lower(), raw[0].upper()), raw)


def _simple(field: str, lines: list[str], key: str) -> dict:
    found = find_labelled(lines, *LABELS[key])
    return _entry(field, found[0], found)


def passport_entries(text: str) -> list[dict]:
    lines = split_lines(text)
    country = find_labelled(lines, *LABELS["nationality"])
    if any(word in country[0].lower() for word in NOT_COUNTRIES):
        country = NOTHING
    return [
        _name(lines), _simple("Passport Number", lines, "passport_number"), _entry("Nationality", country[0], country),
        _simple("Date of Birth", lines, "passport_born"), _simple("Date of Expiry", lines, "passport_ends"), _gender(lines),
    ]


def visa_entries(text: str) -> list[dict]:
    lines = split_lines(text)
    return [_simple(f, lines, k) for f, k in zip(VISA_FIELDS, ("visa_number", "visa_type", "entries", "stay"), strict=True)]


def _year(value: str) -> int:
    found = re.search(r"\b(?:19|20)\d{2}\b", value)
    return int(found.group()) if found else 0


def generic_entries(text: str) -> list[dict]:
    lines = split_lines(text)
    number = find_labelled(lines, *LABELS["number"])
    if number[0] == NOT_DETECTED:
        loose = next(filter(None, (re.search(p, text) for p in LOOSE_NUMBERS)), None)
        number = (loose.group().strip(), "regex_match") if loose else number
    born, ends = (find_labelled(lines, *LABELS[k]) for k in ("born", "ends"))
    if ends[0] in (NOT_DETECTED, born[0]) or not re.search(r"\d", ends[0]):
        dates = [d for d in dict.fromkeys(m.group().strip() for m in re.finditer(DATE, text, re.I)) if d != born[0]]
        latest = max(dates, key=_year, default="")  # of equal years the first
        if _year(latest) > 2000:
            ends = (latest, "regex_match")
    return [
        _name(lines), _entry("Document Number", number[0], number), _entry("Date of Birth", born[0], born), _entry("Date of Expiry", ends[0], ends),
        _gender(lines), *(_entry(alias, number[0], number) for alias in NUMBER_ALIASES),
    ]


def _labelled(text: pd.Series, kind: pd.Series) -> pd.Series:
    parse = {"passport": passport_entries, "visa": visa_entries}
    fallback = {"passport": PASSPORT_FIELDS, "visa": VISA_FIELDS}

    def one(t, k):
        try:
            return parse.get(k, generic_entries)(t or "")
        except (re.error, RecursionError):
            return [_entry(f, NOT_DETECTED, NOTHING) for f in fallback.get(k, GENERIC_FIELDS)]

    return pd.Series([one(t, k) for t, k in zip(text, kind, strict=True)])


def labelled_fields(text: Column, kind: Column) -> Column:
    """The fields of each text by its document type's key; all but passports and visas are generic."""
    return F.pandas_udf(_labelled, FOUND).asNondeterministic()(text, kind)  # called once, not once for each use of its result


# -- confidence --------------------------------------------------------------------------------------------------


def word_confidence(value: Column, boxes: Column, otherwise: Column) -> Column:
    """Mean confidence of the words of value among the boxes; otherwise if none of them is there."""
    bare = lambda b: F.upper(F.regexp_replace(b["text"], "[^A-Za-z0-9]", ""))

    def mean(tokens):  # no token is empty, so boxes without letters and digits are never among them
        own = F.filter(boxes, lambda b: b["confidence"].isNotNull() & F.array_contains(tokens, bare(b)))
        return let(own, lambda o: F.when(F.size(o) > 0, F.aggregate(o, F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size(o)).otherwise(otherwise))

    return let(F.regexp_extract_all(F.upper(value), F.lit("[A-Za-z0-9]+"), F.lit(0)), mean)


def field_confidence(value: Column, strength: Column, boxes: Column, ocr: Column) -> Column:
    """0 to 100: the words' confidence, less for weaker matches; 0 for what wasn't detected."""
    weight = F.coalesce(F.try_element_at(literal_map(STRENGTHS), strength), F.lit(0.5))
    score = to_int(F.greatest(F.lit(0.0), F.least(F.lit(100.0), word_confidence(value, boxes, ocr) * weight * 100)))
    return F.when((strength == "not_found") | (value == NOT_DETECTED), 0).otherwise(score)


# -- machine-readable zone ---------------------------------------------------------------------------------------

LINE_2 = r"([A-Z0-9]{8,10})\s*([A-Z]{3})?\s*(\d{6,8})\s*\d?\s*([MF<])\s*(\d{6,8})"
FILL = r"(?:(?<=[<A-Z0-9])|(?<!^)\G)s(?=s*(?:[<A-Z0-9]|$))"


def mrz_date(c: Column) -> Column:
    """DDMMYYYY or YYMMDD (below 50 is 20yy) as DD/MM/YYYY; other lengths stay as they are."""
    part = lambda a, n: F.substring(c, a, n)
    century = F.when(part(1, 2) < "50", "20").otherwise("19")
    return (
        F.when(F.length(c) == 8, F.concat_ws("/", part(1, 2), part(3, 2), part(5, 4)))
        .when(F.length(c) == 6, F.concat(part(5, 2), F.lit("/"), part(3, 2), F.lit("/"), century, part(1, 2)))
        .otherwise(c)
    )


def parse_td3(first: Column, second: Column) -> Column:
    """A passport's two lines as a struct; null if neither name nor number is there."""
    clean = lambda c: F.regexp_replace(F.translate(c, "s", "<"), "<+$", "")
    spaced = lambda c: F.trim(F.translate(c, "<", " "))
    raw = F.concat(first, F.lit("\n"), second)

    def names(one: Column) -> Column:
        content = F.when(one.startswith("P<"), F.substring(one, 3, 1 << 20)).otherwise(F.substring(one, 2, 1 << 20))
        return let(F.split(content, "<<"), lambda p: F.struct(spaced(F.get(p, F.lit(0))).alias("surname"), F.coalesce(spaced(F.get(p, F.lit(1))), F.lit("")).alias("given")))

    def named(n: Column) -> Column:
        code = F.substring(n["surname"], 1, 3)
        known = (F.length(n["surname"]) > 3) & code.isin(*MRZ_COUNTRIES)
        surname = F.when(known, F.trim(F.substring(n["surname"], 4, 1 << 20))).otherwise(n["surname"])
        return F.struct(F.trim(F.concat(surname, F.lit(" "), n["given"])).alias("name"), F.when(known, code).alias("code"))

    def numbers(two: Column) -> Column:
        group = lambda i: F.regexp_extract(two, LINE_2, i)
        return F.when(two.rlike(LINE_2), F.struct(*(group(i).alias(f"g{i}") for i in range(1, 6))))

    def zone(r: Column) -> Column:
        n, m, missing = r["n"], r["m"], F.lit(NOT_DETECTED)
        whole = F.struct(
            F.lit("P").alias("document_type"), F.when(n["name"] != "", n["name"]).otherwise(missing).alias("name"), F.coalesce(m["g1"], missing).alias("number"),
            F.coalesce(F.when(m["g2"] != "", m["g2"]), n["code"], missing).alias("nationality"), F.coalesce(mrz_date(m["g3"]), missing).alias("born"),
            F.coalesce(m["g4"], missing).alias("gender"), F.coalesce(mrz_date(m["g5"]), missing).alias("ends"), r["raw"].alias("mrz_raw"), F.lit(0.92).alias("confidence"),
        )
        return F.when((n["name"] != "") | m.isNotNull(), whole)

    n = let(let(clean(first), names), named)
    return let(F.struct(n.alias("n"), let(clean(second), numbers).alias("m"), raw.alias("raw")), zone)


def mrz(text: Column) -> Column:
    """The machine-readable zone of a text, null if there is none.

    Candidates are long lines with fillers or a P or V in front. A line that starts with P goes with one of the next three;
    failing that, the first two neighbours that both have fillers. The first pair that can be read counts.
    """
    found = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: F.regexp_replace(F.trim(x), " ", ""))
    found = F.transform(found, lambda x: F.translate(F.regexp_replace(x, FILL, "<"), "$«()", "<<<<"))
    lines = F.filter(found, lambda x: (F.length(x) >= 25) & (F.contains(x, F.lit("<")) | x.startswith("P") | x.startswith("V")))
    return let(lines, _mrz_of)


def _mrz_of(lines: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(lines))
    line = lambda i: F.try_element_at(lines, i.cast("int"))
    leading = F.filter(at, lambda i: line(i).startswith("P") & (F.length(line(i)) >= 28))
    pair = lambda a, b: F.struct(line(a).alias("a"), line(b).alias("b"))
    near = F.flatten(F.transform(leading, lambda i: F.transform(F.sequence(i + 1, i + 3), lambda j: pair(i, j))))
    near = F.filter(near, lambda p: (F.length(p["b"]) >= 28) & (F.contains(p["b"], F.lit("<")) | p["b"].rlike(r"\d{6}")))
    beside = F.filter(F.transform(at, lambda i: pair(i, i + 1)), lambda p: F.contains(p["a"], F.lit("<")) & F.contains(p["b"], F.lit("<")))
    parsed = F.filter(F.transform(F.concat(near, beside), lambda p: parse_td3(p["a"], p["b"])), lambda m: m.isNotNull())
    return F.when(F.size(lines) > 0, F.get(parsed, F.lit(0)))


MRZ_FIELD = {"Name": "name", "Passport Number": "number", "Nationality": "nationality", "Date of Birth": "born", "Date of Expiry": "ends", "Gender": "gender"}


def extract(df: DataFrame, text: str = "raw_text", kind: str = "document_type", boxes: str | None = "bounding_boxes", ocr: str | None = "ocr_confidence") -> DataFrame:
    """df with fields, field_confidence, low_confidence_fields and mrz_data.

    A passport's machine-readable zone fills fields that were not detected, have a confidence below 88 or one
    character, with confidence 90. Without boxes or confidence the words count as unread (0).
    """
    own_boxes = F.col(boxes) if boxes and boxes in df.columns else F.array().cast("array<struct<text:string,confidence:double>>")
    own_ocr = F.coalesce(F.col(ocr).cast("double"), F.lit(0.0)) if ocr and ocr in df.columns else F.lit(0.0)
    own_boxes = F.coalesce(own_boxes, F.slice(own_boxes, 1, 0), F.array().cast(df.schema[boxes].dataType if boxes and boxes in df.columns else "array<struct<text:string,confidence:double>>"))
    rows = spread(df).withColumn("__found", labelled_fields(F.col(text), document_type(F.col(kind)))).withColumn("mrz_data", mrz(F.col(text)))

    def confidence(entry: Column) -> Column:
        each = F.transform(entry["pieces"], lambda p: field_confidence(p["value"], p["strength"], own_boxes, own_ocr))
        mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)
        return to_int(mean)

    passport = document_type(F.col(kind)) == "passport"
    zone = F.create_map(*(x for f, k in MRZ_FIELD.items() for x in (F.lit(f), F.col("mrz_data")[k])))

    def settled(entry: Column) -> Column:
        own, other = confidence(entry), F.try_element_at(zone, entry["field"])
        better = passport & F.coalesce(other != NOT_DETECTED, F.lit(False)) & ((entry["value"] == NOT_DETECTED) | (own < 88) | (F.length(entry["value"]) < 2))
        return F.struct(entry["field"].alias("field"), F.when(better, other).otherwise(entry["value"]).alias("value"), F.when(better, 90).otherwise(own).alias("confidence"))

    rows = rows.withColumn("__settled", F.transform("__found", settled))
    entry = lambda name: F.map_from_arrays(F.transform("__settled", lambda e: e["field"]), F.transform("__settled", lambda e: e[name]))
    low = F.transform(F.filter("__settled", lambda e: e["confidence"] < LOW_CONFIDENCE), lambda e: e["field"])
    return rows.withColumns({"fields": entry("value"), "field_confidence": entry("confidence"), "low_confidence_fields": low}).drop("__found", "__settled")

"""Risk scoring: four signals to a score, a band, an explanation and the factors behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import Steps, clamp, let, literal_map, strip, to_int
from papyra.schema import BANDS, FACTOR, RISK_LABELS, RISK_WEIGHTS, STATUS_RISK

# Texts that results carry.
STATUS_DETAIL = {
    "valid": "Document number found in the registry with a valid status.",
    "not found": "Document number was not found in the registry.",
    "expired": "Document number is registered but marked expired.",
    "blacklisted": "Document number is registered as BLACKLISTED.",
    "error": "Registry lookup could not be completed.",
}
HEADLINES = {
    "LOW": "Low risk — no significant concerns identified.",
    "MEDIUM": "Medium risk — recommend manual review before proceeding.",
    "HIGH": "High risk — recommend escalation and thorough manual review.",
    "CRITICAL": "Critical risk — recommend rejecting or escalating for investigation.",
}
FLOORED = " Score floored due to a registry blacklist hit, which overrides the weighted average."
NO_DATA = "Insufficient data to compute a reliable risk score — treat as medium risk pending manual review."


def _signal(score: Column, detail: Column, present: Column) -> tuple[Column, Column]:
    """Score and detail, both null for a signal that isn't there; apart, so that details cost nothing where none are asked for."""
    return F.when(present, score.cast("double")), F.when(present, detail)


def validation_risk(status: Column, errors: Column, warnings: Column) -> tuple[Column, Column]:
    """score and detail from a validation's status and its numbers of errors and warnings; null without a status."""
    score = (
        F.when(status == "pass", 0.0)
        .when(status == "warning", F.least(F.lit(100.0), 20.0 + 10.0 * warnings))
        .when(status == "fail", F.least(F.lit(100.0), 60.0 + 15.0 * errors))
        .otherwise(50.0)
    )
    detail = (
        F.when(status == "pass", "All fields validated with no issues.")
        .when(status == "warning", F.concat(warnings.cast("string"), F.lit(" field(s) flagged for manual review.")))
        .when(status == "fail", F.concat(errors.cast("string"), F.lit(" validation error(s), e.g. expired or logically inconsistent dates.")))
        .otherwise("Validation status could not be determined.")
    )
    return _signal(score, detail, status.isNotNull())


def registry_risk(status: Column) -> tuple[Column, Column]:
    key = F.lower(strip(status))
    detail = F.coalesce(F.try_element_at(literal_map(STATUS_DETAIL), key), F.concat(F.lit("Unrecognized registry status '"), status, F.lit("'.")))
    return _signal(F.coalesce(F.try_element_at(literal_map(STATUS_RISK), key), F.lit(50.0)), detail, status != "")


def tampering_risk(score: Column) -> tuple[Column, Column]:
    risk = clamp(score.cast("double"))
    detail = (
        F.when(risk < 30, "No significant signs of tampering detected.")
        .when(risk < 60, "Some tampering indicators present; recommend closer inspection.")
        .otherwise("Multiple strong tampering indicators detected.")
    )
    return _signal(risk, detail, score.isNotNull())


def face_risk(similarity: Column) -> tuple[Column, Column]:
    like = clamp(similarity.cast("double"))
    shown = F.format_string("%.0f", F.bround(like))
    detail = (
        F.when(like >= 70, F.concat(F.lit("Selfie closely matches the document photo ("), shown, F.lit("% similarity).")))
        .when(like >= 50, F.concat(F.lit("Selfie similarity to the document photo is borderline ("), shown, F.lit("%).")))
        .otherwise(F.concat(F.lit("Selfie does not appear to match the document photo ("), shown, F.lit("% similarity).")))
    )
    return _signal(100.0 - like, detail, similarity.isNotNull())


def band(score: Column) -> Column:
    """The band of a score; one that falls between two bands, such as 20.5, is CRITICAL."""
    value = clamp(score)
    out = F.lit("CRITICAL")
    for name, low, high in reversed(BANDS):
        out = F.when(value.between(low, high), name).otherwise(out)
    return out


def recommendation(level: Column, factors: Column) -> Column:
    """The band's headline and up to three factors of a weighted score of 2 or more, which come sorted."""
    headline = F.coalesce(F.try_element_at(literal_map(HEADLINES), level), F.lit(HEADLINES["MEDIUM"]))
    notable = F.slice(F.filter(factors, lambda f: f["weighted_score"] >= 2.0), 1, 3)
    said = F.array_join(F.transform(notable, lambda f: F.concat(f["factor"], F.lit(" — "), f["detail"])), "; ")
    return F.when(F.size(notable) == 0, headline).otherwise(F.concat(headline, F.lit(" Primary contributors: "), said, F.lit(".")))


def risk(status: Column, errors: Column, warnings: Column, registry_status: Column, tampering: Column, similarity: Column, weights: dict[str, float] | None = None) -> Column:
    """risk_score, risk_band, explanation, contributing_factors, excluded_factors, weights_used.

    Signals that are null are left out and the weights of the others scaled up; no signal at all is 50, MEDIUM. Then
    floors: blacklisted 80; similarity under 50, 65; tampering of 30 or more with a failed validation, 55.
    """
    return _risk(let, (status, errors, warnings, registry_status, tampering, similarity), weights or RISK_WEIGHTS)


def with_risk(
    df: DataFrame, name: str, status: Column, errors: Column, warnings: Column, registry_status: Column, tampering: Column, similarity: Column, weights: dict[str, float] | None = None
) -> DataFrame:
    """df with risk() in a column; steps are columns of their own, which compile, where risk() is one interpreted expression."""
    steps = Steps(df)
    return steps.ended(name, _risk(steps, (status, errors, warnings, registry_status, tampering, similarity), weights or RISK_WEIGHTS))


def _risk(bind, inputs: tuple[Column, ...], weights: dict[str, float]) -> Column:
    names = [f"i{n}" for n in range(len(inputs))]
    return bind(dict(zip(names, inputs, strict=True)), lambda i: _signals(bind, *(i[n] for n in names), weights))


def _signals(bind, status: Column, errors: Column, warnings: Column, registry_status: Column, tampering: Column, similarity: Column, weights: dict[str, float]) -> Column:
    signals = {
        "validation": validation_risk(status, errors, warnings),
        "db_status": registry_risk(registry_status),
        "tampering": tampering_risk(tampering),
        "face_match": face_risk(similarity),
    }
    floors = {
        80: F.lower(strip(registry_status)) == "blacklisted",
        65: similarity < 50.0,
        55: (tampering != 0) & (tampering >= 30) & (status == "fail"),
    }
    least = F.coalesce(F.greatest(*(F.when(c, F.lit(v)).otherwise(0) for v, c in floors.items())), F.lit(0))
    parts = {k: v[0] for k, v in signals.items()} | {f"{k}_detail": v[1] for k, v in signals.items()}
    return bind(parts | {"least": least}, lambda s: _weigh(bind, s, weights))


def _weigh(bind, s, weights: dict[str, float]) -> Column:
    """From the signals to their shares and the score, weights added in the signals' order."""
    own = {k: F.when(s[k].isNotNull(), F.lit(float(weights.get(k, 0.0)))).otherwise(F.lit(0.0)) for k in RISK_LABELS}
    total = F.lit(0.0)
    for w in own.values():
        total = total + w

    def shares(total: Column) -> Column:
        used = {k: w / F.when(total == 0, 1.0).otherwise(total) for k, w in own.items()}
        return bind(used, lambda u: _score(bind, s, u))

    return bind(total, shares)


def _score(bind, s, used) -> Column:
    weighted = F.lit(0.0)
    for k in RISK_LABELS:
        weighted = weighted + F.coalesce(s[k] * used[k], F.lit(0.0))
    none = F.lit(True)
    for k in RISK_LABELS:
        none = none & s[k].isNull()
    plain = to_int(clamp(weighted))

    def one(i: int, k: str) -> Column:
        part = s[k] * used[k]
        row = F.struct(
            (-F.bround(part, 1)).alias("down"), F.lit(i).alias("nth"), F.lit(RISK_LABELS[k]).alias("factor"), F.bround(s[k], 1).alias("raw_score"),
            F.bround(used[k], 3).alias("weight"), F.bround(part, 1).alias("weighted_score"), s[f"{k}_detail"].alias("detail"),
        )
        return F.when(s[k].isNotNull(), row)

    names = ("factor", "raw_score", "weight", "weighted_score", "detail")
    rows = F.array(*(one(i, k) for i, k in enumerate(RISK_LABELS)))
    excluded = F.array_compact(F.array(*(F.when(s[k].isNull(), F.lit(k)) for k in RISK_LABELS)))
    kept = F.map_filter(F.create_map(*(x for k in RISK_LABELS for x in (F.lit(k), F.when(s[k].isNotNull(), F.bround(used[k], 3))))), lambda k, v: v.isNotNull())
    step = {"none": none, "plain": plain, "least": s["least"], "rows": rows, "excluded": excluded, "kept": kept}

    def ranked(r) -> Column:
        factors = F.transform(F.sort_array(F.array_compact(r["rows"])), lambda x: F.struct(*(x[n].alias(n) for n in names))).cast(f"array<{FACTOR}>")
        score = F.when(r["none"], F.lit(50)).otherwise(F.greatest(r["plain"], r["least"]))
        return bind({"factors": factors, "score": score}, lambda x: _explained(r, x["score"], x["factors"]))

    return bind(step, ranked)


def _explained(r, score: Column, factors: Column) -> Column:
    level = F.when(r["none"], "MEDIUM").otherwise(band(score))
    labels = F.array_join(F.transform(r["excluded"], lambda k: F.element_at(literal_map(RISK_LABELS), k)), ", ")
    said = F.concat(
        recommendation(level, factors),
        F.when(~r["none"] & (score > r["plain"]), FLOORED).otherwise(""),
        F.when(F.size(r["excluded"]) > 0, F.concat(F.lit(" (No data for: "), labels, F.lit(" — excluded from scoring.)"))).otherwise(""),
    )
    return F.struct(
        score.alias("risk_score"), level.alias("risk_band"), F.when(r["none"], NO_DATA).otherwise(said).alias("explanation"),
        factors.alias("contributing_factors"), r["excluded"].alias("excluded_factors"), r["kept"].alias("weights_used"),
    )


def of_validation(validation: Column) -> tuple[Column, Column, Column]:
    """Status, errors and warnings of a validation struct, as risk takes them."""
    count = lambda severity: F.size(F.filter(validation["issues"], lambda x: x["severity"] == severity))
    return validation["status"], count("error"), count("warning")

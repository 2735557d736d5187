"""Value coercion: what loosely typed model output becomes before it is used."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import strip_space


def clamp01(value: Column, default: float = 0.0) -> Column:
    """A number between 0 and 1; ``default`` for anything that is no number."""
    number = value.try_cast("double")
    return F.when(number.isNull(), F.lit(float(default))).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    )


def coerce_enum(value: Column, members: list[str], default: str | None) -> Column:
    tidy = F.lower(strip_space(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(tidy.isin(members), tidy).otherwise(F.lit(default).cast("string"))


def coerce_confidence(value: Column, default: str = "medium") -> Column:
    return coerce_enum(value, fv.CONFIDENCES, default)


def coerce_bool(value: Column, default: bool = False) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(
        F.lower(strip_space(value.cast("string"))).isin(fv.TRUE_WORDS)
    )


def coerce_int(value: Column, default: int, lo: int | None = None, hi: int | None = None) -> Column:
    """An integer within bounds.

    Text must be a plain integer; JSON numbers may carry a fraction, which is
    dropped, so callers pass those as numbers.
    """
    out = F.coalesce(strip_space(value.cast("string")).try_cast("int"), F.lit(default))
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return out


def coerce_str(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def coerce_str_list(values: Column) -> Column:
    """Trimmed, non-blank items of an array; NULL becomes the empty array."""
    tidy = F.filter(
        F.transform(values, lambda v: strip_space(F.coalesce(v.cast("string"), F.lit("")))),
        lambda v: v != "",
    )
    return F.coalesce(tidy, F.array().cast("array<string>"))


def json_str_list(document: Column, path: str) -> Column:
    """A JSON array of strings, or one string, at ``path`` as a tidy array."""
    raw = F.get_json_object(document, path)
    as_array = F.from_json(raw, "array<string>")
    scalar = F.when(raw.isNotNull() & ~raw.rlike(r"^\s*[\[{]"), F.array(raw))
    return coerce_str_list(F.coalesce(scalar, as_array))


def mode_to_intent(mode: Column, model_intent: Column) -> Column:
    """Model intent if it is a known one; debug and review cannot be talked down."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(fv.MODE_INTENTS.items())])
    prior = F.coalesce(table[mode], F.lit("question"))
    candidate = F.coalesce(coerce_enum(model_intent, fv.INTENTS, None), prior)
    pinned = mode.isin("debug", "change_review") & ~candidate.isin("debugging", "change_review")
    return F.when(pinned, prior).otherwise(candidate)


def parse_iso_ts(value: Column) -> Column:
    return F.try_to_timestamp(F.nullif(value, F.lit("")))


def positive(value: int | None, name: str) -> int | None:
    """A limit that a caller sets: None for no limit, else at least 1."""
    if value is not None and value < 1:
        raise ValueError(f"{name} must be at least 1")
    return value

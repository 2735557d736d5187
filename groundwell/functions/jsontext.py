"""JSON out of model text: fences, prose around the object, trailing commas."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip_space

# fixed value: a fenced block in model output
FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"


def strip_fence(text: Column) -> Column:
    inner = F.regexp_extract(text, FENCE, 1)
    return F.when(text.rlike(FENCE), strip_space(inner)).otherwise(strip_space(text))


def _is_object(text: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))


def _first_object(text: str) -> str | None:
    """The first ``{`` up to its matching ``}``, braces in strings ignored."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted = 0, False
    for token in re.finditer(r'\\.|["{}]', text[start:], re.S):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark == "{":
            depth += 1
        elif not quoted and mark == "}":
            depth -= 1
            if depth == 0:
                return text[start : start + token.end()]
    return None


def _repair(fenced: str | None, raw: str | None) -> str | None:
    if raw is None:
        return None
    snippet = _first_object(fenced or "") or _first_object(raw)
    if snippet is None:
        return None
    for candidate in (snippet, re.sub(r",\s*([}\]])", r"\1", snippet)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        return candidate if isinstance(value, dict) else None
    return None


@F.pandas_udf(StringType())
def _carve(fenced: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([_repair(f, r) for f, r in zip(fenced, raw)], dtype=object)


def extract_json(text: Column) -> Column:
    """JSON text of the object in a model reply, or NULL.

    Replies that are an object after the fence is gone are recognised in the
    JVM; only the others are handed to Python (the rest arrive there as NULL).
    """
    fenced = strip_fence(text)
    ready = _is_object(fenced)
    return F.coalesce(F.when(ready, fenced), _carve(F.when(~ready, fenced), F.when(~ready, text)))

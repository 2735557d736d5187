"""How many rows each query asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def top_k_of(queries: DataFrame) -> Column:
    wanted = F.col("top_k") if "top_k" in queries.columns else F.lit(fv.DEFAULT_TOP_K)
    return F.greatest(F.coalesce(wanted, F.lit(fv.DEFAULT_TOP_K)), F.lit(1)).cast("int")


def largest_top_k(queries: DataFrame) -> int:
    """The most rows that any query asks for; window bounds need it as a literal."""
    if "top_k" not in queries.columns:
        return fv.DEFAULT_TOP_K
    return queries.agg(F.max(top_k_of(queries))).first()[0] or 1

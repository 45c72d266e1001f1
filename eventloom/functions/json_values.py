"""Attributes as JSON text: normal form and trimming."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deepest level kept; most bytes of an event, of a field before it is cut, characters that stay of it.
DEPTH, EVENT_BYTES, FIELD_BYTES, FIELD_CHARS = 8, 256 * 1024, 4096, 1024
TOO_DEEP, CUT = "_observe_truncated", "…[truncated]"


def _normal(v, depth: int):
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if not isinstance(v, dict | list):
        return v
    if depth >= DEPTH:
        return {TOO_DEEP: f"max_depth {DEPTH} exceeded"}
    return {str(k): _normal(x, depth + 1) for k, x in v.items()} if isinstance(v, dict) else [_normal(x, depth + 1) for x in v]


@F.pandas_udf(T.StringType())
def normal_json(texts: pd.Series) -> pd.Series:
    """VAL-4: NaN and infinities are null, what lies deeper than DEPTH levels is a marker, white space goes. Null for what isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(_normal(json.loads(t), 0), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def sorted_json(texts: pd.Series) -> pd.Series:
    """The same JSON with its keys sorted and no white space. Null for what isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def trimmed(df: DataFrame, attributes: str = "attributes", limit: int = EVENT_BYTES) -> DataFrame:
    """VAL-6: where the map of attributes is larger than the limit as JSON, its long values are cut and named in trimmed; what is still too large goes."""
    size = lambda m: F.octet_length(F.to_json(m))
    large = size(F.col(attributes)) > limit
    long = lambda v: F.octet_length(v) > FIELD_BYTES
    cut: Column = F.transform_values(attributes, lambda k, v: F.when(long(v), F.concat(F.substring(v, 1, FIELD_CHARS), F.lit(CUT))).otherwise(v))
    names = F.array_sort(F.map_keys(F.map_filter(attributes, lambda k, v: long(v))))
    out = df.withColumns({"trimmed": F.when(large, names).otherwise(F.array().cast("array<string>")), attributes: F.when(large, cut).otherwise(F.col(attributes))})
    return out.where(F.coalesce(size(F.col(attributes)) <= limit, F.lit(True)))

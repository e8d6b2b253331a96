"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get(c: Column | str, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}")


def text(c: Column | str, key: str) -> Column:
    """A string field that is not blank."""
    v = get(c, key)
    return F.when(F.trim(v) != "", v)


def overlay(base: Column, top: Column) -> Column:
    """Object overlay: keys of ``top`` win and replace whole values; a null ``top`` keeps ``base``."""
    variant = T.MapType(T.StringType(), T.VariantType())
    merged = F.map_concat(F.from_json(F.coalesce(base, F.lit("{}")), variant), F.from_json(top, variant))
    return F.when(top.isNull(), base).otherwise(F.to_json(merged))

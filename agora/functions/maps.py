"""Metadata map access (``map<string,string>`` columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.constants import UNKNOWN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metadata_get(m, key: str, default: str = UNKNOWN) -> Column:
    """``m[key]`` or ``default`` when the key (or the map) is missing."""
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(default))


def metadata_set(m, key: str, value) -> Column:
    """Copy of ``m`` with ``key`` set to ``value`` (replacing any old value)."""
    v = value if isinstance(value, Column) else F.lit(value)
    kept = F.map_filter(F.coalesce(_c(m), F.create_map().cast("map<string,string>")),
                        lambda k, _v: k != F.lit(key))
    return F.map_concat(kept, F.create_map(F.lit(key), v.cast("string")))


def json_to_map(text) -> Column:
    """Flat JSON object text → ``map<string,string>`` (values as text)."""
    return F.from_json(_c(text), "map<string,string>")

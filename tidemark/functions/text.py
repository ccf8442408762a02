"""Text, name, map and JSON helpers as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8_truncate(c: Column | str, n: int) -> Column:
    """Longest prefix of at most ``n`` UTF-8 bytes that ends on a whole character.

    A cut after byte k is clean when byte k+1 starts a character. A character has at
    most four bytes, so one of the last four candidate positions is always clean.
    """
    raw = F.encode(_col(c), "UTF-8")

    def starts_character(position: int) -> Column:
        lead = F.substring(raw, position, 1)
        return (lead < F.lit(b"\x80")) | (lead > F.lit(b"\xbf"))

    cut = F.when(F.octet_length(raw) <= n, F.octet_length(raw))
    for k in range(n, max(n - 4, -1), -1):
        cut = cut.when(starts_character(k + 1), F.lit(k))
    prefix = F.substring(raw, F.lit(1), cut.otherwise(F.lit(0)))
    return F.decode(prefix, "UTF-8")


def build_name(prefix: Column | str, suffix: Column | str) -> Column:
    """``prefix::suffix``; a missing part becomes the text ``None``."""
    none = F.lit("None")
    return F.concat(F.coalesce(_col(prefix), none), F.lit("::"), F.coalesce(_col(suffix), none))


def split_name(c: Column | str) -> Column:
    """Struct of the parts before and after the first ``::``."""
    parts = F.split(_col(c), "::", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("suffix"))


def screen_label(x: Column | str, y: Column | str) -> Column:
    """Histogram key of a screen pair: ``(x, y)``, a missing part shown as ``None``."""
    none = F.lit("None")
    x, y = (F.coalesce(_col(v).cast("string"), none) for v in (x, y))
    return F.concat(F.lit("("), x, F.lit(", "), y, F.lit(")"))


def partition_uri(bucket: Column | str, period: Column | str, file: Column | str) -> Column:
    """``s3://bucket/period/file``."""
    slash = F.lit("/")
    return F.concat(F.lit("s3://"), _col(bucket), slash, _col(period), slash, _col(file))


def split_uri(c: Column | str) -> Column:
    """Struct of everything before the last two path parts, and those two parts."""
    c = _col(c)
    pattern = r"(?s)^(.*)/([^/]*/[^/]*)$"
    return F.struct(
        F.regexp_extract(c, pattern, 1).alias("root"),
        F.regexp_extract(c, pattern, 2).alias("path"),
    )


def name_like(c: Column | str, stem: str) -> Column:
    """Case-blind, unanchored name filter; the last character of ``stem`` may repeat or be absent."""
    return _col(c).rlike(f"(?i){stem}*")


def overlay_maps(*maps: Column | str) -> Column:
    """Merge maps left to right; a later map wins on a shared key, a null map adds nothing."""
    empty = F.create_map().cast("map<string,string>")
    filled = [F.coalesce(_col(m), empty) for m in maps]

    def overlay(a: Column, b: Column) -> Column:
        # a key present on the right wins even when its value is null
        kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
        return F.map_concat(kept, b)

    return reduce(overlay, filled)


def _as_text(c: Column, dtype: T.DataType) -> Column:
    none = F.lit("None")
    if isinstance(dtype, T.StructType):
        return F.struct(*[_as_text(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _as_text(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _as_text(v, dtype.valueType))
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), none).when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.coalesce(c.cast("string"), none)


def stringify_json(df: DataFrame, *keep: str, name: str = "json") -> DataFrame:
    """One JSON text per row with every leaf turned into text; ``keep`` columns stay beside it."""
    leaves = [_as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(*keep, F.to_json(F.struct(*leaves)).alias(name))

"""Text column functions: names, statements, signatures, WAL positions and settings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix of a versioned schema and the whitespace class of statement texts.
VERSION_SUFFIX = r"_api_r[_0-9]+"
STATEMENT_SPACE = r"[ \t\n\r]+"


def proc_base_name(name: Column) -> Column:
    """Procedure name without its argument list."""
    return F.split_part(name, F.lit("("), F.lit(1))


def proc_short_name(name: Column) -> Column:
    """Procedure name with an emptied argument list."""
    return F.regexp_replace(name, r"\(.*\)", "()")


def normalise_query(query: Column) -> Column:
    return F.lower(F.ltrim(F.regexp_replace(query, STATEMENT_SPACE, " ")))


def clip(text: Column, limit: int, suffix: str = "..") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(suffix))).otherwise(text)


def strip_version(schema: Column) -> Column:
    """Schema family: the first version suffix removed, in any letter case."""
    return F.regexp_replace(schema, rf"(?is)^(.*?){VERSION_SUFFIX}", "$1")


def full_name(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", schema, name)


def split_full_name(full: Column) -> tuple[Column, Column]:
    return F.split_part(full, F.lit("."), F.lit(1)), F.split_part(full, F.lit("."), F.lit(2))


def wal_mb(location: Column) -> Column:
    """WAL location ``hi/lo`` (hex) in megabytes, 16 MB per segment; 0 for null or empty."""
    hi = F.split_part(location, F.lit("/"), F.lit(1))
    lo = F.lpad(F.split_part(location, F.lit("/"), F.lit(2)), 8, "0")
    segments = F.conv(F.concat(hi, F.substring(lo, 1, 2)), 16, 10).cast("bigint")
    inside = F.floor(F.conv(F.substring(lo, 3, 6), 16, 10).cast("bigint") / F.lit(1000000))
    mb = F.greatest(segments * 16 + inside - 16, F.lit(0).cast("bigint"))
    return F.when(location.isNull() | (location == ""), F.lit(0).cast("bigint")).otherwise(mb)


def signature(name: Column, types: Column, modes: Column) -> Column:
    """``name(i int, text)``: inputs marked ``i``, output arguments left bare."""
    mode_list = F.split(F.coalesce(modes, F.lit("")), ",")
    args = F.transform(
        F.split(types, ","),
        lambda t, i: F.when(F.try_element_at(mode_list, (i + 1).cast("int")) == "o", t).otherwise(
            F.concat(F.lit("i "), t)
        ),
    )
    return _with_args(name, types, args)


def signature_unmarked(name: Column, types: Column) -> Column:
    """The older form without argument modes."""
    return _with_args(name, types, F.split(types, ","))


def _with_args(name: Column, types: Column, args: Column) -> Column:
    inner = F.when(types.isNull() | (types == ""), F.lit("")).otherwise(F.array_join(args, ", "))
    return F.concat(name, F.lit("("), inner, F.lit(")"))


def query_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash (base 31) over the UTF-16 code units of a text."""
    # the platform's own string hash, in one pass over the text; Spark holds calls by name for not deterministic, so use it in a projection
    return F.when(text.isNotNull(), F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("bigint"))


def settings_map(settings: Column) -> Column:
    return F.from_json(settings, "map<string,int>")


def feature_on(settings: Column, feature: str) -> Column:
    return F.coalesce(F.try_element_at(settings_map(settings), F.lit(feature)) > 0, F.lit(False))


def active_features(settings: Column) -> Column:
    on = F.map_filter(settings_map(settings), lambda _, v: v > 0)
    return F.array_sort(F.map_keys(on))


def update_setting(settings: Column, key: str, value: int) -> Column:
    """Change an existing integer setting inside the JSON text, keeping the layout."""
    quoted = re.escape(key)
    return F.regexp_replace(F.trim(settings), rf'"({quoted})"\s?:\s?\d+', f'"$1": {value}')


def set_setting(settings: Column, key: str, value: int) -> Column:
    """Change a setting, or append it on a line of its own."""
    appended = F.regexp_replace(F.trim(settings), r"(?s)^\{(.*\d)\s*\}$", f'{{$1,\n"{key}": {value}\n}}')
    return F.when(F.contains(settings, F.lit(f'"{key}"')), update_setting(settings, key, value)).otherwise(appended)

"""File names: ids, times and keys that they hold, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def id_by_mission(name: Column) -> Column:
    """The number after "-E-" and a mission."""
    return _id(F.regexp_extract(name, r"[A-Za-z0-9]+-E-([0-9]+)", 1))


def id_by_digits(path: Column) -> Column:
    """The first run of five to eight digits of the base name."""
    return _id(F.regexp_extract(base_name(path), r"([0-9]{5,8})", 1))


def id_before_underscore(path: Column) -> Column:
    """What stands after the last "-" and before the first "_" after it."""
    return _id(F.element_at(F.split(F.element_at(F.split(stem(path), "-"), -1), "_"), 1))


def id_after_dash(path: Column) -> Column:
    """What stands after the last "-"."""
    return _id(F.element_at(F.split(stem(path), "-"), -1))


def id_by_station(path: Column) -> Column:
    """The number after "ISS..-E-", else the first run of five to eight digits."""
    return F.coalesce(_id(F.regexp_extract(base_name(path), r"ISS[0-9]+-E-([0-9]+)", 1)), id_by_digits(path))


RENDER = "render_output_"


def render_time(name: Column) -> Column:
    """The UTC time in a render's file name, or null."""
    text = F.substring_index(F.substring(name, len(RENDER) + 1, 1 << 20), "_L", 1)
    return F.when(name.startswith(RENDER), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH-mm-ss-SSS")))


def _short(value: Column) -> Column:
    """Two decimals at most, one at least, with "-" for the point."""
    return F.replace(F.bround(value, 2).cast("string"), F.lit("."), F.lit("-"))


def render_name(time: Column, lat: Column, lon: Column, alt: Column, yaw: Column, pitch: Column, roll: Column) -> Column:
    parts = [F.concat(F.lit(f"_{k}"), _short(v)) for k, v in zip("LGHYPR", (lat, lon, alt, yaw, pitch, roll), strict=True)]
    return F.concat(F.lit(RENDER), F.date_format(time, "yyyy-MM-dd'T'HH-mm-ss-SSS"), *parts, F.lit(".png"))


def source_key(x: Column, y: Column, decimals: int = 3) -> Column:
    """The key of a grid node: both coordinates with fixed decimals. It keeps negative zero apart, as text.

    A number whose shortest text lies between two keys goes to the one further from zero, whatever its binary value.
    """
    return F.format_string(f"%.{decimals}f|%.{decimals}f", x, y)


def parse_source_key(key: Column) -> Column:
    parts = F.split(key, r"\|")
    return F.struct(F.get(parts, 0).try_cast("double").alias("x"), F.get(parts, 1).try_cast("double").alias("y"))


def safe_fragment(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def sibling(path: Column, suffix: str, other: str) -> Column:
    """``path`` with another ending; null if it doesn't end in ``suffix``."""
    return F.when(path.endswith(suffix), F.concat(F.substring(path, F.lit(1), F.char_length(path) - len(suffix)), F.lit(other)))


def is_image(name: Column, endings: str = "jpe?g") -> Column:
    return name.rlike(rf"(?i)\.({endings})$")


def settings(line: Column) -> Column:
    """struct(key, value) of a "key = value" line, split at the first "=" and trimmed; null without one."""
    at = F.instr(line, "=")
    key, value = F.trim(F.substring(line, F.lit(1), at - 1)), F.trim(F.substring(line, at + 1, F.char_length(line)))
    return F.when(at > 0, F.struct(key.alias("key"), value.alias("value")))

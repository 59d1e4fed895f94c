"""Column builders for tags, identifiers, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres a storey, least derived height, default height, drawing height, and accepted ranges.
STOREY_M, LEAST_LEVELS_M, DEFAULT_M, DRAWN_M = 3.2, 3.0, 10.0, 32.0
HEIGHT_RANGE, LEVELS_RANGE, CAMERA_M = (0.0, 500.0), (0.0, 150.0), 1.7
OVERHEAD = ("roof", "canopy", "carport", "bridge")


def finite(x: Column) -> Column:
    """The number, or null where it is none."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normal_heading(x: Column) -> Column:
    return F.pmod(finite(x), F.lit(360.0)) + F.lit(0.0)  # no negative nought


def _number_and_unit(text: Column) -> tuple[Column, Column]:
    pattern = r"^\s*\+?([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)\s*([a-zA-Z']*)\s*$"
    number = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    return number, F.lower(F.regexp_extract(text, pattern, 2))


def parse_height(text: Column) -> Column:
    """Metres of a height tag: a number with decimal point or comma, and a unit of metres, feet or none."""
    number, unit = _number_and_unit(text)
    metres = F.when(unit.isin("ft", "foot", "feet", "'"), number * 0.3048).when(unit.isin("", "m", "meter", "meters", "metre", "metres"), number)
    return F.when((metres >= HEIGHT_RANGE[0]) & (metres <= HEIGHT_RANGE[1]), metres)


def parse_levels(text: Column) -> Column:
    number, unit = _number_and_unit(text)
    return F.when((unit == "") & (number > LEVELS_RANGE[0]) & (number <= LEVELS_RANGE[1]), number)


def building_height(height: Column, levels: Column) -> tuple[Column, Column, Column]:
    """(height, where it comes from, height to draw) of parsed tags."""
    from_levels = F.greatest(levels * STOREY_M, F.lit(LEAST_LEVELS_M))
    metres = F.coalesce(height, from_levels, F.lit(DEFAULT_M))
    source = F.when(height.isNotNull(), "height").when(levels.isNotNull(), "levels").otherwise("default")
    return metres, source, F.when(height.isNull() & levels.isNull(), F.lit(DRAWN_M)).otherwise(metres)


def bottom_height(min_height: Column, min_level: Column) -> Column:
    return F.coalesce(min_height, min_level * STOREY_M, F.lit(0.0))


def is_building(tag: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return ~value.isin("", "no")


def is_overhead(tag: Column, bottom: Column) -> Column:
    return F.lower(F.trim(F.coalesce(tag, F.lit("")))).isin(*OVERHEAD) | (F.coalesce(bottom, F.lit(0.0)) > CAMERA_M)


def plausible_year(text: Column) -> Column:
    """The first stand-alone year from 1000 to 2099."""
    return F.regexp_extract(text, r"(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])", 1).try_cast("int")


def building_parts(building: Column) -> tuple[Column, Column, Column]:
    """(type, number, parent) of type/number[/part-n]; parent is null unless it is a part."""
    whole = r"^(way|relation)/([0-9]+)(?:/part-[0-9]+)?$"
    number = F.regexp_extract(building, whole, 2).try_cast("long")
    kind = F.nullif(F.regexp_extract(building, whole, 1), F.lit(""))
    parent = F.nullif(F.regexp_extract(building, r"^((?:way|relation)/[0-9]+)/part-[0-9]+$", 1), F.lit(""))
    return kind, number, parent


def month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def date_cutoff_ms(day: str) -> Column:
    return F.unix_millis(F.to_timestamp(F.lit(day)))


def squeezed(text: Column, n: int) -> Column:
    """White space runs as one space, trimmed, at most n characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def enumeration(text: Column) -> Column:
    """A class name without regard to case, spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")


def duration_text(seconds: Column) -> Column:
    """Days and hours, hours and minutes, minutes and seconds, or seconds; "unknown" for null."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    return (
        F.when(s.isNull(), "unknown")
        .when(days > 0, F.format_string("%d d %d h", days, hours % 24))
        .when(hours > 0, F.format_string("%d h %02d min", hours, minutes % 60))
        .when(minutes > 0, F.format_string("%d min %02d s", minutes, s % 60))
        .otherwise(F.format_string("%d s", s))
    )


def canonical_json(value: Column) -> Column:
    """JSON of a struct whose fields are in the order given; maps should come through :func:`sorted_map`."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def canonical_sha256(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)


def camera_up(rx: Column, ry: Column, rz: Column) -> tuple[Column, Column, Column]:
    """The world's up direction in the camera's frame, for an angle-axis rotation from world to camera:
    the rotation of (0, 0, 1), to six decimals."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    safe = F.when(angle > 1e-12, angle)
    kx, ky, kz = rx / safe, ry / safe, rz / safe
    c, s = F.cos(angle), F.sin(angle)
    up = (ky * s + kx * kz * (1 - c), -kx * s + ky * kz * (1 - c), c + kz * kz * (1 - c))
    return tuple(F.bround(F.coalesce(u, F.lit(d)), 6) for u, d in zip(up, (0.0, 0.0, 1.0), strict=True))

"""Column functions: predicates, names, colours, keys, display transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.7

#: Axis names and their aliases -> slot in t, c, z, y, x order.
AXIS_SLOTS = {"t": 0, "time": 0, "c": 1, "channel": 1, "ch": 1, "z": 2, "depth": 2, "y": 3, "x": 4}
#: Space units that are not micrometres -> micrometres.
UNIT_MICROMETRES = {"nanometer": 1e-3, "nanometre": 1e-3, "nm": 1e-3, "millimeter": 1e3, "millimetre": 1e3, "mm": 1e3, "centimeter": 1e4, "centimetre": 1e4, "cm": 1e4, "meter": 1e6, "metre": 1e6, "m": 1e6, "angstrom": 1e-4}
#: Channel colours by position, and label colours by hash.
CHANNEL_COLORS = ("FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF")
LABEL_COLORS = ("#ffbf69", "#5ba7ff", "#52df83", "#ff5c73", "#d67cff", "#4be0d3", "#ffe14d", "#ff9f43")
#: Largest value of each type of pixel.
TYPE_MOST = {"u8": 255.0, "u16": 65535.0, "u32": 4294967295.0}


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def _trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_low_confidence(confidence: Column) -> Column:
    return confidence.isNotNull() & (confidence < LOW_CONFIDENCE)


def track_of(track_id: Column, cell_id: Column) -> Column:
    """The track, or the cell's own id before tracking."""
    return F.coalesce(track_id, cell_id)


def trail_alpha(at: Column, t: int, trail: int, most: float = 1.0, least: float = 0.0, fade: bool = True) -> Column:
    """Linear from ``most`` at t to ``least`` at t - trail, exact at both ends."""
    if not fade or trail <= 0:
        return F.lit(most)
    age = F.lit(t) - at
    return F.when(age <= 0, most).when(age >= trail, least).otherwise(most - (most - least) * age / trail)


def axis_slot(name: Column) -> Column:
    return _lookup(F.lower(_trimmed(name)), AXIS_SLOTS)


def unit_micrometres(unit: Column) -> Column:
    return F.coalesce(_lookup(F.lower(_trimmed(unit)), UNIT_MICROMETRES), F.lit(1.0))


def combine_scales(inner: Column, outer: Column) -> Column:
    """Elementwise product as long as ``inner``; what ``outer`` lacks counts as 1."""
    return F.transform(inner, lambda v, i: v * F.coalesce(F.get(outer, i), F.lit(1.0)))


def channel_name(name: Column, index: Column) -> Column:
    """The stored name, else Channel 1 for index 0 and so on."""
    return F.coalesce(name, F.concat(F.lit("Channel "), (index + 1).cast("string")))


def channel_color(color: Column, index: Column) -> Column:
    """Stored colour upper-cased without leading #, else the cycle of six by index from 0."""
    cycle = F.element_at(F.array(*[F.lit(c) for c in CHANNEL_COLORS]), (F.pmod(index, F.lit(len(CHANNEL_COLORS))) + 1).cast("int"))
    return F.coalesce(F.upper(F.regexp_replace(color, "^#+", "")), cycle)


def channel_window(least: Column, most: Column, start: Column, stop: Column, dtype: Column) -> Column:
    """Struct least, most, start, stop: stored numbers where they are finite, else 0 to the type's largest value, and the window as wide as the limits."""

    def finite(x: Column) -> Column:
        return F.when(F.abs(F.nanvl(x.cast("double"), F.lit(None).cast("double"))) < float("inf"), x.cast("double"))

    low, high = F.coalesce(finite(least), F.lit(0.0)), F.coalesce(finite(most), _lookup(dtype, TYPE_MOST))
    return F.struct(low.alias("least"), high.alias("most"), F.coalesce(finite(start), low).alias("start"), F.coalesce(finite(stop), high).alias("stop"))


def label_name(name: Column) -> Column:
    """Trimmed, null when nothing is left."""
    return F.nullif(_trimmed(name), F.lit(""))


def label_color(color: Column) -> Column:
    """#rrggbb in lower case and trimmed, null for anything else."""
    tidy = _trimmed(color)
    return F.when(tidy.rlike(r"^#[0-9a-fA-F]{6}\z"), F.lower(tidy))


def labels_of_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_of_labels(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.to_json(labels))


def op_scope(op: Column) -> Column:
    return F.coalesce(F.get_json_object(op, "$.scope"), F.get_json_object(op, "$.kind"))


def signed_labels(add: Column, remove: Column) -> Column:
    """``+a, −b``."""
    return F.array_join(F.concat(F.transform(add, lambda x: F.concat(F.lit("+"), x)), F.transform(remove, lambda x: F.concat(F.lit("−"), x))), ", ")


def palette_index(label: Column) -> Column:
    """0 for the background and for what is no id."""
    return F.when(label > 0, F.pmod(F.least(label, F.lit(16777215)) - 1, F.lit(1024))).otherwise(F.lit(0))


def default_label_color(name: Column, colors: int = 8) -> Column:
    """Index of the default colour: h = h * 31 + code modulo 2**32 over the UTF-16 units of the name."""
    units = F.encode(name, "UTF-16BE")
    codes = F.transform(F.sequence(F.lit(1), F.floor(F.length(units) / 2).cast("int")), lambda i: F.conv(F.hex(F.substring(units, 2 * i - 1, F.lit(2))), 16, 10).cast("long"))
    return F.when(F.length(units) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % colors)


def label_hex(name: Column, color: Column) -> Column:
    """The colour a label is drawn with: its own, or the default by its name."""
    return F.coalesce(color, F.element_at(F.array(*[F.lit(c) for c in LABEL_COLORS]), (default_label_color(name, len(LABEL_COLORS)) + 1).cast("int")))


def color_hex(text: Column) -> Column:
    """Numbers from 0 to 1 -> RRGGBB, clamped, rounded half to even; missing ones are 0, further ones are ignored; null if one is no number."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda v: v != "")
    numbers = F.transform(parts, lambda v: v.try_cast("double"))
    three = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(numbers, i), F.lit(0.0)))
    digits = F.transform(three, lambda v: F.lpad(F.hex(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v * 255))).cast("long")), 2, "0"))
    return F.when(text.isNotNull() & ~F.exists(numbers, lambda v: v.isNull() | F.isnan(v)), F.array_join(digits, ""))


#: The ISO forms of a date (calendar and week, extended and basic), a time and an offset.
_DATE = r"^\s*(?:(\d{4})-?(\d{2})-?(\d{2})|(\d{4})-?W(\d{2})(?:-?([1-7]))?)"
_TIME = r"(?:[^\d](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?)?)?\s*$"


def parse_timestamp(text: Column) -> Column:
    """Any ISO form of a date or of a date and time, with or without fractions and offset; null for anything else."""
    form = _DATE + _TIME + _ZONE
    part = [F.nullif(F.regexp_extract(text, form, i), F.lit("")) for i in range(12)]
    fourth = F.make_date(part[4].try_cast("int"), F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    days = (part[5].try_cast("int") - 1) * 7 + F.coalesce(part[6].try_cast("int"), F.lit(1)) - 1
    week = F.when(part[5].try_cast("int").between(1, 53), F.date_format(F.date_add(monday, days), "yyyy-MM-dd"))
    date = F.coalesce(F.concat_ws("-", *[F.when(part[3].isNotNull(), p) for p in part[1:4]]), F.lit(""))
    date = F.when(part[3].isNotNull(), date).otherwise(week)
    time = F.concat(F.coalesce(part[7], F.lit("00")), F.lit(":"), F.coalesce(part[8], F.lit("00")), F.lit(":"), F.coalesce(part[9], F.lit("00")), F.lit("."), F.rpad(F.substring(F.coalesce(part[10], F.lit("0")), 1, 6), 6, "0"))
    zone = F.coalesce(F.regexp_replace(part[11], r"^([+-]\d{2}):?(\d{2})?$", "$1:$2"), F.lit(""))
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    return F.when(text.rlike(form), F.concat(date, F.lit(" "), time, zone).try_cast("timestamp"))


def chunk_key(level: Column, c: Column, t: Column, gz: Column, gy: Column, gx: Column) -> Column:
    return F.concat_ws("/", level, c, t, F.lit(0), gz, gy, gx)


def chunk_key_parts(key: Column) -> Column:
    """Struct level, t, gz, gy, gx; null if the key has another form."""
    form = r"^(\d+)/c/(\d+)/0/(\d+)/(\d+)/(\d+)$"
    parts = F.struct(*[F.regexp_extract(key, form, i + 1).try_cast("long").alias(n) for i, n in enumerate(("level", "t", "gz", "gy", "gx"))])
    return F.when(key.rlike(form), parts)


def grid_size(extent: Column, chunk: Column) -> Column:
    """Chunks along an axis, at least one."""
    return F.greatest(F.lit(1), F.ceil(extent / F.greatest(chunk, F.lit(1))))


def clipped(extent: Column, chunk: Column, index: Column) -> Column:
    """Voxels of chunk ``index`` along an axis, cut at the edge."""
    return F.greatest(F.lit(0), F.least(chunk, extent - index * chunk))


#: Fixed value: the least difference from 1 that a double can hold.
EPSILON = 2.220446049250313e-16


def ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where b is below the machine's epsilon or either is not finite."""
    fine = ~(F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))) & (F.abs(b) >= EPSILON)
    return F.when(fine, F.try_divide(a, b)).otherwise(1.0)


def window_gamma(v: Column, low: float, high: float, gamma: float) -> Column:
    """Display intensity 0 to 1: window, then gamma clamped to 0.2 to 3 (1 if it is not finite)."""
    g = min(3.0, max(0.2, gamma)) if math.isfinite(gamma) else 1.0
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / max(5e-4, high - low))), F.lit(g))

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hz_to_midi(hz: Column) -> Column:
    return 69 + 12 * F.log2(hz / 440.0)


def midi_to_hz(pitch: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (pitch - 69) / 12.0)


def contour_bin(pitch: Column, per_semitone: int = 3, lowest: float = 27.5) -> Column:
    return 12.0 * per_semitone * F.log2(midi_to_hz(pitch) / lowest)


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def micros_per_beat(bpm: Column) -> Column:
    return (F.lit(6e7) / bpm).cast("long")


def u32(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(1 << 32))


def u16(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(1 << 16))


def rgb565(r: Column, g: Column, b: Column) -> Column:
    """Red, green and blue of 0..255 in 16 bits."""
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?<=[a-z0-9])([A-Z])", "_$1"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def camel_to_snake(text: Column) -> Column:
    """Capitals in lower case, each but the first after an underscore."""
    head = F.regexp_extract(text, r"^([^A-Z]*[A-Z]?)", 1)
    rest = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "([A-Z])", "_$1")
    return F.translate(F.concat(head, rest), UPPER, LOWER)


def snake_to_camel(text: Column) -> Column:
    """The first letter and each after an underscore as capitals, without the underscores."""
    return F.array_join(F.transform(F.split(text, "_"), lambda x: F.concat(F.translate(F.substring(x, 1, 1), LOWER, UPPER), F.substring(x, F.lit(2), F.length(x)))), "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[<>:"/\\|?*]', "_")


def short_id(text: Column, width: int = 12) -> Column:
    return F.rpad(F.substring(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")), 1, width), width, "X")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def varlen_hex(value: Column) -> Column:
    """The variable-length bytes of a number as hex; negative numbers count as 0."""
    v = F.greatest(F.lit(0), value).cast("long")
    part = lambda k: F.shiftright(v, 7 * k).bitwiseAND(F.lit(127))
    at = lambda k: F.when(F.shiftright(v, 7 * k) > 0, F.lpad(F.hex(part(k).bitwiseOR(F.lit(128))), 2, "0")).otherwise("")
    return F.concat(at(4), at(3), at(2), at(1), F.lpad(F.hex(part(0)), 2, "0"))

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(n: Column) -> Column:
    return F.format_string("%06d.sst", n)


def file_number(name: Column) -> Column:
    """The number in a valid run name, else null."""
    return F.when(valid_file_name(name), F.regexp_extract(name, r"^([0-9]+)\.sst$", 1).cast("long"))


def valid_file_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[0-9]{6,}\.sst$"), F.lit(False))


def fixed_key(v: Column, size: int = 16) -> Column:
    """A big-endian key of ``size`` bytes."""
    return F.unhex(F.lpad(F.hex(v), 2 * size, "0"))


def fixed_value(seed: Column, seq: Column, size: int = 128) -> Column:
    return F.unhex(F.repeat(F.lpad(F.hex(F.pmod(seed + seq + 13, F.lit(256))), 2, "0"), size))


def base36(x: Column) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, 36))


def positive(ns: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), ns)


def tick_delay(interval: Column, multiplier: Column) -> Column:
    """Ticks of a skewed clock: at least one apart."""
    return F.greatest(F.lit(1).cast("long"), F.round(interval / multiplier).cast("long"))


def clock_multiplier(u: Column) -> Column:
    """A uniform draw scaled to [0.5, 2]."""
    return u * 1.5 + 0.5


def tower_height(u: Column, inverse_p: int = 4, most: int = 16) -> Column:
    """Geometric height of a tower, from a uniform draw in (0, 1]."""
    return F.least(F.lit(most), 1 + F.floor(F.log(u) / F.log(F.lit(1.0 / inverse_p)))).cast("int")


def peers(text: Column) -> Column:
    """Map of a list id=address,...; null where an id is missing, zero, repeated or not a number, or
    an address is empty."""
    parts = F.split(text, ",")
    pair = lambda p: F.split(p, "=", 2)
    good = F.forall(parts, lambda p: p.rlike(r"^\s*[0-9]+=\S+\s*$") & (F.try_to_number(F.trim(pair(p)[0]), F.lit("99999999999999999")) > 0))
    ids = F.transform(parts, lambda p: F.trim(pair(p)[0]).cast("long"))
    unique = F.size(ids) == F.size(F.array_distinct(ids))
    return F.when(good, F.when(unique, F.map_from_arrays(ids, F.transform(parts, lambda p: F.trim(pair(p)[1])))))


def checked_add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def checked_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def is_utc_timestamp(text: Column) -> Column:
    return F.coalesce(text.endswith("Z") & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mixed_seed(seed: Column, node: Column) -> Column:
    """A seed for each (seed, node), order-free."""
    return F.xxhash64(seed, node)


def nibble_encode(data: Column) -> Column:
    """Bytes as a frame: each half byte a symbol 0 to 15, between the frame marks 0xFA and 0xFB."""
    symbols = F.regexp_replace(F.hex(data), "(.)", "0$1")
    return F.unhex(F.concat(F.lit("FA"), symbols, F.lit("FB")))


def nibble_decode(frame: Column) -> Column:
    """The bytes of a complete frame, else null."""
    text = F.hex(frame)
    inner = F.substring(text, F.lit(3), F.greatest(F.length(text) - 4, F.lit(0)))
    return F.when(text.rlike("^FA(0[0-9A-F]0[0-9A-F])*FB$"), F.unhex(F.regexp_replace(inner, "0(.)", "$1")))

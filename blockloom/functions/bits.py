"""Bit fields, identifiers, packed times and pixels as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(x: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(x.cast("long"), shift).bitwiseAND(F.lit(mask).cast("long"))


def hex_id(x: Column) -> Column:
    """Eight upper-case hexadecimal digits."""
    return F.lpad(F.hex(x.cast("long")), 8, "0")


def version(packed: Column) -> Column:
    """major.minor.build.patch from fields of 4, 4, 16 and 8 bits."""
    return F.concat_ws(".", *[field(packed, s, m).cast("string") for s, m in ((28, 15), (24, 15), (8, 65535), (0, 255))])


def version_text(packed: Column, base: Column, flat: Column) -> Column:
    """The version, with the base version in brackets unless that is zero. Where flat, the number is a build count without fields."""
    whole = F.when(base == 0, version(packed)).otherwise(F.concat(version(packed), F.lit(" (base "), version(base), F.lit(")")))
    return F.when(flat, packed.cast("string")).otherwise(whole)


def disc_title(title: Column, number: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(title, F.lit(" (Disc "), number.cast("string"), F.lit("/"), count.cast("string"), F.lit(")"))).otherwise(title)


#: Fixed: the year's mask of the packed time keeps these bits.
DOS_YEAR_MASK = 0xEF


def dos_time(ts: Column) -> Column:
    """A time as 32 packed bits: year from 1980, month, day, hour, minute, and the low five bits of the second."""
    year = (F.year(ts) - 1980).bitwiseAND(F.lit(DOS_YEAR_MASK)).cast("long")
    parts = [F.shiftleft(year, 25), F.shiftleft(F.month(ts).cast("long"), 21), F.shiftleft(F.dayofmonth(ts).cast("long"), 16), F.shiftleft(F.hour(ts).cast("long"), 11), F.shiftleft(F.minute(ts).cast("long"), 5), F.second(ts).cast("long").bitwiseAND(F.lit(31).cast("long"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def spread(x: Column) -> Column:
    """Bits of a 16-bit number moved to the even places."""
    x = x.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(x: Column, y: Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def rgb565(c: Column, replicate: bool) -> list[Column]:
    """Eight-bit channels of a 16-bit colour: spread over 0 to 255 and rounded, or shifted up with low bits zero."""
    out = []
    for shift, bits in ((11, 5), (5, 6), (0, 5)):
        v = field(c, shift, (1 << bits) - 1)
        t = v * 255 + (1 << bits - 1)
        out.append(F.shiftrightunsigned(F.shiftrightunsigned(t, bits) + t, bits) if replicate else F.shiftleft(v, 8 - bits))
    return out


def utf16(text: Column, units: int) -> Column:
    """Big-endian UTF-16 of at most so many units, padded with zeros."""
    return F.rpad(F.substring(F.encode(text, "UTF-16BE"), 1, units * 2), units * 2, F.unhex(F.lit("00")))


def from_utf16(data: Column) -> Column:
    """Text before the first NUL."""
    return F.split_part(F.decode(data, "UTF-16BE"), F.lit("\0"), F.lit(1))

"""Changes to an executable's certificate as column expressions over its bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: the certificate's size, places in it, and the media it may be told to allow.
CERTIFICATE_SIZE, TITLE_AT, TITLE_SIZE, MEDIA_AT = 464, 0x0C, 80, 0x9C
HARD_DISK, MEDIA_BOARD, NONSECURE_HARD_DISK = 0x1, 0x200, 0x40000000


def turned(digits: Column) -> Column:
    """Eight hexadecimal digits, byte by byte from the last."""
    return F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])


def u32_le(content: Column, at: Column) -> Column:
    """The 32-bit number, least byte first, at a place from 0."""
    return F.conv(turned(F.hex(F.substring(content, at.cast("int") + 1, F.lit(4)))), 16, 10).cast("long")


def bytes_le(value: Column) -> Column:
    return F.unhex(turned(F.lpad(F.hex(value), 8, "0")))


def replaced(content: Column, at: Column, new: Column) -> Column:
    return F.overlay(content, new, at.cast("int") + 1)


def certificate_at(content: Column) -> Column:
    """Where the certificate begins; null if the content is no executable or the certificate isn't within it."""
    base, address = u32_le(content, F.lit(0x104)), u32_le(content, F.lit(0x118))
    inside = (F.octet_length(content) >= 0x11C) & (F.hex(F.substring(content, 1, 4)) == "58424548") & (address >= base) & (address - base + CERTIFICATE_SIZE <= F.octet_length(content))
    return F.when(inside, address - base)


def patch_certificate(content: Column, media: Column, title: Column) -> Column:
    """The executable with hard disks and media boards allowed where media is true, and with this title (UTF-16, least byte
    first, cut or filled with zeros to its field) where it isn't null. Null if there is no certificate."""
    at = certificate_at(content)
    allowed = u32_le(content, at + MEDIA_AT).bitwiseOR(F.lit(HARD_DISK | MEDIA_BOARD | NONSECURE_HARD_DISK))
    patched = F.when(media, replaced(content, at + MEDIA_AT, bytes_le(allowed))).otherwise(content)
    field = F.rpad(F.substring(F.encode(title, "UTF-16LE"), 1, TITLE_SIZE), TITLE_SIZE, F.unhex(F.lit("00")))
    return F.when(at.isNotNull(), F.when(title.isNotNull(), replaced(patched, at + TITLE_AT, field)).otherwise(patched))
